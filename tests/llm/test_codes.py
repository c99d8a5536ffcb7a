"""Operators 11 to 13: vector codes by full scans, token counts by the library, fill-in-the-middle by plain slices and SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolens.llm import infill, tokencounts, vectorcodes
from ferrolens.llm.bpe import tokenizer_path
from ferrolens.llm.oracles import SQL

# -- 11: vector codes ------------------------------------------------------------------------------


def full_scan(vectors):
    """Codes, errors and codebooks of integer vectors in order of their ids, all distances measured."""
    x = np.array(vectors, np.int64).reshape(len(vectors), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    for k in range(5):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = d.argmin(-1)
        if k < 4:
            for p in range(4):
                for e in range(books.shape[1]):
                    some = x[code[:, p] == e, p]
                    if len(some):
                        books[p, e] = some.sum(0) // len(some)
    return code, d.min(-1).sum(-1), books


def coded(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return vectorcodes.vector_codes(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize(("n", "width", "spread"), [(700, 12, 0.02), (400, 8, 3.0), (90, 4, 0.001)])
def test_codes_equal_full_scans(spark, n, width, spread):
    r = np.random.default_rng(n)
    centres = r.normal(size=(40, width))
    vectors = (centres[r.integers(0, 40, n)] + spread * r.normal(size=(n, width))).astype(np.float32)
    vectors[n // 2 : n // 2 + 20] = vectors[3]  # copies, and entries that tie
    df, books = coded(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)])
    code, error, want = full_scan(np.floor(1024 * vectors.astype(float)))
    assert (books == want).all()
    got = {r["vec_id"]: (list(r["code"]), r["error"]) for r in df.collect()}
    assert got == {i: (code[i].tolist(), error[i]) for i in range(n)}


def test_bounds_prune_and_stay_right():
    """Bounds of earlier rounds, moved by net displacements, save scans and change no code."""
    r = np.random.default_rng(7)
    x = np.floor(1024 * (r.normal(size=(60, 16))[r.integers(0, 60, 4000)] + 0.03 * r.normal(size=(4000, 16))))
    history, old, measured = [x[:256][None].copy()], None, []
    for _ in range(5):
        books = vectorcodes.Codebooks(np.stack(history))
        old, n = vectorcodes.assign(x, 0, books, old)
        measured.append(n / len(x) / 256)
        d = ((x[:, None] - history[-1][0]) ** 2).sum(-1)
        assert (old.code == d.argmin(1)).all()
        new = history[-1].copy()
        for e in np.unique(old.code):
            new[0, e] = np.floor(x[old.code == e].mean(0))
        history.append(new)
        # every lower bound holds: no other entry of the group is nearer
        for g, group in enumerate(books.groups):
            other = np.where(group[None] == old.code[:, None], np.inf, d[:, group]).min(1)
            valid = old.lower[:, g] - books.farthest[old.lower_round[:, g], 0, g]
            assert (valid <= np.sqrt(other) + 1e-6).all()
    assert measured[0] == 1 and measured[-1] < 0.5
    assert (books.moved[0, 0] <= np.sqrt(((np.diff(books.history[:, 0], axis=0)) ** 2).sum(-1)).sum(0) + 1e-9).all()


def test_vectors_that_go_and_odd_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 4, 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], None), (4, [nan] * 4, 2), (5, [inf, 0.0, 0.0, 0.0], 2), (None, [-0.5, 0.25], None), (7, [], None), (1, [1.0] * 4, 1)]
    df, books = coded(spark, rows)
    assert books.shape == (4, 4, 1)
    got = sorted((str(r["vec_id"]), r["label"], list(r["code"]), r["error"]) for r in df.collect())
    assert got == sorted([("1", 1, [0] * 4, 0), ("1", 1, [0] * 4, 0), ("None", None, [3, 3, 2, 2], 0), ("7", None, [2] * 4, 0)])
    assert books[0, :, 0].tolist() == [1024, 1024, 0, -512]


def test_no_vectors_at_all(spark):
    df, books = coded(spark, [], "vec_id long, embedding array<float>, label int")
    assert df.collect() == [] and df.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    df, _ = coded(spark, [(1, None, 1)])
    assert df.collect() == []


def test_clashing_columns_and_ranges(spark):
    df, _ = coded(spark, [(1, [1.0] * 4, "x", 2)], "vec_id long, embedding array<double>, code string, Error int")
    assert df.columns == ["vec_id", "code", "Error", "code_1", "error_1"]
    with pytest.raises(ValueError, match="not exact"):
        coded(spark, [(1, [1e12] * 4, 1)])


def test_codes_equal_sql(spark, tmp_path):
    """Repeated ids, null labels, dropped vectors, against the query's SQL."""
    r = random.Random(3)
    rows = [(i // 2 if i % 9 else None, [round(r.gauss(0, 1), 3) for _ in range(8)] if i % 13 else None, r.choice([None, 1, 2])) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vectorcodes.op11_vectorcodes(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["op11_vectorcodes"]).fetchall()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


# -- 12: token counts ------------------------------------------------------------------------------

MODEL = "piece_bpe_32k.model"
ODD = [None, "", " ", "  a", "a\tb\n\nc", "<s>x</s> <unk> <0x41>", "▁a ▁", "한국어 테스트 문장", "ﬁ Ａ é é", "a\x00b", "😀😀 ", " " * 70 + "x" + " " * 33, "a" * 5000, "ab" * 3000, "日本語のテキスト", "‮​"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    return lambda text: len(held.encode(text or ""))


def test_counts_equal_the_library(spark, library):
    r = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "ing", "▁", "é", "한", "\n", "1", "Ａ", "the", "er", ".", "00", "😀", "'s"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.count_tokens(df, tokenizer_path(MODEL)).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}


def test_counts_when_known_parts_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "KNOWN_PARTS", 3)
    counter = tokencounts.Counter(tokencounts.Pieces.read(tokenizer_path(MODEL)))
    texts = [f"number {i} of many words" for i in range(50)]
    assert counter(texts).tolist() == [library(t) for t in texts]


def test_merges_go_by_rank_then_from_the_left():
    rank = {"aa": 5, "ab": 1, "aab": 3, "a": 9, "b": 9}
    assert tokencounts.count_merges("aab", rank) == 2  # ab first, then aab
    assert tokencounts.count_merges("aaa", rank) == 1
    assert tokencounts.count_merges("b", rank) == 0
    assert tokencounts.count_merges("aaaa", {"aa": 1, "aaaa": 1, "aaa": 1}) == 3


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError, match="only BPE"):
        tokencounts.Pieces.read(str(path))


def test_counts_of_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, N_tokens int")
    out = tokencounts.count_tokens(df, tokenizer_path(MODEL))
    assert out.columns == ["text", "N_tokens", "n_tokens_1"] and out.collect() == []


# -- 13: fill-in-the-middle ------------------------------------------------------------------------


def plainly(doc_id, text):
    """The contract, by slices."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def documents():
    r = random.Random(5)
    letters = ["a", "b ", "é", "한", "😀", "\n", "<", ">", "P", "S", "M", "é", "\x00"]
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(400)]
    mixed = "".join(r.choice("ab") * r.randint(1, 400) + r.choice("한é😀") * r.randint(1, 400) for _ in range(60))
    return [(i, t) for i, t in enumerate([None, "", "x", "<P>", "a<S>b", mixed, mixed[::-1], "한" * 5000, *made])] + [(None, "no id"), (7, "again"), (7, "again")]


def test_fill_in_middle_by_slices(spark):
    rows = documents()
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(key((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out) == sorted(key((i, *plainly(i, t))) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_the_index_is_exact_within_its_bound():
    r = np.random.default_rng(2)
    width = np.concatenate([r.integers(1, 5, 3000), np.ones(5000, int), np.full(4000, 3), r.choice([1, 4], 9000, p=[0.9, 0.1])])
    boundaries = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    index = infill.RankIndex.fit(boundaries, np.array([0]), np.array([len(boundaries)]))
    assert (index(np.arange(len(boundaries))) == boundaries).all()
    assert np.abs(index.residuals).max() <= infill.ERROR + 1 and 2 < len(index.ranks) < 400
    plain = infill.RankIndex.fit(np.arange(10_001), np.array([0]), np.array([10_001]))
    assert len(plain.ranks) == 1 and not plain.residuals.any()


def test_fill_in_middle_equals_sql(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = infill.op13_infill(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op13_infill"]).fetchall()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest() for r in got for t in [dict(documents()).get(r["doc_id"]) or ""] if r["doc_id"] not in (None, 7))


def test_fill_in_middle_of_empty_tables_and_clashing_columns(spark):
    out = infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string, N int, output string"))
    assert out.columns == ["doc_id", "text", "N", "output", "n_1", "form", "prefix_chars", "middle_chars", "output_1"] and out.collect() == []


# -- long words ------------------------------------------------------------------------------------


def test_long_words_that_collide_in_a_polynomial_differ():
    """The words that follow the Thue-Morse order of ab and of ba share every polynomial hash modulo 2**64 from 1,024 letters on."""
    import pyarrow as pa

    from ferrolens.llm.bytewords import words

    for n in (256, 1024, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        b = "".join("ba"[bin(i).count("1") % 2] for i in range(n))
        h, *_ = words(pa.array([a, b, f"x {a}", a.upper()]))
        assert h[0] == h[3] == h[4] and h[0] != h[1]


def test_long_colliding_words_in_decontamination(spark):
    from ferrolens.llm import decontamination

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    found = decontamination.contamination(docs, items)
    assert {r["doc_id"]: r[found.columns[-3]] for r in found.collect()} == {1: 1, 2: 0}


# -- pages: forms, comments, anchors ---------------------------------------------------------------


def main(html):
    from ferrolens.llm.pages import Page

    return Page(html).text({})[0]


def test_a_form_around_the_page_keeps_it():
    assert main("<form id='aspnetForm'><div><article><h1>T</h1><p>Body text here.</p></article></div></form>") == "T\n\nBody text here."
    assert main("<form><main><p>Body</p></main></form>") == "Body"
    assert main("<body><form><div class=nav>menu</div><div><p>Body text here and more of it.</p></div></form></body>") == "Body text here and more of it."
    assert main("<body><p>Long text of the page that matters.</p><form>Login <p>here</p></form></body>") == "Long text of the page that matters."
    assert main("<article><p>Body</p><form><p>Subscribe to a much longer text than the body is</p></form></article>") == "Body"


@pytest.mark.parametrize("name", "disqus_thread user-comments reader-comments commentlist fb-comments entry-comments comments-title cookieConsent cookie-law-info-bar googleAd related-articles side-bar breadcrumb-trail ad-slot".split())
def test_furniture_goes(name):
    assert main(f"<body><div><p>Body</p></div><div class='{name}'><p>gone</p></div></body>") == "Body"


@pytest.mark.parametrize("name", "no-comments has-sidebar share-price post-content adhoc read heading load shadow related-work comments-open".split())
def test_prose_stays(name):
    assert main(f"<body><div class='{name}'><p>kept</p></div></body>") == "kept"


def test_sections_with_common_ids_stay():
    html = "<article><h1>T</h1><section id='social'><p>one</p></section><section id='notice'><p>two</p></section><section id='comments'><p>x</p></section></article>"
    assert main(html) == "T\n\none\n\ntwo"


def test_templates_of_many_entries_are_joined_by_salt(spark, monkeypatch):
    from ferrolens.llm import pages

    keyed = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 2), (None, 3)], "host string, c0 long")
    templates = spark.createDataFrame([("a", [(1, 0.5)]), ("b", [(2, 1.0), (3, 1.0)])], "host string, template array<struct<hash: long, share: double>>")
    want = sorted(map(str, pages.with_templates(keyed, templates).select("host", "c0", "template").collect()))
    monkeypatch.setattr(pages, "MOST_ENTRIES", 1)
    assert sorted(map(str, pages.with_templates(keyed, templates).select("host", "c0", "template").collect())) == want


# -- 9: contexts, divergence and back-off weights ---------------------------------------------------


def plain_tree(texts, depth):
    """Contexts (tokens -> back-off weight) and continuations (tokens -> log10 probability), by dictionaries."""
    from collections import Counter
    from math import log, log10, sqrt

    streams = [[*t.split(), "END"] for t in texts]
    counts = {n: Counter(tuple(s[i : i + n]) for s in streams for i in range(len(s) - n + 1)) for n in range(1, depth + 2)}
    total, distinct = sum(counts[1].values()), len(counts[1])
    p = {w: (c + 1) / (total + distinct + 1) for w, c in counts[1].items() if c >= 3}
    contexts, continuations, passed = {}, {}, 0
    for n in range(2, depth + 2):
        frequent = {s: c for s, c in counts[n].items() if c >= 3}
        groups = {}
        for s, c in frequent.items():
            groups.setdefault(s[:-1], []).append((s, c))
        here = {}
        for context, some in groups.items():
            c_context = counts[n - 1][context]
            shares = [(s, (c - 0.5) / c_context, p[s[1:]]) for s, c in some]
            below, rest = min(sum(b for *_, b in shares), 1 - 1e-9), max(1 - sum(h for _, h, _ in shares), 1e-9)
            free = 1 - below
            divergence = sum(h * log(h / b) for _, h, b in shares) + rest * log(rest / free)
            kept = 2 * c_context * divergence > len(some) + 4 * sqrt(2 * len(some)) + 10
            passed += not kept
            if kept:
                contexts[context] = log10(rest / free)
            for s, h, b in shares:
                here[s] = h if kept else b
                if kept:
                    continuations[s] = log10(h)
        p = here
    return contexts, continuations, passed


def test_contexts_divergence_and_weights_by_brute_force(spark):
    import pyarrow as pa

    from ferrolens.llm import suffixtree
    from ferrolens.llm.bytewords import INK_BYTE, words

    r = random.Random(6)
    texts = []
    for _ in range(500):
        w = [r.choice("abcdefgh")]
        for _ in range(r.randint(3, 14)):  # mostly a chain, some of it three words long, else noise
            after = {"a": "b", "b": "c", "c": "d"}.get(w[-1])
            after = "x" if w[-2:] == ["b", "c"] and r.random() < 0.8 else after
            w.append(after if after and r.random() < 0.8 else r.choice("abcdefgh"))
        texts.append(" ".join(w))
    tree, _ = suffixtree.suffix_tree(spark.createDataFrame([(t,) for t in texts], "text string"), depth=3)
    contexts, continuations, passed = plain_tree(texts, 3)
    names = sorted({w for t in texts for w in t.split()})
    h, *_ = words(pa.array(names), INK_BYTE)
    single = dict(zip(names, h, strict=True)) | {"END": suffixtree.END}

    def key(s):
        return single[s[0]] if len(s) == 1 else suffixtree.pair_key(np.array([key(s[:-1])]), np.array([key(s[1:])]))[0]

    got_contexts = [{int(k): float(v) for k, v in zip(*level, strict=True)} for level in tree.whole.contexts]
    got_continuations = [{int(k): float(v) for k, v in zip(*level, strict=True)} for level in tree.whole.continuations]
    for n in range(1, 4):
        assert got_contexts[n - 1] == pytest.approx({int(key(s)): w for s, w in contexts.items() if len(s) == n}, abs=1e-5)
        assert got_continuations[n - 1] == pytest.approx({int(key(s)): w for s, w in continuations.items() if len(s) == n + 1}, abs=1e-5)
    assert passed > 20 and {len(s) for s in contexts} >= {1, 2}  # the test keeps some and drops some
