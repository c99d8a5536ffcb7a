"""What the README says of accuracy and recall, and the pipeline from end to end against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrolens.llm import bpe, licenses, quality, toxicity
from ferrolens.llm.bytewords import words
from tests.llm.test_operators import lower, shingles
from tests.llm.test_text import brute_hits

FOLDER = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.1")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def area(score, label):
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@tables
@pytest.mark.parametrize(("make", "label", "least"), [(quality.op6_quality, "quality", 0.3), (toxicity.op5_toxicity, "toxic", 0.7)])
def test_held_out_accuracy(spark, make, label, least):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("label")).filter("label is not null")
    got = make(spark, FOLDER).filter("held_out").join(labels, "doc_id").select("score", "label", "predicted").toPandas()
    score, y = got["score"].to_numpy(), got["label"].to_numpy()
    assert len(y) > 300 and set(y) == {0, 1}
    assert ((score >= least).astype(int) == got["predicted"].to_numpy()).all()
    assert area(score, y) >= 0.98
    assert ((score >= least) == (y == 1)).mean() >= 0.95


def test_long_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path()
    library, encoder = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary.read(path))
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(2)
    for word in ("z" * 100_000, "".join(rnd.choices("abcdefgh", k=60_000)), "é" * 700, "ab" * 256, "ab" * 257):
        assert encoder.merged(word) == library.encode(word, add_special_tokens=False).ids
        assert encoder.encode([f"x {word} y"])[0].tolist() == library.encode(f"x {word} y", add_special_tokens=False).ids


def best_alignment(a, b):
    """Matched words of the best local alignment of a with b, by the full table (match 1, mismatch and gap -1)."""
    score, matched, best = np.zeros(len(b) + 1, int), np.zeros(len(b) + 1, int), (0, 0)
    for x in a:
        now, got = np.zeros(len(b) + 1, int), np.zeros(len(b) + 1, int)
        for j in range(1, len(b) + 1):
            same = int(x == b[j - 1])
            now[j], got[j] = max((0, 0), (score[j - 1] + 2 * same - 1, matched[j - 1] + same), (score[j] - 1, matched[j]), (now[j - 1] - 1, got[j - 1]))
            best = max(best, (now[j], got[j]))
        score, matched = now, got
    return best[1]


def test_licenses_against_the_full_alignment_of_all_templates():
    rnd = random.Random(4)
    index = licenses.Index.of(licenses.TEMPLATES)
    fillers = ["pump", "valve", "the", "of", "software", "rights", "license", "copy"]
    texts = []
    for _ in range(12):
        parts = []
        for _ in range(rnd.randrange(3)):
            t = re.findall(r"\S+", licenses.TEMPLATES[rnd.choice(list(licenses.TEMPLATES))])[:60]
            for _ in range(len(t) // 25):  # a few words changed
                t[rnd.randrange(len(t))] = "other"
            parts += [" ".join(rnd.choices(fillers, k=rnd.randrange(6))), " ".join(t)]
        texts.append(" ".join(parts))
    _, found = licenses.scan(pa.array(texts), index, 0.8)
    for text, matches in zip(texts, found, strict=True):
        h = words(pa.array([text]))[0]
        for name, template in zip(index.names, index.words, strict=True):
            share = best_alignment(template, h) / len(template)
            said = max((m["coverage"] for m in matches if m["license"] == name), default=0)
            assert said == pytest.approx(share) if share >= 0.8 else said == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables: nulls, empty, long and repeated texts, ties, and columns with clashing names."""
    rnd = random.Random(9)
    lexicon = ["".join(rnd.choices("abcdeéfgh", k=rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choices(lexicon, k=n))
    base, shared, test = prose(150), prose(60), [prose(30) for _ in range(4)]
    texts = [prose(rnd.randint(5, 200)) for _ in range(40)] + [None, "", " \n", base, base, prose(4000)]
    for _ in range(8):
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(40)} {shared} {prose(40)}" for _ in range(5)] + [f"{prose(10)} {t} {prose(10)}" for t in test]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(20), None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    names = "doc_id long, text string, lang string, source string, n_chars int, score double, node long"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 9 else 0, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(test)] + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, test


def cut_brute(texts):
    """What is left of the texts, in order, when every byte of a 100-byte string that started before goes, and with it halves of characters."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        if not any(gone):
            out.append(t)
            continue
        pieces, at = [], 0
        for m in re.finditer(b"\1+", bytes(gone)):
            pieces.append(b[at : m.start()])
            at = m.end()
        out.append("".join(x.decode("utf-8", "ignore") for x in [*pieces, b[at:]]))
    return out


def test_pipeline(spark, folder):
    import corpus_pipeline as p

    path, test = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, path).cache()
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "tokens" or out.columns == docs.columns)
        kept[name] = (docs.collect(), out.collect())
        docs = out
    before, after = kept["quality"]
    assert set(after) <= set(before) and len(after) > 30
    before, after = kept["near_duplicates"]
    sets = [shingles(r["text"]) for r in before]
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    left = [shingles(r["text"]) for r in after]
    assert set(after) <= set(before) and not any(linked(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(not s or any(linked(s, x) or s == x for x in left) for s in sets)  # these groups are stars, not chains
    assert sum(not s for s in left) == sum(not s for s in sets)
    before, after = kept["repeats"]
    order = sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = {r["doc_id"]: t for r, t in zip(order, cut_brute([r["text"] for r in order]), strict=True) if t == r["text"] or t.strip()}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after if r["n_chars"] is not None)
    before, after = kept["benchmarks"]
    hits = brute_hits([lower(r["text"]) for r in before], [(str(i), t) for i, t in enumerate(test)], 13)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, (n, hit, _) in zip(before, hits, strict=True) if not (hit and 20 * hit >= n)} and len(after) < len(before)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    before, after = kept["tokens"]
    assert len(after) == len(before)
    ids = [c for c in docs.columns if c not in docs.columns[:7]]
    for r in after:
        assert list(r[ids[0]]) == library.encode(r["text"] or "", add_special_tokens=False).ids and r[ids[1]] == len(r[ids[0]])
    assert p.run(spark, path).count() == len(after)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name, columns in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_sequences_are_counted_exactly(spark, monkeypatch):
    """op9's sequences of two and three tokens against plain counting, also dealt out in two steps."""
    from collections import Counter

    from ferrolens.llm import suffixtree as st

    monkeypatch.setattr(st, "RADIX", 2)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(i % 11)) for i in range(60)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    sections = st.sections_of(st.Shelf(spark).put(st.tokenised(frame, 0), "tokens"))
    words = st.count_words(sections, 3)
    states = words.filter("c >= 3")
    for n in (2, 3):
        plain = Counter(tuple(s[i : i + n]) for t in texts for s in [[*(t or "").split(), None]] for i in range(len(s) - n + 1))
        states = st.frequent_sequences(sections, states, n, 3)
        assert sorted(r["c"] for r in states.select("c").collect()) == sorted(c for c in plain.values() if c >= 3)
