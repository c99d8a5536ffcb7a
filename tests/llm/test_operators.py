"""The corpus operators on small tables, against brute force: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from ferrolens.llm import bpe, decontamination, ftrl, jaccardjoin, licenses, media, pages, quality, suffixdedup, suffixtree, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "and", *("".join(rnd.choice(["ra", "to", "mi", "né", "ß", "lu"]) for _ in range(rnd.randint(1, 4))) for _ in range(60))]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = prose(120)
    texts = [prose(rnd.randint(1, 80)) for _ in range(30)] + [None, "", " \n", "x", base, base, prose(3000), "ab" * 400]
    for _ in range(12):  # near copies
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(20) + " " + base[:300] + " " + prose(9) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[5], out[5], (7, "another text of the same id"), (None, base), (None, None)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1.5, "x", i) for i, t in rows], "doc_id long, text string, score double, `n0` string, row long").repartition(3).cache()


def test_classifiers_and_clashing_names(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(40)] + [(None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    assert scored.columns == [*docs.columns, "score_1"] and scored.count() == docs.count()
    assert scored.filter("score_1 is null or score_1 < 0 or score_1 > 1").count() == 0
    empty = docs.limit(0)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.train_quality(empty, labels.limit(0))
    chars = toxicity.character_model(toxicity.count_characters(docs))
    weights = toxicity.train_toxicity(docs, labels, chars)
    done = toxicity.score_toxicity(docs, chars, weights).collect()
    by_text = {}
    for r in done:
        assert 0 <= r["score_1"] <= 1 and by_text.setdefault(r["text"] or "", r["score_1"]) == r["score_1"]
    assert toxicity.restore_text(docs, chars).filter("text is null and restored != ''").count() == 0


def test_ftrl_separates():
    import numpy as np

    rnd = np.random.default_rng(1)
    labels = rnd.integers(0, 2, 400)
    data = [(np.array([0, 1 + y, 3 + int(rnd.integers(0, 5))]), np.ones(3)) for y in labels]
    weights, bias = ftrl.Ftrl(l1=0.1).fit(data, labels.tolist(), 8)
    right = [(weights[i] @ x + bias > 0) == y for (i, x), y in zip(data, labels, strict=True)]
    assert np.mean(right) == 1.0


def test_bpe_operators(docs):
    path = bpe.tokenizer_path()
    coded = bpe.encode_bpe(docs, path)
    assert coded.columns == [*docs.columns, "ids"]
    once = bpe.roundtrip_bpe(docs, path).withColumn("again", bpe.encode_bpe(docs, path).schema and F.col("decoded"))
    assert once.filter("decoded is null").count() == 0
    back = bpe.decode_bpe(coded, path)
    pairs = {r["text"]: r["decoded"] for r in back.collect()}
    assert pairs == {r["text"]: r["decoded"] for r in once.collect()}
    words = bpe.decode_bpe(coded, path, words=True).filter("doc_id = 3").first()
    assert words["decoded"].split() == bpe.Encoder(bpe.Vocabulary.read(path)).plain(words["text"])


def test_media_round_trip(spark, docs, tmp_path):
    folder = str(tmp_path / "media")
    made = media.store_media(docs, folder).collect()
    assert sum(r["members"] for r in made) == docs.count()
    read = media.media_features(media.read_media(spark, folder, rangeBytes="700")).collect()
    want = Counter()
    for r in docs.collect():
        b = (r["text"] or "").encode()
        padded = media.pad(b)
        want[None if r["doc_id"] is None else str(r["doc_id"]), len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((r["key"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in read) == want
    # one damaged member: all others still come, and it is told by its offset
    path = made[0]["path"]
    data = bytearray(open(path, "rb").read())
    with open(path, "rb") as f:
        member = media.directory(f, len(data))[0]
    data[member.offset + 60] ^= 255
    open(path, "wb").write(data)
    found = media.read_media(spark, folder, mode="permissive", retries="1").collect()
    assert len(found) == docs.count() and [r["attempts"] for r in found if r["error"]] == [2]
    with pytest.raises(Exception, match="damaged"):
        media.read_media(spark, folder, retries="0").collect()
    assert media.read_media(spark, str(tmp_path / "none")).count() == 0
    assert isinstance(media._open(str(tmp_path))[0], pafs.FileSystem)


def test_retries_read_a_member_again(tmp_path, monkeypatch):
    with open(tmp_path / "a.zip", "wb") as f:
        w = media.ArchiveWriter(f)
        w.add("0/1", media.png(media.pad(b"abc"), "3"))
        w.close()
    reader = media.MediaReader({"path": str(tmp_path)})
    real, failures = media.read_member, iter([OSError("lost"), OSError("lost")])

    def flaky(source, member):
        for e in failures:
            raise e
        return real(source, member)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["key"], r["n_bytes"], r["attempts"]) for r in rows] == [("1", 3, 3)]


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("hub", "parts"), [(1000, 18), (3, 1)])  # without and with hubs and components verified by buckets
def test_jaccard_join(spark, docs, rows, monkeypatch, hub, parts):
    monkeypatch.setattr(jaccardjoin, "PART", 4)  # several parts of one component
    monkeypatch.setattr(jaccardjoin, "HUB", hub)
    monkeypatch.setattr(jaccardjoin, "MOST_PARTS", parts)
    if hub < 1000:
        monkeypatch.setattr(jaccardjoin, "hub_limit", lambda spark, rows: 3)
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    n = [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    cluster = list(range(len(sets)))
    for _ in sets:
        cluster = [min([cluster[i], *(cluster[j] for j, b in enumerate(sets) if linked(a, b))]) for i, a in enumerate(sets)]
    least = lambda who: min((rows[j][0] for j in who if rows[j][0] is not None), default=None)
    want = Counter()
    for i, (k, _) in enumerate(rows):
        same = [j for j, s in enumerate(sets) if s == sets[i]] if sets[i] else [i]
        want[k, least(same), n[i], least([j for j, c in enumerate(cluster) if c == cluster[i]])] += 1
    got = jaccardjoin.jaccard_join(docs).collect()
    assert Counter((r["id"], r["class_id"], r["n_links"], r["cluster_id"]) for r in got) == want
    kept = jaccardjoin.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    full = [i for i, s in enumerate(sets) if s]
    assert len(left) == len({cluster[i] for i in full}) + len(sets) - len(full)
    assert jaccardjoin.jaccard_join(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, width = jaccardjoin.plan_bands(threshold, recall)
        assert 1 - (1 - threshold**width) ** bands >= recall and bands * width <= 120


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, rows, docs, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    done = suffixdedup.remove_repeats(docs)
    assert done.columns == [*docs.columns, "spans", "kept"]
    ordered = done.withColumn("h", F.xxhash64("text")).collect()
    ordered.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], len(r["spans"])))
    seen = set()
    for r in ordered:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        assert [(s["start"], s["end"]) for s in r["spans"]] == runs
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0
    cut = suffixdedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.filter("text like '%�%'").count() == 0


def test_decontamination_blocks(spark, docs, rows):
    items = spark.createDataFrame([("b", rows[0][1]), ("a", None), ("9", ""), ("c", "x"), *((str(i), t[:90]) for i, t in rows if t and len(t) > 400)], "item_id string, text string")
    one = decontamination.contamination(docs, items, window=5)
    assert one.columns == [*docs.columns, "n_words", "n_hit", "items", "spans"]
    many = decontamination.contamination(docs, items, window=5, block_words=30)
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["n_words"], r["n_hit"], r["items"], [tuple(s)[:2] for s in r["spans"]])
    a, b = sorted(map(key, one.collect())), sorted(map(key, many.collect()))
    assert len(a) == docs.count() and sum(x[3] for x in a) > 0
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    none = decontamination.contamination(docs, items.limit(0)).agg(F.sum("n_hit"), F.max(F.size("items"))).first()
    assert tuple(none) == (0, 0)


def test_suffix_tree(spark, rows, docs):
    texts = docs.select("text")
    tree, counts = suffixtree.suffix_tree(texts, rate=1e-3, word_rate=5e-3)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in rows]
    c = Counter(x for w in tokens for x in w)
    total = sum(c.values())
    assert (tree.total, tree.distinct) == (total, len(c))
    assert any(len(k) for k, _ in tree.contexts)
    held = spark.createDataFrame([(1, "the of unseen and"), (2, None), (3, "")], "id long, text string")
    for r in suffixtree.score_texts(held, tree, counts).collect():
        w = [*"the of unseen and".split(), None] if r["id"] == 1 else [None]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(log10((c[x] + 1) / (total + len(c) + 1)) for x in w))
    # in every state the words' probabilities add up to 1
    vocabulary = [x for x in c if x is not None]
    for context in ("the", "the of", "changed", " ".join(t for t in (rows[0][1] or "a b").split()[:2])):
        n = len(context.split())
        frame = spark.createDataFrame([(i, f"{context} {x}") for i, x in enumerate([*vocabulary, "\u0001unseen"])] + [(-1, context)], "id long, text string")
        # the score of "context x" without its end token is the score up to x
        scores = state_probabilities(tree, counts, frame, n)
        assert sum(scores) == pytest.approx(1.0, abs=1e-6)


def test_suffix_tree_keeps_what_a_large_corpus_dilutes(spark):
    """A context of 14 occurrences stays in the tree among 3 million other tokens, and scoring meets it."""
    import pyarrow as pa

    filler = spark.range(0, 500, 1, 4).select(F.repeat(F.concat(F.lit("w"), F.col("id") % 50, F.lit(" ")), 6000).alias("text"))
    planted = spark.createDataFrame([("alpha beta gamma",)] * 14, "text string")
    tree, counts = suffixtree.suffix_tree(filler.union(planted))
    assert tree.total > 3_000_000
    h, _ = suffixtree.token_stream(pa.array(["alpha"]))
    assert int(h[0]) in tree.contexts[0][0].tolist()
    texts = ["alpha beta gamma", "beta w1 w1", None, "new"]
    held = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in suffixtree.score_texts(held, tree, counts).collect()}
    assert len(got) == 4 and got[0]["score"] > got[0]["base_score"] + 9
    # sections meet the same tree as a scorer that holds all of it
    _, _, base, states, *_ = suffixtree.Scorer(tree)(pa.array([t or "" for t in texts]))
    for i in range(4):
        assert got[i]["score"] - got[i]["base_score"] == pytest.approx(states[i] - base[i])


def state_probabilities(tree, counts, frame, n):
    """P(x | context) of every row's last word, and of the end token, from differences of scores."""
    import numpy as np
    import pyarrow as pa

    score = suffixtree.Scorer(tree)
    rare = {int(r["key"]) & (1 << 64) - 1: r["c"] for r in counts.collect()}
    out = []
    for r in frame.collect():
        h, sizes = suffixtree.token_stream(pa.array([r["text"]]))
        logs = token_logs(score, h, sizes, rare, tree)
        out.append(10 ** logs[n] if r["id"] >= 0 else 10 ** logs[len(h) - 1])
    assert np.isfinite(out).all()
    return out


def token_logs(score, h, sizes, rare, tree):
    logs = [log10((rare.get(int(x), 0) + 1) / (tree.total + tree.distinct + 1)) for x in h]
    previous = h
    for n, now, valid in suffixtree.sequences(h, sizes, len(score.levels) + 1):
        if n > 1:
            contexts, weights, continuations, p = score.levels[n - 2]
            for i in range(len(h)):
                if valid[i] and (state := contexts(previous[i - 1 : i])[0]) >= 0:
                    found = continuations(now[i : i + 1])[0]
                    logs[i] = p[found] if found >= 0 else logs[i] + weights[state]
        previous = now
    return logs


def test_pages(spark):
    shell = "<html><body><div>Our site</div><p>{}</p></body></html>"
    data = [(i, f"http://h.example/{i}", shell.format(f"text {i}")) for i in range(8)] + [(8, None, None), (9, "http://other.example", shell.format("alone")), (9, "http://other.example", shell.format("alone"))]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    done = pages.main_text(frame)
    assert done.columns == [*frame.columns, "text_1", "n_template", "n_rules"]
    got = sorted((r["page_id"], r["text_1"]) for r in done.collect())
    assert got == [*((i, f"text {i}") for i in range(8)), (8, ""), (9, "Our site\n\nalone"), (9, "Our site\n\nalone")]
    assert pages.main_text(frame.limit(0)).count() == 0


def test_site_templates_against_all_pages_counted(spark):
    rnd = random.Random(3)
    parts = [f"<div>part {i}</div>" for i in range(12)]
    data = [(f"http://h{rnd.randrange(3)}.example/{i}", "<body>" + "".join(rnd.sample(parts, rnd.randrange(4))) + f"<p>own {i}</p></body>") for i in range(60)] + [(None, None), ("http://h0.example", "")]
    counts, sizes = Counter(), Counter()
    for url, html in data:
        host = (url or "").removeprefix("http://").split("/")[0]
        sizes[host] += 1
        counts.update({(host, h) for h in pages.Page(html or "").hashes().values()})
    want = {(host, h): n / sizes[host] for (host, h), n in counts.items() if n >= pages.MIN_PAGES and n >= pages.SHARE * sizes[host]}
    frame = spark.createDataFrame(data, "url string, html string").select(pages.host_of(F.col("url")).alias("host"), "html").repartition(5)
    got = {(r["host"], x["hash"]): x["share"] for r in pages.site_templates(frame).collect() for x in r["template"]}
    assert want and got == want
    most = pages.MOST_HOSTS
    try:
        pages.MOST_HOSTS = 1  # the way beyond the broadcast
        few = pages.main_text(spark.createDataFrame(data, "url string, html string")).collect()
    finally:
        pages.MOST_HOSTS = most
    assert sorted(map(str, few)) == sorted(map(str, pages.main_text(spark.createDataFrame(data, "url string, html string")).collect()))


def test_licenses(docs):
    found = licenses.scan_licenses(docs)
    assert found.columns == [*docs.columns, "n_words", "matches"] and found.count() == docs.count()
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
