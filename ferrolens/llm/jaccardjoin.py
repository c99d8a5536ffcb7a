"""Operator 2: similarity join of documents by the Jaccard measure of their word n-grams.

1. Words are runs of letters and digits, A-Z lower-cased; a document's set is the hashes of its
   5-word n-grams (a shorter document has its whole word sequence as its one n-gram).
2. Documents with equal sets form a class; its smallest doc_id stands for it. Only classes go on.
3. MinHash: BANDS bands of ROWS rows; classes that agree on a band are candidates. A pair of
   similarity s is met with probability 1 - (1 - s**ROWS)**BANDS; `plan_bands` chooses the numbers
   for a target recall at the threshold (18 bands of 5 rows: 0.999 at 0.8).
4. Classes and band buckets are joined into candidate components by propagating the smallest id.
   Components are cut into parts of at most PART classes, and every pair of parts is a group of its
   own: the classes' full sets meet there, all pairs are verified exactly, and only counts and a
   spanning forest of the links come out. So a component of any size is spread over many tasks,
   pairs are never emitted, and no link is lost. A component of more than MOST_PARTS parts
   (chains of chance collisions grow such) is verified bucket by bucket instead, where only pairs that share
   a band meet, each in the first band that it shares: a set is copied once for each bucket then, which is less.
5. Links join classes into clusters.

Result, one row for each document: id, class_id, n_links (documents with a similarity of at least
the threshold: copies, and all members of linked classes) and cluster_id (smallest id that is
reachable by links). Null and empty texts, and texts without words, have no n-grams: each is a
class of its own without links. Repeated rows are members of one class. Null ids take part; a class
or cluster of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import BASE, U, mix, ngrams, words
from ferrolens.llm.frames import column_index, map_text, pick, positional, slices, stored, table, texts_of

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Classes, and n-grams, of one part of a large component.
PART, PART_GRAMS = 1024, 1_000_000
#: A component of more parts than this is verified by buckets; the plan has about as many bands.
MOST_PARTS = 18
#: Rows of one key from which on they may be dealt out apart from the others.
HUB = 1000
NO_ID = -(1 << 63)
#: Elements that one step of verification holds at once.
STEP = 1 << 21


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 120) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the recall at the threshold allows within `most` hashes."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes, and offsets by text."""
    h, owner, *_ = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    grams, who = ngrams(h, owner, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            some = counts[short] > k
            extra[some] = extra[some] * BASE + h[begin[short[some]] + k]
        grams, who = np.concatenate([grams, mix(extra + counts[short].astype(U))]), np.concatenate([who, short])
    order = np.lexsort((grams, who))
    grams, who = grams[order], who[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])
    grams, who = grams[new], who[new]
    return grams, np.searchsorted(who, np.arange(len(texts) + 1))


def set_hashes(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; of an empty set 0."""
    out = np.zeros(len(offsets) - 1, U)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(grams ^ BASE), offsets[some]) + np.diff(offsets)[some].astype(U))
    return out


def bands_of(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of the MinHash bands; sets must not be empty."""
    x = (grams >> U(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=U) * BASE)
    out = np.zeros((len(offsets) - 1, bands), U)
    for b in range(bands):
        for r in range(rows):
            s = seeds[b * rows + r]
            h = x * np.uint32((s & U(0xFFFFFFFF)) | U(1))
            h ^= h >> np.uint32(15)
            h *= np.uint32((s >> U(32)) | U(1))
            low = np.minimum.reduceat(h, offsets[:-1])
            out[:, b] = out[:, b] * BASE + low
        out[:, b] = mix(out[:, b] + U(b))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(values))


def sketches(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """(id, node, grams, bands): of each document the hash of its set, the set's size, the band hashes;
    node and bands are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                grams, offsets = shingles(texts_of(piece.column(1)), n)
                sizes = np.diff(offsets)
                none = sizes == 0
                some = np.flatnonzero(~none)
                b = bands_of(grams, np.append(offsets[some], offsets[-1]), bands, rows) if len(some) else np.zeros((0, bands), U)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~none) * bands]), pa.int32()), _signed(b.ravel()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(set_hashes(grams, offsets).view(np.int64), mask=none), pa.array(sizes.astype(np.int64)), lists], names=["id", "node", "grams", "bands"])

    return docs.select("id", "text").mapInArrow(run, "id long, node long, grams long, bands array<long>")


def hub_limit(spark: SparkSession, rows: int) -> int:
    """Rows of a key that make it a hub: of `rows` rows at most 4 * shuffle partitions are hubs, so these may be broadcast."""
    return max(HUB, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread(rows: DataFrame, facts: DataFrame, hubs: DataFrame | None, key: str) -> DataFrame:
    """rows joined with facts (one row a key): the hubs' facts by broadcast, so that their rows stay where they are."""
    if hubs is None:
        return rows.join(facts, key)
    hubs = F.broadcast(hubs.select(key))
    few, many = facts.join(hubs, key, "left_semi"), facts.join(hubs, key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(hubs, key, "left_anti").join(many, key))


def hubs_of(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of stored rows that are hubs, as a stored table, or None if there are none."""
    total = rows.count()
    if total <= HUB:
        return None
    found = stored(rows.groupBy(key).count().filter(F.col("count") > hub_limit(rows.sparkSession, total)).select(key), "hubs")
    return found if found.limit(1).count() else None


def component_ids(edges: DataFrame, checkpoint: str) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node with.

    Rounds of large-star and small-star, each a groupBy: a node's neighbours are all tied to the
    smallest of them, first the larger ones, then the smaller ones. The number of rounds grows with
    the logarithm of the longest chain; each round is stored. Hubs' edges aren't brought together.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), checkpoint)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = hubs_of(both, "a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread(both, least, hubs, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = spread(large, least, hubs, "a")  # of a node no more edges than before
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, checkpoint)
        # a forest of stars that no longer changes: nobody's root has a root
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.join(roots, "a", "left_semi").limit(1).count() == 0 and after.groupBy("a").count().filter("count > 1").limit(1).count() == 0:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
        now = after


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows (root, i, j, node, part, size, set, level, bands) in the order of root, i, j: link counts and a forest
    of the links of each pair of parts. A pair of parts holds 2 * PART classes at most, up to chance."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        at = 0
        for edge in [*edges.tolist(), batch.num_rows]:
            if edge == at:
                continue
            this = tuple(keys[:, at])
            if held and this != key:
                yield _pairs(pa.Table.from_batches(held), threshold)
                held = []
            key = this
            held.append(batch.slice(at, edge - at))
            at = edge
    if held:
        yield _pairs(pa.Table.from_batches(held), threshold)


def _pairs(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    get = lambda c: rows.column(c).combine_chunks()
    node, first = np.unique(get("node").to_numpy(), return_index=True)  # documents that share id and set come twice
    rows = rows.take(pa.array(first))
    size, part, sets = get("size").to_numpy(), get("part").to_numpy(), get("set")
    n = len(node)
    lengths = np.diff(sets.offsets.to_numpy()).astype(np.int32)
    shared = common_elements(sets.flatten().to_numpy(), lengths)
    linked = shared >= threshold * (lengths[:, None] + lengths[None, :] - shared) - 1e-9
    linked[np.arange(n), np.arange(n)] = False
    if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
        linked &= part[:, None] != part[None, :]
    level = rows.column("level")[0].as_py()
    if level > 0:  # a bucket: pairs that share an earlier band were counted there
        bands = get("bands").flatten().to_numpy().reshape(n, -1)
        for k in range(level):
            linked &= bands[:, None, k] != bands[None, :, k]
    count = linked @ size
    # a forest of the links: every node is tied to the least one that it reaches here
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(count.astype(np.int64)), pa.array(node[root])], names=["node", "links", "tied"])


def common_elements(elements: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of the sets that follow one another in `elements`."""
    n = len(lengths)
    _, element = np.unique(elements, return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    many = np.bincount(element) > 1
    column = np.where(many, np.cumsum(many) - 1, -1)[element]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.int32)
    step = max(64, STEP // n)
    for a in range(0, int(many.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        member = np.zeros((n, min(step, int(many.sum()) - a)), np.float32)
        member[owner[lo:hi], column[lo:hi] - a] = 1
        out += (member @ member.T).astype(np.int32)
    out[np.arange(n), np.arange(n)] = lengths
    return out


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """(id, node, class_id, n_links, cluster_id, cluster) for every row of docs; see the module.

    node and cluster are hashes that tell classes and clusters apart, null where there are no n-grams.
    """
    spark = docs.sparkSession
    bands, rows = plan_bands(threshold, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(docs, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    members = stored(sketches(docs, bands, rows, n), "sketches")
    classes = stored(members.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "classes")
    # buckets of band hashes, each tied to its least class
    banded = classes.select("node", "grams", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("grams").alias("bulk")).filter("n > 1"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    hot = buckets.filter(F.col("n") > hub_limit(spark, total)).select("band")
    edges = spread(banded.select("node", "band"), buckets.select("band", "hub"), hot if total > HUB else None, "band").filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    candidates = stored(component_ids(edges, "candidates"), "components")
    # every candidate component in parts of bounded size; every pair of parts once
    # (components of more than one part are at most one in PART classes, or in PART_GRAMS n-grams)
    in_parts = lambda count, bulk: F.greatest(F.ceil(count / PART), F.ceil(bulk / PART_GRAMS)).cast("int")
    shape = candidates.join(classes.select(F.col("node"), "grams"), "node").groupBy("root").agg(in_parts(F.count("*"), F.sum("grams")).alias("parts"))
    shape = stored(shape.filter("parts > 1"), "shape")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    place = "array<struct<root: long, parts: int, part: int, level: int>>"
    sized = candidates.join(shape, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = sized.filter(F.col("parts") <= MOST_PARTS).select("node", F.array(F.struct("root", "parts", part, F.lit(-1).alias("level"))).cast(place).alias("places"))
    asked = asked.join(classes.select("node", "class_id", "size"), "node").withColumn("bands", F.lit(None).cast("array<long>"))
    if shape.filter(F.col("parts") > MOST_PARTS).limit(1).count():
        giant = sized.filter(F.col("parts") > MOST_PARTS).select("node").join(classes.drop("grams"), "node")
        in_bucket = giant.select("node", F.posexplode("bands").alias("level", "band"))
        in_bucket = spread(in_bucket, buckets.select("band", in_parts(F.col("n"), F.col("bulk")).alias("parts")), hot, "band")
        places = in_bucket.groupBy("node").agg(F.collect_list(F.struct(F.col("band").alias("root"), "parts", part, "level")).cast(place).alias("places"))
        asked = asked.unionByName(giant.join(places, "node").select(*asked.columns))
    asked = asked.withColumn("id", F.coalesce("class_id", F.lit(NO_ID))).drop("class_id")
    texts = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text").join(asked, "id").select("places", "bands", "node", "size", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 4):
                grams, offsets = shingles(texts_of(piece.column(4)), n)
                mine = set_hashes(grams, offsets).view(np.int64) == piece.column(2).to_numpy(zero_copy_only=False)  # not another text of the same id
                made = pa.RecordBatch.from_arrays([*piece.columns[:4], _lists(grams, offsets)], names=["places", "bands", "node", "size", "set"])
                yield made.filter(pa.array(mine))

    sets = texts.mapInArrow(fetch, f"places {place}, bands array<long>, node long, size long, set array<long>")
    sets = sets.select(F.explode("places").alias("at"), "bands", "node", "size", "set").select("at.*", "bands", "node", "size", "set")
    # part p meets itself and all others: (i, j) with i <= j
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", "size", "set", "level", "bands")
    checked = stored(
        paired.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda batches: _verify(batches, threshold), "node long, links long, tied long"), "links"
    )
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    clusters = component_ids(checked.filter("node != tied").select(F.col("node").alias("a"), F.col("tied").alias("b")), "links")
    facts = (
        classes.select("node", "class_id", "size").join(links, "node", "left").join(clusters, "node", "left")
        .select("node", "class_id", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("cluster"))
    )
    facts = stored(facts, "facts")
    large = hubs_of(facts, "cluster")
    least = facts.groupBy("cluster").agg(F.min("class_id").alias("cluster_id"))
    facts = spread(facts, least, large, "cluster")
    rows_ = facts.agg(F.sum("size")).first()[0] or 0
    copied = facts.filter(F.col("size") > hub_limit(spark, rows_)).select("node") if rows_ > HUB else None
    facts = facts.select("node", "class_id", "n_links", "cluster_id", "cluster")
    found = spread(members.filter(F.col("node").isNotNull()).select("id", "node"), facts, copied, "node").select("id", "node", "class_id", "n_links", "cluster_id", "cluster")
    bare = members.filter(F.col("node").isNull()).select("id", "node", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("cluster_id"), F.lit(None).cast("long").alias("cluster"))
    return found.unionByName(bare)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each cluster: the one with its least id. Rows without n-grams all stay.

    Of repeated rows one stays; all columns pass through, whatever their names.
    """
    names = docs.columns
    flat = positional(docs)
    k, t = f"c{column_index(docs, key)}", column_index(docs, text)
    joined = jaccard_join(flat, k, f"c{t}", threshold).filter(F.col("node").isNotNull())
    first = stored(joined.filter(F.col("id").eqNullSafe(F.col("cluster_id")) & F.col("class_id").eqNullSafe(F.col("cluster_id"))).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "node", "cluster"), "first")
    repeated = first.groupBy("cluster").count().filter("count > 1").limit(1).count() > 0
    first = first.dropDuplicates(["cluster"]).withColumn("stays", F.lit(True)).drop("cluster")

    def make():
        def apply(texts: pa.Array) -> list[pa.Array]:
            grams, offsets = shingles(texts)
            return [pa.array(set_hashes(grams, offsets).view(np.int64), mask=np.diff(offsets) == 0)]

        return apply

    marked = map_text(flat, f"c{t}", make, [("node", T.LongType())]).withColumn("id", F.coalesce(F.col(k).cast("long"), F.lit(NO_ID)))
    kept = marked.join(first, ["id", "node"], "left").filter(F.col("node").isNull() | F.col("stays"))
    if repeated:  # rows alike in id and text
        bare = kept.filter(F.col("node").isNull())
        kept = kept.filter(F.col("node").isNotNull()).dropDuplicates(["node"]).unionByName(bare)
    return kept.select(flat.columns).toDF(*names)


def op2_jaccardjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), "class_id", "n_links", "cluster_id")
