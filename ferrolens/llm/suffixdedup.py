"""Operator 3: removal of repeated substrings by suffix order, built by columns.

Every byte that a string of LENGTH bytes covers goes, if that string also starts earlier: in an
earlier document, or before in the same one. Strings never cross documents.

1. Anchors. Of the hashes of the K-byte strings in a window of LENGTH bytes, the least (the first of
   equals) is the window's anchor. Equal windows have equal anchors at equal places, so windows can
   be dealt out by the hash of their anchor. Consecutive windows with one anchor form a segment of
   LENGTH to 2 * LENGTH - K bytes. Only hashes and places of segments travel.
2. Anchors that one segment alone has are settled. Segments equal as a whole are copies: all but the
   first go, and the first stands for them from here on. Each task drops its own copies beforehand
   (`Seen`), so that what a hot line sends to one task grows with the tasks, not with its occurrences.
3. Anchors with different segments need suffix order: the segments' bytes are fetched, dealt out by
   anchor, and collected into string collections of bounded size, less what no other string can
   share. For each, transform and common
   prefixes are built column by column through sequential files (`columnbwt`). Suffixes that share
   LENGTH bytes with their neighbour are equal windows; all but the first are removed.
4. An anchor with more than HOT different segments (a line that many texts quote in different
   surroundings) would be a collection without bound. It is split: its windows are dealt out by their
   own 128-bit hashes, and equal ones are settled there.
5. The spans of a document are merged.

Order is by doc_id, null first. Repeated ids are ordered by text, and repeated rows one after
another (`ranked`), so of repeated rows one stays. Null and empty texts have nothing to remove.
Texts are taken whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import U, flat_bytes, mix, prefix_hash, span_hash
from ferrolens.llm.columnbwt import build
from ferrolens.llm.frames import column_index, fresh, positional, slices, stored, table, texts_of

LENGTH, K = 100, 32
#: Different segments of one anchor that still form one collection.
HOT = 2048
COLLECTION_BYTES = 2 << 20
#: Segments that a task remembers to drop copies of.
HELD = 1 << 18
BLOCK = 2 << 20
PLACE_BITS = U(23)


# -- anchors ---------------------------------------------------------------------------------------


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = K, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, content hash, text number, start and end (within the text) of all segments.

    A segment that goes over the edge of a block is given in two parts.
    """
    if len(data) < length:
        return
    prefix = prefix_hash(data)
    owner_of = lambda at: np.searchsorted(bounds, at, "right") - 1
    for a in range(0, len(data) - length + 1, block):
        n = min(block, len(data) - length + 1 - a)  # windows that start in this block
        places = np.arange(a, a + n + length - k)
        hashes = span_hash(prefix, places, places + k)
        low = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(places)).astype(U)
        width, span = 1, length - k + 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        anchor = np.minimum(low[:n], low[span - width : span - width + n]) & U((1 << 23) - 1)
        anchor = anchor.astype(np.int64)
        start = np.arange(a, a + n)
        who = owner_of(start)
        whole = start + length <= bounds[who + 1]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])
        stop = whole.copy()
        stop[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])
        s, e = np.flatnonzero(new), np.flatnonzero(stop)
        who = who[s]
        yield hashes[anchor[s]], span_hash(prefix, a + s, a + e + length), who, a + s - bounds[who], a + e + length - bounds[who]


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one owner joined; in order."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far  # furthest end so far of the owner
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return owner[first], start[first], reach[np.append(first[1:], len(owner)) - 1]


REMOVED, NEEDED = 1, 0
MARKS = "anchor long, content long, rank long, start int, end int, kind int"
MARK_NAMES = [c.split(" ")[0] for c in MARKS.split(", ")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def _marks(anchor, content, rank, start, end, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(anchor), _signed(content), _signed(rank), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(rank), kind, np.int32))], names=MARK_NAMES)


class Seen:
    """First places (rank, start) of segments by content hash, of the last HELD to 2 * HELD different ones."""

    def __init__(self):
        self.sorted: list[tuple[np.ndarray, ...]] = []  # newest first

    def copies(self, content: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which segments (content distinct, sorted) repeat one that was seen and comes earlier; the others are kept in mind."""
        out, known = np.zeros(len(content), bool), np.zeros(len(content), bool)
        for c, r, s in self.sorted:
            at = np.minimum(np.searchsorted(c, content), len(c) - 1)
            hit = (c[at] == content) & ~known
            out |= hit & ((r[at] < rank) | (r[at] == rank) & (s[at] < start))
            known |= hit
        if not known.all():
            self._add(content[~known], rank[~known], start[~known])
        return out

    def _add(self, *new: np.ndarray) -> None:
        self.sorted.insert(0, new)
        # runs of like sizes are merged, as in a log-structured table
        while len(self.sorted) > 1 and 2 * len(self.sorted[0][0]) >= len(self.sorted[1][0]) and len(self.sorted[0][0]) < HELD:
            a, b = self.sorted.pop(0), self.sorted.pop(0)
            c = np.concatenate([a[0], b[0]])
            order = np.argsort(c)
            self.sorted.insert(0, (c[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))))
        while sum(len(x[0]) for x in self.sorted) > 2 * HELD:
            self.sorted.pop()


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (rank, text), less copies of what the task has seen, whose spans are removed right away."""
    seen = Seen()
    for batch in batches:
        for piece in slices(batch, 1, BLOCK):
            data, bounds = flat_bytes(texts_of(piece.column(1)))
            ranks = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = list(segments(data, bounds))
            if not found:
                continue
            anchor, content, who, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
            rank = ranks[who]
            order = np.lexsort((start, rank, content))
            anchor, content, rank, start, end = anchor[order], content[order], rank[order], start[order], end[order]
            first = np.ones(len(content), bool)
            first[1:] = content[1:] != content[:-1]
            once = np.flatnonzero(first)
            first[once[seen.copies(content[once], rank[once], start[once])]] = False
            if first.any():
                yield _marks(anchor[first], content[first], rank[first], start[first], end[first], NEEDED)
            if not first.all():
                rank, start, end = merged(rank[~first], start[~first], end[~first])
                yield _marks(mix(rank.astype(U) + start.astype(U)), np.zeros(len(rank), U), rank, start, end, REMOVED)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of marks in the order of anchor, content, rank, start: copies are removed, segments whose anchor
    has others are needed. What is carried from batch to batch is the last segment alone."""
    held = None  # (anchor, content, whether its anchor has others, its first mark)
    for batch in batches:
        anchor, content, rank, start, end, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        gone = kind == REMOVED
        if gone.any():
            yield batch.filter(pa.array(gone))
            anchor, content, rank, start, end = anchor[~gone], content[~gone], rank[~gone], start[~gone], end[~gone]
        if not len(anchor):
            continue
        if held is not None:
            anchor, content, rank, start, end = (np.concatenate([[h], x]) for h, x in zip(held[2], (anchor, content, rank, start, end), strict=True))
        new_anchor, new_content = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_content[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        copies = ~new_content
        group = np.cumsum(new_anchor) - 1
        different = np.bincount(group, new_content).astype(np.int64)
        others = different > 1
        if held is not None:
            others[0] |= held[0]
        done = held[1] if held is not None else False  # the held mark was sent on already
        send = new_content & others[group]
        if done:
            send[0] = False
        if send.any():
            yield _marks(anchor[send], content[send], rank[send], start[send], end[send], NEEDED)
        if copies.any():
            yield _marks(anchor[copies], content[copies], rank[copies], start[copies], end[copies], REMOVED)
        last = int(np.flatnonzero(new_content)[-1])
        sent = bool(others[group[last]]) and (bool(send[last]) or last == 0 and done)
        held = (bool(others[group[-1]]), sent, (anchor[last], content[last], rank[last], start[last], end[last]))


# -- suffix order ----------------------------------------------------------------------------------


def repeated_windows(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (rank, start, end) of windows of the strings that another string's window equals and precedes.

    data[bounds[i]:bounds[i + 1]] stands in document rank[i] from start[i] on. Only what suffix order
    can still tell apart goes into the collection: strings without a window whose hash occurs twice
    here stay out, the others are cut to the stretch from their first to their last such window.
    """
    n = np.maximum(np.diff(bounds) - length + 1, 0)
    before = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - before[owner] + bounds[:-1][owner]
    hashes = span_hash(prefix_hash(data), at, at + length)
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(order), bool)
    same = hashes[order][1:] == hashes[order][:-1]
    again[order[1:]] = same
    again[order[:-1]] |= same
    at, owner = at[again], owner[again]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    string, first = np.unique(owner, return_index=True)
    low, high = at[first], at[np.append(first[1:], len(at)) - 1] + length
    rank, start = rank[string], start[string] + low - bounds[:-1][string]
    sizes = high - low
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = data[np.arange(bounds[-1]) + np.repeat(low - bounds[:-1], sizes)]
    suffixes = build(data, bounds)
    alike = suffixes.common >= length
    member = alike.copy()
    member[:-1] |= alike[1:]
    rows = np.flatnonzero(member)
    group = np.cumsum(~alike)[rows]
    string = suffixes.string[rows]
    place = start[string] + np.diff(bounds)[string] - suffixes.length[rows]
    order = np.lexsort((place, rank[string], group))
    later = np.zeros(len(rows), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    string, place = string[order][later], place[order][later]
    return merged(rank[string], place, place + length)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle rows (key, sub, rank, start, bytes) in the order of key, sub, rank, start.

    Rows with bytes are segments of the anchor `key`; rows without are windows with the hash
    (key, sub), of which all but the first go.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    before = None

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        some = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if len(rows) > 1 else rows[0]
        data, bounds = flat_bytes(some.column(4))
        rank, start, end = repeated_windows(data, bounds, some.column(2).to_numpy(zero_copy_only=False), some.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
        return _spans(rank, start, end)

    for batch in batches:
        windows = pc.equal(pc.binary_length(batch.column(4)), 0)
        if pc.any(windows).as_py():
            some = batch.filter(windows)
            key, sub, rank, start = (c.to_numpy(zero_copy_only=False) for c in some.columns[:4])
            later = np.zeros(len(key), bool)
            later[1:] = (key[1:] == key[:-1]) & (sub[1:] == sub[:-1])
            later[0] = before == (key[0], sub[0])
            before = (key[-1], sub[-1])
            if later.any():
                yield _spans(*merged(rank[later], start[later].astype(np.int64), start[later].astype(np.int64) + LENGTH))
            batch = batch.filter(pc.invert(windows))
        while batch.num_rows:
            sizes = np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False).astype(np.int64))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            n = len(key)
            if size + sizes[-1] >= COLLECTION_BYTES:
                # up to the first end of an anchor's rows once the collection is full
                full = int(np.searchsorted(sizes, COLLECTION_BYTES - size))
                edges = np.flatnonzero(key[1:] != key[:-1]) + 1
                if held and held[-1].column(0)[-1].as_py() != key[0]:
                    edges = np.insert(edges, 0, 0)
                later_edges = edges[edges >= max(full, 0 if held else 1)]
                if len(later_edges):
                    n = int(later_edges[0])
                    if n:
                        held.append(batch.slice(0, n))
                    yield flush(held)
                    held, size = [], 0
                    batch = batch.slice(n)
                    continue
            held.append(batch)
            size += int(sizes[-1])
            break
    if held:
        yield flush(held)


def _spans(rank, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(rank), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["rank", "start", "end"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the needed segments of (rank, text, needs); of hot anchors the windows' hashes instead."""
    for batch in batches:
        for piece in slices(batch, 1, BLOCK):
            data, bounds = flat_bytes(texts_of(piece.column(1)))
            needs = piece.column(2)
            n = np.diff(needs.offsets.to_numpy())
            flat = needs.flatten()
            who = np.repeat(np.arange(piece.num_rows), n)
            anchor, start, end, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            rank = piece.column(0).to_numpy(zero_copy_only=False)[who]
            a, b = bounds[who] + start, bounds[who] + end
            cold = ~hot
            if cold.any():
                size = (b - a)[cold]
                offsets = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(offsets[-1]) + np.repeat(a[cold] - offsets[:-1], size)
                bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                yield _rows(anchor[cold], np.zeros(len(size), np.int64), rank[cold], start[cold], bytes_)
            if hot.any():
                size = (b - a)[hot] - LENGTH + 1
                before = np.cumsum(size) - size
                at = np.arange(size.sum()) + np.repeat(a[hot] - before, size)
                prefix = prefix_hash(data)
                key = span_hash(prefix, at, at + LENGTH)
                sub = mix(span_hash(prefix, at, at + LENGTH // 2) ^ mix(span_hash(prefix, at + LENGTH // 2, at + LENGTH)))
                yield _rows(key, sub, np.repeat(rank[hot], size), at - np.repeat(bounds[who][hot], size), pa.array([b""] * len(at), pa.binary()))


def _rows(key, sub, rank, start, bytes_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(key), _signed(sub), _signed(rank), pa.array(start.astype(np.int32)), bytes_], names=["key", "sub", "rank", "start", "bytes"])


# -- the operator ----------------------------------------------------------------------------------


def ranked(flat: DataFrame, key: str, text: str) -> DataFrame:
    """flat with a unique long `rank` in the order of documents: the key itself where it is unique and
    not null, else places in a stored table sorted by key and text."""
    ids = flat.select(F.col(key).cast("long").alias("id"))
    if ids.filter(F.col("id").isNull()).limit(1).count() == 0 and ids.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
        return flat.withColumn("rank", F.col(key).cast("long"))
    ordered = flat.withColumn("o0", F.col(key).cast("long")).withColumn("o1", F.xxhash64(text))
    return stored(ordered.orderBy(F.col("o0").asc_nulls_first(), "o1").drop("o0", "o1").withColumn("rank", F.monotonically_increasing_id()), "ranked")


def removal_spans(docs: DataFrame, rank: str = "rank", text: str = "text") -> DataFrame:
    """(rank, spans array<struct<start, end>>), in bytes, not yet merged: of documents with anything to remove.

    docs has a unique long rank, in the order of the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(rank).alias("rank"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    proposed = texts.mapInArrow(_propose, MARKS)
    settled = stored(proposed.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "rank", "start").mapInArrow(_settle, MARKS), "settled")
    needed, removed = settled.filter(F.col("kind") == NEEDED), settled.filter(F.col("kind") == REMOVED).select("rank", "start", "end")
    # anchors with more segments than HOT: at most one in HOT of what is needed
    hot = stored(needed.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    needs = needed.join(hot, "anchor", "left").groupBy("rank").agg(F.collect_list(F.struct("anchor", "start", "end", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("needs"))
    cut = texts.join(needs, "rank").select("rank", "text", "needs").mapInArrow(_cut, "key long, sub long, rank long, start int, bytes binary")
    repeated = cut.repartition(parts, "key").sortWithinPartitions("key", "sub", "rank", "start").mapInArrow(_collect, "rank long, start int, end int")
    return removed.unionByName(repeated).groupBy("rank").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def kept_pieces(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return [*out, data[at:]]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """docs with `spans` (merged, in bytes) and `kept` (the bytes that stay) appended, under fresh names.

    as_text gives the rest as a string; a character that a span cuts goes as a whole.
    """
    fields = [("spans", SPANS), ("kept", T.StringType() if as_text else T.BinaryType())]
    names, width, at = docs.columns, len(docs.columns), column_index(docs, text)
    flat = ranked(positional(docs), f"c{column_index(docs, key)}", f"c{at}")
    spans = removal_spans(flat, "rank", f"c{at}")
    joined = flat.join(spans, "rank", "left").drop("rank")
    schema = T.StructType([*joined.schema.fields[:width], *(T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                texts, found = texts_of(piece.column(at)).cast(pa.binary()).to_pylist(), piece.column(width)
                n = np.diff(found.offsets.to_numpy()) if found.null_count == 0 else pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
                flat_ = found.flatten()
                owner, s, e = merged(np.repeat(np.arange(len(n)), n), *(flat_.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)))
                cut = np.searchsorted(owner, np.arange(len(n) + 1))
                pairs = list(zip(s.tolist(), e.tolist(), strict=True))
                pieces = (kept_pieces(t, pairs[a:b]) for t, a, b in zip(texts, cut, cut[1:], strict=False))
                kept = ["".join(x.decode("utf-8", "ignore") for x in p) if as_text else b"".join(p) for p in pieces]
                made = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"]))
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], made, pa.array(kept, pa.string() if as_text else pa.binary())], names=schema.names)

    new: list[str] = []
    for name, _ in fields:
        new.append(fresh(name, [*names, *new]))
    return joined.mapInArrow(run, schema).toDF(*names, *new)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated substrings cut out of the texts, and n_chars set anew where there is such a
    column. Texts of which only white space is left go; texts without repeats stay as they are."""
    names = docs.columns
    at = column_index(docs, text)
    flat = positional(docs)
    done = remove_repeats(flat, f"c{column_index(docs, key)}", f"c{at}", as_text=True)
    cut = F.size("spans") > 0
    done = done.filter(~cut | (F.length(F.trim(F.regexp_replace("kept", r"\s+", " "))) > 0)).withColumn(f"c{at}", F.when(cut, F.col("kept")).otherwise(F.col(f"c{at}")))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        done = done.withColumn(n, F.when(cut, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return done.select(flat.columns).toDF(*names)


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs)
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select("doc_id", n.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
