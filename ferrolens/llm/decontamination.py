"""Operator 1: benchmark decontamination with an FM-index for each training shard.

Test phrases are windows of 13 consecutive benchmark words (an item of fewer words is one window).
A shard is a slice of the documents that a task holds. For each shard:

1. All its words are numbered; its text is the sequence of the numbers, with a 0 after each document.
2. An FM-index is built over it: suffix order, Burrows-Wheeler transform, a wavelet tree (one bit
   vector with ranks for each bit of a word number), and every 8th suffix position.
3. All windows are searched backwards together, one word a step, through wavelet-tree ranks; a window
   with a word that the shard lacks ends there.
4. Occurrences are located by walking back to sampled positions, and their spans are merged.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words, one at a time; a longer item is
split where windows overlap. One block serves while the benchmark is as small as test sets are;
beyond that the documents are indexed once for each block, and the spans found are merged by document.
Memory of a task is bound by the slice, or the longest text, and the block.

Null and empty texts have no words and are clean; an item without words has no window; equal
windows of several items count for each of them, rows that share an item id are one item; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import words
from ferrolens.llm.frames import column_index, fresh, pick, positional, slices, stored, table, texts_of

WINDOW = 13
SAMPLE_EVERY = 8
#: Benchmark words that are broadcast at once.
BLOCK_WORDS = 1_000_000


# -- the index -------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of a sequence of numbers in order; zeros end runs and compare by position.

    `order` may give the places in the order of their first symbols, zeros by position.

    Prefix doubling: ranks of 1, 2, 4, ... symbols. A rank is the place of its group's first suffix;
    groups of one suffix are done, and only the others are sorted again.
    """
    n = len(text)
    key = text.astype(np.int64) + n
    ends = np.flatnonzero(text == 0)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key) if order is None else order.copy()
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(key[order])
    open_ = _shared(rank[order])  # places whose group has several suffixes
    width = 1
    while len(open_):
        at = order[open_]
        second = np.zeros(len(at), np.int64)
        inside = at + width < n
        second[inside] = rank[at[inside] + width] + 1
        by = np.lexsort((second, rank[at])) if n >= 1 << 31 else np.argsort(rank[at] * (n + 1) + second)
        at, second = at[by], second[by]
        order[open_] = at
        first = rank[at]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[_shared(rank[at])]
        width *= 2
    return order


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys the place of the first equal one."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _shared(ranks: np.ndarray) -> np.ndarray:
    """Places at which a value equals one of its neighbours."""
    same = np.zeros(len(ranks) + 1, bool)
    same[1:-1] = ranks[1:] == ranks[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


class WaveletTree:
    """Ranks of symbols in a sequence: one level for each bit, the highest first (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols.astype(np.int32) if bits < 32 else symbols
        for level in range(bits - 1, -1, -1):
            bit = (now & (1 << level)) != 0
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(int(len(now) - ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = symbol >> (self.bits - 1 - k) & 1 == 1
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            a = ones[at].astype(np.int64)
            bit = ones[at + 1] > a
            out = out << 1 | bit
            at = np.where(bit, zeros + a, at - a)
        return out


class FmIndex:
    """Counts and locates phrases in a text of numbers from 1 on, whose runs end in 0."""

    def __init__(self, text: np.ndarray, symbols: int, order: np.ndarray | None = None):
        order = suffix_order(text, order)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.sampled = order % SAMPLE_EVERY == 0
        self.sampled |= text[order - 1] == 0  # the walk never crosses the end of a run
        self.number = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases (rows, filled up with 0), last symbol first."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(int(lengths.max(initial=0)), 0, -1):
            go = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(go):
                continue
            c = phrases[go, k - 1]
            lo[go], hi[go] = self.before[c] + self.tree.rank(c, lo[go]), self.before[c] + self.tree.rank(c, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the nearest sampled one."""
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.positions[self.number[at[done]]] + walked[live[done]]
            live, at = live[~done], at[~done]
            walked[live] += 1
            c = self.tree.access(at)
            at = self.before[c] + self.tree.rank(c, at)
        return out


# -- phrases ---------------------------------------------------------------------------------------


@dataclass
class Phrases:
    """Distinct windows over a vocabulary of word hashes, and the items that have each."""

    vocabulary: np.ndarray  # sorted word hashes; number = place + 1
    windows: np.ndarray  # rows of word numbers, filled up with 0
    lengths: np.ndarray
    items: list[str]
    owner: np.ndarray  # of (window, item) pairs, by window
    owner_starts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Phrases:
        h, who, *_ = words(pa.array([t or "" for _, t in items], pa.string()))
        vocabulary, number = np.unique(h, return_inverse=True)
        number = np.append(number.astype(np.int64) + 1, np.zeros(window, np.int64))
        counts = np.bincount(who, minlength=len(items))
        begin = np.cumsum(counts) - counts
        names = sorted({k for k, _ in items})  # rows of one id are one item
        number_of = {k: i for i, k in enumerate(names)}
        per = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)  # windows of each item
        if not per.sum():
            return cls(vocabulary, np.zeros((0, window), np.int64), np.zeros(0, np.int64), names, np.zeros(0, np.int64), np.zeros(1, np.int64))
        item = np.repeat(np.arange(len(items)), per)
        start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + begin[item]
        inside = np.arange(window) < np.minimum(counts, window)[item][:, None]
        rows = np.where(inside, number[start[:, None] + np.arange(window)], 0)
        windows, back = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(back.ravel() * len(names) + np.array([number_of[k] for k, _ in items])[item])
        starts = np.searchsorted(pairs // len(names), np.arange(len(windows) + 1))
        return cls(vocabulary, windows, (windows > 0).sum(1), names, pairs % len(names), starts)


@dataclass
class Hits:
    """Of one slice of texts: numbers of words, and merged spans and found items by text."""

    n_words: np.ndarray
    span_text: np.ndarray
    span_start: np.ndarray  # word positions within the text
    span_end: np.ndarray
    item_text: np.ndarray
    item: np.ndarray
    char_spans: np.ndarray  # byte positions within the text, of each span


def find(texts: pa.Array, phrases: Phrases) -> Hits:
    """Occurrences of the phrases in the texts, through an FM-index of these texts."""
    h, owner, starts, ends, bounds = words(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    none = np.zeros(0, np.int64)
    empty = Hits(n_words, none, none, none, none, none, np.zeros((0, 2), np.int64))
    if not len(h) or not len(phrases.windows):
        return empty
    by_word = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[by_word][1:] != h[by_word][:-1]
    vocabulary, number = h[by_word][new], np.empty(len(h), np.int64)
    number[by_word] = np.cumsum(new) - 1
    # the text: all words' numbers, and a 0 behind each document that has words
    last = np.ones(len(h), bool)
    last[:-1] = owner[1:] != owner[:-1]
    at = np.arange(len(h)) + np.cumsum(last) - last
    text = np.zeros(len(h) + int(last.sum()), np.int64)
    text[at] = number + 1
    source = np.zeros(len(text), np.int64)  # of places in the text: which word stands there
    source[at] = np.arange(len(h))
    index = FmIndex(text, len(vocabulary), np.concatenate([np.flatnonzero(text == 0), at[by_word]]))
    # the windows in the shard's numbers; those with a word that it lacks don't occur
    place = np.minimum(np.searchsorted(vocabulary, phrases.vocabulary), len(vocabulary) - 1)
    number_of = np.append(0, np.where(vocabulary[place] == phrases.vocabulary, place + 1, 0))
    windows = number_of[phrases.windows]
    whole = np.flatnonzero((windows > 0).sum(1) == phrases.lengths)
    lo, hi = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    lo[whole], hi[whole] = index.search(windows[whole], phrases.lengths[whole])
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    if not len(rows):
        return empty
    start = source[index.locate(rows)]
    who = owner[start]
    # merge the spans
    order = np.argsort(start, kind="stable")
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + phrases.lengths[which], -1)
    hit = np.cumsum(cover)[:-1] > 0
    s = hit.copy()
    s[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    e = hit.copy()
    e[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
    begin = np.cumsum(n_words) - n_words
    text_of = owner[s]
    # items by text
    which, who = which[order], who[order]
    per = phrases.owner_starts[which + 1] - phrases.owner_starts[which]
    flat = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(phrases.owner_starts[which], per)
    pairs = np.unique(np.repeat(who, per) * len(phrases.items) + phrases.owner[flat])
    chars = np.stack([starts[s] - bounds[text_of], ends[e - 1] - bounds[text_of]], 1)
    return Hits(n_words, text_of, s - begin[text_of], e - begin[text_of], pairs // len(phrases.items), pairs % len(phrases.items), chars)


# -- the operator ----------------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "byte_start", "byte_end")]))
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", SPANS)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _pieces(text: str, most: int, window: int) -> Iterator[tuple[int, str]]:
    """(words, text) of pieces of at most `most` words; a piece repeats the last window - 1 words of the one before."""
    if len(text) < 2 * most:  # a word and what parts it from the next are two characters at least
        yield len(text) // 2 + 1, text
        return
    spans = [m.span() for m in WORD.finditer(text)]
    for a in range(0, max(len(spans) - window + 1, 1), most - window + 1):
        some = spans[a : a + most]
        yield len(some), text[some[0][0] : some[-1][1]] if some else ""


def _blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, str]]]:
    """Items of the benchmark in blocks of at most `most` words; never all at once."""
    most = max(most, 2 * window)
    block, held = [], 0
    for row in benchmark.filter(F.col("text").isNotNull()).toLocalIterator():
        for size, text in _pieces(row["text"], most, window):
            if block and held + size > most:
                yield block
                block, held = [], 0
            block.append(("" if row["item"] is None else row["item"], text))
            held += size
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids) and merged spans appended (fresh names).

    Spans are in words, and in bytes of the text. benchmark has the columns `item`, `item_text`.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item=item, text=item_text).withColumn("item", F.col("item").cast("string"))
    names = list(docs.columns)
    at, width = column_index(docs, text), len(names)
    flat = positional(docs)

    def scan(rows: DataFrame, shared) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, *(T.StructField(f"n{i}", t) for i, (_, t) in enumerate(FIELDS))])
        labels = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                for piece in slices(batch, at, 4 << 20):
                    yield pa.RecordBatch.from_arrays([*piece.columns, *_columns(texts_of(piece.column(at)), phrases)], names=labels)

        return rows.mapInArrow(run, schema)

    def out(df: DataFrame) -> DataFrame:
        new = []
        for name, _ in FIELDS:
            new.append(fresh(name, names + new))
        return df.toDF(*names, *new)

    blocks = _blocks(items, block_words, window)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return out(scan(flat, spark.sparkContext.broadcast(Phrases.of(block, window))))
    # one scan for each block, its results stored before the next is broadcast; rows are told apart by a number that is stored with them
    rows = stored(flat.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = None
    while block is not None:
        shared = spark.sparkContext.broadcast(Phrases.of(block, window))
        some = scan(rows, shared).select("row", "n1", F.explode_outer("n3").alias("span"), "n2").select("row", "n2", "span.*").filter(F.col("start").isNotNull())
        some = stored(some, "block")
        found = some if found is None else found.unionByName(some)
        shared.destroy()
        block, following = following, next(blocks, None)
    merged = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n2")))).alias("n2"), F.collect_list(F.struct("start", "end", "byte_start", "byte_end")).alias("n3"))
    merged = stored(merged.select("row", "n2", _merged_spans(F.col("n3")).alias("n3")), "found")
    counted = scan(rows, spark.sparkContext.broadcast(Phrases.of([], window))).drop("n1", "n2", "n3")
    total = F.aggregate("n3", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    joined = counted.join(merged, "row", "left").select(*(f"c{i}" for i in range(width)), "n0", F.coalesce(total, F.lit(0)).cast("long"), F.coalesce("n2", F.array().cast("array<string>")), F.coalesce("n3", F.array().cast(SPANS)))
    return out(joined)


def _merged_spans(spans):
    """Overlapping and touching spans of one document merged."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"), F.element_at(out, -1)["byte_start"].alias("byte_start"), F.greatest(F.element_at(out, -1)["byte_end"], x["byte_end"]).alias("byte_end"))))
        ).otherwise(F.concat(out, F.array(x))),
    )


def _columns(texts: pa.Array, phrases: Phrases) -> list[pa.Array]:
    hits = find(texts, phrases)
    n = len(texts)
    n_hit = np.bincount(hits.span_text, hits.span_end - hits.span_start, minlength=n).astype(np.int64)
    names = np.array(phrases.items, object)
    items = pa.array(names[hits.item].tolist(), pa.string())  # numbered in the order of their strings, and found in it
    offsets = lambda owner: pa.array(np.searchsorted(np.sort(owner), np.arange(n + 1)), pa.int32())
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (hits.span_start, hits.span_end, hits.char_spans[:, 0], hits.char_spans[:, 1])], names=["start", "end", "byte_start", "byte_end"])
    return [pa.array(hits.n_words.astype(np.int64)), pa.array(n_hit), pa.ListArray.from_arrays(offsets(hits.item_text), items), pa.ListArray.from_arrays(offsets(hits.span_text), spans)]


def contaminated(n_words="n_words", n_hit="n_hit"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
