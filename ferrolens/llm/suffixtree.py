"""Operator 9: scores of a probabilistic suffix tree over words.

Tokens are words between white space, A-Z lower-cased, then one end token for each text. The root
is the smoothed unigram model over all training tokens. A context is a sequence of up to DEPTH
words. Texts are read once: each task writes its tokens in sections (a million or so), as numbers
of the section's own words. The tree is learned in passes over the sections:

1. All unigrams are counted.
2. Sequences of 2 to DEPTH + 1 tokens are added up in each task, then by ranges of their keys in
   Spark; those that occur LEAST times or more are kept. What is kept grows with the corpus, so it
   stays in stored tables.
3. A context is retained if its next-symbol distribution diverges from that of its longest
   retained suffix: twice its count times the Kullback-Leibler divergence must exceed what chance
   gives. Its frequent continuations keep discounted estimates; the rest of the mass goes to the
   suffix's distribution (back-off), so every word has a probability in every state.

Growing is a sequence of joins and grouped sums, one length after the other. For scoring, the
distinct sequences of a section go to the tree by ranges of keys, what is found comes back to the
section, and the section walks its texts with its own part of the tree, taking at each token the
longest retained suffix. Keys travel as packed sorted arrays (`pack`), not as rows.

Null and empty texts have the end token alone. Repeated rows are scored each for itself. Words are
known by 64-bit hashes. Logarithms of the tree are kept in single precision, counts exactly. Other
columns are kept; where one has the name of a new column, the new one gets a suffix.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import BASE, INK_BYTE, U, mix, words
from ferrolens.llm.frames import collected, column_index, fresh, give_back, pick, positional, shared_folder, slices, table, texts_of
from ferrolens.llm.ftrl import fold

DEPTH = 4
#: Occurrences that it takes to learn from a sequence.
LEAST = 3
#: Share of the training tokens from which on a word is held by a tree that is looked at as a whole.
WORD_RATE = 1e-6
#: Tokens of a section: at least SECTION / 2, at most 3 * SECTION / 2, if the task has as many.
SECTION = 500_000
#: log2 of the bits of a broadcast bitmap over keys.
SKETCH = 26
#: Sequences that a task adds up before it sends them.
HELD = 1_000_000
#: Tokens, or entries of the tree, for each range of keys; and log2 of the ranges that a task deals out at once.
RANGE, RADIX = 1 << 19, 10
#: Rounds in which sections are scored: what is asked and answered at once is that part of it.
ROUNDS = 4
DISCOUNT = 0.5
END = U(0x0E0D0E0D0E0D0E0D)


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an END after each, and each text's number of tokens with END."""
    h, owner, *_ = words(texts, INK_BYTE)
    counts = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(int(counts.sum()), END)
    out[np.arange(len(h)) + owner] = h
    return out, counts


def pair_key(context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Hash of a sequence by those of it without its last and without its first token."""
    return mix(context * BASE + shorter)


def sequences(h: np.ndarray, counts: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, valid) for n from 1 on: the hash of the n tokens that end at each token of a text."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    now = h
    yield 1, now, np.ones(len(h), bool)
    for n in range(2, longest + 1):
        valid = place >= n - 1
        longer = np.zeros(len(h), U)
        longer[1:] = pair_key(now[:-1], now[1:])
        now = np.where(valid, longer, U(0))
        yield n, now, valid


def _sections(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token streams of whole texts, in sections; the last is joined with what is left over."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(some):
        return np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some])

    for batch in batches:
        for piece in slices(batch, column):
            held.append(token_stream(texts_of(piece.column(column))))
            size += len(held[-1][0])
            if size >= 3 * SECTION // 2:
                n = k = 0
                while n < SECTION - len(held[k][0]) // 2 and k < len(held) - 1:
                    n += len(held[k][0])
                    k += 1
                k = max(k, 1)
                yield out(held[:k])
                held = held[k:]
                size = sum(len(a) for a, _ in held)
    if held:
        yield out(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def pack(x: np.ndarray) -> bytes:
    """The array's bytes, all first ones before all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, U), dtype=U)


SECTIONS = T.StructType([T.StructField(n, T.LongType()) for n in ("section", "n_texts", "n_tokens", "n_words")] + [T.StructField(n, T.BinaryType()) for n in ("sizes", "words", "counts", "ids")])


def tokenised(docs: DataFrame, at: int, number: int = 0) -> DataFrame:
    """Rows of two kinds: docs without the text (column number `at`) but with a `row` number, and sections of tokens.

    A section has the number of its first row, the texts' numbers of tokens, its distinct words with their counts, and
    all tokens as places of their words in order of falling counts. Rows are numbered from `number` << 33 on.
    """
    kept = [T.StructField(f.name, f.dataType) for i, f in enumerate(docs.schema.fields) if i != at]
    schema = T.StructType([*kept, T.StructField("row", T.LongType()), *SECTIONS.fields])

    def run(batches):
        row = first = number + TaskContext.get().partitionId() << 33
        passed: list[pa.RecordBatch] = []
        blank: list[pa.DataType] = []

        def seen():
            for batch in batches:
                blank[:] = [c.type for i, c in enumerate(batch.columns) if i != at]
                passed.append(pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(np.zeros(batch.num_rows, bool))], names=[*schema.names[: len(kept)], ""]))
                yield batch

        def rows():
            nonlocal row
            for batch in passed:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(row, row + n)), *(pa.nulls(n, k) for k in [pa.int64()] * 4 + [pa.binary()] * 4)], names=schema.names)
                row += n
            passed.clear()

        for h, sizes in _sections(seen(), at):
            yield from rows()
            distinct, place, counts = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            values = [first, len(sizes), len(h), len(distinct)], [pack(sizes), pack_sorted(distinct), pack(counts), pack(rank[place])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in blank), pa.nulls(1, pa.int64()), *(pa.array([v], pa.int64()) for v in values[0]), *(pa.array([v], pa.binary()) for v in values[1])], names=schema.names)
            first += len(sizes)
        yield from rows()

    return docs.mapInArrow(run, schema)


def sections_of(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("section").isNotNull()).select(*SECTIONS.names)


def read_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, tokens, texts' numbers of tokens, distinct words (sorted) and their counts of each section."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in SECTIONS.names}
            distinct, counts = unpack_sorted(r["words"], r["n_words"]), unpack(r["counts"], r["n_words"], np.int64)
            by_rank = distinct[np.argsort(-counts, kind="stable")]
            yield r["section"], by_rank[unpack(r["ids"], r["n_tokens"], np.uint32)], unpack(r["sizes"], r["n_texts"], np.int64), distinct, counts
            del r, by_rank, distinct, counts
            give_back()


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of `mix`."""
    x = x ^ x >> U(31) ^ x >> U(62)
    x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ x >> U(27) ^ x >> U(54)
    x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ x >> U(30) ^ x >> U(60)


def range_bits(n: int) -> int:
    """log2 of the number of ranges of keys that n rows are dealt to."""
    return max(0, int(n // RANGE).bit_length())


def ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the parts of sorted keys that share their leading bits."""
    part = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(part[a]), a, b


Counted = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted keys, contexts, counts
COUNTED = "part long, n long, keys binary, contexts binary, counts binary"


def merged(pieces: list[Counted]) -> Counted:
    """Counts of equal keys added up."""
    if len(pieces) == 1:
        return pieces[0]
    keys, contexts, counts = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], contexts[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts


def sent(found: Iterator[Counted], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by range of keys; a task adds up some HELD of them first."""

    def rows(pieces):
        keys, contexts, counts = merged(pieces)
        out = [(part, b - a, pack_sorted(keys[a:b]), pack(contexts[a:b]), pack(counts[a:b])) for part, a, b in ranges(keys, bits)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "n", "keys", "contexts", "counts"]) if out else None

    held, size = [], 0
    for piece in found:
        held.append(piece)
        size += len(piece[0])
        if size >= HELD:
            yield rows(held)
            held, size = [], 0
    if held and (last := rows(held)) is not None:
        yield last


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, keys, contexts, counts = (batch.column(name)[i].as_py() for name in ("n", "keys", "contexts", "counts"))
            yield unpack_sorted(keys, n), unpack(contexts, n, U), unpack(counts, n, np.int64)


def added_up(sections: DataFrame, find, bits: int, least: float) -> DataFrame:
    """(key, context, shorter, c) of what `find` yields from batches of sections, if c is at least `least`.

    shorter follows from key and context (`pair_key`). Beyond 2 ** RADIX ranges, rows are dealt out in more than one step.
    """
    level = min(bits, RADIX)
    rows = sections.mapInArrow(lambda batches, level=level: sent(find(batches), level), COUNTED)
    while level < bits:
        level = min(bits, level + RADIX)
        rows = rows.repartition("part").mapInArrow(lambda batches, level=level: sent(received(batches), level), COUNTED)

    def run(group: pa.Table) -> pa.Table:
        keys, contexts, counts = merged(list(received(group.to_batches())))
        kept = counts >= least
        keys, contexts = keys[kept], contexts[kept]
        return pa.table([_signed(keys), _signed(contexts), _signed(unmix(keys) - contexts * BASE), pa.array(counts[kept])], names=["key", "context", "shorter", "c"])

    return rows.groupBy("part").applyInArrow(run, "key long, context long, shorter long, c long")


def count_words(sections: DataFrame, bits: int) -> DataFrame:
    """(key, c): counts of all tokens."""

    def find(batches):
        for *_, distinct, counts in read_sections(batches):
            yield distinct, np.zeros(len(distinct), U), counts

    return added_up(sections, find, bits, 1).select("key", "c")


class Lookup:
    """Places of 64-bit keys in a sorted array, by way of a table over their leading bits."""

    def __init__(self, keys: np.ndarray):  # sorted
        self.bits = max(8, min(20, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)).astype(np.int32)
        self.deepest = int(np.diff(np.append(self.first, len(keys))).max(initial=0))
        self.padded = np.append(keys, np.zeros(self.deepest + 1, U))
        self.keys = self.padded[: len(keys)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Place of each, -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.first[(x >> U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        live = np.arange(len(x))
        for k in range(self.deepest):
            place = at[live] + k
            there = self.padded[place]
            hit = (there == x[live]) & (place < len(self.keys))
            out[live[hit]] = place[hit]
            live = live[~hit & (there < x[live]) & (place + 1 < len(self.keys))]
            if not len(live):
                break
        return out


class Shelf:
    """A folder of tables between steps, each of which is deleted when no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def put(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.get(name, df.schema)

    def get(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark delete the shuffle files of finished steps."""
        for name in names:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.spark.range(1).count()  # until another job runs, Spark holds on to the last one's shuffle
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def sketch(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bit of every key's leading SKETCH bits set; at most 2 ** SKETCH / 64 rows reach the driver."""
    place = F.shiftrightunsigned("key", 64 - SKETCH)
    rows = collected(keys.select(F.shiftrightunsigned(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")))
    out = np.zeros(1 << SKETCH - 6, U)
    out[rows["word"].astype(np.int64)] = rows["bits"].astype(np.int64).view(U)
    return out


def met(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be in the bitmap; those that were put in always are."""
    place = keys >> U(64 - SKETCH)
    return bitmap[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1) > 0


def frequent_sequences(sections: DataFrame, below: DataFrame, longest: int, bits: int, least: float = LEAST) -> DataFrame:
    """(key, context, shorter, c): all sequences of `longest` tokens with a count of at least `least`, exactly.

    context is the sequence without its last token, shorter without its first; below are the frequent sequences one
    shorter (key). Counts are added up in each task before the shuffle.
    """
    shared = sections.sparkSession.sparkContext.broadcast(sketch(below))

    def find(batches):
        for _, h, sizes, *_ in read_sections(batches):
            previous = now = h
            for _, following, valid in sequences(h, sizes, longest):
                previous, now = now, following
            # both shorter sequences must be frequent
            may = met(shared.value, previous)
            fit = valid & may
            fit[1:] &= may[:-1]
            at = np.flatnonzero(fit)
            at = at[np.argsort(now[at])]
            keys = now[at]
            new = np.ones(len(at), bool)
            new[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(new)
            yield keys[first], previous[at[first] - 1], np.diff(np.append(first, len(at)))

    return added_up(sections, find, bits, least)


@dataclass
class Part:
    """A part of the tree in arrays: words with their counts, contexts with back-off weights, continuations."""

    total: int
    distinct: int
    word_keys: np.ndarray
    word_counts: np.ndarray
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by length - 1: sorted keys, log10 back-off weight
    continuations: list[tuple[np.ndarray, np.ndarray]]  # by length of the context - 1: sorted keys, log10 probability

    @classmethod
    def of(cls, total: int, distinct: int, word_keys: np.ndarray, word_counts: np.ndarray, rows: dict[str, np.ndarray], depth: int) -> Part:
        """From rows of a tree's entries."""
        order = np.argsort(rows["key"].view(U))
        key, kind, value = rows["key"].view(U)[order], rows["kind"][order], rows["value"][order]
        levels = lambda listed: [(key[kind == 2 * n + listed], value[kind == 2 * n + listed]) for n in range(depth)]
        return cls(total, distinct, word_keys, word_counts, levels(0), levels(1))


@dataclass
class Tree:
    """The suffix tree: stored tables of all words' counts (key, c) and of all contexts and continuations.

    entries: key, kind (twice the length of the context less one, and one more for a continuation), value (log10 of a
    continuation's probability or of a context's back-off weight).
    """

    total: int
    distinct: int
    counts: DataFrame
    entries: DataFrame
    depth: int = DEPTH
    word_rate: float = WORD_RATE

    @cached_property
    def whole(self) -> Part:
        """All of a small tree, with its common words, to look at; nothing else collects it."""
        common = collected(self.counts.filter(F.col("c") >= F.greatest(F.lit(self.word_rate * self.total), F.lit(1.0))))
        keys, n = common["key"].astype(np.int64).view(U), common["c"].astype(np.int64)
        order = np.argsort(keys)
        return Part.of(self.total, self.distinct, keys[order], n[order], collected(self.entries), self.depth)

    @property
    def contexts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self.whole.contexts


ENTRIES = T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("value", T.DoubleType())])


def grow(shelf: Shelf, sections: DataFrame, bits: int, total: int, distinct: int, counts: DataFrame, least: float, depth: int) -> DataFrame:
    """Entries of the tree, one length after the other: frequent sequences are counted, and the divergence test of their
    contexts is a few joins and a grouped sum."""
    # sequences one shorter: key, count, probability of the last token in its state
    states = counts.filter(F.col("c") >= least).select("key", "c", ((F.col("c") + 1) / F.lit(float(total + distinct + 1))).alias("p"))
    single = lambda c: F.col(c).cast("float").cast("double") if isinstance(c, str) else c.cast("float").cast("double")
    for n in range(2, depth + 2):
        f = frequent_sequences(sections, states, n, bits, least)
        below = states.select(F.col("key").alias("shorter"), F.col("p").alias("below"))
        whole = states.select(F.col("key").alias("context"), F.col("c").alias("c_context"))
        f = f.join(below, "shorter").join(whole, "context")
        f = shelf.put(f.select("key", "context", "c", "c_context", "below"), f"level{n}")
        shelf.drop()
        here = (F.col("c") - DISCOUNT) / F.col("c_context")
        sums = f.groupBy("context").agg(
            F.max("c_context").alias("c_context"), F.count("*").alias("n"), F.sum(here).alias("here"), F.least(F.sum("below"), F.lit(1 - 1e-9)).alias("below"), F.sum(here * F.ln(here / F.col("below"))).alias("divergence")
        )
        rest, free = F.greatest(1 - F.col("here"), F.lit(1e-9)), 1 - F.col("below")
        divergence = F.col("divergence") + rest * F.ln(rest / free)
        kept = 2 * F.col("c_context") * divergence > F.col("n") + 4 * F.sqrt(2 * F.col("n")) + 10
        contexts = shelf.put(sums.filter(kept).select("context", F.log10(rest / free).alias("weight")), f"contexts{n}")
        kind = lambda listed, n=n: F.lit(2 * (n - 2) + listed).cast("byte").alias("kind")
        shelf.put(contexts.select(F.col("context").alias("key"), kind(0), single("weight").alias("value")), "entries", "append")
        marked = f.join(contexts.select("context", F.lit(True).alias("kept")), "context", "left")
        last = n == depth + 1  # nothing grows from these
        states_ = marked.select("key", "c", F.coalesce("kept", F.lit(False)).alias("kept"), F.when(F.col("kept"), here).otherwise(F.col("below")).alias("p"))
        states = shelf.put(states_.filter("kept") if last else states_, f"states{n}")
        shelf.put(states.filter("kept").select("key", kind(1), single(F.log10("p")).alias("value")), "entries", "append")
        shelf.drop(f"level{n}", f"contexts{n}", f"states{n - 1}", *([f"states{n}"] if last else []))
    return shelf.get("entries", ENTRIES)


class Scorer:
    def __init__(self, tree: Tree | Part):
        tree = tree.whole if isinstance(tree, Tree) else tree
        self.tree = tree
        self.words = Lookup(tree.word_keys)
        self.log_word = np.log10((tree.word_counts + 1) / (tree.total + tree.distinct + 1))
        self.levels = [(Lookup(c), w, Lookup(k), p) for (c, w), (k, p) in zip(tree.contexts, tree.continuations, strict=True)]

    def __call__(self, texts: pa.Array):
        """By text: tokens, broadcast tokens, their unigram log, the state's log without what rare words add; and (text, key, tf) of rare words."""
        return self.stream(*token_stream(texts))

    def stream(self, h: np.ndarray, counts: np.ndarray):
        owner = np.repeat(np.arange(len(counts)), counts)
        at = self.words(h)
        rare = at < 0
        base = np.where(rare, 0.0, self.log_word[at] if len(self.log_word) else 0.0)
        score = base.copy()
        previous = h
        for n, now, valid in sequences(h, counts, len(self.levels) + 1):
            if n > 1:
                contexts, weights, continuations, logs = self.levels[n - 2]
                i = np.flatnonzero(valid)
                state = contexts(previous[i - 1])
                i, state = i[state >= 0], state[state >= 0]
                found = continuations(now[i])
                score[i] = np.where(found >= 0, logs[found] if len(logs) else 0.0, score[i] + (weights[state] if len(weights) else 0.0))
            previous = now
        pairs = h[rare]
        order = np.lexsort((pairs, owner[rare]))
        key, who = pairs[order], owner[rare][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(key)))
        n = len(counts)
        return counts, np.bincount(owner[~rare], minlength=n), np.bincount(owner, base, n), np.bincount(owner, score, n), who[first], key[first], tf


def suffix_tree(texts: DataFrame, rate: float = 0.0, word_rate: float = WORD_RATE, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree learned from the `text` column, and the stored table (key, c) of all words.

    Sequences need LEAST occurrences whatever the corpus; a rate above 0 asks for that share of the tokens too.
    """
    shelf = Shelf(texts.sparkSession)
    stored = shelf.put(tokenised(pick(texts, text="text"), 0), "tokens")
    tree = learned(shelf, sections_of(stored), rate, word_rate, depth)
    shelf.drop("tokens")
    return tree, tree.counts


def learned(shelf: Shelf, sections: DataFrame, rate: float = 0.0, word_rate: float = WORD_RATE, depth: int = DEPTH) -> Tree:
    total = sections.agg(F.sum("n_tokens")).first()[0] or 0
    bits = range_bits(total)
    counts = shelf.put(count_words(sections, bits), "words")
    shelf.drop()
    distinct = counts.count()
    entries = grow(shelf, sections, bits, total, distinct, counts, max(LEAST, rate * total), depth)
    return Tree(total, distinct, counts, entries, depth, word_rate)


#: Kind of a word's count among the entries that a section asks for.
WORD = -1


def score_texts(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """docs (text, ...) with n_tokens, n_known, base_score and score; the text goes.

    Sections of texts ask the tree, range of keys by range, for what they hold of it, and are scored with the answers.
    """
    at = column_index(docs, "text")
    names = [n for i, n in enumerate(docs.columns) if i != at]
    kept = [f"c{i}" for i in range(len(docs.columns)) if i != at]
    shelf = Shelf(docs.sparkSession)
    new = scored(shelf, shelf.put(tokenised(positional(docs), at), "tokens"), kept, tree, counts)
    for name in SCORES:
        names.append(fresh(name, names))
    return new.toDF(*names)


SCORES = ["n_tokens", "n_known", "base_score", "score"]


def scored(shelf: Shelf, stored: DataFrame, kept: list[str], tree: Tree, counts: DataFrame) -> DataFrame:
    """The kept columns and SCORES of all rows of a `tokenised` table."""
    spark = shelf.spark
    total, distinct, depth = tree.total, tree.distinct, tree.depth
    sections = sections_of(stored)
    entries = tree.entries.unionByName(counts.select("key", F.lit(WORD).cast("byte").alias("kind"), F.col("c").cast("double").alias("value")))
    bits = range_bits(entries.count())
    listed = F.col("kind") % 2 == 1
    present = spark.sparkContext.broadcast((sketch(tree.entries.filter(~listed)), sketch(tree.entries.filter(listed))))

    def probe(batches):
        contexts, continuations = present.value
        for section, h, sizes, distinct_words, _ in read_sections(batches):
            asked, is_context = [distinct_words], np.zeros(len(h), bool)
            for n, now, valid in sequences(h, sizes, depth + 1):
                # a continuation counts only after a context of the tree
                after = np.append(False, is_context[:-1]) & valid
                is_context = valid & met(contexts, now)
                after[after] = met(continuations, now[after])
                if n > 1:
                    asked.append(now[is_context & (n <= depth) | after])
            keys = np.sort(np.concatenate(asked))
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
            out = [(part, section, b - a, pack_sorted(keys[a:b])) for part, a, b in ranges(keys, bits)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "section", "n", "keys"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("key").to_numpy().view(U))
        key, kind, value = right.column("key").to_numpy().view(U)[order], right.column("kind").to_numpy()[order], right.column("value").to_numpy()[order]
        out = {name: [] for name in ("section", "n", "n_words", "keys", "kinds", "values", "counts")}
        for section, n, packed in zip(*(left.column(c).to_pylist() for c in ("section", "n", "keys")), strict=True):
            asked = unpack_sorted(packed, n)
            low, high = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
            times = high - low
            found = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            is_word = kind[found] == WORD
            row = section, len(found), int(is_word.sum()), pack_sorted(key[found]), pack(kind[found]), pack(value[found[~is_word]].astype(np.float32)), pack(value[found[is_word]].astype(np.int64))
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        told = pa.table({name: pa.array(v, pa.int64() if name in ("section", "n", "n_words") else pa.binary()) for name, v in out.items()})
        del out, order, key, kind, value
        give_back()
        return told

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for k in range(right.num_rows):
            r = {name: right.column(name)[k].as_py() for name in right.column_names}
            kinds = unpack(r["kinds"], r["n"], np.int8)
            values = np.empty(r["n"])
            values[kinds != WORD] = unpack(r["values"], r["n"] - r["n_words"], np.float32)
            values[kinds == WORD] = unpack(r["counts"], r["n_words"], np.int64)
            found.append((unpack_sorted(r["keys"], r["n"]), kinds, values))
        key, kind, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0))
        w = np.flatnonzero(kind == WORD)
        w, rest = w[np.argsort(key[w])], kind != WORD
        counted, told = (key[w], value[w].astype(np.int64)), {"key": key[rest].view(np.int64), "kind": kind[rest], "value": value[rest]}
        del found, key, kind, value, w, rest
        score = Scorer(Part.of(total, distinct, *counted, told, depth))
        del counted, told
        out = []
        for section, h, sizes, *_ in read_sections(left.to_batches()):
            n, known, base, states, who, _, tf = score.stream(h, sizes)
            unseen = np.bincount(who, tf, len(n)) * -np.log10(total + distinct + 1)
            out.append(pa.table([pa.array(np.arange(section, section + len(n))), *(pa.array(c) for c in (n.astype(np.int64), known.astype(np.int64), base + unseen, states + unseen))], names=scored_names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in [pa.int64()] * 3 + [pa.float64()] * 2], names=scored_names)

    scored_names = ["row", *SCORES]
    ranged = entries.withColumn("part", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))

    def answered(k: int) -> DataFrame:
        some = sections.filter(F.pmod(F.xxhash64("section"), F.lit(ROUNDS)) == k)
        probes = some.mapInArrow(probe, "part long, section long, n long, keys binary")
        hits = probes.groupBy("part").cogroup(ranged.groupBy("part")).applyInArrow(answer, "section long, n long, n_words long, keys binary, kinds binary, values binary, counts binary")
        return shelf.put(some.groupBy("section").cogroup(hits.groupBy("section")).applyInArrow(run, "row long, n_tokens long, n_known long, base_score double, score double"), "scored", "append")

    for k in range(ROUNDS):
        scores = answered(k)
        shelf.drop()
    return stored.filter(F.col("row").isNotNull()).select(*kept, "row").join(scores, "row").select(*kept, *SCORES)


#: Number from which on rows of held-out texts are counted (`tokenised`): beyond the tasks of the training texts.
HELD_OUT = 1 << 28


def op9_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    held_out = fold(F.col("doc_id"), 7) == 2
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    trained = F.coalesce(~F.col("held_out"), F.lit(False))
    shelf = Shelf(spark)
    shelf.put(tokenised(docs.filter(trained), 1), "tokens")
    stored = shelf.put(tokenised(docs.filter(~trained), 1, HELD_OUT), "tokens", "append")
    tree = learned(shelf, sections_of(stored).filter(F.col("section") < F.lit(HELD_OUT << 33)))
    scores = scored(shelf, stored, ["doc_id", "held_out"], tree, tree.counts)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
