"""Operator 11: product-quantisation codes by exact integer k-means with norm-of-sum bounds.

Vectors are cut into equal consecutive parts; each part position has a codebook of up to 256 entries. A round
assigns every part to its nearest entry and moves each entry to the mean of its parts (rounded down).

A round is one Arrow pass over a table that holds the packed vectors and their bounds:

* For each part: its code, an upper bound of the distance to it, and for each group of entries a
  lower bound of the distance to the group's other entries. Each bound keeps the round in which it was measured.
* The codebooks of all rounds are kept (rounds x entries numbers: small, and broadcast). A bound of
  round s serves in round t once it is moved by the net displacement |c(t) - c(s)| of its entry, or the largest
  of its group: the norm of the sum of the moves, never more than the sum of their norms.
* Where a group's lower bound is not above the upper bound, first the upper bound is measured anew, and what still
  is not settled is scanned exactly. Bounds only skip entries that are strictly farther, so
  ties go to the lower index as in a full scan, and results equal it.

Then the sums of each entry's parts are added up in the tasks, and by Spark over tasks, and one row for each entry
reaches the driver. All arithmetic on distances is exact: components are integers, and squared
distances stay below 2**53. Tables between rounds are Parquet in the shared folder; a round's
table goes when the next stands, so lost executors cost tasks, not rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.frames import column_index, fresh, pick, positional, shared_folder, table

#: A component x counts as floor(SCALE * x).
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Groups of entries with a common lower bound.
GROUPS = 8
#: What a bound must be ahead, for the rounding of roots (squared distances themselves are exact).
SLACK = 1e-6
#: Vectors that are measured at a time.
BLOCK = 4096


@dataclass
class Codebooks:
    """The codebooks of every round so far: history[round][part][entry][position], integers held as floats."""

    history: np.ndarray

    def __post_init__(self):
        self.now = len(self.history) - 1
        self.norms = (self.history**2).sum(-1)
        entries = self.history.shape[2]
        self.groups = [g for g in np.array_split(np.arange(entries), GROUPS) if len(g)]
        self.group_of = np.repeat(np.arange(len(self.groups)), [len(g) for g in self.groups])
        #: Net way of each entry from round s to now, and the farthest of each group.
        self.moved = np.sqrt(((self.history[-1] - self.history) ** 2).sum(-1))
        self.farthest = np.stack([self.moved[..., g].max(-1) for g in self.groups], -1)


@dataclass
class Bounds:
    """For n vectors' parts at one position: code, upper bound and its round, lower bounds by group and theirs."""

    code: np.ndarray
    upper: np.ndarray
    upper_round: np.ndarray
    lower: np.ndarray
    lower_round: np.ndarray


def squared(x: np.ndarray, entries: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Exact squared distances of n parts to m entries."""
    return (x**2).sum(-1)[:, None] - 2.0 * (x @ entries.T) + norms


def assign(x: np.ndarray, part: int, books: Codebooks, old: Bounds | None) -> tuple[Bounds, int]:
    """The bounds of this round, and how many distances were measured. Without old ones everything is scanned."""
    n, now, entries, norms = len(x), books.now, books.history[-1, part], books.norms[-1, part]
    rows = np.arange(n)
    if old is None:
        best, code = np.full(n, np.inf), np.full(n, len(entries))
        lower, stamp = np.zeros((n, len(books.groups))), np.zeros((n, len(books.groups)), np.int64)
        upper, upper_stamp = best.copy(), np.zeros(n, np.int64)
        open_, measured = np.ones(lower.shape, bool), 0
    else:
        code, stamp, upper_stamp = old.code.astype(np.int64), old.lower_round.astype(np.int64), old.upper_round.astype(np.int64)
        lower = old.lower.astype(float)
        reach = lower - books.farthest[stamp, part, np.arange(len(books.groups))]
        upper = old.upper.astype(float)
        bound = upper + books.moved[upper_stamp, part, code]
        unsure = np.flatnonzero(reach.min(1) <= bound + SLACK)
        best = np.full(n, np.inf)
        best[unsure] = ((x[unsure] - entries[code[unsure]]) ** 2).sum(-1)
        upper[unsure], upper_stamp[unsure] = np.sqrt(best[unsure]), now
        open_ = np.zeros(lower.shape, bool)
        open_[unsure] = reach[unsure] <= upper[unsure, None] + SLACK
        measured = len(unsure)
    was, was_best = code.copy(), best.copy()
    nearest, second = {}, {}
    for g, group in enumerate(books.groups):
        r = np.flatnonzero(open_[:, g])
        if not len(r):
            continue
        d = squared(x[r], entries[group], norms[group])
        measured += d.size
        first = d.argmin(1)
        least = d[np.arange(len(r)), first]
        d[np.arange(len(r)), first] = np.inf
        nearest[g], second[g] = (r, least), d.min(1)
        candidate = group[first]
        closer = (least < best[r]) | ((least == best[r]) & (candidate < code[r]))
        best[r[closer]], code[r[closer]] = least[closer], candidate[closer]
    home = books.group_of[code]
    for g, (r, least) in nearest.items():
        lower[r, g] = np.sqrt(np.where(home[r] == g, second[g], least))
        stamp[r, g] = now
    if old is not None:
        left = rows[(was != code) & ~open_[rows, books.group_of[was]]]  # the entry left behind joins its group's others
        g = books.group_of[was[left]]
        lower[left, g] = np.minimum(lower[left, g] - books.farthest[stamp[left, g], part, g], np.sqrt(was_best[left]))
        stamp[left, g] = now
    scanned = open_.any(1)
    upper[scanned], upper_stamp[scanned] = np.sqrt(best[scanned]), now
    return Bounds(code, upper, upper_stamp, lower, stamp), measured


def down(x: np.ndarray) -> np.ndarray:
    """As float32, never larger; up(x) never smaller."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def up(x: np.ndarray) -> np.ndarray:
    return -down(-x)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of an array as binaries of equal length."""
    flat = np.ascontiguousarray(x).reshape(len(x), -1)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), *shape)


#: Columns of the table of bounds behind the caller's own: packed numbers.
STATE = ["vector", "code", "upper", "upper_round", "lower", "lower_round"]


class Rounds:
    """The tables and passes of one call."""

    def __init__(self, kept: DataFrame, width: int, largest: int, entries: int):
        self.kept, self.width, self.entries = kept, width, entries
        self.kind = "<i2" if largest < 1 << 15 else "<i4"
        self.spark, self.folder = kept.sparkSession, shared_folder(kept.sparkSession)
        self.own = kept.schema.fields[1:]
        self.schema = T.StructType(self.own + [T.StructField(f"s_{name}", T.BinaryType()) for name in STATE])

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def vectors(self) -> DataFrame:
        """The kept vectors as packed integers, filled up with zeros to the common width."""
        width, kind = self.width, self.kind
        schema = T.StructType(self.own + [T.StructField("s_vector", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
                out = np.zeros((len(column), width), kind)
                out[np.arange(width) < sizes[:, None]] = flat
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], packed(out)], names=schema.names)

        return self.kept.mapInArrow(run, schema)

    def assigned(self, df: DataFrame, history: list[np.ndarray]) -> DataFrame:
        """df with the bounds of the newest codebooks."""
        parts, piece, kind, n_own, schema = PARTS, self.width // PARTS, self.kind, len(self.own), self.schema
        shared = self.spark.sparkContext.broadcast(np.stack(history))
        first = len(history) == 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = Codebooks(shared.value.astype(float))
            groups = len(books.groups)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    state = batch.columns[n_own:]
                    x = unpacked(state[0], kind, parts, piece).astype(float)
                    if not first:
                        code, upper, upper_round = unpacked(state[1], "u1", parts), unpacked(state[2], "<f4", parts), unpacked(state[3], "u1", parts)
                        lower, lower_round = unpacked(state[4], "<f4", parts, groups), unpacked(state[5], "u1", parts, groups)
                    new = []
                    for p in range(parts):
                        old = None if first else Bounds(code[:, p], upper[:, p], upper_round[:, p], lower[:, p], lower_round[:, p])
                        new.append(assign(x[:, p], p, books, old)[0])
                    columns = [
                        packed(np.stack([b.code for b in new], 1).astype("u1")),
                        packed(up(np.stack([b.upper for b in new], 1)).astype("<f4")),
                        packed(np.stack([b.upper_round for b in new], 1).astype("u1")),
                        packed(down(np.stack([b.lower for b in new], 1)).astype("<f4")),
                        packed(np.stack([b.lower_round for b in new], 1).astype("u1")),
                    ]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], state[0], *columns], names=schema.names)

        return df.mapInArrow(run, schema)

    def means(self, df: DataFrame, book: np.ndarray) -> np.ndarray:
        """The next codebooks: means of the assigned parts, rounded down; an entry without parts stays."""
        parts, piece, kind, entries = PARTS, self.width // PARTS, self.kind, self.entries
        names = [f"x{i}" for i in range(piece)]
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ["part", "entry", "n", *names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, piece), np.int64)
            for batch in batches:
                x = unpacked(batch.column(0), kind, parts, piece)
                code = unpacked(batch.column(1), "u1", parts)
                for p in range(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    there, begin, n = np.unique(code[order, p], return_index=True, return_counts=True)
                    if len(there):
                        count[p, there] += n
                        sums[p, there] += np.add.reduceat(x[order, p].astype(np.int64), begin, axis=0)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (part, entry, count[part, entry], *sums[part, entry].T)], names=schema.names)

        totals = df.select("s_vector", "s_code").mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names]))
        rows = totals.toArrow()  # one row for each entry at most
        at = [rows.column(c).to_numpy() for c in ("part", "entry", "n")]
        out = book.copy()
        if rows.num_rows:
            out[at[0], at[1]] = np.stack([rows.column(c).to_numpy() for c in names], 1) // at[2][:, None]
        return out

    def errors(self, df: DataFrame, book: np.ndarray) -> DataFrame:
        """The caller's columns, the code as binary, and the exact squared distance to it."""
        piece, kind, own = self.width // PARTS, self.kind, [f.name for f in self.own]
        shared = self.spark.sparkContext.broadcast(book)
        schema = T.StructType([*self.own, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unpacked(batch.column(len(own)), kind, PARTS, piece).astype(np.int64)
                code = unpacked(batch.column(len(own) + 1), "u1", PARTS)
                error = ((x - shared.value[np.arange(PARTS), code]) ** 2).sum((1, 2))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], batch.column(len(own) + 1), pa.array(error, pa.int64())], names=schema.names)

        return df.select(*own, "s_vector", "s_code").mapInArrow(run, schema)


def vector_codes(df: DataFrame, vector: str = "embedding", order: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """The rows that have a whole vector, with `code` (binary, one byte for each part) and `error` (long) in place of it, and
    the final codebooks as integers [part][entry][position].

    Rows whose vector is null or holds null, NaN or infinite components go. Codebooks begin with the rows of
    the 256 smallest values of `order` (nulls last, equal values by vector), fewer if there are fewer rows. Shorter
    vectors are filled up with zeros to the longest one's length, and that to a multiple of 4. Equal vectors
    have equal codes. Other columns stay; a clashing name gets a suffix. No row at all gives no
    row, and codebooks without entries. Components whose squared distances would pass 2**53 raise ValueError.
    """
    at, first_by = column_index(df, vector), column_index(df, order)
    rest = [name for i, name in enumerate(df.columns) if i != at]
    names = list(rest)
    for name in ("code", "error"):
        names.append(fresh(name, names))
    flat = positional(df)
    numbers = flat[f"c{at}"].cast("array<double>")
    whole = F.coalesce(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = flat.filter(whole).select(flat[f"c{at}"].alias("v"), *(f"c{i}" for i in range(len(df.columns)) if i != at))
    largest = F.max(F.array_max(F.transform(F.col("v").cast("array<double>"), lambda x: F.abs(x) * SCALE)))
    n, length, top = kept.select(F.count("*"), F.max(F.size("v")), largest).first()
    if not n:
        none = kept.filter(F.lit(False)).drop("v").withColumns({"code_": F.lit(b""), "error_": F.lit(0).cast("long")})
        return none.toDF(*names), np.zeros((PARTS, 0, 0), np.int64)
    width = max(PARTS, -(-length // PARTS) * PARTS)
    if (width // PARTS) * (2 * (int(top or 0) + 1)) ** 2 >= 1 << 53:
        raise ValueError(f"components of up to {top} in vectors of {length}: squared distances are not exact")
    seeds = kept.orderBy(F.col(f"c{first_by}").asc_nulls_last(), F.col("v")).select("v").limit(ENTRIES).toArrow().column(0).to_pylist()
    start = np.zeros((len(seeds), width), np.int64)
    for i, seed in enumerate(seeds):
        start[i, : len(seed)] = np.floor(SCALE * np.array(seed, float))
    books = [np.ascontiguousarray(start.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2))]
    rounds = Rounds(kept, width, int(top or 0) + 1, len(seeds))
    state = rounds.put(rounds.vectors(), "vectors")
    before = "vectors"
    for k in range(ROUNDS + 1):
        state = rounds.put(rounds.assigned(state, books), f"round_{k}")
        rounds.drop(before)
        before = f"round_{k}"
        if k < ROUNDS:
            books.append(rounds.means(state, books[-1]))
    return rounds.errors(state, books[-1]).toDF(*names), books[-1]


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding", label="label")
    coded, books = vector_codes(vectors)
    totals = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["same"]), "left")
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
