"""Operator 13: fill-in-the-middle texts, cut by a piecewise-linear learned index of character boundaries.

A text's index maps the rank of a character (0, 1, ..., n) to the byte where it begins, n to the end. It is
learned in one pass: segments, each a line through its first boundary, grow while one slope keeps
every boundary within ERROR bytes of the line, and the difference between line and boundary is stored
for every rank in one byte. A cut is predicted from its segment's line and corrected by the stored
residual, so it is exact, and no text is counted through again for its cuts. Texts of one-byte
characters are one segment.

Cuts and forms follow from the document's id alone (SHA-256 of seed, colon, decimal id), so a row is
transformed alike wherever and whenever it runs. No shuffle: one Arrow pass over the table, in
slices of bounded bytes; memory is bound by a slice or the longest text (about 20 bytes for each of its own).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import flat_bytes
from ferrolens.llm.frames import column_index, fresh, pick, positional, slices, table, texts_of

#: Largest distance, in bytes, of a boundary from its segment's line.
ERROR = 60
#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed; of 100 transformed ones so many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Boundaries that a growing segment looks at first; each further look doubles.
FIRST_LOOK = 256


@dataclass
class RankIndex:
    """Lines over the ranks of boundaries: first rank, first boundary and slope of each; a residual for every rank."""

    ranks: np.ndarray
    bytes: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, boundaries: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> RankIndex:
        """Segments for several texts, whose boundaries are [start, stop) of one array; none spans two texts."""
        firsts: list[int] = []
        slopes: list[float] = []
        wide = np.flatnonzero(boundaries[stops - 1] - boundaries[starts] > stops - 1 - starts)
        plain = np.ones(len(starts), bool)
        plain[wide] = False
        for a, b in zip(starts[wide].tolist(), stops[wide].tolist(), strict=True):
            while a < b:
                length, slope = _grow(boundaries[a:b])
                firsts.append(a)
                slopes.append(slope)
                a += length
        ranks = np.concatenate([starts[plain], np.array(firsts, np.int64)])
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        slopes = np.concatenate([np.ones(int(plain.sum())), np.array(slopes, float)])[order]
        index = cls(ranks, boundaries[ranks], slopes, np.zeros(0, np.int8))
        error = boundaries - index.predict(np.arange(len(boundaries)))
        if len(error) and np.abs(error).max() > 127:
            raise AssertionError("a segment left its error bound")
        index.residuals = error.astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ranks, ranks, "right") - 1
        return self.bytes[at] + np.rint(self.slopes[at] * (ranks - self.ranks[at])).astype(np.int64)

    def __call__(self, ranks: np.ndarray) -> np.ndarray:
        """The byte of each boundary, exactly."""
        return self.predict(ranks) + self.residuals[ranks]


def _grow(boundaries: np.ndarray) -> tuple[int, float]:
    """Length and slope of the longest segment from the first boundary whose lines within ERROR share a slope."""
    n, look, done = len(boundaries), FIRST_LOOK, 1
    low, high = 0.0, np.inf
    while done < n:
        stop = min(n, done + look)
        step = np.arange(done, stop)
        rise = boundaries[done:stop] - boundaries[0]
        lows = np.maximum(np.maximum.accumulate((rise - ERROR) / step), low)
        highs = np.minimum(np.minimum.accumulate((rise + ERROR) / step), high)
        crossed = lows > highs
        if crossed.any():
            k = int(crossed.argmax())
            if k:
                low, high = lows[k - 1], highs[k - 1]
            done += k
            break
        low, high, done, look = lows[-1], highs[-1], stop, look * 2
    return done, 1.0 if done == 1 else float((low + high) / 2)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers (as longs) from seed and id; a null id is drawn like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _transform(texts: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
    data, bounds = flat_bytes(texts)
    rows = np.arange(len(texts))
    head = np.flatnonzero((data & 0xC0) != 0x80)
    # every text's character starts, then its end: the boundaries of ranks 0 to n
    n = np.diff(np.searchsorted(head, bounds))
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    boundaries = np.empty(starts[-1], np.int64)
    last = np.zeros(len(boundaries), bool)
    last[starts[1:] - 1] = True
    boundaries[last], boundaries[~last] = bounds[1:], head
    index = RankIndex.fit(boundaries, starts[:-1], starts[1:])
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    whole = data.tobytes()
    cut1, cut2 = index(starts[:-1] + low), index(starts[:-1] + high)
    plain = (n == 0) | (h[2] % 100 >= RATE)
    swapped = h[3] % 100 < SUFFIX_FIRST
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    out, forms = [], []
    for i, a, b, c, d in zip(rows.tolist(), bounds[:-1].tolist(), cut1.tolist(), cut2.tolist(), bounds[1:].tolist(), strict=True):
        text = whole[a:d]
        if plain[i] or any(m in text for m in marks):
            plain[i] = True
            out.append(text)
            forms.append("plain")
            continue
        prefix, middle, suffix = whole[a:b], whole[b:c], whole[c:d]
        if swapped[i]:
            out.append(b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle]))
            forms.append("spm")
        else:
            out.append(b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle]))
            forms.append("psm")
    return [
        pa.array(n, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array(low, pa.int64(), mask=plain),
        pa.array(high - low, pa.int64(), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def fill_in_middle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """df with columns appended: n (characters), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Prefix and middle end after the smaller and the larger of two draws from 0 to n. Texts that are
    empty, null (as if empty), hold a marker, or draw it, stay plain: output is the text, and prefix_chars
    and middle_chars are null. Equal ids draw alike, so repeated rows come out alike. Other columns
    stay; a clashing name gets a suffix (`frames.fresh`).
    """
    at, id_at = column_index(df, text), column_index(df, doc_id)
    names = list(df.columns)
    for name, _ in FIELDS:
        names.append(fresh(name, names))
    flat = positional(df)
    schema = T.StructType(flat.schema.fields + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(FIELDS)])
    labels = schema.names
    drawn = flat.select("*", *(x.alias(f"h{k}") for k, x in enumerate(draws(flat[f"c{id_at}"], seed))))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at):
                h = [column.to_numpy(zero_copy_only=False).astype(np.int64) for column in piece.columns[-4:]]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-4], *_transform(texts_of(piece.column(at)), h)], names=labels)

    return drawn.mapInArrow(run, schema).toDF(*names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; markers can't stand in its parts."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    size, n = len(PREFIX), F.length(output)
    middle = F.substring(output, m + size, n)
    psm = F.concat(F.substring(output, p + size, s - p - size), middle, F.substring(output, s + size, m - s - size))
    spm = F.concat(F.substring(output, p + size, m - p - size), middle, F.substring(output, s + size, p - s - size))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    made = fill_in_middle(docs)
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))
