"""Operator 12: token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text's symbols are its characters, joined in a doubly linked list. A heap holds the adjacent pairs
whose joint string is a piece of the vocabulary, lowest rank first, leftmost first among equals.
The lowest pair is popped and merged again and again; the count is what the symbols weighed at
first, less the number of merges. A character weighs one token, or its number of UTF-8 bytes where it
is no piece (byte fallback).

Two neighbouring characters that no piece holds side by side are never merged across, so a text is
cut there first, by one look-up for all pairs of a slice; a task merges each different part once.

The vocabulary (a bounded file of a public tokenizer) is read on the driver and broadcast as ranks.
Null and empty texts have no tokens. Texts of any length are taken whole: a part of n characters
costs n log n. No shuffle; memory is bound by a slice of texts, or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bpe import tokenizer_path
from ferrolens.llm.frames import map_text, pick, table

#: Tokens beyond which a text is over the limit of `op12_counts`.
LIMIT = 4096
#: Parts of texts that a task remembers, and the characters of the longest of them.
KNOWN_PARTS, KNOWN_LENGTH = 1_000_000, 64
#: Text bytes of a slice.
SLICE = 1 << 20
SPACE = "▁"

# Fixed values of the model file's format: kinds of pieces, and the fields that are read here.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_MODEL, TRAINER_BYTES = 3, 35
MODEL_BPE = 2
NORMALIZER_NAME, NORMALIZER_PREFIX, NORMALIZER_SQUEEZE, NORMALIZER_ESCAPE = 1, 3, 4, 5


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        width = {0: None, 1: 8, 2: 0, 5: 4}[key & 7]
        if width is None:
            yield key >> 3, number()
        else:
            width = width or number()
            yield key >> 3, message[at : at + width]
            at += width


@dataclass
class Pieces:
    """Pieces by rank: the higher a piece's score, the lower its rank; equal scores share a rank."""

    rank: dict[str, int]
    prefix: bool

    @classmethod
    def read(cls, path: str) -> Pieces:
        """From a model file of the BPE kind with byte fallback and texts taken as they are; others are refused."""
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        trainer = dict(fields(b"".join(v for k, v in model if k == TRAINER)))
        normal = dict(fields(b"".join(v for k, v in model if k == NORMALIZER)))
        found = [dict(fields(v)) for k, v in model if k == PIECE]
        kinds = {p.get(PIECE_KIND, NORMAL) for p in found}
        if trainer.get(TRAINER_MODEL) != MODEL_BPE or not trainer.get(TRAINER_BYTES) or kinds & {USER, UNUSED}:
            raise ValueError(f"{path}: only BPE models with byte fallback and without user-defined or unused pieces")
        if normal.get(NORMALIZER_NAME) != b"identity" or normal.get(NORMALIZER_SQUEEZE, 1) or not normal.get(NORMALIZER_ESCAPE, 1):
            raise ValueError(f"{path}: only models that take texts as they are, spaces escaped")
        plain = {p[PIECE_TEXT].decode(): float(np.frombuffer(p.get(PIECE_SCORE, bytes(4)), "<f4")[0]) for p in found if p.get(PIECE_KIND, NORMAL) == NORMAL}
        if any(c not in plain for piece in plain for c in piece):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        order = {score: k for k, score in enumerate(sorted(set(plain.values()), reverse=True))}
        return cls({piece: order[score] for piece, score in plain.items()}, bool(normal.get(NORMALIZER_PREFIX, 1)))

    def weights(self) -> np.ndarray:
        """Tokens of each code point that stands alone."""
        out = np.repeat(np.array([1, 2, 3, 4], np.int8), [0x80, 0x800 - 0x80, 0x10000 - 0x800, 0x110000 - 0x10000])
        out[[ord(piece) for piece in self.rank if len(piece) == 1]] = 1
        return out

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The class of each code point, and whether a piece holds characters of two classes side by side.

        Class 0 is for characters that no longer piece holds.
        """
        longer = [piece for piece in self.rank if len(piece) > 1]
        letters = sorted(set("".join(longer)))
        number = {c: k for k, c in enumerate(letters, 1)}
        classes = np.zeros(0x110000, np.uint16)
        classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in longer:
            for a, b in zip(piece, piece[1:], strict=False):
                beside[number[a], number[b]] = True
        return classes, beside


def count_merges(part: str, rank: dict[str, int]) -> int:
    """Merges that turn the characters of a part into its tokens."""
    get, n, merges = rank.get, len(part), 0
    ranks = list(map(get, map(add, part, part[1:])))  # of the pair that begins at each place
    heap = [r * n + i for i, r in enumerate(ranks) if r is not None]
    if not heap or n == 2:
        return len(heap)
    heapify(heap)
    symbols, before, after = list(part), list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        r, i = divmod(heappop(heap), n)
        if ranks[i] != r:
            continue  # one of the two has gone into another symbol since
        merges += 1
        j = after[i]
        symbols[i] = joint = symbols[i] + symbols[j]
        after[i] = k = after[j]
        ranks[i] = None
        if k < n:
            before[k], ranks[j] = i, None
            if (r := get(joint + symbols[k])) is not None:
                ranks[i] = r
                heappush(heap, r * n + i)
        if (h := before[i]) >= 0:
            ranks[h] = r = get(symbols[h] + joint)
            if r is not None:
                heappush(heap, r * n + h)
    return merges


class Counter:
    """Counts of texts; parts that a task has met are remembered, in a table of bounded size."""

    def __init__(self, pieces: Pieces):
        self.rank, self.prefix = pieces.rank, SPACE if pieces.prefix else ""
        self.weights, (self.classes, self.beside) = pieces.weights(), pieces.neighbours()
        self.known: dict[str, int] = {}

    def merges(self, part: str) -> int:
        n = self.known.get(part)
        if n is None:
            n = count_merges(part, self.rank)
            if len(part) <= KNOWN_LENGTH:
                if len(self.known) >= KNOWN_PARTS:
                    self.known.clear()
                self.known[part] = n
        return n

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the texts are laid out one after another, cut together, and each different part is counted once."""
        texts = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends, whole = np.cumsum(sizes), "".join(texts)
        if not whole:
            return sizes
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.beside[classes[:-1], classes[1:]]
        cut[ends] = True
        edges = np.flatnonzero(cut)
        places = np.zeros(len(codes) + 1, np.int64)  # in bytes
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=places[1:])
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(places[edges]), pa.py_buffer(whole.encode()))
        coded = parts.dictionary_encode()
        merges = np.fromiter(map(self.merges, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        total = np.zeros(len(codes) + 1, np.int64)
        total[1:] = self.weights[codes]
        total[edges[1:]] -= merges[coded.indices.to_numpy()]
        total = np.cumsum(total)
        return total[ends] - total[ends - sizes]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with a long column appended: the number of tokens that the model file at `path` gives a text.

    Begin, end and other special tokens are not added; their strings inside texts are ordinary text. Null and
    empty texts have 0. Other columns stay; a clashing name gets a suffix (`frames.fresh`).
    """
    pieces = Pieces.read(path)
    if len(pieces.rank) > 2_000_000:
        raise ValueError(f"{path}: {len(pieces.rank)} pieces are too many to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def make():
        counter = Counter(shared.value)

        def apply(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(counter(texts.to_pylist()), pa.int64())]

        return apply

    return map_text(df, text, make, [(out, T.LongType())], limit=SLICE)


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    counted = count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
