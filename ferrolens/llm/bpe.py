"""Operator 8: BPE encoding and decoding by speculation and verification.

Words that a task has not met yet are encoded together:

1. Speculate: greedy longest match proposes a token sequence for each word.
2. Verify: a sequence is the exact BPE encoding if every adjacent pair of tokens is compatible,
   that is, if merging the two tokens' text alone would give those two tokens again. All pairs of
   all words are tested at once in numpy: both tokens are taken apart step by step along the
   merges that made them, and a merge across the seam that would have come first refutes the pair.
3. Repair: only words with a refuted pair go through exact merging.

The vocabulary (a bounded file of a public tokenizer) is read on the driver and broadcast.
Null, empty and blank texts have no tokens. Texts of any length are taken whole; memory is bound
by a slice of texts and by a table of known words that is emptied when it is full.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import prefix_hash, span_hash
from ferrolens.llm.frames import map_text, pick, table

#: Chunks between white space that a task keeps with their encodings.
KNOWN_CHUNKS = 300_000
#: Control characters at which str.split parts a text, though they aren't White_Space.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")
NEVER = np.int64(1) << 40
#: Characters from which on a word is merged without a proposal.
LONG = 512


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return letters


@dataclass
class Vocabulary:
    """What encoding needs of a tokenizer file: token strings, merges by rank, special tokens, pattern."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]  # left, right, whole, in order of rank
    special: dict[str, int]
    pattern: str
    suffix: str
    text_of: dict[int, str] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        tokens = [""] * (max(chain(ids.values(), (t["id"] for t in spec["added_tokens"]))) + 1)
        for token, i in ids.items():
            tokens[i] = token
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in special.items():
            tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special, split["pattern"]["Regex"], model.get("end_of_word_suffix") or "")


class Encoder:
    """Exact encodings of words and texts under a Vocabulary; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.v = v
        n = len(v.tokens)
        self.letters = byte_letters()
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys = np.empty(len(v.merges), np.int64)
        for r, (a, b, whole) in enumerate(v.merges):
            keys[r] = a << 32 | b
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, r
        self._hash_pairs(keys)
        self.merge = {(a, b): (r, whole) for r, (a, b, whole) in reversed(list(enumerate(v.merges)))}
        self.id_of = {t: i for i, t in enumerate(v.tokens) if t and t not in v.special}
        self._hash_tokens()
        # white space is what the pattern's \s means: Unicode's White_Space property
        self.pattern = regex.compile(v.pattern.replace(r"^\s", r"^\p{White_Space}"), regex.V0)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True))) if v.special else None
        self.forget()

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """A table of buckets over the merges' pairs, probed for whole arrays of pairs at once."""
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=1 << 18)
        self.deepest = int(counts.max())
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.pair_keys = np.append(keys[order], np.full(self.deepest, -1))
        self.pair_rank = np.append(order, np.full(self.deepest, NEVER))

    def _hash_tokens(self) -> None:
        """A table over the tokens' bytes; the hash of one that ends a word is one more."""
        byte_of = {c: b for b, c in self.letters.items()}
        suffix = self.v.suffix
        self.inner, self.final = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        self.reach = np.ones(1 << 16, np.int64)  # length of the longest token that begins with two bytes
        spelt, ends, ids = [], [], []
        for t, i in self.id_of.items():
            ends.append(bool(suffix) and t.endswith(suffix))
            spelt.append(bytes(byte_of[c] for c in (t.removesuffix(suffix) if ends[-1] else t)))
            ids.append(i)
            if len(spelt[-1]) == 1:
                (self.final if ends[-1] else self.inner)[spelt[-1][0]] = i
            else:
                k = spelt[-1][0] << 8 | spelt[-1][1]
                self.reach[k] = max(self.reach[k], len(spelt[-1]))
        if not suffix:
            self.final = self.inner
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
        hashes = span_hash(prefix_hash(np.frombuffer(b"".join(spelt), np.uint8)), bounds[:-1], bounds[1:])
        hashes, ids = (np.concatenate([hashes, hashes + np.uint64(1)]), np.tile(ids, 2)) if not suffix else (hashes + np.array(ends, np.uint64), np.array(ids))
        order = np.argsort(hashes, kind="stable")
        bucket = (hashes[order] >> np.uint64(46)).astype(np.int64)
        counts = np.bincount(bucket, minlength=1 << 18)
        self.token_deepest = int(counts.max())
        self.token_first = np.concatenate([[0], np.cumsum(counts)])
        self.token_hash = np.append(hashes[order], np.zeros(self.token_deepest, np.uint64))
        self.token_id = np.append(ids[order], np.full(self.token_deepest, -1))

    @staticmethod
    def _bucket(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def seam_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, NEVER where there is none."""
        keys = a << 32 | b
        at = self.first[self._bucket(keys)]
        out = np.full(keys.shape, NEVER)
        for k in range(self.deepest):
            hit = self.pair_keys[at + k] == keys
            out[hit] = self.pair_rank[at[hit] + k]
        return out

    def forget(self) -> None:
        self.words, self.chunks = Known(), Known()

    # -- words ---------------------------------------------------------------------------------

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest token first, from the left, for all words at once: ids, and offsets by word."""
        data, bounds = flat_words(words)
        prefix = prefix_hash(data)
        pairs = (data.astype(np.int64) << 8) | np.append(data[1:], np.uint8(0))
        at, end, word = bounds[:-1].copy(), bounds[1:], np.arange(len(words))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            room = end[word] - at
            reach = np.minimum(np.where(room > 1, self.reach[pairs[at]], 1), room)
            ids = np.full(len(word), -1, np.int64)
            step = np.ones(len(word), np.int64)
            open_ = np.arange(len(word))
            for n in range(int(reach.max()), 0, -1):
                some = open_[reach[open_] >= n]
                last = room[some] == n
                hit = self.token(span_hash(prefix, at[some], at[some] + n) + last.astype(np.uint64))
                fine = hit >= 0
                ids[some[fine]], step[some[fine]] = hit[fine], n
                open_ = open_[ids[open_] < 0]
                if not len(open_):
                    break
            if len(open_):
                raise ValueError(f"no token for byte {data[at[open_[0]]]}")
            found.append((word, ids))
            at = at + step
            go = at < end[word]
            at, word = at[go], word[go]
        owner = np.concatenate([w for w, _ in found])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([i for _, i in found])[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])

    def token(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the token with each hash, -1 where there is none."""
        at = self.token_first[(hashes >> np.uint64(46)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        for k in range(self.token_deepest):
            hit = self.token_hash[at + k] == hashes
            out[hit] = self.token_id[at[hit] + k]
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging: the adjacent pair of lowest rank first, leftmost among equals.

        Pairs wait in a heap, and parts are a linked list, so that n bytes take n log n steps.
        """
        data = word.encode("utf-8")
        parts = [*self.inner[np.frombuffer(data[:-1], np.uint8)].tolist(), int(self.final[data[-1]])]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merge]
        heapify(waiting)
        while waiting:
            _, i, a, b = heappop(waiting)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged otherwise
            parts[i], parts[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (parts[x], parts[y]) in self.merge:
                    heappush(waiting, (self.merge[parts[x], parts[y]][0], x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def merged_all(self, words: list[str]) -> list[list[int]]:
        """`merged` for many words at once: each round makes every word's next merge."""
        data, bounds = flat_words(words)
        first = self.inner[data]
        first[bounds[1:] - 1] = self.final[data[bounds[1:] - 1]]
        lengths = np.diff(bounds)
        order = np.argsort(lengths, kind="stable")
        out: list[list[int]] = [[]] * len(words)
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            upto = min(at + 20_000, int(np.searchsorted(lengths[order], width + 3, "right")))
            some = order[at:upto]
            width = int(lengths[some[-1]])
            if width > 64:  # a few very long words: rows of a table would be wide
                for i in some.tolist():
                    out[i] = self.merged(words[i])
            else:
                rows = np.full((len(some), width), -1, np.int64)
                inside = np.arange(width) < lengths[some][:, None]
                rows[inside] = first[(bounds[some][:, None] + np.arange(width))[inside]]
                for i, row, n in zip(some.tolist(), *self._merge_rows(rows, lengths[some]), strict=True):
                    out[i] = row[:n]
            at = upto
        return out

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[list[list[int]], list[int]]:
        n, width = rows.shape
        if width < 2:
            return rows.tolist(), sizes.tolist()
        rank = np.full((n, width), NEVER)
        inner = np.arange(width - 1) < sizes[:, None] - 1
        rank[:, :-1][inner] = self.seam_rank(rows[:, :-1][inner], rows[:, 1:][inner])
        whole = np.array([w for _, _, w in self.v.merges] or [0], np.int64)
        sizes, live = sizes.copy(), np.arange(n)
        columns = np.arange(width)
        while len(live):
            part, ranks = rows[live], rank[live]
            i = ranks.argmin(1)
            k = np.arange(len(live))
            best = ranks[k, i]
            go = best < NEVER
            live, part, ranks, i, best = live[go], part[go], ranks[go], i[go], best[go]
            if not len(live):
                break
            k = np.arange(len(live))
            move = np.minimum(columns + (columns > i[:, None]), width - 1)  # what stands behind moves up by one
            part, ranks = part[k[:, None], move], ranks[k[:, None], move]
            part[k, i] = whole[best]
            sizes[live] -= 1
            left = self.seam_rank(part[k, np.maximum(i - 1, 0)], part[k, i])
            ranks[k[i > 0], i[i > 0] - 1] = left[i > 0]
            more = i + 1 < sizes[live]
            right = self.seam_rank(part[k, i], part[k, np.minimum(i + 1, width - 1)])
            ranks[k, i] = np.where(more, right, NEVER)
            ranks[:, -1] = NEVER
            rows[live], rank[live] = part, ranks
        return rows.tolist(), sizes.tolist()

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of token a followed by that of token b gives a, b again.

        Undo the later of the two tokens' own merges, again and again, looking only at the pieces
        that touch at the seam. A merge over the seam refutes the pair if it ranks before the
        merge just undone on the left, or no later than the one just undone on the right
        (of equal merges the leftmost goes first).
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), NEVER)  # a seam merge of a rank below this would have come first
        while len(live):
            seam = self.seam_rank(a, b)
            bad = seam < until
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            # left undone: the pair must not merge before rank ra; right undone: nor at rank rb itself
            until = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words not met before. Very long ones, which would hold up the others' proposals, are merged at once."""
        endless = [w for w in words if len(w) > LONG]
        if endless:
            self.words.add(endless, *flat_lists([self.merged(w) for w in endless]))
            words = [w for w in words if len(w) <= LONG]
            if not words:
                return
        flat, bounds = self.greedy(words)
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(words)), sizes)
        seams = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, back = np.unique(flat[seams] << 32 | flat[seams + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.union1d(owner[seams[~fine]], owner[np.isin(flat, self.weak)])
        exact = self.merged_all([words[i] for i in failing.tolist()])
        good = np.setdiff1d(np.arange(len(words)), failing, assume_unique=True)
        self.words.add([words[i] for i in good.tolist()], flat[~np.isin(owner, failing)], sizes[good])
        self.words.add([words[i] for i in failing.tolist()], *flat_lists(exact))

    @cached_property
    def weak(self) -> np.ndarray:
        """Tokens that their own text doesn't merge into; a proposal that holds one is never trusted."""
        made = np.flatnonzero(self.rank >= 0)
        fine = self.compatible_halves(made)
        return made[~fine]

    def compatible_halves(self, made: np.ndarray) -> np.ndarray:
        """Whether nothing would have merged over the token's inner seam before the token's own merge."""
        a, b, until = self.left[made], self.right[made], self.rank[made]
        good, live = np.ones(len(made), bool), np.arange(len(made))
        limit = until.copy()
        while len(live):
            ra, rb = self.rank[a], self.rank[b]
            go = (ra >= 0) | (rb >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            seam = self.seam_rank(a, b)
            bad = seam < limit
            good[live[bad]] = False
            live, a, b = live[~bad], a[~bad], b[~bad]
        ends = np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])
        return good & (ends < self.rank[made])

    # -- texts ---------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Chunks of the text between white space, normalised; special tokens stand alone and unchanged."""
        if self.marks is not None and "<" in text and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += self.plain(text[at : m.start()])
                out.append(m.group())
                at = m.end()
            return out + self.plain(text[at:])
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # letter by letter: no final form
        text = text.lower()
        return SPACE.split(text) if SEPARATORS.search(text) else text.split()

    def meet(self, chunks: set[str]) -> None:
        """Encode chunks not met before, by way of their words."""
        chunks = list(chunks)
        parts = [[c] if c.isascii() and c.isalpha() or c in self.v.special else self.pattern.findall(c) for c in chunks]
        new = {w for p in parts for w in p}.difference(self.words.at)
        if special := [w for w in new if w in self.v.special]:
            self.words.add(special, *flat_lists([[self.v.special[w]] for w in special]))
        if plain := [w for w in new if w not in self.v.special]:
            self.learn(plain)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, offsets = self.words.gather(np.fromiter(map(self.words.at.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum())))
        self.chunks.add(chunks, ids, np.diff(offsets[np.concatenate([[0], np.cumsum(counts)])]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and n + 1 offsets."""
        split = [self.split(t) for t in texts]
        met = set(chain.from_iterable(split))
        new = met.difference(self.chunks.at)
        if len(self.chunks.at) + len(new) > KNOWN_CHUNKS:
            self.forget()
            new = met
        if new:
            self.meet(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        found = np.fromiter(map(self.chunks.at.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ids, offsets = self.chunks.gather(found)
        return ids, offsets[np.concatenate([[0], np.cumsum(counts)])]


class Known:
    """Encodings by string, in flat arrays."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.at)
        self.at.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of the numbered strings one after another, and the offsets between them."""
        sizes = self.starts[which + 1] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.arange(offsets[-1]) + np.repeat(self.starts[which] - offsets[:-1], sizes)], offsets


def flat_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Their UTF-8 bytes one after another, and the offsets between them."""
    spelt = [w.encode("utf-8") for w in words]
    return np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))])


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Decoder:
    """Texts from ids, special tokens kept. Without a decoder in the tokenizer file, as in
    word_bpe_49k.json, the tokens' own strings are joined by one space; `words=True` instead
    gives readable text: bytes restored, words apart."""

    def __init__(self, vocabulary: Vocabulary, words: bool = False):
        self.strings = vocabulary.tokens
        self.words, self.suffix = words, vocabulary.suffix
        self.byte_of = {c: b for b, c in byte_letters().items()}

    def decode(self, ids: list[int]) -> str:
        if not self.words:
            return " ".join(map(self.strings.__getitem__, ids))
        spelt = "".join(map(self.strings.__getitem__, ids)).split(self.suffix)
        return " ".join(bytes(self.byte_of[c] for c in w if c in self.byte_of).decode("utf-8", "replace") for w in spelt).rstrip(" ")


def _vocabulary(spark: SparkSession, path: str):
    v = Vocabulary.read(path)
    if len(v.tokens) > 2_000_000:
        raise ValueError(f"{path}: {len(v.tokens)} tokens are too many to broadcast")
    return spark.sparkContext.broadcast(v)


def encode_bpe(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with an array<int> of token ids appended, as the tokenizer file at `path` gives them.

    Null and empty texts have an empty array. Other columns stay; a clashing name gets a suffix.
    """
    shared = _vocabulary(df.sparkSession, path)

    def make():
        encoder = Encoder(shared.value)

        def apply(texts: pa.Array) -> list[pa.Array]:
            ids, offsets = encoder.encode(texts.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return apply

    return map_text(df, text, make, [(out, T.ArrayType(T.IntegerType()))])


def decode_bpe(df: DataFrame, path: str, ids: Column | str = "ids", out: str = "decoded", words: bool = False) -> DataFrame:
    """df with the decoded text of an array<int> column appended; null decodes as empty."""
    shared = _vocabulary(df.sparkSession, path)

    @F.pandas_udf(T.StringType())
    def decoded(column):
        decoder = Decoder(shared.value, words)
        return column.map(lambda x: "" if x is None else decoder.decode(x.tolist()))

    return df.withColumn(out, decoded(ids))


def roundtrip_bpe(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode_bpe and decode_bpe in one pass over the texts: ids, and the text that the ids decode to."""
    shared = _vocabulary(df.sparkSession, path)

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def apply(texts: pa.Array) -> list[pa.Array]:
            flat, offsets = encoder.encode(texts.to_pylist())
            strings = decoder.strings
            spelt = list(map(strings.__getitem__, flat.tolist()))
            bounds = offsets.tolist()
            back = [" ".join(spelt[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), pa.array(back, pa.string())]

        return apply

    return map_text(df, text, make, [(ids, T.ArrayType(T.IntegerType())), (out, T.StringType())], limit=1 << 20)


def digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    coded = roundtrip_bpe(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
