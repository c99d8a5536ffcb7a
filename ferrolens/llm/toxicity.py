"""Operator 5: toxicity scores after noisy-channel deobfuscation.

1. A character language model (4-grams over 30 classes) is counted over all documents.
2. Spans that may be disguised are found in numpy: tokens with a look-alike symbol next to a
   letter, tokens with a letter three times in a row, runs of single letters, and letters with
   separators between them; between spaces or separators a symbol counts like a letter, if
   the span has a letter at all. In every other token the lattice has one path, the token itself.
3. Each such span becomes a lattice: a symbol may stand for the letters it looks like, a run of one
   letter for one or two of it, a separator between letters for nothing. Viterbi decoding under
   the character model picks the best path.
4. The restored text is scored: a logistic regression over the rates of words and word prefixes,
   trained by FTRL with an L1 penalty that leaves few features with a weight.

Null, empty and blank texts have the bias alone, repeated texts score alike, and texts of any
length are decoded and scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import INK_BYTE, LOWER, WORD_BYTE, flat_bytes, mix, prefix_hash, span_hash, tokens
from ferrolens.llm.frames import collected, map_text, pick, slices, table, texts_of
from ferrolens.llm.ftrl import Ftrl, documents_and_labels, fit_in_one_task, fold, labelled_sample, sigmoid

#: Bits of the hashed feature space, and the lengths of word prefixes in bytes.
BITS, PREFIXES = 24, (3, 4, 5, 6, 7, 8)
#: Labelled rows that training reads at most; the parameter of the bounded sample.
TRAIN_ROWS = 8000
KNOWN_SPANS = 100_000

# Character classes: 0 space, 1-26 a-z, 27 other letters, 28 digits, 29 the rest.
CLASSES, ORDER = 30, 4
CLASS = np.full(256, 29, np.int64)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = 27
CLASS[0x30:0x3A] = 28
LETTER = (CLASS >= 1) & (CLASS <= 27)

# The letters that a symbol may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
SEPARATORS = " .-_*~"
# log10 costs of the channel: a symbol for a letter, a letter written more than once, a separator put in.
COST_SYMBOL, COST_WILD, COST_REPEAT, COST_SEPARATOR = -0.7, -2.0, -0.5, -0.2

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in LOOKS_LIKE]] = True
STRONG = np.zeros(256, bool)  # may also end a word; the others do so as punctuation
STRONG[[ord(c) for c in "0123456789@$"]] = True
JOINT = np.zeros(256, bool)
JOINT[[ord(c) for c in SEPARATORS]] = True


# -- the character model ---------------------------------------------------------------------------


def count_characters(documents: DataFrame) -> np.ndarray:
    """Counts of class 4-grams over all texts; tasks send what they have counted, at most 30**4 rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for piece in slices(batch, 0):
                data, bounds = flat_bytes(texts_of(piece.column(0)))
                # three spaces before each text and one after it
                sizes = np.diff(bounds)
                at = np.arange(len(data)) + np.repeat(3 * np.arange(1, len(sizes) + 1), sizes)
                line = np.zeros(len(data) + 3 * len(sizes) + 3, np.int64)
                line[at] = CLASS[data]
                key = line[:-3] * CLASSES + line[1:-2]
                key = (key * CLASSES + line[2:-1]) * CLASSES + line[3:]
                total += np.bincount(key, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["gram", "n"])

    rows = collected(pick(documents, text="text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    out = np.zeros(CLASSES**ORDER, np.int64)
    out[rows["gram"]] = rows["n"]
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | three classes before), each order smoothed towards the one below."""
    p = np.full(CLASSES, 1 / CLASSES)
    for n in range(1, ORDER + 1):
        c = counts.reshape((CLASSES ** (ORDER - n), *[CLASSES] * n)).sum(0).astype(float)
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log10(p).astype(np.float32).ravel()


# -- decoding --------------------------------------------------------------------------------------


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step through the span, what may have been meant, and its channel cost."""
    steps: list[list[tuple[str, float]]] = []
    i, n = 0, len(span)
    spaced = any(c.isspace() for c in span)  # single characters with spaces between them
    while i < n:
        c, j = span[i], i + 1
        while j < n and span[j] == c:
            j += 1
        follows = j < n and (spaced or not span[j].isspace())
        beside = i > 0 and follows and (spaced or not span[i - 1].isspace())
        if c.isalpha():
            run = j - i
            options = [(c * min(run, 2), 0.0)] if run < 3 else [(c, COST_REPEAT), (c * 2, COST_REPEAT), (c * run, 0.0)]
            steps.append([(c, COST_REPEAT), (c * 2, 0.0)] if run == 2 and len(set(span)) > 2 else options)
        else:
            for k in range(i, j):
                options = [(span[k], 0.0)]
                wild = c in "*#"
                if c in LOOKS_LIKE and (beside if wild else STRONG[ord(c)] or follows):
                    options += [(x, COST_WILD if wild else COST_SYMBOL) for x in LOOKS_LIKE[c]]
                if c in SEPARATORS and 0 < i and j < n:
                    options.append(("", COST_SEPARATOR))
                steps.append(options)
        i = j
    return steps


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest intended text of the span: Viterbi over the last three character classes."""
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    modulus = CLASSES ** (ORDER - 1)
    for options in [*lattice(span), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple]] = {}
        for state, (score, path) in best.items():
            for meant, cost in options:
                s, here = score + cost, state
                for c in meant:
                    k = ord(c)
                    here = here * CLASSES + (int(CLASS[k]) if k < 128 else 27 if c.isalpha() else 29)
                    s += float(model[here])
                    here %= modulus
                if here not in after or s > after[here][0]:
                    after[here] = (s, (path, meant))
        best = after
    _, path = max(best.values(), key=lambda x: x[0])
    out = []
    while path:
        path, meant = path
        out.append(meant)
    return "".join(reversed(out[1:]))


def suspects(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of spans that may be disguised, and the texts' offsets."""
    raw, bounds = flat_bytes(texts)
    data = LOWER[raw]
    starts, ends, owner = tokens(data, bounds, INK_BYTE)
    if not len(starts):
        return starts, ends, owner, bounds
    letter = LETTER[data]
    after, before = np.append(letter[1:], False), np.insert(letter[:-1], 0, False)
    odd = SYMBOL[data] & (after | STRONG[data] & before)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), starts) if len(starts) else np.zeros(0)
    n_letters, n_joints = total(letter & (data < 128)), total(JOINT[data] & (after & before))
    # a symbol between separators or spaces is taken like a letter
    like = letter & (data < 128) | SYMBOL[data] & ~JOINT[data]
    n_like, n_between = total(like), total(JOINT[data] & np.append(letter[1:] | like[1:], False) & np.insert(letter[:-1] | like[:-1], 0, False))
    pick_ = ((total(odd) > 0) & (n_letters > 0)) | (total(same) > 0) | ((n_letters >= 3) & (n_joints >= n_letters - 1)) | ((n_letters > 0) & (n_like >= 3) & (n_between >= n_like - 1))
    # runs of three or more tokens of one letter or symbol each, a letter among them
    single = (n_letters == 1) & (ends - starts <= 2) | (ends - starts == 1) & SYMBOL[data[starts]]
    edge = np.diff(np.concatenate([[0], (single & np.append(False, single[1:] & (owner[1:] == owner[:-1]))).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1  # the token before the first that follows a single one
    first = np.where(single[np.maximum(first, 0)] & (first >= 0), first, first + 1)
    summed = np.concatenate([[0], np.cumsum(n_letters)])
    long = (last - first >= 2) & (summed[last + 1] > summed[first])
    first, last = first[long], last[long]
    inside = np.zeros(len(starts) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    alone = pick_ & (np.cumsum(inside)[:-1] == 0)
    s = np.concatenate([starts[alone], starts[first]])
    order = np.argsort(s, kind="stable")
    return s[order], np.concatenate([ends[alone], ends[last]])[order], np.concatenate([owner[alone], owner[first]])[order], bounds


class Restorer:
    """Restores texts under a character model; spans met again are looked up."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def span(self, text: str) -> str:
        out = self.known.get(text)
        if out is None:
            if len(self.known) >= KNOWN_SPANS:
                self.known.clear()
            out = self.known[text] = decode(text, self.model)
        return out

    def texts(self, texts: pa.Array) -> pa.Array:
        starts, ends, owner, bounds = suspects(texts)
        if not len(starts):
            return texts
        raw = bytes(flat_bytes(texts)[0])
        bounds = bounds.tolist()
        parts, at = [], 0
        sizes = np.diff(bounds)
        for s, e, who in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
            span = raw[s:e].decode("utf-8").lower()
            new = self.span(re.sub(r"\s+", " ", span)).encode("utf-8")
            parts += [raw[at:s], new]
            sizes[who] += len(new) - (e - s)
            at = e
        parts.append(raw[at:])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if offsets[-1] < 1 << 31:
            return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(b"".join(parts)))
        raise ValueError("a slice of restored texts exceeds 2 GB")


def restore_text(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "restored") -> DataFrame:
    """df with the deobfuscated text appended. The model has 30**4 numbers: a bounded broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        restorer = Restorer(shared.value)
        return lambda texts: [restorer.texts(texts)]

    return map_text(df, text, make, [(out, T.StringType())])


# -- scoring ---------------------------------------------------------------------------------------


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed index and text number of every word and every proper word prefix of PREFIXES bytes,
    and the number of words of each text. Prefixes carry what inflected insults have in common."""
    data, bounds = flat_bytes(texts)
    data = LOWER[data]
    starts, ends, owner = tokens(data, bounds, WORD_BYTE)
    prefix = prefix_hash(data)
    hashes, owners = [span_hash(prefix, starts, ends)], [owner]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes.append(mix(span_hash(prefix, starts[longer], starts[longer] + n) + np.uint64(n)))
        owners.append(owner[longer])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def values(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What a feature is worth: its occurrences in a hundred words, 3 at most."""
    return np.minimum(100 * counts / n_words, 3.0)


def fit_toxicity(texts: pa.Array, labels: list[int], model: np.ndarray) -> bytes:
    """(feature index, weight) of the features that keep a weight; the first entry is the bias."""
    restorer = Restorer(model)
    index, value, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
    for piece in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
        at, owner, n_words = features(restorer.texts(piece.column(0)))
        keys, counts = np.unique(owner << BITS | at, return_counts=True)
        index.append((keys & ((1 << BITS) - 1)).astype(np.int32))
        value.append(values(counts, n_words[keys >> BITS]).astype(np.float32))
        sizes.append(np.bincount(keys >> BITS, minlength=piece.num_rows))
    index, value = np.concatenate(index), np.concatenate(value)
    used = np.zeros(1 << BITS, bool)
    used[index] = True
    vocabulary = np.flatnonzero(used)
    index = (np.cumsum(used, dtype=np.int32) - 1)[index]
    cut = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
    rows = [(index[a:b], value[a:b].astype(float)) for a, b in zip(cut, cut[1:], strict=False)]
    weights, bias = Ftrl(alpha=1.0, l1=2.0, l2=0.001, epochs=4).fit(rows, labels, len(vocabulary))
    kept = np.flatnonzero(weights)
    return np.concatenate([[-1], vocabulary[kept]]).astype(np.int64).tobytes() + np.concatenate([[bias], weights[kept]]).tobytes()


def train_toxicity(documents: DataFrame, labels: DataFrame, model: np.ndarray, most: int = TRAIN_ROWS) -> bytes:
    """Word weights from labels.toxic, of rows whose crc32(doc_id) mod 3 is not 1, `most` rows at most."""
    docs, marks = documents_and_labels(documents, labels, "toxic")
    sample = labelled_sample(docs, marks, "toxic", fold(F.col("id"), 3) != 1, most)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return fit_in_one_task(sample, lambda texts, y: fit_toxicity(texts.fill_null(""), y, shared.value))


def score_toxicity(df: DataFrame, model: np.ndarray, weights: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability that a text, once restored, is toxic."""
    shared = df.sparkSession.sparkContext.broadcast((model, weights))

    def make():
        model, packed = shared.value
        restorer = Restorer(model)
        n = len(packed) // 16
        keys, weight = np.frombuffer(packed[: 8 * n], np.int64), np.frombuffer(packed[8 * n :], np.float64)
        table_ = np.zeros(1 << BITS, bool)
        table_[keys[1:]] = True

        def apply(texts: pa.Array) -> list[pa.Array]:
            at, owner, n_words = features(restorer.texts(texts))
            hit = table_[at]
            found, counts = np.unique(owner[hit] << BITS | at[hit], return_counts=True)
            who = found >> BITS
            w = weight[1:][np.searchsorted(keys[1:], found & ((1 << BITS) - 1))] if len(found) else np.zeros(0)
            return [pa.array(sigmoid(np.bincount(who, w * values(counts, n_words[who]), minlength=len(texts)) + weight[0]))]

        return apply

    return map_text(df, text, make, [(out, T.DoubleType())], limit=1 << 20)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = character_model(count_characters(documents))
    weights = train_toxicity(documents, table(spark, sf_dir, "labels"), model)
    scored = score_toxicity(pick(documents, doc_id="doc_id", text="text"), model, weights)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
