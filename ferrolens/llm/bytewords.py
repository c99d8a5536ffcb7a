"""Vectorised tokenising and hashing of UTF-8 texts held as one byte array.

A token's 64-bit hash is a polynomial in an odd base over a random table of byte values, taken
from prefix sums, so that the hash of every token of a slice costs a few array passes. A polynomial modulo
2**64 has built-in collisions between long strings of a certain form (from 1,024 bytes on), so `words` hashes
tokens of over LONG bytes by BLAKE2 instead. Two different tokens share a hash with probability about
2**-64; operators that need certainty compare bytes afterwards.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of the longest token that is hashed by prefix sums.
LONG = 256
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if size <= 1 << 23:
            _powers[name] = held
    return held[:n]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 offsets between them."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: 0-9, a-z after lower-casing, and all of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

#: Bytes of tokens between white space.
INK_BYTE = np.ones(256, bool)
INK_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of value(byte) * BASE**position over the first k bytes, for k from 0 to n."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * _power("up", BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), by content and length alone."""
    down = _power("down", BASE_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def tokens(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) and text numbers of the maximal runs of member bytes within texts."""
    ink = np.zeros(len(data) + 2, np.int8)
    ink[1:-1] = member[data]
    step = np.diff(ink)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(bounds[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[(ink[inner] == 1) & (ink[inner + 1] == 1)]  # a run goes over the edge of a text
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def words(texts: pa.Array, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) tokens: hash, text number, start, end within the slice, and the texts' offsets."""
    data, bounds = flat_bytes(texts)
    data = LOWER[data]
    starts, ends, owner = tokens(data, bounds, member)
    hashes = span_hash(prefix_hash(data), starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = np.frombuffer(blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "<u8")[0]
    return hashes, owner, starts, ends, bounds


def ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n consecutive tokens of one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(m, U)
    for k in range(n):
        out *= BASE
        out += hashes[k : k + m]
    whole = owner[:m] == owner[n - 1 : n - 1 + m]
    return mix(out[whole]), owner[:m][whole]
