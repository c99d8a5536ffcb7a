"""Burrows-Wheeler transform and common prefixes of a collection of strings, built by columns.

Round j inserts one symbol of every string, the one before its suffix of j symbols, into the
transform of all shorter suffixes. Transform and common prefixes are two sequential files: a round
reads them from front to back in chunks, finds for each string where its symbol's new suffix goes
and what it shares with its neighbours, then writes both files anew with the symbols inserted.
In memory are a chunk and a few numbers for each string.

The files are scratch of the task that builds the collection, like a sort's spill: they live as
long as the call and nothing else reads them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
SYMBOLS = 256  # 0 ends a string; the bytes that occur are 1, 2, ... in their order
MOST = 255  # common prefixes are counted up to here


@dataclass
class Collection:
    """Suffixes of all strings in order: string, length, and common prefix with the one before."""

    string: np.ndarray
    length: np.ndarray
    common: np.ndarray


class _File:
    """The file of a round: pairs of a symbol and a common prefix, a byte each, one after another."""

    def __init__(self, folder: str, name: str):
        self.handle = open(os.path.join(folder, name), "w+b")  # noqa: SIM115
        self.rows = 0

    def rewrite(self, parts: Iterator[np.ndarray]) -> None:
        self.handle.seek(0)
        self.rows = 0
        for part in parts:
            part.tofile(self.handle)
            self.rows += len(part)
        self.handle.flush()

    def chunks(self, size: int) -> Iterator[tuple[int, np.ndarray]]:
        self.handle.seek(0)
        for start in range(0, self.rows, size):
            yield start, np.fromfile(self.handle, np.uint16, min(size, self.rows - start))


def pairs(symbols: np.ndarray, common: np.ndarray) -> np.ndarray:
    return symbols.astype(np.uint16) | common.astype(np.uint16) << np.uint16(8)


def build(data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK) -> Collection:
    """Of the strings data[bounds[i]:bounds[i + 1]] (uint8). Equal suffixes follow in the order of the strings.

    At most 255 different bytes may occur (in UTF-8 no more than 243 can).
    """
    m = len(bounds) - 1
    lengths = np.diff(bounds)
    occur = np.bincount(data, minlength=256) > 0
    if occur.sum() > 255:
        raise ValueError("more than 255 different bytes")
    data = np.cumsum(occur).astype(np.uint8)[data]
    ends = bounds[1:]
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        file, other = _File(folder, "a"), _File(folder, "b")
        last = np.zeros(m, np.uint8)
        some = lengths > 0
        last[some] = data[ends[some] - 1]
        file.rewrite(iter([pairs(last, np.zeros(m))]))
        totals = np.bincount(last, minlength=SYMBOLS)
        live = np.flatnonzero(some)  # strings whose symbol of the last round is yet to become a suffix
        at, symbol = live.copy(), last[live]  # where that symbol stands, and what it is
        for j in range(1, int(lengths.max(initial=0)) + 1):
            base = m + np.concatenate([[0], np.cumsum(totals[1:])])  # first row of the suffixes that begin with symbol 1, 2, ...
            order = np.argsort(at, kind="stable")
            live, at, symbol = live[order], at[order], symbol[order]
            rows, common, changed = _places(file, at, base, totals, chunk)
            before = np.zeros(len(live), np.uint8)
            more = lengths[live] > j
            before[more] = data[ends[live[more]] - 1 - j]
            other.rewrite(_insert(file, rows, before, common, changed, chunk))
            file, other = other, file
            totals = totals + np.bincount(before, minlength=SYMBOLS)
            live, at, symbol = live[more], rows[more], before[more]
        final = np.concatenate([np.zeros(0, np.uint16), *(x for _, x in file.chunks(chunk))])
        file.handle.close()
        other.handle.close()
    return _named((final & 255).astype(np.uint8), final >> 8, m, int(lengths.max(initial=0)))


def _places(file: _File, at: np.ndarray, base: np.ndarray, totals: np.ndarray, chunk: int):
    """Rows and common prefixes of the new suffixes (in the order of `at`), and the changed common
    prefixes (rows, values) of the suffixes behind them."""
    rows, common = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    changed_rows, changed = [], []
    seen = np.zeros(SYMBOLS, np.int64)
    had, asked = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
    lowest = np.full(SYMBOLS, MOST, np.int64)  # least common prefix since the symbol's last place
    total = int(totals.sum())
    for start, x in file.chunks(chunk):
        b = (x & np.uint16(255)).astype(np.uint8)
        h = np.full(len(x) + 1, MOST, np.uint8)
        h[:-1] = x >> np.uint16(8)
        lo, hi = np.searchsorted(at, [start, start + len(b)])
        query = np.zeros(len(b), bool)
        query[at[lo:hi] - start] = True
        order = np.argsort(b, kind="stable")
        counts = totals if len(b) == total else np.bincount(b, minlength=SYMBOLS)
        firsts = np.cumsum(counts) - counts
        # places, in the order by symbol, of the asked ones and of those that follow an asked one
        mine = np.flatnonzero(query[order])
        t = np.sort(np.concatenate([mine, mine + 1, firsts[asked & (counts > 0)]]), kind="stable")
        t = t[(np.append(t[1:], -1) != t) & (t < len(b))]
        s = np.searchsorted(firsts, t, "right") - 1
        while len(wrong := np.flatnonzero(counts[s] == 0)):
            s[wrong] -= 1
        p = order[t]
        mine = query[p]
        same = t > firsts[s]
        exists = same | had[s]
        follows = np.where(same, query[order[t - 1]], asked[s])
        fit = (mine | follows) & (s > 0)
        t, s, p, mine, same, exists = t[fit], s[fit], p[fit], mine[fit], same[fit], exists[fit]
        back = np.argsort(p, kind="stable")[::-1]  # from back to front, so that the ranges below touch each other at most
        t, s, p, mine, same, exists = t[back], s[back], p[back], mine[back], same[back], exists[back]
        left = np.where(same, order[t - 1] + 1, 0)
        low = np.minimum.reduceat(h, np.stack([left, p + 1], 1).ravel())[::2].astype(np.int64) if len(t) else np.zeros(0, np.int64)
        low = np.where(same, low, np.minimum(low, lowest[s]))
        share = np.where(exists, np.minimum(low + 1, MOST), 0)
        row = base[s - 1] + seen[s] + t - firsts[s]
        k = np.searchsorted(at, p[mine] + start)
        rows[k], common[k] = row[mine], share[mine]
        behind = ~mine & exists
        changed_rows.append(row[behind])
        changed.append(share[behind])
        if len(b) == chunk:  # what the next chunk needs to know
            present = np.flatnonzero(counts)
            final = order[firsts[present] + counts[present] - 1]
            tail = np.minimum.accumulate(h[::-1])[::-1].astype(np.int64)
            lowest = np.minimum(lowest, tail[0])
            lowest[present] = tail[final + 1]
            had[present], asked[present] = True, query[final]
            seen += counts
    return rows, common, (np.concatenate([np.zeros(0, np.int64), *changed_rows]), np.concatenate([np.zeros(0, np.int64), *changed]))


def _insert(old: _File, rows: np.ndarray, symbols: np.ndarray, common: np.ndarray, changed, chunk: int) -> Iterator[np.ndarray]:
    """The old file's rows with the new rows (places among all) put in, chunk by chunk."""
    order = np.argsort(rows, kind="stable")
    rows, put = rows[order], pairs(symbols[order], common[order])
    order = np.argsort(changed[0], kind="stable")
    changed_rows, changed_values = changed[0][order], changed[1][order].astype(np.uint8)
    gaps = rows - np.arange(len(rows))  # how many old rows stand before each new one
    written = end = 0
    for start, x in old.chunks(chunk):
        end = start + len(x)
        lo, hi = np.searchsorted(gaps, [start, end])
        out = np.insert(x, gaps[lo:hi] - start, put[lo:hi])
        c, d = np.searchsorted(changed_rows, [written, written + len(out)])
        out.view(np.uint8)[2 * (changed_rows[c:d] - written) + 1] = changed_values[c:d]  # little-endian: the second byte
        yield out
        written += len(out)
    yield put[np.searchsorted(gaps, end) :]


def _named(symbols: np.ndarray, common: np.ndarray, m: int, longest: int) -> Collection:
    """Which string's suffix each row is: every string's suffixes are walked from the shortest on."""
    order = np.argsort(symbols, kind="stable")
    zeros = int((symbols == 0).sum())
    forward = np.zeros(len(symbols), np.int64)  # row of the suffix that is one symbol longer
    forward[order[zeros:]] = np.arange(m, len(symbols))
    string, length = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    rows, who = np.arange(m), np.arange(m)
    string[:m] = who
    for n in range(1, longest + 1):
        go = symbols[rows] > 0
        rows, who = forward[rows[go]], who[go]
        string[rows], length[rows] = who, n
    return Collection(string, length, common.astype(np.int64))
