"""Operator 10: license scans by winnowed fingerprints and banded alignment.

1. Templates are read as words; of the hashes of their K-word sequences, the least of every W
   neighbours is kept (winnowing), all of them for short templates. These fingerprints form an
   inverted index: hash -> (template, place). Templates are few and their size is checked, so the
   index is broadcast.
2. Every K-word sequence of every document is looked up. A shared run of W + K - 1 words always
   meets a fingerprint. Hits of one template on neighbouring diagonals make a candidate.
3. Each candidate is aligned with its template in a band around its diagonals (local alignment;
   match 1, mismatch and gap -1), which gives the covered share of the template and the span. What lies before and behind a match is
   aligned again, until nothing is left that reaches the coverage.

A match needs `coverage` of the template's words. Null, empty and wordless texts have no matches; a
document may have many, also of one template. Repeated rows are scanned each for itself. Texts are
scanned whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import U, ngrams, words
from ferrolens.llm.frames import map_text, pick, table

K, W, BAND = 3, 4, 6
COVERAGE = 0.8
#: Words that all templates may have together; their index is broadcast.
MOST_WORDS = 2_000_000

# Notices and texts of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the least hash (the last of equals) of every w neighbours."""
    if len(hashes) <= w:
        return np.arange(len(hashes))
    rows = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(len(rows)) + w - 1 - rows.argmin(1))


@dataclass
class Index:
    """Fingerprints in order of their hash, with template and place."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        names, texts = list(templates), list(templates.values())
        h, owner, *_ = words(pa.array(texts, pa.string()))
        if len(h) > MOST_WORDS:
            raise ValueError(f"templates of {len(h)} words; {MOST_WORDS} may be broadcast")
        each = [h[owner == i] for i in range(len(names))]
        hashes, template, place = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, x in enumerate(each):
            grams, _ = ngrams(x, np.zeros(len(x), np.int64), min(K, max(len(x), 1)))
            at = winnow(grams) if len(grams) == max(len(x) - K + 1, 0) else np.zeros(0, np.int64)  # under K words: no fingerprint
            hashes.append(grams[at])
            template.append(np.full(len(at), i))
            place.append(at)
        h, t, p = np.concatenate(hashes), np.concatenate(template), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        return cls(names, each, h[order], t[order], p[order])


def align(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """Best local alignment of template a with words b, on diagonals j - i from lo to hi.

    Returns matched words, and first and behind-last place in b.
    """
    width = hi - lo + 1
    n = len(a)
    score = np.zeros((n + 1, width + 2), np.int64)
    step = np.zeros((n + 1, width + 2), np.int8)  # 1 diagonal, 2 up (gap in b), 3 left (gap in a)
    diagonals = np.arange(lo, hi + 1)
    for i in range(1, n + 1):
        j = i - 1 + diagonals  # place in b that this row's cells meet
        inside = (j >= 0) & (j < len(b))
        same = np.zeros(width, bool)
        same[inside] = b[j[inside]] == a[i - 1]
        diagonal = np.where(inside, score[i - 1, 1 : width + 1] + np.where(same, 1, -1), 0)
        up = score[i - 1, 2 : width + 2] - 1
        best = np.maximum(np.maximum(diagonal, up), 0)
        kind = np.where(best == 0, 0, np.where(best == diagonal, 1, 2))
        run = np.maximum.accumulate(best + np.arange(width)) - np.arange(width)  # gaps in a run along the row
        kind[run > best] = 3
        score[i, 1 : width + 1], step[i, 1 : width + 1] = run, kind
    # of several ends that are as good, the middle one: what is left on both sides is aligned again
    ends = np.flatnonzero(score == score.max())
    i, k = np.unravel_index(ends[len(ends) // 2], score.shape)
    matched, last, first = 0, int(i - 1 + lo + k - 1), 0
    while i > 0 and step[i, k]:
        j = int(i - 1 + lo + k - 1)
        if step[i, k] == 1:
            matched += int(b[j] == a[i - 1])
            first, i = j, i - 1
        elif step[i, k] == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return matched, first, last + 1


def alignments(a: np.ndarray, b: np.ndarray, lo: int, hi: int, coverage: float) -> list[tuple[int, int, int]]:
    """Matched words and places in b of all matches of template a that reach the coverage; none overlap."""
    out, todo = [], [(0, len(b))]
    while todo:
        x, y = todo.pop()
        left, right = max(lo - x, 1 - len(a)), min(hi - x, y - x - 1)
        if y - x < coverage * len(a) or left > right:
            continue
        matched, s, e = align(a, b[x:y], left, right)
        if matched and matched / len(a) >= coverage:
            out.append((matched, x + s, x + e))
            todo += [(x, x + s), (x + e, y)]
    return out


MATCHES = T.ArrayType(
    T.StructType(
        [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())] + [T.StructField(n, T.LongType()) for n in ("start", "end", "byte_start", "byte_end")]
    )
)
ARROW = pa.struct([("license", pa.string()), ("coverage", pa.float64()), *((n, pa.int64()) for n in ("start", "end", "byte_start", "byte_end"))])


def scan(texts: pa.Array, index: Index, coverage: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Numbers of words, and the matches of each text by place."""
    h, owner, starts, ends, bounds = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    grams, _ = ngrams(h, np.zeros(len(h), np.int64), K)
    if not len(grams) or not len(index.hashes):
        return counts, found
    begin = np.cumsum(counts) - counts
    lo, hi = np.searchsorted(index.hashes, grams, "left"), np.searchsorted(index.hashes, grams, "right")
    at = np.flatnonzero((hi > lo) & (owner[: len(grams)] == owner[K - 1 :]))
    if not len(at):
        return counts, found
    n = (hi - lo)[at]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at], n)
    spot = np.repeat(at, n)
    template, diagonal = index.template[entry], spot - index.place[entry]
    order = np.lexsort((diagonal, template, owner[spot]))
    spot, template, diagonal = spot[order], template[order], diagonal[order]
    who = owner[spot]
    new = np.ones(len(spot), bool)
    new[1:] = (who[1:] != who[:-1]) | (template[1:] != template[:-1]) | (np.diff(diagonal) > BAND)
    firsts = np.flatnonzero(new)
    for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(spot)).tolist(), strict=True):
        i, t = int(who[a]), int(template[a])
        text = h[begin[i] : begin[i] + counts[i]]
        left = int(diagonal[a] - begin[i]) - BAND  # the band, in places of this text
        right = int(diagonal[b - 1] - begin[i]) + BAND
        offset = max(left, 0)
        part = text[offset : max(right, 0) + len(index.words[t])]
        for matched, s, e in alignments(index.words[t], part, left - offset, right - offset, coverage):
            s, e = s + offset, e + offset
            g = int(begin[i])
            found[i].append({"license": index.names[t], "coverage": matched / len(index.words[t]), "start": s, "end": e, "byte_start": int(starts[g + s] - bounds[i]), "byte_end": int(ends[g + e - 1] - bounds[i])})
    for matches in found:
        matches.sort(key=lambda m: (m["start"], m["end"], m["license"]))
    return counts, found


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """df with n_words and matches appended (fresh names): license, coverage, span in words and bytes."""
    shared = df.sparkSession.sparkContext.broadcast(Index.of(TEMPLATES if templates is None else templates))

    def make():
        def apply(texts: pa.Array) -> list[pa.Array]:
            counts, found = scan(texts, shared.value, coverage)
            return [pa.array(counts.astype(np.int64)), pa.array(found, pa.list_(ARROW))]

        return apply

    return map_text(df, text, make, [("n_words", T.LongType()), ("matches", MATCHES)])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    best = F.array_max(F.transform("matches", lambda m: F.struct((m["end"] - m["start"]).alias("n"), m["coverage"].alias("coverage"), m["license"].alias("license"))))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), "matches")
