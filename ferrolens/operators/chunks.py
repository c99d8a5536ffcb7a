"""Documents to chunks. A document is walked in a task, slice by slice of documents; chunks keep their place."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 512, 128
SENTENCE_END = re.compile(r"[.!?。](?=\s|$)|\n")
SPACE = re.compile(r"\s")


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk: at most `size` characters, ending behind the last sentence or line in
    the second half, else behind the last white space there, else hard; the next one starts `overlap` back."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            middle = at + size // 2
            for pattern in (SENTENCE_END, SPACE):
                last = None
                for last in pattern.finditer(text, middle, end):
                    pass
                if last is not None:
                    end = last.end()
                    break
        yield at, end
        if end >= n:
            return
        at = max(end - overlap, at + 1)


def sections(text: str) -> Iterator[tuple[str, int, int]]:
    """(header path, start, end) of the parts between Markdown headers; an empty path before the first."""
    path: list[str] = []
    start = 0
    for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M):
        if text[start : m.start()].strip():
            yield " > ".join(x for x in path if x), start, m.start()
        level = len(m[1])
        path = [*path[: level - 1], *[""] * (level - 1 - len(path)), m[2].strip()]
        start = m.end()
    if text[start:].strip():
        yield " > ".join(x for x in path if x), start, len(text)


#: Chunks, and characters of them, that a task holds before it gives them on.
MOST_ROWS, MOST_CHARS = 4_000, 2_000_000

SCHEMA = "chunk_index int, text string, char_start int, char_end int, line_start int, line_end int, section string"


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, markdown: bool = False, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Chunks of (keys, text), with character offsets and lines; with `markdown` by section, each chunk
    led by its header path. Null and blank documents have no chunks."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    columns = [*keys, "chunk_index", "text", "char_start", "char_end", "line_start", "line_end", "section"]

    def chunks_of(key: list, text: str) -> Iterator[tuple]:
        k = 0
        seen, line = 0, 1  # the line of the character at `seen`
        for section, a, b in sections(text) if markdown else [("", 0, len(text))]:
            lead = f"[{section}]\n" if section else ""
            for s, e in cuts(text[a:b], max(64, size - len(lead)), overlap):
                part = text[a + s : a + e]
                if part.strip():
                    line, seen = line + text.count("\n", seen, a + s), a + s
                    yield (*key, k, lead + part, a + s, a + e, line, line + part.count("\n"), section)
                    k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        rows: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                kinds_ = dict(zip(columns[len(keys) :], (pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string()), strict=True))
                schema = pa.schema([(k, kinds_[k] if k in kinds_ else batch.schema.field(k).type) for k in columns])
            # one text after the other: neither all texts of a batch nor all their chunks are there as objects
            for *key, text in zip(*(batch.column(k) for k in keys), batch.column("text"), strict=True):
                text = text.as_py()
                if not text or not text.strip():
                    continue
                for row in chunks_of([k.as_py() for k in key], text):
                    rows.append(row)
                    held += len(row[len(keys) + 1]) + len(row[-1])
                    if len(rows) >= MOST_ROWS or held >= MOST_CHARS:
                        yield told()
                        rows, held = [], 0
        if rows:
            yield told()

    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, {SCHEMA}")


def sections_of(docs: DataFrame) -> DataFrame:
    """(document_id, place, section, text): the parts of documents (document_id, text) between Markdown headers, with their
    header path, empty before the first; blank parts don't count."""
    key = docs.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, section, text[a:b].strip()) for d, text in zip(batch["document_id"], batch["text"], strict=True) for i, (section, a, b) in enumerate(sections(text or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "place", "section", "text"])

    return docs.select("document_id", "text").mapInPandas(run, f"document_id {key}, place int, section string, text string")


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pages (document_id, page, text); no chunk goes over the edge of a page."""
    return chunk(pages, size, overlap, keys=("document_id", "page"))


def _by_group(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], out: str, make: Callable[[list], list[tuple]]) -> DataFrame:
    """make's rows for each group's rows in order (as records of the other columns). A group is a document or a page,
    which fits into a task, as it did when it was read; groups travel as arrays, many to a batch."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    rest = [*order, *(c for c in rows.columns if c not in keys and c not in order)]
    names = [*keys, *(c.split(" ")[0] for c in out.split(", "))]
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(*key, *r) for *key, some in zip(*(batch[k] for k in keys), batch["rows"], strict=True) for r in make(list(some))]
            yield pd.DataFrame(made, columns=names)

    return grouped.mapInPandas(run, f"{kinds}, {out}")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(document_id, place, text): the parts of documents between blank lines, trimmed."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("document_id", F.posexplode(parts).alias("place", "text"))


def chunk_semantic(paragraphs: DataFrame, threshold: float = 0.65, size: int = SIZE) -> DataFrame:
    """(document_id, chunk_index, text) from paragraphs (document_id, place, text, vector): a paragraph begins a chunk if
    its cosine with the one before is under the threshold, or the chunk would hold more than `size` characters."""
    w = Window.partitionBy("document_id").orderBy("place")
    v = F.transform("vector", lambda x: x.cast("double"))
    before = F.lag(v).over(w)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot(v, v)) * F.sqrt(dot(before, before))
    like = F.when(norms > 0, dot(v, before) / norms).otherwise(0.0)
    marked = paragraphs.select("document_id", "place", "text", like.alias("like"))

    def make(rows: list) -> list[tuple]:
        out: list[list[str]] = []
        held = 0
        for text, near in ((r["text"], r["like"]) for r in rows):
            if out and near >= threshold and held + len(text) <= size:
                out[-1].append(text)
                held += len(text) + 2
            else:
                out.append([text])
                held = len(text)
        return [(i, "\n\n".join(x)) for i, x in enumerate(out)]

    return _by_group(marked, ("document_id",), ("place",), "chunk_index int, text string", make)


LEAST_TOKENS, MOST_TOKENS, TOKEN_CHARS = 64, 512, 4


def repair_chunk_sizes(chunks: DataFrame, least: int = LEAST_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """(document_id, chunk_index, text) with chunks of a fair size: a short one joins the next, the last one the one
    before; a long one is cut by a sliding window that overlaps by half the least size. Tokens are four characters."""
    low, high = least * TOKEN_CHARS, most * TOKEN_CHARS

    def make(rows: list) -> list[tuple]:
        out: list[str] = []
        waiting = ""
        for text in (r["text"] or "" for r in rows):
            text = f"{waiting}\n\n{text}" if waiting else text
            waiting = text if len(text) < low else ""
            if not waiting:
                out += [text] if len(text) <= high else [text[a:b] for a, b in cuts(text, high, low // 2)]
        if waiting and out:
            out[-1] += f"\n\n{waiting}"
        elif waiting:
            out = [waiting]
        return list(enumerate(out))

    return _by_group(chunks.select("document_id", "chunk_index", "text"), ("document_id",), ("chunk_index",), "chunk_index int, text string", make)


def chunk_documents(docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_index, text, strategy): documents (document_id, text, is_markdown) by structure where they are
    Markdown, else by meaning where `vectors` (document_id, place, vector) of paragraphs are given, else by a sliding window."""
    names = ["document_id", "chunk_index", "text"]
    marked, plain = docs.filter("is_markdown"), docs.filter(~F.col("is_markdown"))
    parts = [(chunk(marked, markdown=True), "structure")]
    if vectors is None:
        parts.append((chunk(plain), "sliding"))
    else:
        parts.append((chunk_semantic(paragraphs(plain).join(vectors, ["document_id", "place"], "left")), "semantic"))
    first, second = (df.select(*names, F.lit(how).alias("strategy")) for df, how in parts)
    return first.unionByName(second)


def pack_batches(chunks: DataFrame, most: int = 1800) -> DataFrame:
    """(document_id, batch_index, text): consecutive chunks joined by a blank line while they fit; longer ones are cut to fit."""

    def make(rows: list) -> list[tuple]:
        out: list[str] = []
        for text in ((r["text"] or "")[:most] for r in rows):
            if out and out[-1] and len(out[-1]) + len(text) + 2 <= most:
                out[-1] += f"\n\n{text}"
            elif out and not out[-1]:
                out[-1] = text
            else:
                out.append(text)
        return list(enumerate(x for x in out if x))

    return _by_group(chunks.select("document_id", "chunk_index", "text"), ("document_id",), ("chunk_index",), "batch_index int, text string", make)


# -- tables ----------------------------------------------------------------------------------------

TABLE_ROW, TABLE_RULE = re.compile(r"^\|(.+)\|$"), re.compile(r"^\|[\s\-:|]+\|$")


def _flat(text: str | None) -> str | None:
    if not text or "|" not in text:
        return text
    lines, out = text.split("\n"), []
    header: list[str] | None = None
    cells = lambda line: [c.strip() for c in line.strip("|").split("|")]
    skip = False
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        bare = line.strip()
        if skip:
            skip = False
        elif header is not None and TABLE_ROW.match(bare) and not TABLE_RULE.match(bare):
            told = [f"{h}: {c}" for h, c in zip(header, cells(bare), strict=False) if c]
            out += [", ".join(told) + "."] if told else []
        elif TABLE_ROW.match(bare) and TABLE_RULE.match(after.strip()):
            header, skip = cells(bare), True
        else:
            header = None
            out.append(line)
    return "\n".join(out)


def flattened_text(text: Column | str) -> Column:
    """Markdown tables as sentences, a row each: 'Header: cell, Header: cell.'; other lines stay."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_flat, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(text)


def tables_from_words(words: DataFrame, row_gap: float = 3.0, column_gap: float = 20.0) -> DataFrame:
    """(document_id, page, table): a Markdown table for each page whose words (document_id, page, left, right, bottom, text)
    stand in columns: words within `row_gap` of a row's first are a row, wider gaps than `column_gap` part
    cells, and at least three rows share the most frequent number of cells (of equals the greatest), which is two or more."""

    def make(words: list) -> list[tuple]:
        rows: list[list] = []
        for w in words:
            if rows and abs(rows[-1][0]["bottom"] - w["bottom"]) < row_gap:
                rows[-1].append(w)
            else:
                rows.append([w])
        table: list[list[str]] = []
        for row in rows:
            row.sort(key=lambda w: w["left"])
            cells = [[row[0]["text"]]]
            for a, b in zip(row, row[1:], strict=False):
                if b["left"] - a["right"] > column_gap:
                    cells.append([])
                cells[-1].append(b["text"])
            table.append([" ".join(c) for c in cells])
        n, width = max((c, w) for w, c in Counter(map(len, table)).items())
        if width < 2 or n < 3:
            return []
        kept = [r for r in table if len(r) == width]
        return [("\n".join("| " + " | ".join(r) + " |" for r in (kept[0], ["---"] * width, *kept[1:])),)]

    placed = words.select("document_id", "page", (-F.col("bottom")).alias("down"), "left", "right", "bottom", "text")
    return _by_group(placed, ("document_id", "page"), ("down", "left"), "table string", make)


# -- figures ---------------------------------------------------------------------------------------

# What references and captions look like, and the kinds that they name.
REFERENCES = (
    r"(?i)(?P<type>그림|도면|사진)\s*(?P<id>\d+(?:[.\-]\d+)*)",
    r"(?i)(?P<type>표)\s*(?P<id>\d+(?:[.\-]\d+)*)",
    r"(?i)(?P<type>Figure|Fig|Diagram|Photo|Photograph)\.?\s*(?P<id>\d+(?:[.\-]\d+)*)",
    r"(?i)(?P<type>Table)\s*(?P<id>\d+(?:[.\-]\d+)*)",
)
CAPTIONS = (
    r"(?i)(?P<type>그림|도면|표|사진)\s*(?P<id>\d+(?:[.\-]\d+)*)\s*[:\-–—]\s*(?P<caption>[^\n]{3,80})",
    r"(?i)(?P<type>Figure|Fig|Table|Diagram|Photo)\.?\s*(?P<id>\d+(?:[.\-]\d+)*)\s*[:\-–—]\s*(?P<caption>[^\n]{3,80})",
)
FIGURE_KINDS = {"그림": "figure", "도면": "diagram", "사진": "photo", "표": "table", "diagram": "diagram", "photo": "photo", "photograph": "photo", "table": "table"}


def _figures(df: DataFrame, patterns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    compiled = [re.compile(p) for p in patterns]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "type", "id", "position", "caption"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text in zip(*(batch[k] for k in keys), batch["text"], strict=True):
                found: dict[int, tuple] = {}
                for p in compiled:
                    for m in p.finditer(text or ""):
                        told = m.groupdict().get("caption")
                        found.setdefault(m.start(), (FIGURE_KINDS.get(m["type"].lower(), "figure"), m["id"], m.start(), told.strip() if told else None))
                rows += [(*key, *found[at]) for at in sorted(found)]
            yield pd.DataFrame(rows, columns=columns).astype({"position": "int32"})

    return df.select(*keys, "text").mapInPandas(run, f"{kinds}, type string, id string, position int, caption string")


def figure_references(chunks: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """(keys, type, id, position) of references to figures, diagrams, photos and tables; one for each position."""
    return _figures(chunks, REFERENCES, keys).drop("caption")


def caption_map(docs: DataFrame) -> DataFrame:
    """(document_id, type, id, caption): the first caption of each figure of a document, ids without regard to case."""
    found = _figures(docs, CAPTIONS, ("document_id",)).filter("caption != ''")
    return found.groupBy("document_id", "type", F.lower("id").alias("id")).agg(F.min_by("caption", "position").alias("caption"))


def enrich_with_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """chunks (document_id, chunk_index, text) with the captions of the figures that they refer to behind their text, in order."""
    told = figure_references(chunks).withColumn("low", F.lower("id")).join(captions.select("document_id", "type", F.col("id").alias("low"), "caption"), ["document_id", "type", "low"])
    line = F.concat(F.lit("["), F.upper("type"), F.lit(" "), "id", F.lit(": "), "caption", F.lit("]"))
    lines = told.groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("told"))
    added = F.concat("text", F.lit("\n\n"), F.array_join(F.transform("told", lambda x: x["line"]), "\n"))
    return chunks.join(lines, ["document_id", "chunk_index"], "left").withColumn("text", F.coalesce(added, "text")).drop("told")


# -- causes ----------------------------------------------------------------------------------------


def causal_from_tables(chunks: DataFrame) -> DataFrame:
    """Rows | code | symptom | cause | action | of tables; rows without a cause don't count."""
    cell = r"\s*(.*?)\s*\|"
    pattern = rf"^\|\s*([A-Z]-?\d{{2,5}})\s*\|{cell}{cell}{cell}"
    line = chunks.select("document_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(pattern))
    names = ("error_code", "symptom", "cause", "action")
    return line.select("document_id", *(F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names))).filter("cause != ''").withColumn("confidence", F.lit(0.9))


# How texts name codes, symptoms, causes and actions.
CODE_LABELLED = r"(?i)(?:에러\s*코드|error\s*code|alarm\s*code|알람\s*코드|fault\s*code)\s*[:\-]?\s*([A-Z]-?\d{2,5}(?:\.\d+)?)"
CODE_ALONE = r"\b([A-Z]-?\d{3,5})\b"
LABELLED = {
    "symptom": r"(?im)(?:증상|현상|symptom|phenomenon|indication)\s*[:\-]\s*(.+?)(?:\n|$)",
    "cause": r"(?im)(?:원인|원인\s*분석|root\s*cause|cause|진단)\s*[:\-]\s*(.+?)(?:\n|$)",
    "action": r"(?im)(?:조치|조치\s*방법|대처|해결|corrective\s*action|action|resolution|remedy)\s*[:\-]\s*(.+?)(?:\n|$)",
}
CONDITIONAL = r"(?im)(?:if|when|인\s*경우|발생\s*시)\s+(.+?)\s*[,，]\s*(?:then|check|replace|교체|확인|점검)\s+(.+?)(?:\.|。|\n|$)"
CAUSAL = ("document_id", "error_code", "symptom", "cause", "action", "confidence")


def _matches(chunks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(document_id, chunk_index, kind, at, end, first, second): where each pattern matches, and its groups."""
    compiled = [(kind, re.compile(p)) for kind, p in patterns.items()]
    keys = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in ("document_id", "chunk_index"))
    columns = ["document_id", "chunk_index", "kind", "at", "end", "first", "second"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, c, kind, m.start(), m.end(), m[1].strip(), m[2].strip() if p.groups > 1 else None)
                for d, c, text in zip(batch["document_id"], batch["chunk_index"], batch["text"], strict=True)
                for kind, p in compiled
                for m in p.finditer(text or "")
            ]
            yield pd.DataFrame(rows, columns=columns)

    return chunks.select("document_id", "chunk_index", "text").mapInPandas(run, f"{keys}, kind string, at int, end int, first string, second string")


def causal_from_blocks(chunks: DataFrame) -> DataFrame:
    """Causes that chunks (document_id, chunk_index, text) label, each with the nearest code and symptom within 500 characters
    before it and the first action within 300 behind it; confidence 0.7 with a code, 0.5 without.

    The neighbours come from one sorted pass over a chunk's matches: the last code and symptom before, the next action behind.
    """
    found = _matches(chunks, {"code": CODE_LABELLED, "alone": CODE_ALONE, **LABELLED})
    # of a code that a label names too, standing alone doesn't count; nor does it again
    once = Window.partitionBy("document_id", "chunk_index", "first", F.col("kind").isin("code", "alone")).orderBy((F.col("kind") == "alone").cast("int"), "at")
    found = found.withColumn("k", F.row_number().over(once)).filter("kind != 'alone' or k = 1").withColumn("kind", F.when(F.col("kind") == "alone", "code").otherwise(F.col("kind")))
    w = Window.partitionBy("document_id", "chunk_index").orderBy("at")
    near = lambda kind, side, frame: side(F.when(F.col("kind") == kind, F.struct("at", "first")), ignorenulls=True).over(frame)
    before, behind = w.rangeBetween(-499, -1), w.rangeBetween(1, 299)
    found = found.withColumns({"code": near("code", F.last, before), "symptom_": near("symptom", F.last, before), "action_": near("action", F.first, behind)})
    code = F.col("code.first")
    return found.filter("kind = 'cause' and first != ''").select(
        "document_id", code.alias("error_code"), F.coalesce("symptom_.first", F.lit("")).alias("symptom"), F.col("first").alias("cause"), F.coalesce("action_.first", F.lit("")).alias("action"), F.when(code.isNotNull(), 0.7).otherwise(0.5).alias("confidence")
    )


def causal_from_conditionals(chunks: DataFrame) -> DataFrame:
    """Sentences "if X, then Y" as symptom and action without a cause, confidence 0.4, with the first code in the
    sentence or within 100 characters before it."""
    key = chunks.schema["document_id"].dataType.simpleString()
    sentence, code = re.compile(CONDITIONAL), re.compile(CODE_ALONE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text in zip(batch["document_id"], batch["text"], strict=True):
                for m in sentence.finditer(text or ""):
                    named = code.search(text[max(0, m.start() - 100) : m.end()])
                    if m[2].strip():
                        rows.append((d, named[1] if named else None, m[1].strip(), "", m[2].strip(), 0.4))
            yield pd.DataFrame(rows, columns=list(CAUSAL)).astype({"confidence": "float64"})

    return chunks.select("document_id", "text").mapInPandas(run, f"document_id {key}, error_code string, symptom string, cause string, action string, confidence double")


def extract_causal(chunks: DataFrame) -> DataFrame:
    """Tables, blocks and conditionals of chunks together; of entries alike in code and cause, without regard to case,
    a document keeps the one of the highest confidence (then the least symptom and action)."""
    found = causal_from_tables(chunks).select(*CAUSAL).unionByName(causal_from_blocks(chunks)).unionByName(causal_from_conditionals(chunks))
    w = Window.partitionBy("document_id", F.lower(F.coalesce("error_code", F.lit(""))), F.lower("cause")).orderBy(F.desc("confidence"), "symptom", "action")
    return found.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
