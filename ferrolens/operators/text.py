"""Query preparation, redaction and answer checks: column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules of intents, first match wins.
INTENTS = [
    ("Error", "알람|에러|오류|alarm|error|fault|A[0-9]{2,3}|E[0-9]{2,3}|경고|warning"),
    ("Procedure", r"절차|방법|교체|조치|순서|단계|설치|분해|how\s*to|procedure|replace|install|step"),
    ("Part", "부품|소모품|수명|교환|파트|컨디셔너|패드|리테이너|링|part|consumable|lifetime|lifespan"),
    ("Definition", r"정의|무엇|뜻|의미|개념|what\s+is|define|definition|meaning"),
    ("Spec", "사양|규격|범위|스펙|파라미터|설정값|spec|specification|parameter|range|threshold"),
    ("Comparison", r"비교|차이|다른점|대비|versus|vs\.?|compare|comparison|differ"),
]
# Kinds of documents that suit an intent.
PREFERRED = {
    "Error": ["alarm", "troubleshooting", "error"],
    "Procedure": ["procedure", "troubleshooting", "maintenance"],
    "Part": ["maintenance", "parts", "consumable"],
    "Definition": ["overview", "glossary", "definition"],
    "Spec": ["specification", "parameter", "spec"],
}
# Characters that are no part of a keyword.
PARTICLES = r"[은는이가을를의에서로부터까지와과도만요인가요습니까세요죠나요?!.,\s]+"
# Kinds of documents by words of their name, first match wins.
DOC_TYPES = [
    ("alarm", ["alarm", "error", "fault"]),
    ("troubleshooting", ["troubleshoot", "진단", "조치"]),
    ("maintenance", ["maintenance", "유지보수", "점검"]),
    ("procedure", ["procedure", "절차", "교체"]),
    ("specification", ["spec", "사양", "parameter", "파라미터"]),
    ("overview", ["overview", "개요", "소개"]),
    ("glossary", ["glossary", "용어"]),
    ("parts", ["part", "부품", "consumable", "소모품"]),
]
# Folder names that say nothing.
GENERIC_FOLDERS = ["docs", "doc", "documents", "src", "source", "resources", "res", "assets", "data", "files", "content", "static", "public", "lib"]
# Patterns of sensitive text, and what stands in their place.
SENSITIVE = {
    "yield": (r"\byield\s*[:=]?\s*\d+\.?\d*\s*%", "[YIELD_REDACTED]"),
    "recipe": (r"\b(recipe|RCP)[-_]?[A-Z0-9]{3,}[-_]?[A-Z0-9]*\b", "[RECIPE_REDACTED]"),
    "lot": (r"\b(LOT|BATCH|WF)[-_]?[A-Z0-9]{4,}\b", "[LOT_REDACTED]"),
    "employee": (r"\b(EMP|사번)[-_]?\d{4,}\b", "[EMPLOYEE_REDACTED]"),
    "ip": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_REDACTED]"),
    "parameter": (r"\b(target\s+thickness|film\s+thickness|etch\s+depth|deposition\s+rate)\s*[:=]\s*[\d.]+\s*(nm|μm|Å|angstrom)", "[PARAM_REDACTED]"),
}
EQUIPMENT_ID = r"\b(?:CMP|ETCH|CVD|PVD|DIFF|LITHO|IMP|CDS|WET)[-_]?\d{1,4}\b"
# Log fields whose values are hashed.
HASHED_FIELDS = ["query", "userquery", "rawquery", "searchquery", "userid", "username", "password", "token", "apikey", "secret"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def intent(text: Column | str) -> Column:
    out = F.lit("General")
    for name, pattern in reversed(INTENTS):
        out = F.when(_c(text).rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def preferred_types(of_intent: Column | str) -> Column:
    """Kinds of documents for an intent; null for those without a preference."""
    kinds = (F.when(_c(of_intent) == k, F.array(*map(F.lit, v))) for k, v in PREFERRED.items())
    return F.get(F.array_compact(F.array(*kinds)), F.lit(0))


def keywords(text: Column | str) -> Column:
    words = F.split(F.regexp_replace(_c(text), PARTICLES, " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def unchanged_ratio(before: Column | str, after: Column | str) -> Column:
    """Share of the words of `before` that `after` has too; 1 if nothing changed."""
    split = lambda c: F.filter(F.split(_c(c), r"\s+"), lambda w: w != "")
    a, b = split(before), split(after)
    kept = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    return F.when(_c(before) == _c(after), 1.0).when(F.size(a) == 0, 1.0).otherwise(kept / F.size(a))


def request_key(equipment: Column | str, of_intent: Column | str, text: Column | str) -> Column:
    """Key for the reuse of results: 16 hex digits of the SHA-256 of equipment, intent and normalised query."""
    normal = F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))
    return F.upper(F.substring(F.sha2(F.concat_ws("|", _c(equipment), _c(of_intent), normal), 256), 1, 16))


def split_cached(requests: DataFrame, cache: DataFrame, now: Column, hours: float = 24) -> tuple[DataFrame, DataFrame]:
    """Requests (key) whose results (key, stored_at) are younger than `hours`, and all others."""
    fresh = cache.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp")) < int(hours * 3600e6)).select("key")
    return requests.join(fresh, "key", "left_semi"), requests.join(fresh, "key", "left_anti")


def sub_questions(response: Column | str) -> Column:
    """Strings of the JSON array in a model's response, from the first [ to the last ]; empty if there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(_c(response), r"(?s)(\[.*\])", 1), "array<string>"), F.array().cast("array<string>"))


# -- documents -------------------------------------------------------------------------------------


def folder_tags(path: Column | str) -> Column:
    parts = F.filter(F.split(F.lower(F.regexp_replace(_c(path), r"\\", "/")), "/"), lambda p: p != "")
    return F.filter(F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda p: ~p.isin(GENERIC_FOLDERS))


def _type_of_name(name: Column) -> Column:
    out = F.lit("general")
    for kind, words in reversed(DOC_TYPES):
        out = F.when(name.rlike("|".join(words)), kind).otherwise(out)
    return out


def doc_type(path: Column | str) -> Column:
    """Kind of document by its path as a whole, else by the first telling folder."""
    by_folder = F.filter(F.transform(folder_tags(path), _type_of_name), lambda t: t != "general")
    own = _type_of_name(F.lower(_c(path)))
    return F.when(own != "general", own).otherwise(F.coalesce(F.get(by_folder, F.lit(0)), F.lit("general")))


def highlight_type(text: Column | str) -> Column:
    lines = F.split(F.coalesce(_c(text), F.lit("")), "\n")
    piped = F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3))
    return F.when(piped >= 3, "table").when(F.lower(_c(text)).rlike(r"\[image\]|<<image>>|\[그림\]|\[figure\]|\[사진\]"), "image").otherwise("text")


def language(text: Column | str) -> Column:
    """'ko' if more than half of the Hangul and Latin letters are Hangul, 'en' if not, 'unknown' without any."""
    korean, latin = F.regexp_count(_c(text), F.lit("[가-힣]")), F.regexp_count(_c(text), F.lit("[A-Za-z]"))
    return F.when(F.coalesce(korean + latin, F.lit(0)) == 0, "unknown").when(korean > latin, "ko").otherwise("en")


# -- redaction -------------------------------------------------------------------------------------


def redact(text: Column | str, kinds=tuple(SENSITIVE)) -> tuple[Column, Column]:
    """The text without sensitive parts, and how many there were, kind after kind."""
    out, n = _c(text), F.lit(0)
    for k in kinds:
        pattern, mark = SENSITIVE[k]
        n = n + F.coalesce(F.regexp_count(out, F.lit(f"(?i){pattern}")), F.lit(0))
        out = F.regexp_replace(out, f"(?i){pattern}", mark)
    return out, n


def mask_equipment(df: DataFrame, text: str, scope: list[str], order: list[str]) -> DataFrame:
    """df with `masked` and `aliases`: equipment ids become [EQUIP_A], [EQUIP_B], ... by first appearance
    within a scope's rows, in order. A scope's distinct ids are its alias list."""
    found = df.select(*scope, *order, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?i)({EQUIPMENT_ID})"), 1)).alias("at", "id")).withColumn("id", F.upper("id"))
    first = found.groupBy(*scope, "id").agg(F.min(F.struct(*order, "at")).alias("first"))
    number = F.row_number().over(Window.partitionBy(*scope).orderBy("first")) - 1
    letters = F.when(number < 26, F.char(F.lit(65) + number)).otherwise(F.concat(F.char(F.lit(65) + F.floor(number / 26) - 1), F.char(F.lit(65) + number % 26)))
    named = first.withColumn("alias", F.concat(F.lit("[EQUIP_"), letters, F.lit("]")))
    lists = named.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct(F.length("id").alias("n"), "id", "alias")), asc=False).alias("aliases"))
    joined = df.join(lists, scope, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<struct<n: int, id: string, alias: string>>")))
    masked = F.aggregate("aliases", F.regexp_replace(F.col(text), SENSITIVE["ip"][0], "[IP_REMOVED]"), lambda s, a: F.regexp_replace(s, F.concat(F.lit(r"(?i)\b"), a["id"], F.lit(r"\b")), a["alias"]))
    return joined.withColumn("masked", masked)


# What is masked in texts of logs.
LOG_EQUIPMENT = r"\b[A-Z]{2,6}-\d{2,4}\b"
LOG_SENSITIVE = {
    r"(?i)(?:yield|수율)\s*[:\-=]?\s*\d+\.?\d*\s*%?": "[YIELD_REDACTED]",
    r"(?i)(?:recipe|레시피)\s*[:\-=]?\s*[\w\-\.]+": "[RECIPE_REDACTED]",
}


def mask_text(text: Column | str) -> Column:
    """The text with equipment ids as [EQUIP_A], [EQUIP_B], ... by first appearance in it, without yields and recipes."""
    ids = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(LOG_EQUIPMENT), 0))
    named = F.transform(ids, lambda x, i: F.struct(x.alias("id"), F.concat(F.lit("[EQUIP_"), F.char(F.lit(65) + i), F.lit("]")).alias("alias")))
    out = F.aggregate(named, _c(text), lambda s, a: F.regexp_replace(s, F.concat(F.lit(r"\b"), a["id"], F.lit(r"\b")), a["alias"]))
    for pattern, mark in LOG_SENSITIVE.items():
        out = F.regexp_replace(out, pattern, mark)
    return out


def unmask(text: Column | str, aliases: Column | str) -> Column:
    return F.aggregate(aliases, _c(text), lambda s, a: F.replace(s, a["alias"], a["id"]))


def hash_fields(fields: Column | str) -> Column:
    """A map with the values of sensitive fields replaced by 12 hex digits of their SHA-256."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(HASHED_FIELDS), F.substring(F.sha2(v, 256), 1, 12)).otherwise(v))


# -- answers ---------------------------------------------------------------------------------------


def repeats(text: Column | str) -> Column:
    """Whether three equal words follow one another, or a sentence occurs three times."""
    words = F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")
    n = F.size(words)
    triple = F.exists(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(words, i) == F.get(words, i + 1)) & (F.get(words, i + 1) == F.get(words, i + 2)))
    sentences = F.array_sort(F.filter(F.transform(F.split(F.lower(_c(text)), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 5))
    m = F.size(sentences)
    # sorted, a sentence that occurs three times stands two places on from itself
    thrice = F.exists(F.when(m >= 3, F.sequence(F.lit(0), m - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.get(sentences, i) == F.get(sentences, i + 2))
    return triple | thrice


def answer_check(text: Column | str) -> Column:
    """'empty', 'short', 'repetition', 'chinese' or 'passed'."""
    trimmed = F.trim(F.coalesce(_c(text), F.lit("")))
    return (
        F.when(~trimmed.rlike(r"[\p{L}\p{N}]"), "empty").when(F.length(trimmed) < 50, "short").when(repeats(trimmed), "repetition").when(trimmed.rlike(r"[一-鿿]"), "chinese").otherwise("passed")
    )


# Beginnings of reference sections that a model writes by itself.
REFERENCE_SECTIONS = (
    r"\n---\s*\n\s*📚\s*\*{0,2}참고\s*문서",
    r"\n#{1,3}\s*참조\s*\n",
    r"\n#{1,3}\s*참고\s*문서\s*\n",
    r"\n#{1,3}\s*참고문서\s*\n",
    r"\n#{1,3}\s*출처\s*\n",
    r"\n#{1,3}\s*신뢰도\s*\n",
    r"\n📚\s*\*{0,2}참고\s*문서",
    r"\n---\s*\n\s*\*{0,2}참고\s*문서",
    r"\n---\s*\n\s*\*{0,2}참고\s*정보",
    r"\n---\s*\n\s*- 📄",
)


def clean_answer(text: Column | str) -> Column:
    """Without think blocks, leaked control tokens and all that follows the earliest reference section."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"(?is)<think>.*?</think>", ""), r"<\|[a-z_]+\|>", ""))
    any_section = "(?:" + "|".join(REFERENCE_SECTIONS) + ")"
    return F.when(bare.rlike(any_section), F.regexp_replace(bare, rf"(?s)\s*{any_section}.*", "")).otherwise(bare)


def reflected(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages (answer_id, passage_id, keywords) with at least 3 or 30 % of their keywords in the answer (answer_id, answer), or without keywords."""
    joined = passages.join(answers, "answer_id")
    n = F.size("keywords")
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.lower("answer"), F.lower(k))))
    return joined.filter((n == 0) | (hits >= 3) | (hits >= 0.3 * n)).select("answer_id", "passage_id", hits.cast("long").alias("hits"))


def gate_b(passages: DataFrame, kept: DataFrame) -> DataFrame:
    """'disclaimer' if an answer reflects none of its passages, 'partial' if under half, else 'passed'."""
    counts = passages.groupBy("answer_id").agg(F.count("*").alias("n")).join(kept.groupBy("answer_id").agg(F.count("*").alias("k")), "answer_id", "left")
    k = F.coalesce("k", F.lit(0))
    return counts.select("answer_id", "n", k.alias("k"), F.when(k == 0, "disclaimer").when(k < 0.5 * F.col("n"), "partial").otherwise("passed").alias("gate"))
