"""Knowledge from text and models: query correction, chunk prefixes, life spans, parsed model answers, rule upkeep, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common typing errors, in the order in which they are mended.
TYPOS = {
    "슬러이": "슬러리", "슬러이펌프": "슬러리 펌프", "연마패": "연마 패드", "폴리싱패": "폴리싱 패드", "웨이퍼스크래치": "웨이퍼 스크래치", "콘디셔너": "컨디셔너", "플라텐": "플래튼",
    "멤브레인": "멤브레인", "멤브래인": "멤브레인", "리테이닝": "리테이닝", "리테이니": "리테이닝", "엔드포인트": "엔드포인트", "언드포인트": "엔드포인트",
}
# Units and how they are written.
UNITS = {"um": "μm", "angstrom": "Å", "rpm": "RPM", "slm": "SLM", "sccm": "SCCM", "psi": "PSI", "torr": "Torr", "pa": "Pa", "mbar": "mbar", "nm": "nm"}
# Patterns of life spans, and the hours of a unit.
LIFE = r"(?i)(?:수명|교체\s*주기|expected\s*life|service\s*life|lifetime|사용\s*한도)\s*[:\-]?\s*(?:약\s*)?(\d[\d,\.]*)\s*(시간|hours?|hrs?|일|days?|개월|months?|wafers?|매)"
HOURS = {"시간": 1, "hour": 1, "hr": 1, "일": 24, "day": 24, "개월": 720, "month": 720}


def correct_patterns(query: Column | str) -> Column:
    """The query with typing errors mended, codes as E-1023 and units in their own spelling."""
    out = F.col(query) if isinstance(query, str) else query
    for wrong, right in TYPOS.items():
        if wrong != right:
            out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(out, r"\b([A-Z]{1,3})(\d{3,5})\b", "$1-$2")
    for unit, spelling in UNITS.items():
        if unit != spelling:
            out = F.regexp_replace(out, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}\b", f"$1 {spelling}")
    return out


def corrections(query: Column | str) -> Column:
    """What `correct_patterns` changes: an array of (original, corrected), typing errors first, then codes, then units."""
    text = F.col(query) if isinstance(query, str) else query
    pair = lambda a, b: F.struct(a.alias("original"), b.alias("corrected"))
    said, now = [], text
    for wrong, right in TYPOS.items():
        if wrong != right:
            said.append(F.when(F.contains(now, F.lit(wrong)), F.array(pair(F.lit(wrong), F.lit(right)))))
            now = F.replace(now, F.lit(wrong), F.lit(right))
    found = lambda pattern, spelt: F.transform(F.regexp_extract_all(now, F.lit(pattern), 0), lambda x: pair(x, F.regexp_replace(x, pattern, spelt)))
    said.append(found(r"\b([A-Z]{1,3})(\d{3,5})\b", "$1-$2"))
    said += [found(rf"(?i)(\d+(?:\.\d+)?)\s*{unit}\b", f"$1 {spelling}") for unit, spelling in UNITS.items() if unit != spelling]
    none = F.array().cast("array<struct<original: string, corrected: string>>")
    return F.filter(F.concat(*(F.coalesce(x, none) for x in said)), lambda x: x["original"] != x["corrected"])


# What keywords are expanded by where there are no synonyms.
RELATED = {
    "시기": ["기준", "시간", "수명", "주기"],
    "언제": ["기준", "시간", "시점"],
    "원인": ["이유", "문제", "발생"],
    "방법": ["절차", "순서", "단계"],
    "주기": ["기준", "시간", "수명"],
}


def expand_keywords(words: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, term): keywords (query_id, keyword) and all terms of the synonym groups (group_id, term) that have them;
    without synonyms, the RELATED words."""
    own = words.select("query_id", F.col("keyword").alias("term"))
    if synonyms is None:
        related = F.create_map(*(x for k, v in RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return own.unionByName(words.select("query_id", F.explode(related[F.col("keyword")]).alias("term"))).distinct()
    groups = words.join(synonyms.select("group_id", F.lower("term").alias("low")), F.lower("keyword") == F.col("low")).select("query_id", "group_id").distinct()
    return own.unionByName(groups.join(synonyms, "group_id").select("query_id", "term")).distinct()


def canonical_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries (query_id, query) with `canonical`: each word replaced by the first term of its synonym group
    (group_id, place, term), of several groups the least; other words and their order stay."""
    heads = synonyms.groupBy("group_id").agg(F.min_by("term", "place").alias("head"))
    of_word = synonyms.join(heads, "group_id").groupBy(F.lower("term").alias("low")).agg(F.min_by("head", "group_id").alias("head"))
    words = queries.select("query_id", F.posexplode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("at", "word"))
    told = words.join(of_word, F.lower("word") == F.col("low"), "left").select("query_id", "at", F.coalesce("head", "word").alias("word"))
    joined = told.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("canonical"))
    return queries.join(joined, "query_id", "left").withColumn("canonical", F.coalesce("canonical", F.lit("")))


def prefix_parts(text: Column | str) -> tuple[Column, Column, Column]:
    """Chapter, section and whole path of a chunk that begins with [A > B]; null where it doesn't."""
    text = F.col(text) if isinstance(text, str) else text
    path = F.when(text.rlike(r"^\[[^\]]+\]"), F.regexp_extract(text, r"^\[([^\]]+)\]", 1))
    parts = F.transform(F.filter(F.split(path, " > "), lambda p: p != ""), lambda p: F.trim(F.regexp_replace(p, r"^#{1,6}\s*", "")))
    return F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.element_at(parts, -1)), F.array_join(parts, " > ")


def life_spans(chunks: DataFrame) -> DataFrame:
    """(document_id, amount, unit, hours, wafers): life spans that the texts state, months as 30 days."""
    found = chunks.select("document_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(LIFE), 1).alias("amount"), F.regexp_extract_all("text", F.lit(LIFE), 2).alias("unit"))).alias("x"))
    amount = F.replace(F.col("x.amount"), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_replace(F.lower("x.unit"), "s$", "")
    hours = F.lit(None).cast("double")
    for name, factor in HOURS.items():
        hours = F.when(unit == name, amount * factor).otherwise(hours)
    return found.select("document_id", amount.alias("amount"), unit.alias("unit"), hours.alias("hours"), F.when(unit.isin("wafer", "매"), amount).alias("wafers"))


def unfenced(response: Column | str) -> Column:
    """The JSON in a model's response, without code fences."""
    response = F.col(response) if isinstance(response, str) else response
    return F.trim(F.regexp_replace(response, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", ""))


def rerank_from_scores(results: DataFrame, responses: DataFrame) -> DataFrame:
    """Results (query_id, chunk_id, place) in the order of a model's scores: responses (query_id, response) hold an
    array of {index, score}, index being the place from 0. Unlisted results follow in their order; without a
    readable response the order stays."""
    listed = responses.select("query_id", F.explode(F.from_json(unfenced("response"), "array<struct<index: int, score: double>>")).alias("x")).select("query_id", (F.col("x.index") + 1).cast("long").alias("place"), F.col("x.score").alias("said"))
    once = listed.groupBy("query_id", "place").agg(F.max("said").alias("said"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("said"), "place")
    return results.join(once, ["query_id", "place"], "left").withColumn("new_place", F.row_number().over(w).cast("long"))


def parse_graph(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, type) and relations (source, target, kind) of model answers; ends are named as the entities are.

    Names that differ in case are one entity: the least name of them by code points, with the least of its types. An end that no entity
    has keeps its own name.
    """
    schema = "entities array<struct<name: string, type: string>>, relations array<struct<source: string, target: string, type: string>>"
    parsed = responses.select(F.from_json(unfenced("response"), schema).alias("g"))
    said = parsed.select(F.explode("g.entities").alias("e")).select("e.*").filter("name is not null")
    named = said.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("name", "type")).alias("e")).select("low", "e.name", "e.type")
    names = named.select("low", F.col("name").alias("named"))
    relations = parsed.select(F.explode("g.relations").alias("r")).select(F.col("r.source").alias("source"), F.col("r.target").alias("target"), F.col("r.type").alias("kind"))
    for end in ("source", "target"):
        relations = relations.join(names, F.lower(end) == F.col("low"), "left").withColumn(end, F.coalesce("named", end)).drop("low", "named")
    return named.drop("low"), relations


def parse_candidates(responses: DataFrame) -> DataFrame:
    """Knowledge candidates of model answers, with what they leave out: type unknown, confidence 0.5, to be reviewed."""
    schema = "array<struct<type: string, symptom: string, root_cause: string, solution: string, confidence: double>>"
    found = responses.select("response_id", F.explode(F.from_json(unfenced("response"), schema)).alias("c"))
    return found.select("response_id", F.coalesce("c.type", F.lit("unknown")).alias("type"), "c.symptom", "c.root_cause", "c.solution", F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"), F.lit("PendingReview").alias("status"))


def apply_feedback(rules: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rules (rule_id, confidence, hits, confirms, is_active) after feedback (rule_id, at, right) in order: confidence
    moves a tenth of the way to each outcome; a rule of ten hits or more and a precision under 0.7 goes off for good.

    A rule's feedback is folded as an array: hands give it, so it stays small.
    """
    told = feedback.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "right"))), lambda x: x["right"]).alias("told"))
    start = F.struct(F.col("confidence").cast("double").alias("confidence"), F.col("hits").cast("long").alias("hits"), F.col("confirms").cast("long").alias("confirms"), F.col("is_active").alias("is_active"))

    def step(s, right):
        hits, confirms = s["hits"] + 1, s["confirms"] + right.cast("long")
        off = (hits >= 10) & (confirms / hits < 0.7)
        return F.struct((0.9 * s["confidence"] + 0.1 * right.cast("double")).alias("confidence"), hits.alias("hits"), confirms.alias("confirms"), (s["is_active"] & ~off).alias("is_active"))

    folded = F.aggregate(F.coalesce("told", F.array().cast("array<boolean>")), start, step)
    return rules.join(told, "rule_id", "left").select("rule_id", folded.alias("s")).select("rule_id", "s.*")


def rule_types(rules: DataFrame) -> DataFrame:
    """(equipment_type, n, active): the types that the rules are for."""
    return rules.groupBy("equipment_type").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


def list_rules(rules: DataFrame, equipment_type: str | None = None, active: bool | None = None) -> DataFrame:
    """Current rules of a type (ignoring case) and state, with their place by confidence, ties by rule_id."""
    some = rules if equipment_type is None else rules.filter(F.lower("equipment_type") == equipment_type.lower())
    some = some if active is None else some.filter(F.col("is_active") == F.lit(active))
    return some.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "rule_id")).cast("long"))


# Days that a draft and a changed object live.
DRAFT_DAYS, CHANGED_DAYS = 30, 90


def knowledge_current(events: DataFrame, now: Column) -> DataFrame:
    """Knowledge objects as they stand at `now`: id, status, changed_at, approved_by, approved_at, expires_at.

    events: id, at, event_no (tie-break), status, by. A Draft event creates an object (anew); others change its status. An object lives
    DRAFT_DAYS from its draft and CHANGED_DAYS from its last change; changes of an expired object don't count. The stamps are those of
    the last approval and stay when the status changes again. Objects that have expired by `now` are left out.
    """
    w = Window.partitionBy("id").orderBy("at", "event_no")
    drafts = events.withColumn("now_", now).filter("at <= now_").withColumn("made", F.sum(F.when(F.col("status") == "Draft", 1).otherwise(0)).over(w))
    one = Window.partitionBy("id", "made").orderBy("at", "event_no")
    days = F.when(F.col("status") == "Draft", DRAFT_DAYS).otherwise(CHANGED_DAYS)
    until = F.col("at") + F.make_dt_interval(days=days)
    told = drafts.filter("made > 0").withColumn("until", until).withColumn("dead", F.coalesce(F.col("at") >= F.lag("until").over(one), F.lit(False)))
    alive = told.withColumn("over", F.max("dead").over(one)).filter(~F.col("over"))
    approved = F.col("status") == "Approved"
    state = F.struct("made", "at", "event_no")
    last = lambda c: F.max_by(c, state)
    newest = alive.withColumn("newest", F.max("made").over(Window.partitionBy("id"))).filter("made = newest")
    current = newest.groupBy("id").agg(
        last("status").alias("status"), last("at").alias("changed_at"), F.max_by("by", F.when(approved, state)).alias("approved_by"), F.max_by("at", F.when(approved, state)).alias("approved_at"),
        last("until").alias("expires_at"), F.max("now_").alias("now_"),
    )
    return current.filter("expires_at > now_").drop("now_")


def pending_review(current: DataFrame) -> DataFrame:
    return current.filter("status = 'PendingReview'")


def approved_objects(current: DataFrame) -> DataFrame:
    """What may be indexed."""
    return current.filter("status = 'Approved'")


def get_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities of the names (name), ignoring case."""
    return entities.join(names.select(F.lower("name").alias("low_")).distinct(), F.lower("name") == F.col("low_"), "left_semi")


def delete_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities without those of the names (name), ignoring case; relations stay as they are."""
    return entities.join(names.select(F.lower("name").alias("low_")).distinct(), F.lower("name") == F.col("low_"), "left_anti")


def component_lives(chunks: DataFrame) -> DataFrame:
    """(document_id, component, amount, unit, hours): life spans that the texts state, with the component named before them.

    The component is the last run of one to three capitalised or upper-case words, or the last word, of the 100 characters before the
    statement's label; null where there is none. Months are 30 days; wafers have no hours.
    """
    spans = F.regexp_extract_all("text", F.lit(r"(?s)(.{0,100}?)" + f"({LIFE})"), 1)
    rows = chunks.select("document_id", F.explode(F.arrays_zip(spans.alias("before"), F.regexp_extract_all("text", F.lit(r"(?s)(.{0,100}?)" + f"({LIFE})"), 2).alias("said"))).alias("x"))
    lives = life_spans(rows.select(F.struct("document_id", "x.before").alias("document_id"), F.col("x.said").alias("text")))
    before = F.col("document_id.before")
    named = F.element_at(F.regexp_extract_all(before, F.lit(r"((?:\b[A-Z][\w-]*\s?){1,3})"), 1), -1)
    word = F.element_at(F.regexp_extract_all(before, F.lit(r"(\w[\w-]*)"), 1), -1)
    component = F.trim(F.when(F.size(F.regexp_extract_all(before, F.lit(r"(\b[A-Z][\w-]*)"), 1)) > 0, named).when(F.size(F.regexp_extract_all(before, F.lit(r"(\w[\w-]*)"), 1)) > 0, word))
    return lives.select(F.col("document_id.document_id").alias("document_id"), component.alias("component"), "amount", "unit", "hours")


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.avg("confidence").alias("confidence"), F.sum("hits").alias("hits"), F.try_divide(F.sum("confirms"), F.sum("hits")).alias("precision"))


def link_documents(anomalies: DataFrame, causal: DataFrame) -> DataFrame:
    """Anomalies (equipment_id, sensor_id, description, confidence) and causal entries (entry_id, error_code, symptom, action) whose
    symptom names the sensor as a word, or whose code stands in the description: evidence of tier 3 at 0.8 of the confidence.

    description and error_code may be missing. Both ways are joins on words.
    """
    words = lambda text, split: F.explode(F.array_distinct(F.split(F.lower(text), split)))
    out = ["equipment_id", "sensor_id", "entry_id", "action", "confidence"]
    told = causal.select("entry_id", "action", words("symptom", r"[^a-z0-9_]+").alias("word"))
    linked = anomalies.join(told, F.lower("sensor_id") == F.col("word")).select(out)
    if "description" in anomalies.columns and "error_code" in causal.columns:
        codes = causal.filter("error_code != ''").select("entry_id", "action", F.lower("error_code").alias("word"))
        linked = linked.unionByName(anomalies.withColumn("word", words("description", r"[^a-z0-9_.\-]+|[.\-]+(?![a-z0-9])")).join(codes, "word").select(out)).distinct()
    return linked.withColumn("confidence", 0.8 * F.col("confidence"))


def citations(passages: DataFrame) -> DataFrame:
    """One citation for each answer and source: the best passage, with a readable place; of equal ones the first by line, page, chapter and section.

    passages: answer_id, document_id, chapter, section, line_start, line_end, page, score.
    """
    w = Window.partitionBy("answer_id", "document_id").orderBy(F.desc("score"), "line_start", "line_end", "page", "chapter", "section")
    place = F.when(F.col("line_start").isNotNull(), F.format_string("{Line:%d-%d}", "line_start", "line_end")).when(F.col("page").isNotNull(), F.format_string("{Page:%d}", "page"))
    shown = F.concat_ws("-", F.col("document_id").cast("string"), "chapter", F.concat(F.lit("S"), F.col("section")), place)
    return passages.withColumn("k", F.row_number().over(w)).filter("k = 1").select("answer_id", "document_id", shown.alias("shown"), "score")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Means of runs by mode."""
    return runs.groupBy("mode").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("total_ms", "chars", "citations", "score")))
