"""Diagnosis: evidence of three tiers from four inputs, fused to hypotheses, reports and alerts.

Tier 1 is statistics (anomalies, remaining life), tier 2 expert rules, tier 3 causal knowledge from documents. Evidence is
a table with one row for each hypothesis and source, `n` saying for how many findings it stands:

    equipment_id, key, hypothesis, place, tier, kind, source, description, confidence, n, actions

`key` tells hypotheses apart (anomaly:sensor:type, rul:urgency, expert:rule, doc:code or doc:entry); `place` orders sources within a
tier where the text or the actions of a hypothesis have several.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.operators.life import urgency
from ferrolens.operators.patterns import with_contained

COLUMNS = ["equipment_id", "key", "hypothesis", "place", "tier", "kind", "source", "description", "confidence", "n", "actions"]
# Weights of the tiers, the gain of agreeing tiers, what an indirect link keeps, and the reports' thresholds.
WEIGHTS, AGREE, INDIRECT = {1: 0.35, 2: 0.40, 3: 0.25}, 1.1, 0.8
LEAST, WARNING, CRITICAL, REPORT_WARNING = 0.20, 0.40, 0.70, 0.50
NORMAL = "No anomalies or issues detected. Equipment operating normally."


def whole(x: Column) -> Column:
    """A number without digits behind the point, as text."""
    return F.round(x, 0).cast("long").cast("string")


def percent(x: Column) -> Column:
    return F.concat(whole(F.round(x * 100, 9)), F.lit("%"))


def _row(**columns: Column) -> list[Column]:
    return [columns[c].alias(c) for c in COLUMNS]


def anomaly_groups(anomalies: DataFrame) -> DataFrame:
    """Anomalies (equipment_id, sensor_id, type, confidence, description) that read alike, as one row with their number."""
    return anomalies.groupBy("equipment_id", "sensor_id", "type", "description").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def anomaly_key() -> Column:
    return F.concat_ws(":", F.lit("anomaly"), "sensor_id", "type")


def link_causal(groups: DataFrame, causal: DataFrame) -> DataFrame:
    """Groups of anomalies joined with the causal entries of their equipment whose symptom contains the sensor's name, or whose code
    stands in the description (both ignoring case, inside words too): groups' columns without description, and the entry's.

    Sensors' names are looked up in the symptoms, and codes in the descriptions, by an automaton of all of them; the rest is two equi-joins.
    """
    entry = ["entry_id", "symptom", "cause", "action", "source_document", F.col("confidence").alias("entry_confidence")]
    symptoms = with_contained(causal.select("symptom").distinct(), "symptom", groups.select("sensor_id").distinct(), "sensor_id", "sensors")
    by_sensor = causal.join(symptoms, "symptom").select("equipment_id", *entry, F.explode("sensors").alias("sensor_"))
    first = groups.withColumn("sensor_", F.lower("sensor_id")).join(by_sensor, ["equipment_id", "sensor_"]).drop("sensor_")
    told = with_contained(groups, "description", causal.select("error_code").distinct(), "error_code", "codes")
    by_code = causal.select("equipment_id", *entry, F.lower("error_code").alias("code_"))
    second = told.withColumn("code_", F.explode("codes")).drop("codes").join(by_code, ["equipment_id", "code_"]).drop("code_")
    return first.unionByName(second).dropDuplicates(["equipment_id", "sensor_id", "type", "description", "entry_id"]).drop("description")


def relevant_causal(causal: DataFrame, equipment: DataFrame, active: DataFrame) -> DataFrame:
    """Causal entries (error_code, equipment_type, ...) for each equipment (equipment_id, equipment_type) on which their code is
    active (equipment_id, source): entries with equipment_id. Entries without a type serve all types."""
    held = active.select("equipment_id", F.lower("source").alias("code_")).distinct().join(equipment, "equipment_id")
    entries = causal.withColumnRenamed("equipment_type", "for_type").withColumn("code_", F.lower("error_code"))
    met = held.join(entries, "code_").filter(F.col("for_type").isNull() | (F.col("for_type") == F.col("equipment_type")))
    return met.drop("code_", "for_type", "equipment_type")


def evidence(anomalies: DataFrame, lives: DataFrame, matches: DataFrame, causal: DataFrame) -> DataFrame:
    """Evidence rows (see the module) from four inputs:

    anomalies: equipment_id, sensor_id, type, confidence, description. lives: equipment_id, remaining (hours), confidence, summary; rows without
    remaining don't count. matches: equipment_id, rule_id, name, hypothesis, matched, total, confidence, actions (array).
    causal: equipment_id, entry_id, error_code, symptom, cause, action, source_document, confidence.
    """
    none, text = F.array().cast("array<string>"), lambda c: F.lit(c)
    groups = anomaly_groups(anomalies)
    zero = F.lit(0.0)
    spikes = groups.groupBy("equipment_id", "sensor_id", "type").agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.min("description").alias("told"))
    spikes = spikes.select(*_row(
        equipment_id=F.col("equipment_id"), key=anomaly_key(), hypothesis=F.concat("sensor_id", text(" "), "type", text(" detected")), place=zero, tier=F.lit(1), kind=text("anomaly"),
        source=F.col("sensor_id"), description=F.coalesce("told", F.col("type")), confidence=F.col("confidence"), n=F.col("n"), actions=none,
    ))
    hours = whole(F.col("remaining"))
    ends = lives.filter("remaining is not null").select(*_row(
        equipment_id=F.col("equipment_id"), key=F.concat(text("rul:"), urgency("remaining")), hypothesis=F.concat(text("Component approaching end of life ("), hours, text("h remaining)")),
        place=F.col("remaining"), tier=F.lit(1), kind=text("rul"), source=text("RUL Predictor"), description=F.col("summary"),
        confidence=F.col("confidence") * F.when(F.col("remaining") <= 24, 1.0).otherwise(0.6), n=F.lit(1).cast("long"),
        actions=F.array(F.concat(text("Schedule replacement within "), hours, text(" hours"))),
    ))
    rule = F.col("rule_id").cast("string")
    rules = matches.select(*_row(
        equipment_id=F.col("equipment_id"), key=F.concat(text("expert:"), rule), hypothesis=F.col("hypothesis"), place=zero, tier=F.lit(2), kind=text("expert_rule"),
        source=F.concat(text("Rule "), rule, text(": "), "name"), description=F.concat(text("Matched "), F.col("matched").cast("string"), text("/"), F.col("total").cast("string"), text(" triggers")),
        confidence=F.col("confidence"), n=F.lit(1).cast("long"), actions=F.coalesce("actions", none),
    ))
    action = F.when(F.col("action") != "", F.array("action")).otherwise(none)
    entry = F.col("entry_id").cast("string")
    documents = causal.select(*_row(
        equipment_id=F.col("equipment_id"), key=F.concat(text("doc:"), F.when(F.col("error_code") != "", F.col("error_code")).otherwise(entry)),
        hypothesis=F.when(F.col("cause") != "", F.col("cause")).otherwise(F.col("symptom")), place=F.col("entry_id").cast("double"), tier=F.lit(3), kind=text("document"), source=F.col("source_document"),
        description=F.concat(text("Document evidence: "), F.coalesce("symptom", text("")), text(" → "), F.coalesce("cause", text(""))), confidence=F.col("confidence"), n=F.lit(1).cast("long"), actions=action,
    ))
    linked = link_causal(groups, causal).groupBy("equipment_id", "sensor_id", "type", "entry_id").agg(
        F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("cause", "action", "source_document", "entry_confidence"))
    )  # an entry is one row: its maxima are its values
    links = linked.select(*_row(
        equipment_id=F.col("equipment_id"), key=anomaly_key(), hypothesis=F.concat("sensor_id", text(" "), "type", text(" detected")), place=F.col("entry_id").cast("double"), tier=F.lit(3), kind=text("document"),
        source=F.col("source_document"), description=F.concat(text("Correlated: "), F.coalesce("cause", text(""))), confidence=INDIRECT * F.col("entry_confidence"), n=F.col("n"), actions=action,
    ))
    return reduce(lambda a, b: a.unionByName(b), (ends, rules, documents, links), spikes)


def fuse(rows: DataFrame) -> DataFrame:
    """Evidence to hypotheses: equipment_id, key, hypothesis, confidence, n1, n2, n3 (findings by tier), actions.

    Confidence is the weighted mean of the tiers' maxima over the tiers that have any above 0, times AGREE for two tiers,
    again for three, 1 at most. The text comes from the first source by (tier, place), the actions from all in that order, each once.
    """
    order = F.struct("tier", "place", "hypothesis")
    best = {t: F.max(F.when((F.col("tier") == t) & (F.col("confidence") > 0), F.col("confidence"))) for t in WEIGHTS}
    found = {t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)) for t in WEIGHTS}
    told = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tier", "place", "source", "actions"))), lambda x: x["actions"]))
    wide = rows.groupBy("equipment_id", "key").agg(
        F.min_by("hypothesis", order).alias("hypothesis"), *(c.alias(f"t{t}") for t, c in best.items()), *(c.alias(f"n{t}") for t, c in found.items()), F.array_distinct(told).alias("actions")
    )
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    has = {t: F.col(f"t{t}").isNotNull() for t in WEIGHTS}
    total = add(F.coalesce(F.col(f"t{t}") * w, F.lit(0.0)) for t, w in WEIGHTS.items())
    weight = add(F.when(has[t], w).otherwise(0.0) for t, w in WEIGHTS.items())
    agreeing = add(x.cast("int") for x in has.values())
    gain = F.when(agreeing >= 3, AGREE * AGREE).when(agreeing >= 2, AGREE).otherwise(1.0)
    confidence = F.when(weight > 0, F.least(total / weight * gain, F.lit(1.0))).otherwise(0.0)
    return wide.select("equipment_id", "key", "hypothesis", confidence.alias("confidence"), "n1", "n2", "n3", "actions")


def ranked(fused: DataFrame, least: float = LEAST) -> DataFrame:
    """Hypotheses that are likely enough, with their rank on their equipment (ties by key) and how many it has."""
    kept = fused.filter(F.col("confidence") >= least)
    return kept.withColumns({"rank": _rank(), "n_hypotheses": F.count("*").over(Window.partitionBy("equipment_id"))})


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("equipment_id").orderBy(F.round("confidence", 9).desc(), "key")).cast("long")


def diagnose(equipment: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """One report for each equipment (equipment_id) from evidence rows: health, the best confidence, how many hypotheses, the three best
    ones as text, how many anomalies and matched rules."""
    told = fuse(rows).withColumn("rank", _rank())  # what is too unlikely ranks behind the rest
    likely = F.col("confidence") >= least
    line = F.when(likely & (F.col("rank") <= 3), F.struct("rank", F.concat("hypothesis", F.lit(" ("), percent(F.col("confidence")), F.lit(")")).alias("line")))
    findings = lambda kind, n: F.sum(F.when(F.startswith("key", F.lit(kind)), F.col(n)).otherwise(0))
    reports = told.groupBy("equipment_id").agg(
        F.max(F.when(likely, F.col("confidence"))).alias("top"), F.count_if(likely).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " | ").alias("summary"),
        findings("anomaly:", "n1").alias("anomalies"), findings("expert:", "n2").alias("rules"),
    )
    every = equipment.select("equipment_id").distinct().join(reports, "equipment_id", "left")
    top, none = F.coalesce("top", F.lit(0.0)), F.coalesce("n", F.lit(0)) == 0
    health = F.when(none, "Normal").when(top >= CRITICAL, "Critical").when(top >= REPORT_WARNING, "Warning").otherwise("Caution")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("equipment_id", health.alias("health"), top.alias("top"), count("n"), F.when(none, NORMAL).otherwise(F.col("summary")).alias("summary"), count("anomalies"), count("rules"))


def make_alerts(rows: DataFrame) -> DataFrame:
    """Alerts of the likelier hypotheses: equipment_id, key, severity (Critical or Warning), title, message, actions.

    The message says equipment, confidence, rank, findings by tier, and the first three actions, a line each.
    """
    told = ranked(fuse(rows))
    severity = F.when(F.col("confidence") >= CRITICAL, "Critical").when(F.col("confidence") >= WARNING, "Warning")
    line = lambda label, n: F.when(F.col(n) > 0, F.concat(F.lit(label), F.col(n).cast("string")))
    first = F.transform(F.slice("actions", 1, 3), lambda a: F.concat(F.lit("  - "), a))
    message = F.concat_ws(
        "\n",
        F.concat(F.lit("Equipment: "), F.col("equipment_id").cast("string")), F.concat(F.lit("Confidence: "), percent(F.col("confidence"))),
        F.concat(F.lit("Rank: #"), F.col("rank").cast("string"), F.lit(" of "), F.col("n_hypotheses").cast("string"), F.lit(" hypotheses")),
        F.concat(line("Statistical evidence: ", "n1"), F.lit(" indicators")), line("Expert rules matched: ", "n2"), line("Document references: ", "n3"),
        F.when(F.size("actions") > 0, F.lit("Recommended actions:")), first,
    )
    title = F.concat(F.lit("["), F.upper(severity), F.lit("] "), "hypothesis")
    return told.select("equipment_id", "key", severity.alias("severity"), title.alias("title"), message.alias("message"), "actions").filter("severity is not null")
