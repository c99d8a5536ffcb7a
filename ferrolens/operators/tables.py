"""Equipment, access, conversations, audit, knowledge, graph, rules, fusion and alerts: table operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.runtime import shared_path


def latest_per_key(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def last_write(changes: DataFrame, keys: list[Column], version: str, removed: Column | None = None) -> DataFrame:
    """Current rows of a change log: the last version of each key, without those that were removed."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = changes.withColumns(dict(zip(names, keys, strict=True)))
    w = Window.partitionBy(*names).orderBy(F.col(version).desc())
    last = keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return (last.filter(~removed) if removed is not None else last).drop("_n", *names)


def payload_filter(df: DataFrame, equal: dict[str, object], words: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Rows with all given values, and all given words in the text."""
    tests = [F.col(k) == v for k, v in equal.items()] + [F.contains(F.lower(text), F.lit(w.lower())) for w in words]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def trim_audit(events: DataFrame, n: int = 10_000, cut: int = 500) -> DataFrame:
    """The n latest events (equipment_id, ts, event_id, data) of each equipment and the n latest of all, told apart by `scope`
    (equipment, global), with data cut to `cut` characters."""
    short = events.withColumn("data", F.substring("data", 1, cut))
    order = [F.desc("ts"), F.desc("event_id")]
    each = latest_per_key(short, ["equipment_id"], n, order).drop("place").withColumn("scope", F.lit("equipment"))
    return each.unionByName(short.orderBy(*order).limit(n).withColumn("scope", F.lit("global")))


def equipment_board(readings: DataFrame, lives: DataFrame, alerts: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each equipment and sensor: latest value and its status, the life gauge, and the equipment's health and rule hits.

    readings: equipment_id, sensor_id, ts, event_id, value. lives: equipment_id, sensor_id, remaining, span (hours). alerts: equipment_id,
    severity. matches: equipment_id. Status is that of the latest value against the sensor's mean: Anomaly from 3 deviations on, Caution from 2. The
    gauge is the share of the whole life that is left: ok above 50 %, caution above 20 %, else danger; null without an estimate.
    """
    now = readings.filter("value is not null").groupBy("equipment_id", "sensor_id").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    z = F.when(F.col("std") > 1e-10, F.abs(F.col("latest") - F.col("mean")) / F.col("std")).otherwise(0.0)
    status = F.when(z >= 3, "Anomaly").when(z >= 2, "Caution").otherwise("Normal")
    share = F.try_divide(100 * F.col("remaining"), F.col("remaining") + F.col("span"))
    gauge = lives.filter("remaining is not null").select("equipment_id", "sensor_id", share.alias("life_percent"))
    band = F.when(F.col("life_percent") > 50, "ok").when(F.col("life_percent") > 20, "caution").when(F.col("life_percent").isNotNull(), "danger")
    severe = alerts.groupBy("equipment_id").agg(F.bool_or(F.col("severity") == "Critical").alias("critical"))
    hits = matches.groupBy("equipment_id").agg(F.count("*").alias("rule_hits"))
    health = F.when(F.col("critical"), "Critical").when(F.col("critical").isNotNull(), "Caution").otherwise("Normal")
    board = now.join(gauge, ["equipment_id", "sensor_id"], "left").join(severe, "equipment_id", "left").join(hits, "equipment_id", "left")
    return board.select("equipment_id", "sensor_id", "latest", "at", status.alias("status"), "life_percent", band.alias("life_band"), health.alias("health"), F.coalesce("rule_hits", F.lit(0)).alias("rule_hits"))


def clamp_requests(df: DataFrame, most_minutes: int = 120, most_rows: int = 5000) -> DataFrame:
    """Requests (equipment_id, minutes_before, minutes_after, rows) within policy: windows that are too
    long shrink in proportion, rows are capped, requests without equipment are refused."""
    total = F.col("minutes_before") + F.col("minutes_after")
    factor = F.when(total > most_minutes, most_minutes / total).otherwise(1.0)
    return df.filter("equipment_id is not null").withColumns({"minutes_before": F.col("minutes_before") * factor, "minutes_after": F.col("minutes_after") * factor, "rows": F.least("rows", F.lit(most_rows))})


# The least role of each feature; 0 operator, 1 maintenance, 2 senior engineer, 3 equipment owner, 4 admin.
FEATURE_ROLES = {
    "ChatQuery": 0, "ViewDocumentation": 0,
    "ViewSensorData": 1, "ViewAlarmHistory": 1, "ViewPmHistory": 1, "ViewDashboard": 1,
    "ViewParameterOptimization": 2, "ViewTrendAnalysis": 2, "ViewAnomalyDetection": 2, "RunRca": 2,
    "ViewUnredactedOutput": 3,
    "ManageUsers": 4, "ManageEquipment": 4, "ViewAuditLog": 4, "ConfigureSystem": 4,
}


def feature_roles(spark) -> DataFrame:
    """(feature, least_role) of all features."""
    return spark.createDataFrame(list(FEATURE_ROLES.items()), "feature string, least_role int")


def authorized(requests: DataFrame, users: DataFrame, features: DataFrame) -> DataFrame:
    """Requests (user_id, feature) whose user (user_id, role) has the feature's least role (feature, least_role)."""
    return requests.join(users, "user_id").join(features, "feature").filter(F.col("role") >= F.col("least_role")).select("user_id", "feature")


#: Users that see every row, at most, of one call.
MOST_SEE_ALL = 10_000


def scope_rows(rows: DataFrame, users: DataFrame, now: Column | None = None) -> DataFrame:
    """(user_id, row) that each user may see: every row for role 4 or an empty or null access list, else the equipment
    listed, ignoring case. With `now`, only users whose session (session_expires_at) ends later.

    users: user_id, role, access (array). Listed access is an equi-join on the equipment. Users who see all meet every row by
    intent: their ids are an array that each row is exploded over, MOST_SEE_ALL at most; more are refused, as the
    result would be rows times users (`see_all` marks them, so that a caller can give them the table itself).
    """
    valid = users if now is None else users.filter(now < F.col("session_expires_at"))
    marked = valid.withColumn("all_", see_all())
    key = lambda x: F.lower(x.cast("string"))
    listed = marked.filter(~F.col("all_")).select("user_id", F.explode(F.array_distinct(F.transform("access", key))).alias("key_")).distinct()
    every = [r["user_id"] for r in marked.filter("all_ and user_id is not null").select("user_id").distinct().limit(MOST_SEE_ALL + 1).collect()]
    if len(every) > MOST_SEE_ALL:
        raise ValueError(f"more than {MOST_SEE_ALL} users see every row: give them the table itself")
    met = rows.withColumn("key_", key(F.col("equipment_id"))).join(listed, "key_").select("user_id", *rows.columns)
    if not every:
        return met
    ids = F.array(*(F.lit(u) for u in every)).cast(f"array<{users.schema['user_id'].dataType.simpleString()}>")
    return met.unionByName(rows.select(F.explode(ids).alias("user_id"), *rows.columns))


def see_all() -> Column:
    """Whether a user (role, access) sees all equipment: role 4, or no access list."""
    return F.coalesce(F.col("role") >= 4, F.lit(False)) | F.col("access").isNull() | (F.size("access") == 0)


# -- graph -----------------------------------------------------------------------------------------


def keyword_index(entities: DataFrame) -> DataFrame:
    """(word, entity_id): words of two or more characters of the entities' names."""
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"[\s_\-#]+"), lambda w: F.length(w) >= 2))
    return entities.select(F.explode(words).alias("word"), "entity_id")


#: Relations from which on an entity is heavy, and as which share of all relations at least (so heavy entities are 200,000 at most).
HEAVY, HEAVY_SHARE = 1000, 100_000


def split_relations(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, part, target) of all relations either way, and (source, parts) of the heavy entities.

    A heavy entity's relations are dealt into parts of about HEAVY by their other end, so that a join on (source, part) has no hot key.
    The heavy ones are few by definition, and broadcast. Both are stored in the shared folder, as each round of a search reads them.
    """
    spark, folder = relations.sparkSession, shared_path(relations.sparkSession)
    both = relations.select("source", "target").unionByName(relations.select(F.col("target").alias("source"), F.col("source").alias("target")))
    both.distinct().write.parquet(f"{folder}/both")
    both = spark.read.parquet(f"{folder}/both")
    least = max(HEAVY, both.count() // HEAVY_SHARE)
    degrees = both.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    degrees.select("source", F.ceil(F.col("n") / least).cast("int").alias("parts")).write.parquet(f"{folder}/heavy")
    heavy = spark.read.parquet(f"{folder}/heavy")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("target"), F.col("parts"))).cast("int")
    return both.join(F.broadcast(heavy), "source", "left").select("source", part.alias("part"), "target"), heavy


def neighbours(seeds: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """(seed, entity_id, distance): what up to `depth` relations (source, target), either way, lead to from each seed (seed).

    Each round joins the newest level with the relations and drops what was reached before. Hubs are expanded part by part
    (`split_relations`).
    """
    both, heavy = split_relations(relations)
    reached = seeds.select("seed", F.col("seed").alias("entity_id"), F.lit(0).cast("long").alias("distance"))
    level = reached
    for d in range(1, depth + 1):
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        ready = level.withColumnRenamed("entity_id", "source").join(F.broadcast(heavy), "source", "left").select("seed", "source", parts.alias("part"))
        found = ready.join(both, ["source", "part"]).select("seed", F.col("target").alias("entity_id")).distinct()
        level = found.join(reached.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti").withColumn("distance", F.lit(d).cast("long"))
        reached = reached.unionByName(level)
    return reached


def graph_search(queries: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, entity_id, distance): what the entities that a query's keywords (query_id, keyword) name lead to within
    `depth` relations, each once with its least distance."""
    seeds = resolve_keywords(queries, entities)
    near = neighbours(seeds.select(F.col("entity_id").alias("seed")).distinct(), relations, depth)
    return seeds.withColumnRenamed("entity_id", "seed").join(near, "seed").groupBy("query_id", "entity_id").agg(F.min("distance").alias("distance"))


def resolve_keywords(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id) of the entities whose name, or a word of it, is one of the keywords (query_id, keyword)."""
    asked = queries.select("query_id", F.lower("keyword").alias("word"))
    names = entities.select(F.lower("name").alias("word"), "entity_id").unionByName(keyword_index(entities).select("word", "entity_id"))
    return asked.join(names, "word").select("query_id", "entity_id").distinct()


MOST_SEEDS, MOST_ENTITIES, MOST_RELATIONS = 10, 20, 30


def graph_context(queries: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, context): a text of the entities and relations around a query's keywords (query_id, keyword).

    The first MOST_SEEDS entities by id are followed; named are the first MOST_ENTITIES by distance and name, without
    regard to case, and the first MOST_RELATIONS (source, kind, target) by distance of their nearer end. Queries that
    name no entity have no row.
    """
    first = lambda df, n, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("k") <= n)
    seeds = first(resolve_keywords(queries, entities), MOST_SEEDS, "entity_id").select("query_id", F.col("entity_id").alias("seed"))
    near = seeds.join(neighbours(seeds.select("seed").distinct(), relations, depth), "seed").groupBy("query_id", "entity_id").agg(F.min("distance").alias("distance"))
    known = near.join(entities, "entity_id")
    named = known.groupBy("query_id", F.lower("name").alias("low")).agg(F.min(F.struct("distance", "name", "type")).alias("e")).select("query_id", "e.*")
    named = first(named, MOST_ENTITIES, "distance", "name")
    ends = relations.select("source", "kind", "target", F.explode(F.array("source", "target")).alias("entity_id"))
    around = near.filter(F.col("distance") < depth).join(ends, "entity_id").groupBy("query_id", "source", "kind", "target").agg(F.min("distance").alias("distance"))
    around = first(around, MOST_RELATIONS, "distance", "source", "kind", "target")
    lines = lambda df, line, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias(name))
    a = lines(named, F.concat(F.lit("- "), "name", F.lit(" ["), "type", F.lit("]")), "a")
    b = lines(around, F.concat(F.lit("- "), "source", F.lit(" -["), "kind", F.lit("]-> "), "target"), "b")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    context = F.concat(F.lit("[관련 지식 그래프]\n\n엔티티:\n"), text("a"), F.when(F.col("b").isNotNull(), F.concat(F.lit("\n\n관계:\n"), text("b"))).otherwise(""))
    return a.join(b, "query_id", "left").select("query_id", context.alias("context"))


UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def stable_id(key: Column | str) -> Column:
    """The id of a row with a string key: the key itself, in small letters, if it is a UUID, else its MD5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.rlike(UUID), F.lower(key)).otherwise(F.md5(key))


# -- expert rules ----------------------------------------------------------------------------------


def eval_triggers(equipment: DataFrame, triggers: DataFrame, readings: DataFrame, alarms: DataFrame) -> DataFrame:
    """(equipment_id, rule_id, trigger_id, met): triggers (rule_id, equipment_type, trigger_id, kind, source, operator, low, high) of
    each equipment's type (equipment_id, equipment_type) against its latest readings (equipment_id, source, value) and active codes (equipment_id, source)."""
    asked = equipment.join(triggers, "equipment_type")
    codes = alarms.select("equipment_id", "source", F.lit(True).alias("active")).distinct()
    v = F.col("value")
    test = (
        F.when(F.col("operator") == "gt", v > F.col("low")).when(F.col("operator") == "lt", v < F.col("low")).when(F.col("operator") == "gte", v >= F.col("low")).when(F.col("operator") == "lte", v <= F.col("low"))
        .when(F.col("operator") == "eq", F.abs(v - F.col("low")) <= 0.001).when(F.col("operator") == "between", (v >= F.col("low")) & (v <= F.col("high")))
    )
    met = F.when(F.col("kind") == "sensor", F.coalesce(test, F.lit(False))).when(F.col("kind").isin("alarm", "error"), F.coalesce("active", F.lit(False))).otherwise(False)
    return asked.join(readings, ["equipment_id", "source"], "left").join(codes, ["equipment_id", "source"], "left").select("equipment_id", "rule_id", "trigger_id", met.alias("met"))


def match_rules(met: DataFrame, rules: DataFrame, equipment: DataFrame | None = None) -> DataFrame:
    """Active rules with at least one trigger met, with the share met, the confidence times that share, triggers met and asked; name,
    hypothesis and actions where the rules have them. With equipment (equipment_id, model), a rule that names an equipment_model counts
    only there, ignoring case."""
    hits = F.count_if("met")
    share = met.groupBy("equipment_id", "rule_id").agg(F.avg(F.col("met").cast("double")).alias("ratio"), hits.alias("matched"), F.count("*").alias("total")).filter("ratio > 0")
    told = [c for c in ("name", "hypothesis", "actions") if c in rules.columns]
    matched = share.join(rules.filter("is_active"), "rule_id")
    if equipment is not None and "equipment_model" in rules.columns:
        models = equipment.select("equipment_id", F.lower("model").alias("model_")).distinct()
        matched = matched.join(models, "equipment_id", "left").filter(F.col("equipment_model").isNull() | (F.lower("equipment_model") == F.col("model_")))
    return matched.select("equipment_id", "rule_id", "ratio", (F.col("confidence") * F.col("ratio")).alias("confidence"), "matched", "total", *told)


# -- alerts ----------------------------------------------------------------------------------------


def suppress(alerts: DataFrame, minutes: float = 60) -> DataFrame:
    """Alerts (equipment_id, hypothesis, ts, alert_id) less those within `minutes` of the last one issued for the same key."""
    import numpy as np

    from ferrolens.operators.series import scan

    width = np.timedelta64(int(minutes * 60e6), "us")

    def step(last, rows):
        ts = rows["ts"].astype("datetime64[us]")
        issued, at = [], 0 if last is None else int(np.searchsorted(ts, last + width))
        while at < len(ts):  # once for each alert that is issued
            issued.append(at)
            last = ts[at]
            at = int(np.searchsorted(ts, last + width))
        return last, {c: x[np.array(issued, int)] for c, x in rows.items()}

    kind = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    columns = ["equipment_id", "hypothesis", "ts", "alert_id"]
    return scan(alerts.select(columns), ["equipment_id", "hypothesis"], ["ts", "alert_id"], ", ".join(f"{c} {kind[c]}" for c in columns), step)


SEVERITIES = {"Critical": 0, "Warning": 1}


def active_alerts(alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Alerts (alert_id, severity, ts, ...) that nobody acknowledged (alert_id), with their place: the severest first, of these the newest."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))[F.col("severity")], F.lit(len(SEVERITIES)))
    return alerts.join(acknowledged.select("alert_id").distinct(), "alert_id", "left_anti").withColumn("rank", rank).orderBy("rank", F.desc("ts"), "alert_id").drop("rank")


def alert_history(alerts: DataFrame, n: int = 100) -> DataFrame:
    """The n latest alerts."""
    return alerts.orderBy(F.desc("ts"), F.desc("alert_id")).limit(n)


def alert_counts(alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Alerts by severity: all, and those not acknowledged."""
    marked = alerts.join(acknowledged.select("alert_id", F.lit(True).alias("done")).distinct(), "alert_id", "left")
    return marked.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("done").isNull()).alias("active"))


def acknowledge(acknowledged: DataFrame, ids: DataFrame, by: str, at: Column) -> DataFrame:
    """Acknowledgements (alert_id, by, at) with those of the ids (alert_id); who was first stays."""
    new = ids.select("alert_id").distinct().join(acknowledged, "alert_id", "left_anti").select("alert_id", F.lit(by).alias("by"), at.alias("at"))
    return acknowledged.unionByName(new)


def alert_ids(alerts: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """alerts with `alert_no`: one sequence PA-000001, PA-000002, ... in order of the first column, a time, then the others.

    Alerts are numbered day by day; what came before a day is a running sum over the days.
    """
    dated = alerts.withColumn("day", F.coalesce(F.to_date(order[0]), F.lit("0001-01-01").cast("date")))
    counts = dated.groupBy("day").agg(F.count("*").alias("n"))
    before = counts.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))  # one row a day
    number = (F.row_number().over(Window.partitionBy("day").orderBy(*order)) + F.col("before")).cast("string")
    numbered = dated.join(F.broadcast(before), "day")
    return numbered.withColumn("alert_no", F.concat(F.lit("PA-"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0")))).drop("day", "before")


def expire(df: DataFrame, now: Column, hours: float, at: str = "ts") -> DataFrame:
    """Rows of an expiring table that are younger than `hours`."""
    return df.filter(F.col(at) > now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(round(hours % 1 * 60))))
