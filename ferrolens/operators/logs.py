"""Service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros

# Names of levels and their short forms.
LEVELS = {"fatal": "FTL", "critical": "FTL", "error": "ERR", "warning": "WRN", "debug": "DBG", "verbose": "VRB", "trace": "VRB"}
# Words of questions about logs.
LOG_WORDS = ["로그", "에러", "오류", "경고", "장애", "예외", "스택", "log", "error", "warning", "exception", "stacktrace", "서비스 상태", "서비스 헬스", "service health", "최근 에러", "에러 분석", "로그 분석", "장애 분석"]


def display_level(level: Column | str) -> Column:
    """Short form of a level, INF for any other and for none."""
    level = F.lower(level)
    out = F.lit("INF")
    for name, short in LEVELS.items():
        out = F.when(level == name, short).otherwise(out)
    return out


def rendered(template: Column | str, extra: Column | str) -> Column:
    """The template with each {Key} replaced by the value of that extra field (a map of strings)."""
    template = F.col(template) if isinstance(template, str) else template
    return F.aggregate(F.map_entries(extra), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def is_log_question(text: Column | str) -> Column:
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.lit(False) if not LOG_WORDS else F.exists(F.array(*map(F.lit, LOG_WORDS)), lambda w: F.contains(text, w))


def line_class(line: Column | str) -> Column:
    line = F.lower(line)
    return F.when(line.rlike("fail|error|exception"), "error").when(line.rlike("warn"), "warning").otherwise("info")


def search(df: DataFrame, start=None, end=None, levels: list[str] | None = None, correlation: str | None = None, keyword: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of matching rows, newest first, with their place and the number of all matches."""
    found = df
    if start is not None:
        found = found.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        found = found.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if levels:
        found = found.filter(display_level("level").isin(levels))
    if correlation is not None:
        found = found.filter(F.lower("correlation_id") == correlation.lower())
    if keyword:
        found = found.filter(F.contains(F.lower("message"), F.lit(keyword.lower())))
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy(F.desc("ts"), "event_id").limit(page * size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).cast("long"))
    return placed.filter(F.col("place") > (page - 1) * size).join(F.broadcast(total))


def error_rates(df: DataFrame, seconds: int) -> DataFrame:
    """Errors and warnings by time bucket and service."""
    at = (F.floor(micros("ts") / (seconds * 1_000_000)) * seconds).alias("bucket")
    level = display_level("level")
    return df.groupBy(at, "service").agg(F.count_if(level.isin("ERR", "FTL")).alias("errors"), F.count_if(level == "WRN").alias("warnings"), F.count("*").alias("n"))


def top_errors(df: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent error templates of each service with first and last time."""
    found = df.filter(display_level("level").isin("ERR", "FTL")).groupBy("service", "template").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.orderBy(F.desc("n"), "service", "template").limit(n)


def request_flow(df: DataFrame) -> DataFrame:
    """Rows of each correlation id in time order, with the gap before each and the span of all, in milliseconds."""
    w, every = Window.partitionBy("correlation_id").orderBy("ts", "event_id"), Window.partitionBy("correlation_id")
    at = micros("ts")
    return df.filter("correlation_id is not null").withColumns(
        {"place": F.row_number().over(w).cast("long"), "gap_ms": F.coalesce(at - F.lag(at).over(w), F.lit(0)) / 1000, "total_ms": (F.max(at).over(every) - F.min(at).over(every)) / 1000}
    )


def service_health(df: DataFrame) -> DataFrame:
    """Rows of each service: all, and by level; fatal and verbose ones count in the total alone."""
    level = display_level("level")
    return df.groupBy(F.lower("service").alias("service")).agg(F.count("*").alias("total"), *(F.count_if(level == s).alias(s.lower()) for s in ("ERR", "WRN", "INF", "DBG")))


def latest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def search_stats(df: DataFrame) -> DataFrame:
    level = display_level("level")
    return df.agg(F.count_if(level.isin("ERR", "FTL")).alias("errors"), F.count_if(level == "WRN").alias("warnings"), F.count_distinct("correlation_id").alias("correlations"), F.count_distinct("service").alias("services"))


def metric_rollup(df: DataFrame, seconds: int) -> DataFrame:
    """Metrics by name and time bucket: count, sum, mean, extremes."""
    at = (F.floor(micros("ts") / (seconds * 1_000_000)) * seconds).alias("bucket")
    return df.groupBy("name", at).agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


# Upper bounds of the histograms, milliseconds.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def metric_histograms(df: DataFrame, seconds: int, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Durations (name, ts, value) by name and time bucket: count, sum, extremes, and `counts`, how many lie up to each bound and above
    the one before, the last above all. One pass of partial sums, of a fixed size for each group."""
    at = (F.floor(micros("ts") / (seconds * 1_000_000)) * seconds).alias("bucket")
    x, edges = F.col("value"), [None, *bounds, None]
    inside = lambda a, b: (F.lit(True) if a is None else x > a) & (F.lit(True) if b is None else x <= b)
    counts = F.array(*(F.count_if(inside(a, b)) for a, b in zip(edges, edges[1:], strict=False)))
    return df.filter("value is not null").groupBy("name", at).agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("low"), F.max("value").alias("high"), counts.alias("counts"))


def metric_counters(df: DataFrame, seconds: int) -> DataFrame:
    """Counters (name, ts, value; null counts as one) by name and time bucket: what was added, and the running total of the name."""
    at = (F.floor(micros("ts") / (seconds * 1_000_000)) * seconds).alias("bucket")
    added = df.groupBy("name", at).agg(F.sum(F.coalesce("value", F.lit(1))).alias("added"))
    return added.withColumn("total", F.sum("added").over(Window.partitionBy("name").orderBy("bucket")))


def log_context(df: DataFrame, now: Column, hours: int = 1, n: int = 10) -> DataFrame:
    """(context): one row of text for an answer: the n most frequent errors of the last hours, and each service's health.

    It has no row if there were no logs. Services are few, so their lines are one text.
    """
    recent = df.filter((F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours))))
    errors = top_errors(recent, n).select(F.lit(0).alias("part"), (-F.col("n")).alias("a"), "service", F.format_string("- [%d회] %s: %s", "n", "service", "template").alias("line"))
    health = service_health(recent).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("a"), "service", F.format_string("- %s: Total=%d, ERR=%d, WRN=%d", "service", "total", "err", "wrn").alias("line"))
    lines = errors.unionByName(health).agg(F.array_sort(F.collect_list(F.struct("part", "a", "service", "line"))).alias("x"))
    part = lambda k, title: F.when(F.exists("x", lambda r: r["part"] == k), F.concat(F.lit(title), F.array_join(F.transform(F.filter("x", lambda r: r["part"] == k), lambda r: r["line"]), "\n")))
    return lines.filter(F.size("x") > 0).select(F.concat_ws("\n\n", part(0, "## 최근 Top 에러:\n"), part(1, "## 서비스 헬스:\n")).alias("context"))
