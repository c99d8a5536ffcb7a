"""Remaining useful life by regression of a series on hours since its first reading."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros, shown
from ferrolens.operators.series import KEYS


def _hours(df: DataFrame) -> DataFrame:
    """Readings with hours since the series' first reading: one small aggregate beside, so that no series is sorted. Hours
    since a far time would lose digits of the fit."""
    first = df.groupBy(*KEYS).agg(F.min("ts").alias("first_ts"))
    by = functools.reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in KEYS])
    at = df.alias("r").join(first.alias("f"), by).select("r.*", ((micros("ts") - micros("first_ts")) / F.lit(3600e6)).alias("at"))
    return at.withColumn("hours", F.when(F.col("value").isNotNull(), F.col("at")))


def linear_fit(df: DataFrame) -> DataFrame:
    """Slope, intercept and R-squared of value on hours; flat series have slope and R-squared 0."""
    fit = _hours(df).groupBy(*KEYS).agg(
        F.count("value").alias("n"), F.expr("regr_slope(value, hours)").alias("slope"), F.expr("regr_intercept(value, hours)").alias("intercept"), F.expr("regr_r2(value, hours)").alias("r2"),
        F.max("hours").alias("span"), F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("last"), F.avg("value").alias("mean"), F.var_pop("value").alias("spread"),
    )
    fit = fit.filter("n > 0")
    return fit.withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "intercept": F.coalesce("intercept", "mean"), "r2": F.when(F.col("spread") > 0, F.coalesce("r2", F.lit(0.0))).otherwise(0.0)}).drop("mean", "spread")


def linear_life(df: DataFrame, threshold: float, decreasing: bool) -> DataFrame:
    """Hours until the fitted line meets the threshold, from the last reading on, and the fit's R-squared.

    Null where there are fewer than three readings or the line runs the other way.
    """
    fit = linear_fit(df)
    slope = F.col("slope")
    fits = (F.col("n") >= 3) & (F.abs("slope") >= 1e-12) & ((slope < 0) if decreasing else (slope > 0))
    hours = F.greatest((F.lit(threshold) - F.col("intercept")) / slope - F.col("span"), F.lit(0.0))
    return fit.withColumns({"remaining": F.when(fits, hours), "confidence": F.when(fits, F.least(F.greatest("r2", F.lit(0.0)), F.lit(1.0)))})


def exponential_life(df: DataFrame, threshold: float, decreasing: bool) -> DataFrame:
    """As linear_life, by the logarithm of positive readings, unless the line fits better or fewer than three are positive."""
    line = linear_life(df, threshold, decreasing).select(*KEYS, F.col("remaining").alias("line_remaining"), F.col("confidence").alias("line_confidence"), F.col("r2").alias("line_r2"))
    hours = _hours(df).withColumn("y", F.when(F.col("value") > 0, F.ln("value"))).withColumn("hours", F.when(F.col("y").isNotNull(), F.col("hours")))
    curve = hours.groupBy(*KEYS).agg(F.count("y").alias("n"), F.expr("regr_slope(y, hours)").alias("b"), F.expr("regr_intercept(y, hours)").alias("a"), F.coalesce(F.expr("regr_r2(y, hours)"), F.lit(0.0)).alias("r2"), F.max("hours").alias("span"))
    both = line.join(curve, list(KEYS), "left")
    usable = F.coalesce((F.col("n") >= 3) & (F.abs("b") >= 1e-12) & (F.col("r2") >= F.col("line_r2")), F.lit(False)) & F.lit(threshold > 0)
    remaining = F.greatest((F.ln(F.lit(float(threshold))) - F.col("a")) / F.col("b") - F.col("span"), F.lit(0.0))
    return both.select(*KEYS, F.when(usable, "exponential").otherwise("linear").alias("model"), F.when(usable, remaining).otherwise(F.col("line_remaining")).alias("remaining"), F.when(usable, F.least("r2", F.lit(1.0))).otherwise(F.col("line_confidence")).alias("confidence"))


def urgency(hours: Column | str) -> Column:
    hours = F.col(hours) if isinstance(hours, str) else hours
    return F.when(hours <= 0, "critical").when(hours <= 24, "urgent").when(hours <= 168, "warning").otherwise("info")


def life_summary(threshold: float) -> Column:
    """The summary of a life (remaining, confidence, last): hours left or that the end is reached; null without remaining."""
    over = F.concat(F.lit("Component has reached end of life (current: "), shown("last", 1), F.lit(f", threshold: {threshold:.1f})"))
    left = F.concat(F.lit("Estimated "), F.round("remaining", 0).cast("long").cast("string"), F.lit(" hours remaining (confidence: "), F.round(F.round(F.col("confidence") * 100, 9), 0).cast("long").cast("string"), F.lit("%)"))
    return F.when(F.col("remaining") <= 0, over).when(F.col("remaining").isNotNull(), left)
