"""Series longer than a task: prefix scans over segments, so that one series uses as many tasks as the table has.

A table is range-partitioned by key and order and stored; a segment is what one partition holds of one key. Only a summary of each segment (count, last
known value, an affine map) passes a window of its key, and there are at most as many segments as keys and partitions together. What
is carried into a segment joins its rows on (key, segment), so no task needs a whole series:

* `positioned`: each row's place in its series, from counts of the segments before;
* `blocks`: rows dealt into blocks of equal length by place, with copies of the neighbours that a moving window needs;
* `filled`: the last known value before and the first after, carried over segments; `asof_join` on top of it;
* `ema`: a block is the affine map y -> a y + b; the maps are composed over blocks, then all blocks run at once.

Results equal the operators of `series`, which keep a series in one sorted task and are cheaper while series are small.
Order columns must tell rows of a key apart. Null keys are keys like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.operators.series import scan, smoothed
from ferrolens.runtime import shared_path

#: Rows of a block.
BLOCK = 1 << 16
#: Bits of a row's number within its partition, below the partition's number.
ROW_BITS = 33


def _carried(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of carry (keys, then others), null keys meeting null keys."""
    renamed = carry.toDF(*(f"{c}_" if c in keys else c for c in carry.columns))
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(renamed[f"{k}_"]) for k in keys))
    return rows.join(renamed, same).drop(*(f"{k}_" for k in keys))


def segmented(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """df stored in order of (keys, order), with `segment_` and `row_`, a row's number in its partition.

    It is stored because a range partitioning isn't the same twice; tasks: partitions, by default those of shuffles.
    """
    spark = df.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_path(spark)}/segments"
    sorted_ = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("id_", F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.withColumns({"segment_": F.shiftright("id_", ROW_BITS), "row_": F.col("id_").bitwiseAND((1 << ROW_BITS) - 1)}).drop("id_")


def positioned(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """df with `at`, the row's place in its series from 0 on, and `n`, the series' length."""
    rows = segmented(df, keys, order, tasks)
    counts = rows.groupBy(*keys, "segment_").agg(F.count("*").alias("m_"), F.min("row_").alias("from_"))
    w = Window.partitionBy(*keys)
    before = F.sum("m_").over(w.orderBy("segment_")) - F.col("m_") - F.col("from_")
    carry = counts.select(*keys, "segment_", before.alias("before_"), F.sum("m_").over(w).alias("n"))
    met = _carried(rows, carry, [*keys, "segment_"])
    return met.withColumn("at", F.col("before_") + F.col("row_")).drop("segment_", "row_", "before_")


def blocks(placed: DataFrame, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows of `positioned` with `block` and `own`: each in the block of its place, and as a copy (own is false) in those of the
    `before` places after it and the `after` places before it. Windows over (keys, block) ordered by `at` then see all they need."""
    if max(before, after) > size:
        raise ValueError(f"a window of {before} and {after} rows around needs blocks of more than {size}")
    home = F.floor(F.col("at") / size).cast("long")
    first, last = F.floor((F.col("at") - after) / size).cast("long"), F.floor((F.col("at") + before) / size).cast("long")
    spread = placed.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("own", F.col("block") == home)


def moving_average(df: DataFrame, n: int, keys: list[str], order: list[str], size: int = BLOCK) -> DataFrame:
    """Means of full windows of n values; in a shorter series of all its values (as `series.moving_average`)."""
    spread = blocks(positioned(df, keys, order), before=n - 1, size=max(size, n))
    w = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(1 - n, 0)
    told = spread.withColumn("average", F.avg("value").over(w))
    return told.filter(F.col("own") & (F.col("at") + 1 >= F.least(F.lit(n), F.col("n")))).drop("at", "n", "block", "own")


def trend(df: DataFrame, keys: list[str], order: list[str], flat: float = 0.001) -> DataFrame:
    """Least-squares slope of the value over its place in the series, and its direction (as `series.trend`)."""
    fitted = positioned(df, keys, order).withColumn("x", F.col("at").cast("double"))
    fitted = fitted.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("value", "x").alias("slope"), F.avg("value").alias("mean"))
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("slope", F.lit(0.0)))
    share = F.when(F.col("mean") == 0, slope).otherwise(slope / F.abs("mean"))
    share = F.round(share, 9)
    direction = F.when(F.abs(share) < flat, "Stable").when(share > 0, "Increasing").otherwise("Decreasing")
    return fitted.select(*keys, "n", slope.alias("slope"), direction.alias("direction"))


def local_anomalies(df: DataFrame, keys: list[str], order: list[str], window: int = 20, threshold: float = 2.5, size: int = BLOCK) -> DataFrame:
    """Readings far from the `window` readings around them; edges and series of under 2 * window don't count (as `series.local_anomalies`)."""
    half = window // 2
    spread = blocks(positioned(df, keys, order), half, half, max(size, window))
    around, x = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(-half, half), F.col("value")
    sums = spread.withColumns({"s_": F.sum(x).over(around) - x, "q_": F.sum(x * x).over(around) - x * x})
    inner = F.col("own") & (F.col("n") >= 2 * window) & (F.col("at") >= half) & (F.col("at") < F.col("n") - half)
    mean = F.col("s_") / (2 * half)
    std = F.sqrt(F.greatest(F.col("q_") / (2 * half) - mean * mean, F.lit(0.0)))
    scored = sums.filter(inner).withColumn("std", std).withColumn("score", F.abs(x - mean) / F.col("std"))
    return scored.filter((F.col("std") > 1e-10) & (F.col("score") > threshold)).drop("n", "at", "s_", "q_", "block", "own")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], tasks: int | None = None) -> DataFrame:
    """keys, `n` and one column for each share: the least value that at least that share of the group's values don't exceed
    (`percentile_disc`), exactly. Null values take no part.

    Values are placed by a range partitioning, and the rows at the wanted places are the answer: no group is held or sorted by one
    task, and nothing grows with a group's different values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value_"), F.monotonically_increasing_id().alias("tie_"))
    placed = positioned(rows, keys, ["value_", "tie_"], tasks)
    wanted = {name: F.greatest(F.ceil(F.col("n") * F.lit(q)).cast("long") - 1, F.lit(0)) for name, q in shares.items()}
    some = placed.filter(reduce(lambda a, b: a | b, (F.col("at") == w for w in wanted.values())))
    return some.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("at") == w, F.col("value_"))).alias(name) for name, w in wanted.items()))


def gaps(df: DataFrame, keys: list[str], order: list[str], ts: str, size: int = BLOCK) -> DataFrame:
    """df with `place` from 1 on, and `gap_ms` to the row before (0 for the first): the flow of one long request or series."""
    spread = blocks(positioned(df, keys, order), before=1, size=size)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys, "block").orderBy("at")
    told = spread.withColumn("gap_ms", F.coalesce(us - F.lag(us).over(w), F.lit(0)) / 1000)
    return told.filter("own").withColumn("place", F.col("at") + 1).drop("at", "n", "block", "own")


def ema(df: DataFrame, span: int, keys: list[str], order: list[str], size: int = BLOCK) -> DataFrame:
    """df with `ema`, the exponential moving average with alpha 2 / (span + 1) from the first value on; null values take no part."""
    alpha = 2 / (span + 1)
    placed = blocks(positioned(df.filter("value is not null"), keys, order), size=size).drop("own")
    within = F.col("at") - F.col("block") * size  # place in the block; the block's last is size - 1, or the series' last
    last = F.least(F.lit(size), F.col("n") - F.col("block") * size) - 1
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), (last - within).cast("double"))
    first = F.min_by("value", "at")
    maps = placed.groupBy(*keys, "block").agg(F.sum(weight * F.col("value")).alias("b"), F.count("*").alias("m"), first.alias("first"))
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}

    def compose(now, rows):
        starts = []
        for a, b, x in zip((1 - alpha) ** rows["m"], rows["b"], rows["first"], strict=True):
            now = x if now is None else now  # the first map applied to the first value gives that value
            starts.append(now)
            now = a * now + b
        return now, {**rows, "start": starts}

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "block"]) + ", start double"
    carry = scan(maps, keys, ["block"], schema, compose)
    carried = _carried(placed, carry, [*keys, "block"]).drop("n")

    def run(now, rows):
        found = smoothed(rows["value"], alpha, rows["start"][0] if now is None else now)
        return found[-1], {**rows, "ema": found}

    types = {f.name: f.dataType.simpleString() for f in carried.schema.fields}
    columns = [c for c in df.columns]
    return scan(carried, [*keys, "block"], ["at"], ", ".join(f"{c} {types[c]}" for c in columns) + ", ema double", run)


def filled(df: DataFrame, keys: list[str], order: list[str], column: str | Column, tasks: int | None = None) -> DataFrame:
    """df with `before` and `after`: the last non-null value of `column` up to the row and the first from the row on, null where there is none.

    column may be a struct, null where unknown, to bring its time along.
    """
    known = F.col(column) if isinstance(column, str) else column
    rows = segmented(df, keys, order, tasks).withColumn("known_", known)
    ends = rows.groupBy(*keys, "segment_").agg(
        F.max_by("known_", F.when(F.col("known_").isNotNull(), F.col("row_"))).alias("last_"), F.min_by("known_", F.when(F.col("known_").isNotNull(), F.col("row_"))).alias("first_")
    )
    w = Window.partitionBy(*keys).orderBy("segment_")
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(*keys, "segment_", F.last("last_", True).over(earlier).alias("last_"), F.first("first_", True).over(later).alias("first_"))
    own = Window.partitionBy(*keys, "segment_").orderBy("row_")
    met = _carried(rows, carry, [*keys, "segment_"])
    before = F.coalesce(F.last("known_", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("last_"))
    after = F.coalesce(F.first("known_", True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("first_"))
    return met.withColumns({"before": before, "after": after}).drop("segment_", "row_", "known_", "last_", "first_")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str) -> DataFrame:
    """left with `values` of the latest row of right that has the same keys and is not later (`at`); null where there is none.

    Of several rows of right at one time the one with the greatest `tie` counts, a column of right.
    """
    packed = F.struct(*values)
    names = left.columns
    one = left.withColumns({"side_": F.lit(1), "tie_": F.monotonically_increasing_id().cast("string"), "given_": F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType)})
    two = right.select(*keys, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names if c not in (*keys, at)), F.lit(0).alias("side_"), F.lpad(F.col(tie).cast("string"), 40, "0").alias("tie_"), packed.alias("given_"))
    both = one.unionByName(two.select(*one.columns))
    found = filled(both, keys, [at, "side_", "tie_"], "given_").filter("side_ = 1")
    return found.select(*names, *(F.col(f"before.{v}").alias(v) for v in values))
