"""Structured Streaming: rates, joins and state on live data.

Event times are timestamps; a watermark bounds the state, and rows later than it are dropped by
Spark. Each operator takes and gives a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrolens.operators.logs import display_level


def error_rates(logs: DataFrame, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Errors and warnings by service and tumbling window; a window comes out once it is closed."""
    level = display_level("level")
    counts = logs.withWatermark("ts", late).groupBy(F.window("ts", bucket), "service").agg(F.count_if(level.isin("ERR", "FTL")).alias("errors"), F.count_if(level == "WRN").alias("warnings"), F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "service", "errors", "warnings", "n")


def alarm_windows(triggers: DataFrame, records: DataFrame, before: str = "5 minutes", after: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records around each trigger (equipment_id, trigger_id, trigger_ts), both sides live."""
    t = triggers.withWatermark("trigger_ts", late).alias("t")
    r = records.withWatermark("ts", late).alias("r")
    inside = (F.col("r.ts") >= F.col("t.trigger_ts") - F.expr(f"interval {before}")) & (F.col("r.ts") <= F.col("t.trigger_ts") + F.expr(f"interval {after}"))
    return t.join(r, (F.col("t.equipment_id") == F.col("r.equipment_id")) & inside).select("t.equipment_id", "t.trigger_id", "t.trigger_ts", "r.ts", "r.event_id")


def suppress(alerts: DataFrame, minutes: float = 60, late: str = "10 minutes") -> DataFrame:
    """Alerts (equipment_id, hypothesis, ts, alert_id) less those within `minutes` of the last one issued for their key.

    State is one time for each key; it goes when the watermark has passed it by the memory's length.
    """
    width = pd.Timedelta(minutes=minutes)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "alert_id"])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        keep = []
        for ts in rows["ts"]:
            issue = last is None or ts - last >= width
            keep.append(issue)
            last = ts if issue else last
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + width).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep][["equipment_id", "hypothesis", "ts", "alert_id"]]

    schema = "equipment_id long, hypothesis string, ts timestamp, alert_id long"
    return alerts.withWatermark("ts", late).groupBy("equipment_id", "hypothesis").applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def detect(readings: DataFrame, span: int = 10, caution: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """Readings with the running moving average and the deviation from the running mean of their series.

    State is (average, count, mean, sum of squares) for each series.
    """
    alpha = 2 / (span + 1)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ema, n, mean, squares = state.get if state.exists else (None, 0, 0.0, 0.0)
        emas, zs = [], []
        for x in rows["value"].tolist():
            std = (squares / n) ** 0.5 if n else 0.0
            zs.append((x - mean) / std if n >= 5 and std > 1e-10 else 0.0)
            ema = x if ema is None else alpha * x + (1 - alpha) * ema
            emas.append(ema)
            n += 1
            squares += (x - mean) * (x - (mean + (x - mean) / n))
            mean += (x - mean) / n
        state.update((ema, n, mean, squares))
        yield pd.DataFrame({"equipment_id": key[0], "sensor_id": key[1], "event_id": rows["event_id"], "ema": emas, "z": zs, "odd": [abs(z) >= caution for z in zs]})

    schema = "equipment_id long, sensor_id string, event_id long, ema double, z double, odd boolean"
    return readings.withWatermark("ts", late).groupBy("equipment_id", "sensor_id").applyInPandasWithState(step, schema, "ema double, n long, mean double, squares double", "append", GroupStateTimeout.NoTimeout)


def ingest(files: DataFrame, path: str, removed: DataFrame | None = None, markdown: bool = True):
    """Writers that keep the chunks below `path` in step with a live corpus: start each with its checkpoint.

    files is a stream of (document_id, text, changed): of several versions of a document in a batch the newest counts,
    and its chunks replace all older ones. removed is a stream of (document_id) whose chunks go. path may be a
    `sources.chunkstore.ChunkStore`: then each batch is one version, and readers never see half of it.
    """
    from ferrolens.operators.chunks import chunk
    from ferrolens.sources import files as stores
    from ferrolens.sources.chunkstore import ChunkStore

    def write_chunks(rows: DataFrame, where) -> None:
        where.write(rows) if isinstance(where, ChunkStore) else stores.write_chunks(rows, where)

    def delete_chunks(ids: DataFrame, where) -> None:
        where.delete(ids) if isinstance(where, ChunkStore) else stores.delete_chunks(ids, where)

    def put(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("document_id").agg(F.max_by("text", "changed").alias("text")).persist()
        try:
            parts = chunk(newest, markdown=markdown)
            write_chunks(parts, path)
            blank = newest.join(parts.select("document_id").distinct(), "document_id", "left_anti")
            delete_chunks(blank.select("document_id"), path)
        finally:
            newest.unpersist()

    writers = [files.writeStream.foreachBatch(put)]
    if removed is not None:
        writers.append(removed.writeStream.foreachBatch(lambda batch, _: delete_chunks(batch.select("document_id"), path)))
    return writers


def with_passages(triggers: DataFrame, index, k: int, path: str):
    """A writer that finds the k passages of each live trigger (trigger_id, description) in a stored index
    (`operators.textindex`) and puts (trigger_id, chunk_id, score, place) below `path`: start it with a checkpoint.

    Each batch probes the index once for all its triggers, and its rows go to a folder of its number, which a repeated batch
    overwrites: every trigger gets its passages exactly once, those of `bm25_search` in batch.
    """
    from ferrolens.operators.textindex import search

    def put(batch: DataFrame, number: int) -> None:
        asked = batch.select(F.col("trigger_id").alias("query_id"), F.col("description").alias("query"))
        found = search(asked, index, k).results
        found.withColumnRenamed("query_id", "trigger_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return triggers.writeStream.foreachBatch(put)


def rules(readings: DataFrame, triggers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(equipment_id, trigger_id, since, ts): triggers (trigger_id, sensor_id, low, high, duration_seconds; a static table) whose
    condition, a value from low to high, has held for their duration; each comes out once for a stretch in which it holds.

    State is the start of the stretch and whether it was told, for each equipment and trigger.
    """
    met = readings.withWatermark("ts", late).join(F.broadcast(triggers), "sensor_id")
    holds = (F.col("value") >= F.coalesce("low", F.col("value"))) & (F.col("value") <= F.coalesce("high", F.col("value")))
    rows = met.select("equipment_id", "trigger_id", "ts", "event_id", "duration_seconds", F.coalesce(holds, F.lit(False)).alias("holds"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        since, told = state.get if state.exists else (None, False)
        out = []
        for ts, held, need in zip(some["ts"], some["holds"], some["duration_seconds"], strict=True):
            now = ts.value // 1000
            if not held:
                since, told = None, False
                continue
            since = now if since is None else since
            if not told and now - since >= need * 1_000_000:
                told = True
                out.append((*key, pd.Timestamp(since, unit="us"), ts))
        state.update((since, told))
        yield pd.DataFrame(out, columns=["equipment_id", "trigger_id", "since", "ts"])

    schema = "equipment_id long, trigger_id long, since timestamp, ts timestamp"
    return rows.groupBy("equipment_id", "trigger_id").applyInPandasWithState(step, schema, "since long, told boolean", "append", GroupStateTimeout.NoTimeout)


def first_seen(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Requests (key, ts, ...) less those whose key was met within `hours` before: an expiring table of keys. A key's state goes
    when the watermark has passed it."""
    return requests.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["key"])


def changes(readings: DataFrame, mean: float, std: float, threshold: float = 5.0, drift: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """(equipment_id, sensor_id, event_id, ts, direction): change points of live series by a two-sided cumulative sum of deviations
    from a known mean, which starts anew at each. State is the two sums."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        up, down = state.get if state.exists else (0.0, 0.0)
        out = []
        for event, ts, x in zip(some["event_id"], some["ts"], some["value"], strict=True):
            z = (x - mean) / std
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            if up > threshold or down > threshold:
                out.append((*key, event, ts, "up" if up > threshold else "down"))
                up = down = 0.0
        state.update((up, down))
        yield pd.DataFrame(out, columns=["equipment_id", "sensor_id", "event_id", "ts", "direction"])

    schema = "equipment_id long, sensor_id string, event_id long, ts timestamp, direction string"
    return readings.withWatermark("ts", late).groupBy("equipment_id", "sensor_id").applyInPandasWithState(step, schema, "up double, down double", "append", GroupStateTimeout.NoTimeout)
