"""Event-time order on live rows: a reorder buffer with timers, and a second output for late rows.

Rows of a key are kept in its state until the watermark has passed them, then go to a fold in
order of time and tie-break. So results don't depend on how rows fall into batches, as long as each
comes before the watermark has passed it. A row behind the watermark isn't dropped: it comes out at once as a late row,
with its lateness. Timers in event time release rows of keys that get no more input, tell folds that time has passed
(`Fold.wake`), and clear the state of keys that were silent for the fold's `forget`.

A fold is the same object in a stream (`in_order`) and in a batch (`in_batch`). State of a key is one
value: the rows of the watermark's delay, packed, and the fold's tuple. Streams need the RocksDB state store: `use_state_store` or `run_available` sets it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the time in microseconds beside a row's own columns.
AT = "at_us"


class Fold:
    """What happens to the ordered rows of one key.

    columns: schema string of the output, without keys; state: schema string of the state tuple; needs: input
    columns besides keys and order; forget: seconds without a row after which a key starts anew (None: never).
    """

    columns: str
    state: str
    needs: tuple[str, ...] = ()
    forget: float | None = None

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        """New state and output rows. row: time in microseconds, tie-break, then `needs`."""
        raise NotImplementedError

    def wake(self, state: tuple) -> int | None:
        """When, in microseconds, the fold has something to say if no row comes before."""
        return None

    def pass_time(self, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        """New state and output rows once all rows before `until` are known."""
        return state, []

    def run(self, state: tuple | None, last: int | None, rows: list[tuple], until: int | None) -> tuple[tuple | None, int | None, list[tuple]]:
        """State, time of the last row, and output after some rows in order, and then time up to `until`."""
        out: list[tuple] = []
        quiet = None if self.forget is None else int(self.forget * 1e6)
        for row in rows:
            if state is not None:
                state, told = self.pass_time(state, row[0] if quiet is None else min(row[0], last + quiet))
                out += told
                if quiet is not None and row[0] - last >= quiet:
                    state = None
            state, told = self.step(state, row)
            out += told
            last = row[0]
        if state is not None and until is not None:
            state, told = self.pass_time(state, until if quiet is None else min(until, last + quiet))
            out += told
            if quiet is not None and until - last >= quiet:
                state = None
        return state, last, out


class _Reorder(StatefulProcessor):
    """Buffer, release in order, fold; see the module's text.

    A call costs a few messages to Spark and no frame: a key's state, clock and waiting rows are one value, and what a call tells
    of a key is one row of arrays, however many keys there are.
    """

    def __init__(self, fold: Fold, keys: list[T.StructField], row: list[T.StructField]):
        self.fold, self.row = fold, row
        # parsed here: workers have no session
        self.own = T.StructType.fromDDL(fold.columns).fields
        self.held = T.StructType.fromDDL(fold.state).fields
        self.lists = [*self.own, T.StructField("late_by", T.DoubleType()), *(T.StructField(f"late_{f.name}", f.dataType) for f in row)]
        self.schema = T.StructType([*keys, *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.lists)])

    def init(self, handle: Any) -> None:
        self.handle = handle
        clock = [T.StructField("last_us", T.LongType()), T.StructField("timer_ms", T.LongType()), T.StructField("waiting", T.BinaryType())]
        self.state = handle.getValueState("state", T.StructType(self.held + clock))
        self.told = Row(*self.schema.names)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh: list[tuple] = []
        late: list[tuple] = []
        own = None
        for r in rows:
            own = own or itemgetter(*(r.__fields__.index(f.name) for f in self.row))
            row = own(r)
            if row[0] < passed:
                late.append(((passed - row[0]) / 1e6, *row))
            else:
                fresh.append(row)
        if late:
            yield self._tell(key, [[]] * len(self.own) + [list(c) for c in zip(*late, strict=True)])
        yield from self._advance(key, fresh, passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key: Any, fresh: list[tuple], passed: int) -> Iterator[Row]:
        held = self.state.get()
        *state, last, timer, kept = held or (*(None,) * len(self.held), None, None, None)
        state = tuple(state) if last is not None else None
        waiting = pickle.loads(kept) + fresh if kept else fresh
        ready = sorted((r for r in waiting if r[0] < passed), key=itemgetter(0, 1))
        left = [r for r in waiting if r[0] >= passed]
        state, last, out = self.fold.run(state, last, ready, passed if passed > 0 else None)
        due = [min(r[0] for r in left)] if left else []
        if state is not None:
            wake = self.fold.wake(state)
            due += [wake] if wake is not None else []
            due += [last + int(self.fold.forget * 1e6)] if self.fold.forget is not None else []
        at = max(min(due), passed) // 1000 + 1 if due else None
        if timer is not None and timer != at and timer * 1000 > passed:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        if state is None and at is None:
            if held:
                self.state.clear()
        else:
            now = state if state is not None else (None,) * len(self.held)
            self.state.update((*now, last if state is not None else None, at, pickle.dumps(left) if left else None))
        if out:
            yield self._tell(key, [list(c) for c in zip(*out, strict=True)] + [[]] * (1 + len(self.row)))

    def _tell(self, key: Any, lists: list[list]) -> Row:
        return self.told(*key, *lists)

    def close(self) -> None:
        pass


class _Split(StatefulProcessor):
    """Rows in time and late rows side by side; no state."""

    def __init__(self, keys: list[T.StructField], row: list[T.StructField]):
        self.keys, self.row = keys, row

    def init(self, handle: Any) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            behind = (batch[AT] < passed).to_numpy()
            if behind.any():
                late = batch[behind]
                yield self._frame(key, len(late), {"late_by": (passed - late[AT]) / 1e6} | {f"late_{f.name}": late[f.name] for f in self.row})
            ready = batch[~behind]
            yield self._frame(key, len(ready), {f.name: ready[f.name] for f in self.row})

    def _frame(self, key: Any, n: int, columns: dict[str, Any]) -> pd.DataFrame:
        given = {c: list(v) for c, v in columns.items()}
        out = {f.name: [value] * n for f, value in zip(self.keys, key, strict=True)}
        every = [*(f.name for f in (*self.keys, *self.row)), "late_by", *(f"late_{f.name}" for f in self.row)]
        return pd.DataFrame({c: out.get(c, given.get(c, [None] * n)) for c in every}, columns=every).astype(object)

    def close(self) -> None:
        pass


def _prepared(df: DataFrame, keys: list[str], tie: str, needs: tuple[str, ...], late: str, ts: str) -> tuple[DataFrame, list[T.StructField], list[T.StructField]]:
    """Keys and rows, the time as microseconds: a plain number, so that Spark doesn't drop what is behind the watermark."""
    marked = df.withWatermark(ts, late)
    rows = marked.select(*keys, F.unix_micros(ts).alias(AT), F.col(tie), *needs)
    return rows, [rows.schema[k] for k in keys], [rows.schema[c] for c in (AT, tie, *needs)]


def in_order(df: DataFrame, keys: list[str], tie: str, fold: Fold, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Keys and the fold's columns, for the rows of each key in order; late rows beside them.

    late_by (seconds) is null in the fold's rows; in a late row it is how far the row was behind the watermark, and the row's own
    columns are late_at_us, late_<tie>, late_<needs>. See `on_time` and `late_rows`.
    """
    rows, key_fields, row = _prepared(df, keys, tie, fold.needs, late, ts)
    reorder = _Reorder(fold, key_fields, row)
    told = rows.groupBy(*keys).transformWithState(reorder, reorder.schema, "Append", "EventTime")
    return told.select(*keys, F.inline(F.arrays_zip(*(f.name for f in reorder.lists))))


def split_late(df: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts", buckets: int = 64) -> DataFrame:
    """Every row once: as it is, or, where the watermark has passed it, as a late row with its lateness (`late_by`, late_<column>).

    Rows are dealt out by a hash of `key` over `buckets`, so no value of any column makes a hot task. No state is kept.
    """
    needs = tuple(c for c in df.columns if c not in (ts, key))
    salted = df.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows, key_fields, row = _prepared(salted, ["bucket_"], key, needs, late, ts)
    schema = T.StructType([*key_fields, *row, T.StructField("late_by", T.DoubleType()), *(T.StructField(f"late_{f.name}", f.dataType) for f in row)])
    return rows.groupBy("bucket_").transformWithStateInPandas(_Split(key_fields, row), schema, "Append", "EventTime").drop("bucket_")


def _late_columns(tagged: DataFrame) -> list[str]:
    return [c for c in tagged.columns if c.startswith("late_") and c != "late_by"]


def on_time(tagged: DataFrame) -> DataFrame:
    """The rows that came in time."""
    return tagged.filter("late_by is null").drop("late_by", *_late_columns(tagged))


def late_rows(tagged: DataFrame) -> DataFrame:
    """The late rows under their own names, with `late_by` in seconds."""
    own = _late_columns(tagged)
    keys = [c for c in tagged.columns[: tagged.columns.index("late_by")] if f"late_{c}" not in own]
    return tagged.filter("late_by is not null").select(*keys, *(F.col(c).alias(c.removeprefix("late_")) for c in own), "late_by")


def two_sinks(tagged: DataFrame, on_time_path: str, late_path: str):
    """A writer that puts rows in time below one path and late rows below another: start it with a checkpoint.

    A batch's rows go to a folder of its number, which a repeated batch overwrites, so each row is written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for rows, path in ((on_time(batch), on_time_path), (late_rows(batch), late_path)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return tagged.writeStream.foreachBatch(put)


def in_batch(df: DataFrame, keys: list[str], tie: str, fold: Fold, ts: str = "ts", until: str | None = None) -> DataFrame:
    """What `in_order` gives for rows in time, from a table: one sorted pass, each key's rows streamed through the fold.

    until: a timestamp up to which time passes for every key after its last row; by default it ends with the last row.
    """
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias(AT), F.col(tie), *fold.needs)
    end = None if until is None else int(pd.Timestamp(until).value // 1000)
    columns = T.StructType.fromDDL(fold.columns)
    schema = T.StructType([rows.schema[k] for k in keys] + columns.fields)
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = None, None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[: len(keys)] != key:
                    if key is not None and end is not None:
                        out += [(*key, *r) for r in fold.run(state, last, [], end)[2]]
                    key, state, last = row[: len(keys)], None, None
                state, last, told = fold.run(state, last, [row[len(keys) :]], None)
                out += [(*key, *r) for r in told]
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None and end is not None and (rest := fold.run(state, last, [], end)[2]):
            yield pd.DataFrame([(*key, *r) for r in rest], columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, AT, tie).mapInPandas(run, schema)


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run_available(df: DataFrame, folder: str, late_folder: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now, into Parquet below `folder`, and read the result.

    late_folder: late rows of a tagged stream go there, and only rows in time come back.
    """
    spark = df.sparkSession
    use_state_store(spark)
    writer = df.writeStream.format("parquet").option("path", f"{folder}/rows") if late_folder is None else two_sinks(df, f"{folder}/rows", late_folder)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = df.schema if late_folder is None else on_time(df).schema
    return spark.read.schema(schema).parquet(f"{folder}/rows")
