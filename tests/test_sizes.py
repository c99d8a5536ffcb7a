"""What came to light on large tables: numbers beyond a million, many keys, many and long texts."""

import tracemalloc

import duckdb
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import TimerValues

from ferrolens.operators import chunks
from ferrolens.plans.catalogue import QUERIES, SQL
from ferrolens.streaming import folds, ordered


def test_chunks_of_a_document_keep_apart_beyond_a_million_events(spark, tmp_path):
    kinds = ("view", "click", "error")
    rows = [(i + far, 7, kinds[i % 3] if far else "signup") for i in range(12) for far in (0, 1_000_000, 3_000_000_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["cau4_extract_causal"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({SQL['cau4_extract_causal']})").fetchall()
    plain = lambda found: sorted(map(str, map(tuple, found)))
    assert plain(got.collect()) == plain(want)


class Handle:
    """A key's state and timers, and how many messages went to Spark."""

    def __init__(self):
        self.value, self.messages, self.timers = None, 0, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value

    def registerTimer(self, at):
        self.messages += 1
        self.timers.append(at)


def test_a_live_key_costs_few_messages_and_one_row(spark):
    fold = folds.Detect()
    fields = [T.StructField("at_us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())]
    reorder, handle = ordered._Reorder(fold, [T.StructField("equipment_id", T.LongType())], fields), Handle()
    reorder.init(handle)
    live = Row("equipment_id", "at_us", "event_id", "value")
    given = [live(7, 1000 * i, i, float(i % 5)) for i in range(500)]
    assert list(reorder.handleInputRows((7,), iter(given[::-1]), TimerValues(-1, 0))) == []
    assert handle.messages == 3 and handle.timers == [1]
    (told,) = reorder.handleExpiredTimer((7,), TimerValues(-1, 400), None)
    assert handle.messages == 6
    want = fold.run(None, None, [tuple(r)[1:] for r in given[:400]], None)[2]
    assert list(zip(told.event_id, told.ema, told.z, told.odd, strict=True)) == want
    assert told.late_by == []
    late, rest = reorder.handleInputRows((7,), iter([live(7, 5, 900, 1.0)]), TimerValues(-1, 600))
    assert (late.late_event_id, late.late_by) == ([900], [0.599995])
    assert rest.event_id == list(range(400, 500))


class Given:
    """One batch of documents, and the peak of what chunking it holds in Python."""

    schema = T.StructType([T.StructField("document_id", T.LongType())])

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def _drain(self, run, batch):
        tracemalloc.start()
        n = sum(len(x) for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, peak

    def mapInArrow(self, run, _):
        return self._drain(run, self.batch)

    def mapInPandas(self, run, _):
        return self._drain(run, self.batch.to_pandas())


def test_chunks_of_a_batch_are_given_on_as_they_come():
    text = "## Pump\n" + "word " * 4_000
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(1_000)), "text": [text] * 1_000})
    for markdown in (False, True):
        n, peak = chunks.chunk(Given(batch), markdown=markdown)
        assert n >= 50_000
        assert peak < 15_000_000


def test_lines_of_chunks(spark):
    text = "a\n\n# One\n" + "x y.\n" * 300 + "# Two\n\n" + "\n" * 700 + "end"
    for markdown in (False, True):
        found = chunks.chunk(spark.createDataFrame([(1, text), (2, None), (3, " ")], "document_id long, text string"), markdown=markdown).collect()
        assert found and {r.document_id for r in found} == {1}
        assert [r.chunk_index for r in found] == list(range(len(found)))
        for r in found:
            assert r.text.endswith(text[r.char_start : r.char_end])
            assert (r.line_start, r.line_end) == tuple(text.count("\n", 0, at) + 1 for at in (r.char_start, r.char_end))
