"""Operators that SQL doesn't cover: folds, forests, chunks, files, streams."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros
from ferrolens.operators import chunks, forest, series, tables, text
from ferrolens.operators import retrieval as R
from ferrolens.sources import files
from ferrolens.streaming import live


def readings(spark, values, equipment=1):
    return spark.createDataFrame([(equipment, "s", i, float(v) if v is not None else None) for i, v in enumerate(values)], "equipment_id long, sensor_id string, event_id long, value double").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 60).cast("timestamp_ntz")
    )


def test_cusum_finds_a_step_and_starts_anew(spark):
    values = [0.0, 1.0] * 20 + [10.0, 11.0] * 20
    found = [r["event_id"] for r in series.cusum(readings(spark, values)).orderBy("event_id").collect()]
    mean, std = sum(values) / 80, (sum((v - sum(values) / 80) ** 2 for v in values) / 80) ** 0.5
    up = down = 0.0
    want = []
    for i, v in enumerate(values):
        z = (v - mean) / std
        up, down = max(0, up + z - 0.5), max(0, down - z - 0.5)
        if up > 5 or down > 5:
            want.append(i)
            up = down = 0.0
    assert found == want and want
    assert series.cusum(readings(spark, [1.0] * 30)).count() == 0
    assert series.cusum(readings(spark, [1.0, 9.0])).count() == 0


def test_fold_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r["ema"] for r in series.ema(readings(spark, range(50)), 4).orderBy("event_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(pd.Series(range(50), dtype=float).ewm(alpha=0.4, adjust=False).mean().tolist())


def test_moving_average_of_short_series(spark):
    assert [r["average"] for r in series.moving_average(readings(spark, [1, 2, 6]), 5).collect()] == [3.0]


def test_forest_finds_planted_outliers(spark):
    values = [math.sin(i / 5) for i in range(400)] + [9.0, -8.0]
    df = readings(spark, values)
    steps = forest.fit_forest(df)
    scores = {r["event_id"]: r["score"] for r in forest.score(df, steps).collect()}
    assert len(scores) == 402 and min(scores[400], scores[401]) > max(v for k, v in scores.items() if k < 400)
    assert {r["score"] for r in forest.score(readings(spark, [1.0, 2.0], 9), steps).collect()} == {0.5}
    assert [forest.mean_path(n) for n in (0, 1, 2)] == [0, 0, 1]


def test_chunks_cover_the_text(spark):
    for t in ("", "a", "word " * 400, "One. Two! " * 90, "x" * 2000, "line\n" * 300, "no 1.5 end " * 100):
        spans = list(chunks.cuts(t))
        assert all(e - s <= 512 for s, e in spans)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False))
        assert (not t and not spans) or (spans[0][0] == 0 and spans[-1][1] == len(t))
    md = "intro\n# A\ntext a\n## B\ntext b\n# C\n\n### D\ntext d"
    assert [(p, md[a:b].strip()) for p, a, b in chunks.sections(md)] == [("", "intro"), ("A", "text a"), ("A > B", "text b"), ("C > D", "text d")]
    docs = spark.createDataFrame([(1, md), (2, None), (3, "  ")], "document_id long, text string")
    got = chunks.chunk(docs, markdown=True).orderBy("chunk_index").collect()
    assert [r["text"] for r in got][:2] == ["intro\n", "[A]\n\ntext a\n"] and {r["document_id"] for r in got} == {1}
    assert got[-1]["line_end"] == 9


def test_service_logs_from_files(spark, tmp_path):
    line = lambda **x: json.dumps(x)
    (tmp_path / "api-20240101.json").write_text(line(**{"@t": "2024-01-01T00:00:00Z", "@mt": "hi {Who}", "@l": "Error", "Who": "you"}) + "\n\nnot json\n")
    (tmp_path / "api-20240301.json").write_text(line(**{"@t": "2024-03-01T00:00:00Z", "@mt": "later", "ServiceName": "other"}) + "\n")
    (tmp_path / "undated.json").write_text(line(**{"@t": "2023-03-01T00:00:00Z", "@mt": "old"}) + "\n")
    rows = files.read_service_logs(spark, str(tmp_path)).collect()
    assert sorted(r["template"] for r in rows) == ["hi {Who}", "later", "old"]
    first = next(r for r in rows if r["template"] == "hi {Who}")
    assert (first["service"], first["extra"]) == ("api", {"Who": "you"})
    assert sorted(r["template"] for r in files.read_service_logs(spark, str(tmp_path), start="2024-02-01").collect()) == ["later", "old"]
    assert [r["template"] for r in files.read_service_logs(spark, str(tmp_path), service="API", end="2024-01-31").collect()] == ["hi {Who}"]


def test_corpus_and_chunk_store(spark, tmp_path):
    (tmp_path / "in" / "Sub").mkdir(parents=True)
    (tmp_path / "in" / "Sub" / "A.md").write_text("# T\nbody")
    (tmp_path / "in" / "b.txt").write_text("two\nlines")
    (tmp_path / "in" / "c.pdf").write_text("no")
    docs = files.read_corpus(spark, str(tmp_path / "in"))
    assert {r["document_id"]: r["text"] for r in docs.collect()} == {"sub/a.md": "# T\nbody", "b.txt": "two\nlines"}
    store = str(tmp_path / "store")
    put = lambda rows: files.write_chunks(spark.createDataFrame(rows, "document_id string, chunk_index int, text string"), store, 2)
    put([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("c", 0, "4")])
    put([("a", 0, "new"), ("d", 0, "5")])
    assert sorted((r["document_id"], r["text"]) for r in spark.read.parquet(store).collect()) == [("a", "new"), ("b", "3"), ("c", "4"), ("d", "5")]


def test_korean_terms_and_masks(spark):
    df = spark.createDataFrame([("CMP 패드 교체, 펌프 a 링x",)], "text string")
    assert df.select(R.tokenize("text").alias("t")).first()["t"] == ["cmp", "패드", "교체", "펌프", "링"]
    said = spark.createDataFrame([(1, 1, "cmp-01 and ETCH02, CMP-01 at 10.0.0.1"), (1, 2, "ETCH02"), (2, 1, "none")], "c long, turn long, text string")
    masked = text.mask_equipment(said, "text", ["c"], ["turn"]).withColumn("back", text.unmask("masked", "aliases"))
    got = {(r["c"], r["turn"]): (r["masked"], r["back"]) for r in masked.collect()}
    assert got[1, 1] == ("[EQUIP_A] and [EQUIP_B], [EQUIP_A] at [IP_REMOVED]", "CMP-01 and ETCH02, CMP-01 at [IP_REMOVED]")
    assert got[1, 2][0] == "[EQUIP_B]" and got[2, 1][0] == "none"


@pytest.mark.parametrize(
    ("answer", "gate"),
    [("", "empty"), ("?!", "empty"), ("short", "short"), ("pump pump pump " + "word other " * 8, "repetition"), ("It leaks. " * 3 + "and so it goes on and on for a long time", "repetition"), ("这是 an answer that is long enough to be looked at in full", "chinese"), ("An answer that is long enough and says each thing once only.", "passed")],
)
def test_answer_check(spark, answer, gate):
    assert spark.createDataFrame([(answer,)], "a string").select(text.answer_check("a").alias("g")).first()["g"] == gate


def test_model_arrays(spark):
    df = spark.createDataFrame([('x ["a", "b"] y',), ("none",), (None,)], "r string")
    assert [r["q"] for r in df.select(text.sub_questions("r").alias("q")).collect()] == [["a", "b"], [], []]


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_rates_count_closed_windows(spark, tmp_path):
    logs = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 == 0, "Error").otherwise("Warning").alias("level"), F.lit("svc").alias("service"))
    got = drain(live.error_rates(stream(spark, logs, str(tmp_path / "l"))), "rates").collect()
    assert {r["start"].timestamp() if r["start"].tzinfo else r["start"] for r in got} and all((r["errors"], r["warnings"], r["n"]) == (20, 40, 60) for r in got)
    assert len(got) == 16


def test_live_suppression_equals_the_batch(spark, tmp_path):
    rows = [(1, "h", i, i) for i in (0, 10, 59, 60, 61, 119, 125, 300)] + [(2, "h", i, 100 + i) for i in (5, 6)]
    frame = spark.createDataFrame(rows, "equipment_id long, hypothesis string, minute long, alert_id long").withColumn("ts", F.timestamp_seconds((F.col("minute") + 1440) * 60)).drop("minute")
    batch = tables.suppress(frame.select("equipment_id", "hypothesis", F.col("ts").cast("timestamp_ntz").alias("ts"), "alert_id"))
    want = sorted(r["alert_id"] for r in batch.collect())
    assert want == [0, 60, 105, 125, 300]
    got = drain(live.suppress(stream(spark, frame.select("equipment_id", "hypothesis", "ts", "alert_id"), str(tmp_path / "a"))), "issued")
    assert sorted(r["alert_id"] for r in got.collect()) == want


def test_live_detection_equals_the_batch(spark, tmp_path):
    df = readings(spark, [math.sin(i) for i in range(60)] + [50.0])
    live_df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r for r in drain(live.detect(stream(spark, live_df, str(tmp_path / "r"))), "odd").collect()}
    want = {r["event_id"]: r["ema"] for r in series.ema(df, 10).collect()}
    assert {k: r["ema"] for k, r in got.items()} == pytest.approx(want)
    assert [k for k, r in got.items() if r["odd"]] == [60]


def test_live_windows_join(spark, tmp_path):
    base = spark.range(100).select(F.lit(1).cast("long").alias("equipment_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    triggers = base.filter("event_id % 50 = 20").select("equipment_id", F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"))
    got = drain(live.alarm_windows(stream(spark, triggers, str(tmp_path / "t")), stream(spark, base, str(tmp_path / "b"))), "around").collect()
    assert sorted((r["trigger_id"], r["event_id"]) for r in got) == [(t, t + k) for t in (20, 70) for k in range(-5, 6)]


def test_micros(spark):
    assert spark.sql("select timestamp_ntz'1970-01-01 00:00:01.5' as t").select(micros("t").alias("m")).first()["m"] == 1_500_000


def test_parsed_model_answers(spark):
    from ferrolens.operators import knowledge as K

    answer = 'Sure:\n```json\n{"entities": [{"name": "Pump", "type": "Part"}, {"name": "CMP", "type": "Tool"}], "relations": [{"source": "pump", "target": "cmp", "type": "PART_OF"}, {"source": "x", "target": "PUMP", "type": "NEAR"}]}\n```'
    entities, relations = K.parse_graph(spark.createDataFrame([(answer,), ("broken",), (None,)], "response string"))
    assert {tuple(r) for r in entities.collect()} == {("Pump", "Part"), ("CMP", "Tool")}
    assert {tuple(r) for r in relations.select("source", "target", "kind").collect()} == {("Pump", "CMP", "PART_OF"), ("x", "Pump", "NEAR")}
    found = K.parse_candidates(spark.createDataFrame([(1, '[{"symptom": "leak"}]'), (2, "no")], "response_id int, response string")).collect()
    assert [(r["response_id"], r["type"], r["symptom"], r["confidence"], r["status"]) for r in found] == [(1, "unknown", "leak", 0.5, "PendingReview")]
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, chunk_id int, place int")
    placed = K.rerank_from_scores(results, spark.createDataFrame([(1, '[{"index": 1, "score": 9}, {"index": 7, "score": 10}]'), (2, "?")], "query_id int, response string"))
    assert sorted((r["query_id"], r["new_place"], r["chunk_id"]) for r in placed.collect()) == [(1, 1, 11), (1, 2, 10), (2, 1, 12)]


def test_typing_errors_and_units(spark):
    from ferrolens.operators import knowledge as K

    df = spark.createDataFrame([("슬러이 펌프 E1023 100um 30 rpm A-12",)], "q string")
    assert df.select(K.correct_patterns("q").alias("c")).first()["c"] == "슬러리 펌프 E-1023 100 μm 30 RPM A-12"


def test_vector_search_in_blocks_and_with_ties(spark, monkeypatch):
    """More queries than one block holds are all answered; of many equal vectors the least ids win."""
    from ferrolens.operators import retrieval

    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(99, -1, -1)] + [(200, [0.0, 1.0])], "chunk_id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(q, [1.0, 0.1 * q]) for q in range(10)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["place"], r["chunk_id"]) for r in retrieval.vector_search(asked, vectors, 2).collect())
    assert got == [(q, p, p - 1) for q in range(10) for p in (1, 2)]
    assert retrieval.vector_search(asked.limit(0), vectors, 2).count() == 0
