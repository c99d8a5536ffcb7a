"""Chunks, tables and figures by golden texts; stores, reports and live ingest by what they leave behind."""

import json
import os
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from ferrolens.operators import chunks as C
from ferrolens.operators import knowledge as K
from ferrolens.operators import text as X
from ferrolens.sources import files
from ferrolens.streaming import live
from tests.test_operators import drain, stream


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_short_chunks_join_and_long_ones_part(spark):
    short, fair, long = "a" * 100, "b" * 300, "word " * 600
    data = [(1, 0, short), (1, 1, short), (1, 2, short), (1, 3, fair), (1, 4, "end"), (2, 0, "alone"), (3, 0, long), (4, 0, None)]
    got = rows(C.repair_chunk_sizes(spark.createDataFrame(data, "document_id int, chunk_index int, text string")), "document_id", "chunk_index", "text")
    assert got[:2] == [(1, 0, "\n\n".join([short] * 3)), (1, 1, fair + "\n\nend")]
    assert got[2] == (2, 0, "alone")
    parts = [t for d, _, t in got if d == 3]
    assert len(parts) > 1 and all(256 <= len(t) <= 2048 for t in parts) and long.startswith(parts[0]) and long.endswith(parts[-1])
    assert C.repair_chunk_sizes(spark.createDataFrame([], "document_id int, chunk_index int, text string")).count() == 0


def test_documents_by_kind(spark):
    docs = spark.createDataFrame([(1, "# A\nbody", True), (2, "one\n\ntwo\n \nthree", False), (3, None, False)], "document_id int, text string, is_markdown boolean")
    assert rows(C.chunk_documents(docs), "document_id", "strategy", "text") == [(1, "structure", "[A]\n\nbody"), (2, "sliding", "one\n\ntwo\n \nthree")]
    vectors = spark.createDataFrame([(2, 0, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (2, 2, [0.0, 1.0])], "document_id int, place int, vector array<double>")
    assert rows(C.chunk_documents(docs, vectors), "document_id", "chunk_index", "strategy", "text") == [(1, 0, "structure", "[A]\n\nbody"), (2, 0, "semantic", "one\n\ntwo"), (2, 1, "semantic", "three")]


def test_flat_tables_keep_other_lines(spark):
    cases = {
        "no pipes": "no pipes",
        "| a | b |\n|---|---|\n| 1 |  |\n| 2 | 3 | 4 |": "a: 1.\na: 2, b: 3.",
        "| a |\n| b |": "| a |\n| b |",
        "| a |\n|---|\n| 1 |\n|---|\n| 2 |": "a: 1.\n|---|\n| 2 |",
        "| a |\n|---|": "",
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["f"] for r in df.select("i", C.flattened_text("t").alias("f")).orderBy("i").collect()] == list(cases.values())


def test_codes_near_causes(spark):
    far = "x" * 600
    text = f"E-1001 first\nalarm code: B22\n{far}\nA-2002 Symptom: hot\nCause: worn\nAction: swap\nRoot cause - old\n"
    got = rows(C.causal_from_blocks(spark.createDataFrame([(1, 0, text), (1, 1, "Cause: \n"), (2, 0, None)], "document_id int, chunk_index int, text string")), "error_code", "symptom", "cause", "action", "confidence")
    assert got == [("A-2002", "hot", "old", "", 0.7), ("A-2002", "hot", "worn", "swap", 0.7)]


def test_masks_by_first_appearance(spark):
    df = spark.createDataFrame([("CMP-02 CMP-01 CMP-02 CMP-0212 수율: 98.1%",), (None,), ("",)], "t string")
    assert [r["m"] for r in df.select(X.mask_text("t").alias("m")).collect()] == ["[EQUIP_A] [EQUIP_B] [EQUIP_A] [EQUIP_C] [YIELD_REDACTED]", None, ""]


def test_lists_of_corrections(spark):
    df = spark.createDataFrame([("슬러이 E1023 100um",), ("fine",), (None,)], "q string")
    got = [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in df.select(K.corrections("q").alias("c")).collect()]
    assert got == [[("슬러이", "슬러리"), ("E1023", "E-1023"), ("100um", "100 μm")], [], []]


def test_synonyms_and_reports_in_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([["패드", "pad"], ["pump", "", "Pumpe"]]))
    assert rows(files.load_synonyms(spark, str(tmp_path / "s.json")), "group_id", "place", "term") == [(0, 0, "패드"), (0, 1, "pad"), (1, 0, "pump"), (1, 2, "Pumpe")]
    measures = spark.createDataFrame([(i, i % 2 == 0) for i in range(60)], "query_id int, hit boolean")
    report = spark.createDataFrame([(None, None, 60, 0.5, 0.5, 0.5, 0.5, False)], "intent string, language string, n long, recall double, mrr double, ndcg double, hit_rate double, passed boolean")
    files.write_report(measures, report, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "summary")).collect()]
    assert lines[0].startswith("all/all: n=60") and len(lines) == 21 and {"failed: 1", "failed: 39"} <= set(lines)
    assert spark.read.json(str(tmp_path / "out" / "measures")).count() == 60


def test_chunks_are_removed_with_their_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    data = spark.createDataFrame([(f"d{i}", 0, "t") for i in range(20)], "document_id string, chunk_index int, text string")
    files.delete_chunks(data, path)  # nothing there yet
    files.write_chunks(data, path, 4)
    files.delete_chunks(data.filter("document_id in ('d3', 'd4', 'none')"), path, 4)
    assert rows(spark.read.parquet(path), "document_id") == sorted((f"d{i}",) for i in range(20) if i not in (3, 4))
    files.delete_chunks(data, path, 4)
    assert not [f for f in Path(path).rglob("*.parquet") if not f.name.startswith(".")]


def test_live_ingest_follows_the_files(spark, tmp_path):
    path, source = str(tmp_path / "chunks"), str(tmp_path / "in")
    schema = "document_id string, text string, changed int"
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run(removed=None):
        live_files = spark.readStream.schema(schema).parquet(source)
        for k, w in enumerate(live.ingest(live_files, path, removed)):
            w.option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination()

    put([("a", "old", 1), ("a", "new", 2), ("b", "text b", 1)])
    run()
    assert rows(spark.read.parquet(path), "document_id", "text") == [("a", "new"), ("b", "text b")]
    put([("b", " ", 2), ("c", "text c", 1)])
    os.makedirs(tmp_path / "gone")
    spark.createDataFrame([("a",)], "document_id string").write.mode("append").parquet(str(tmp_path / "gone"))
    run(spark.readStream.schema("document_id string").parquet(str(tmp_path / "gone")))
    assert rows(spark.read.parquet(path), "document_id", "text") == [("c", "text c")]


def timed(spark, values, **more):
    data = [(1, "flow", i, datetime(2024, 1, 1) + timedelta(seconds=10 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "equipment_id long, sensor_id string, event_id long, ts timestamp, value double")


def test_live_rules_wait_for_their_duration(spark, tmp_path):
    triggers = spark.createDataFrame([(7, "flow", 5.0, None, 30), (8, "flow", None, 0.0, 0), (9, "other", None, None, 0)], "trigger_id long, sensor_id string, low double, high double, duration_seconds long")
    got = drain(live.rules(stream(spark, timed(spark, [9, 9, 9, 1, 9, 9, 9, 9, 9, 0, 0]), str(tmp_path / "r")), triggers), "rules_met").collect()
    at = lambda t: int((t - datetime(2024, 1, 1)).total_seconds())
    assert sorted((r["trigger_id"], at(r["since"]), at(r["ts"])) for r in got) == [(7, 40, 70), (8, 90, 90)]


def test_live_changes_and_keys(spark, tmp_path):
    got = drain(live.changes(stream(spark, timed(spark, [0.0] * 10 + [4.0] * 4 + [-4.0] * 2), str(tmp_path / "v")), 0.0, 1.0), "steps").collect()
    assert sorted((r["event_id"], r["direction"]) for r in got) == [(11, "up"), (13, "up"), (15, "down")]
    keys = timed(spark, [1, 2, 1, 1]).withColumn("key", F.col("value").cast("string"))
    assert drain(live.first_seen(stream(spark, keys, str(tmp_path / "k"))), "first").count() == 2
