"""Diagnosis: row scope, codes inside texts, four inputs, the numbers of reports and the words of alerts."""

import random

import pytest
from pyspark.sql import functions as F

from ferrolens.operators import fusion, patterns, tables


def test_scope_of_admins_empty_lists_and_sessions(spark):
    users = spark.createDataFrame(
        [(1, 4, ["x"], 9), (2, 1, [], 9), (3, 1, ["b2", "B2", "c"], 9), (4, 2, None, 9), (5, 4, [], 1), (6, 3, ["none"], 9)], "user_id long, role int, access array<string>, session_expires_at int"
    )
    rows = spark.createDataFrame([("A1", 10), ("b2", 20), (None, 30)], "equipment_id string, event_id long")
    got = tables.scope_rows(rows, users, F.lit(5))
    assert sorted((r["user_id"], r["event_id"]) for r in got.collect()) == [(1, 10), (1, 20), (1, 30), (2, 10), (2, 20), (2, 30), (3, 20), (4, 10), (4, 20), (4, 30)]
    assert {r["user_id"] for r in tables.scope_rows(rows, users).collect()} == {1, 2, 3, 4, 5}
    assert tables.scope_rows(rows, users.filter("user_id = 6")).collect() == []


def test_too_many_users_who_see_all(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_SEE_ALL", 1)
    users = spark.createDataFrame([(1, 4, None), (2, 4, None)], "user_id long, role int, access array<string>")
    with pytest.raises(ValueError, match="see every row"):
        tables.scope_rows(spark.createDataFrame([("a", 1)], "equipment_id string, event_id long"), users)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_codes_inside_texts_equal_contains(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", block)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("aB1-é") for _ in range(n))
    codes = [word(r.randint(1, 4)) for _ in range(40)] + ["", None]
    texts = [word(r.randint(0, 60)) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    got = patterns.with_contained(df, "text", spark.createDataFrame([(c,) for c in codes], "code string"), "code", "found").collect()
    want = {i: sorted({c.lower() for c in codes if c and c.lower() in (t or "").lower()}) for i, t in enumerate(texts)}
    assert {r["id"]: r["found"] for r in got} == want


def four(spark):
    anomalies = [("E1", "flow", "SpikeUp", 0.9, "flow at 10:00"), ("E1", "flow", "SpikeUp", 0.5, "code a-77 near"), ("E1", "flow", "SpikeUp", 0.5, "code a-77 near"), ("E2", "heat", "SpikeDown", 0.1, None)]
    lives = [("E1", 12.4, 0.8, "soon"), ("E1", 20.0, 0.9, "later"), ("E3", 500.0, 0.9, "far"), ("E3", None, None, None)]
    rules = [("E1", "R1", "Pump", "Pump is worn", 1, 2, 0.45, ["Check pump", "Check seal"])]
    causal = [("E1", 1, "", "airFLOW too low", "Leak", "Fix leak", "m1", 0.7), ("E1", 2, "A-77", "other", "", "", "m2", 1.0), ("E4", 3, "B-1", "rust", "Water", "Dry", "m3", 0.9)]
    return (
        spark.createDataFrame(anomalies, "equipment_id string, sensor_id string, type string, confidence double, description string"),
        spark.createDataFrame(lives, "equipment_id string, remaining double, confidence double, summary string"),
        spark.createDataFrame(rules, "equipment_id string, rule_id string, name string, hypothesis string, matched long, total long, confidence double, actions array<string>"),
        spark.createDataFrame(causal, "equipment_id string, entry_id long, error_code string, symptom string, cause string, action string, source_document string, confidence double"),
    )


def test_four_inputs_to_hypotheses(spark):
    rows = fusion.evidence(*four(spark)).cache()
    fused = {(r["equipment_id"], r["key"]): r for r in fusion.fuse(rows).collect()}
    assert set(fused) == {("E1", k) for k in ("anomaly:flow:SpikeUp", "rul:urgent", "expert:R1", "doc:1", "doc:A-77")} | {("E2", "anomaly:heat:SpikeDown"), ("E3", "rul:info"), ("E4", "doc:B-1")}
    spike = fused["E1", "anomaly:flow:SpikeUp"]
    # tier 1 at 0.9; tier 3 through both links: the sensor in one symptom (three anomalies), the code in two descriptions
    assert spike["confidence"] == pytest.approx((0.9 * 0.35 + 0.8 * 0.25) / 0.60 * 1.1)
    assert (spike["n1"], spike["n2"], spike["n3"], spike["actions"]) == (3, 0, 5, ["Fix leak"])
    urgent = fused["E1", "rul:urgent"]
    assert urgent["confidence"] == pytest.approx(0.9) and urgent["hypothesis"].endswith("(12h remaining)")
    assert urgent["actions"] == ["Schedule replacement within 12 hours", "Schedule replacement within 20 hours"]
    assert fused["E3", "rul:info"]["confidence"] == pytest.approx(0.54)
    assert fused["E1", "doc:A-77"]["hypothesis"] == "other" and fused["E1", "expert:R1"]["confidence"] == pytest.approx(0.45)


def test_reports_and_alerts(spark):
    rows = fusion.evidence(*four(spark))
    equipment = spark.createDataFrame([(f"E{i}",) for i in range(1, 6)], "equipment_id string")
    got = {r["equipment_id"]: r for r in fusion.diagnose(equipment, rows).collect()}
    assert {k: r["health"] for k, r in got.items()} == {"E1": "Critical", "E2": "Normal", "E3": "Warning", "E4": "Critical", "E5": "Normal"}
    assert (got["E1"]["n"], got["E1"]["anomalies"], got["E1"]["rules"]) == (5, 3, 1)
    assert got["E1"]["summary"] == "other (100%) | flow SpikeUp detected (94%) | Component approaching end of life (12h remaining) (90%)"
    assert got["E2"]["anomalies"] == 1 and got["E5"]["summary"] == fusion.NORMAL
    alerts = {(r["equipment_id"], r["key"]): r for r in fusion.make_alerts(rows).collect()}
    assert alerts["E1", "expert:R1"]["severity"] == "Warning"
    assert alerts["E1", "expert:R1"]["message"].split("\n") == [
        "Equipment: E1", "Confidence: 45%", "Rank: #5 of 5 hypotheses", "Expert rules matched: 1", "Recommended actions:", "  - Check pump", "  - Check seal",
    ]
    assert alerts["E4", "doc:B-1"]["title"] == "[CRITICAL] Water" and ("E2", "anomaly:heat:SpikeDown") not in alerts
