"""Searches around hubs: parts of a hub's relations, the same results; files of logs pruned by their names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ferrolens.operators import tables
from ferrolens.sources.files import read_service_logs


def reach(edges, seeds, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in seeds:
        seen, level = {s: 0}, {s}
        for d in range(1, depth + 1):
            level = {y for x in level for y in near.get(x, ()) if y not in seen}
            seen.update(dict.fromkeys(level, d))
        out |= {(s, e, d) for e, d in seen.items()}
    return sorted(out)


@pytest.mark.parametrize("heavy", [5, 1000])
def test_neighbours_around_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(tables, "HEAVY", heavy)
    r = random.Random(2)
    edges = [("hub", f"n{i}") for i in range(120)] + [(f"n{r.randint(0, 200)}", f"n{r.randint(0, 200)}") for _ in range(80)] + [("hub", "hub"), ("n1", "n2"), ("n2", "n1")]
    seeds = ["hub", "n1", "n150", "alone"]
    relations = spark.createDataFrame(edges, "source string, target string")
    got = tables.neighbours(spark.createDataFrame([(s,) for s in seeds], "seed string"), relations, 2)
    assert sorted(map(tuple, got.collect())) == reach(edges, seeds, 2)


def test_a_star_has_no_hot_part(spark):
    star = spark.range(200_000).select(F.lit("hub").alias("source"), F.concat(F.lit("n"), "id").alias("target"))
    both, heavy = tables.split_relations(star)
    assert [r["source"] for r in heavy.collect()] == ["hub"]
    sizes = [r["count"] for r in both.filter("source = 'hub'").groupBy("part").count().collect()]
    assert len(sizes) == 50 or max(sizes) < 0.02 * sum(sizes)
    assert max(sizes) < 0.02 * sum(sizes)


def test_log_files_out_of_range_are_not_opened(spark, tmp_path):
    for name in ("api-20240130", "api-20240131", "api-20240201", "worker-20240131", "api"):
        os.makedirs(tmp_path / "logs", exist_ok=True)
        (tmp_path / "logs" / f"{name}.json").write_text('{"@t": "2024-01-31T10:00:00Z", "@mt": "x", "n": "%s"}\n' % name)
    df = read_service_logs(spark, str(tmp_path / "logs"), "API", "2024-01-31", "2024-01-31")
    assert sorted(r["extra"]["n"] for r in df.collect()) == ["api", "api-20240131"]
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    files = [leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]
    assert sum(files) == 2
