"""Selections, references, baselines and proposals on literal rows."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import contracts


def test_selection_and_references(spark):
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    assert contracts.select_context(t, t.limit(1)).count() == 1
    with pytest.raises(ValueError):
        contracts.select_context(t, spark.createDataFrame([("z",)], "id string"))
    rows = spark.createDataFrame([("x", ["a", "q"], ["b"])], "id string, fact_ids array<string>, evidence_ids array<string>")
    assert [tuple(r) for r in contracts.broken_references(rows, {"fact_ids": t, "evidence_ids": t}).collect()] == [("x", "fact_ids", "q")]


def test_baselines(spark):
    runs = spark.createDataFrame([("r1", "a", "main"), ("r1", "b", "main"), ("r2", "a", "main"), ("r3", "a", "main"), ("r3", "b", "main"), ("r4", "a", "dev"), ("r4", "b", "main")], "run_id string, repository_id string, ref string")
    refs = {"a": "main", "b": "main"}
    assert [r[0] for r in contracts.compatible_baselines(runs, ["b", "a"], refs, []).collect()] == ["r3", "r1"]
    assert [r[0] for r in contracts.compatible_baselines(runs, ["b", "a"], refs, ["r1"]).collect()] == ["r1", "r3"]


def test_digests_branches_workspaces(spark):
    f = spark.createDataFrame([("c", "b", "2"), ("c", "a", "1"), ("d", "a", "1"), ("d", "b", "2")], "candidate_id string, path string, sha256 string")
    assert contracts.candidate_digest(f).select("digest").distinct().count() == 1
    keys = spark.createDataFrame([("feature/x",), ("feature-x",)], "r string").select(contracts.branch_key(F.col("r"))).distinct()
    assert keys.count() == 2
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    assert {tuple(r) for r in contracts.workspace_changes(p("a", "b"), p("b", "c")).collect()} == {("a", "missing"), ("b", "allowed"), ("c", "pending")}
    m = spark.createDataFrame([("p", {"x": "partial"})], "plugin_id string, capabilities map<string,string>")
    assert tuple(contracts.capability_matrix(m).first()) == ("p", "x", "partial")


def test_proposals(spark):
    found = spark.createDataFrame([("p", "fact", ["f"], [f"e{i}" for i in range(5)]), ("q", "unknown", ["f"], ["e"])], "proposal_id string, classification string, fact_ids array<string>, evidence_ids array<string>")
    asked = spark.createDataFrame([("p", "rename")], "proposal_id string, change string")
    assert {r["proposal_id"]: r["confidence"] for r in contracts.proposals(found, asked).collect()} == {"p": "high", "q": "medium"}
