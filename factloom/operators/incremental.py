"""Incremental refresh: what a change makes invalid, and the rest of a baseline carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import canonical_json, stable_id
from .scope import is_structural
from .traverse import invalidated


#: Between a repository and a path, where both are one key.
BETWEEN = "\u0001"


def file_key(repository: Column, path: Column) -> Column:
    return F.concat_ws(BETWEEN, repository, path)


def path_of(key: Column) -> Column:
    return F.element_at(F.split(key, BETWEEN), -1)


def rebase_evidence(evidence: DataFrame, stale: DataFrame, snapshot: str | DataFrame) -> DataFrame:
    """Evidence of files that aren't stale (path, and repository_id where there are several), with ids of the new snapshot; old_id
    is the one before. snapshot: its id, or the ids (repository_id, snapshot_id); what has none there is gone."""
    keys = [c for c in ("repository_id", "relative_path") if c == "relative_path" or c in stale.columns]
    kept = evidence.join(stale.withColumnRenamed("path", "relative_path").select(keys), keys, "left_anti").withColumn("old_id", F.col("id"))
    if isinstance(snapshot, str):
        kept = kept.withColumn("snapshot_id", F.lit(snapshot))
    else:
        kept = kept.drop("snapshot_id").join(snapshot, "repository_id")
    fresh = stable_id("evidence", F.col("snapshot_id"), F.col("relative_path"), F.col("locator.start"), F.col("locator.end"), F.col("rule_id"))
    return kept.withColumn("id", fresh).select(*[c for c in evidence.columns if c != "snapshot_id"], "snapshot_id", "old_id")


def rebase_facts(facts: DataFrame, rebased: DataFrame) -> DataFrame:
    """Facts all of whose evidence was carried over, with new ids of both. rebased: (old_id, id)."""
    mapped = (
        facts.select(F.col("id").alias("_fact"), F.posexplode("evidence_ids").alias("_n", "old_id"))
        .join(rebased.select("old_id", F.col("id").alias("_new")), "old_id")
        .groupBy("_fact").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_new"))), lambda x: x["_new"]).alias("_ids"))
    )
    whole = facts.join(mapped, F.col("id") == F.col("_fact")).filter(F.size("_ids") == F.size("evidence_ids"))
    fresh = stable_id("fact", F.col("component_id"), F.col("kind"), canonical_json(F.col("value_json")), F.array_join("_ids", ","))
    return whole.withColumns({"id": fresh, "evidence_ids": F.col("_ids")}).select(facts.columns)


def plan_refresh(changes: DataFrame, imports: DataFrame, same_rules: bool = True) -> tuple[str, DataFrame | None]:
    """changes (path, change) -> unchanged, incremental with the stale paths, or full: other rules and changed build files
    need everything again."""
    if not same_rules:
        return "full", None
    found = changes.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_structural(path_of(F.col("path")))).alias("structural")).first()
    if not found["n"]:
        return "unchanged", None
    return ("full", None) if found["structural"] else ("incremental", invalidated(changes, imports))


def merge(baseline: dict[str, DataFrame], delta: dict[str, DataFrame], stale: DataFrame, snapshot_id: str | DataFrame) -> dict[str, DataFrame]:
    """facts, evidence and diagnostics of a baseline without what is stale, and those of the files that were read again."""
    evidence = rebase_evidence(baseline["evidence"], stale, snapshot_id)
    run = F.lit(snapshot_id) if isinstance(snapshot_id, str) else F.lit("")
    facts = rebase_facts(baseline["facts"], evidence)
    told = baseline["diagnostics"].join(stale.select(F.col("path").alias("scope")), "scope", "left_anti")
    told = told.withColumn("id", stable_id("diagnostic", run, F.col("scope"), F.col("code"), F.col("message"))).select(baseline["diagnostics"].columns)
    return {
        "facts": facts.unionByName(delta["facts"]).dropDuplicates(["id"]),
        "evidence": evidence.drop("old_id").unionByName(delta["evidence"]).dropDuplicates(["id"]),
        "diagnostics": told.unionByName(delta["diagnostics"]).dropDuplicates(["id"]),
    }


def orphans(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, evidence_id): evidence that facts name and that isn't there; a fact without evidence has a null one."""
    named = facts.select("id", F.explode_outer("evidence_ids").alias("evidence_id"))
    return named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti").select("id", "evidence_id")


def invalid_evidence(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, problem) of evidence that breaks a rule."""
    path = F.col("relative_path")
    problem = (
        F.when(~F.col("source_hash").rlike("^[0-9a-f]{64}$"), "hash").when(path.startswith("/") | path.rlike("(^|/)\\.\\.(/|$)|^[A-Za-z]:"), "path")
        .when(F.col("locator.end") < F.col("locator.start"), "locator")
    )
    known = snapshots.select(F.col("id").alias("snapshot_id"))
    broken = evidence.select("id", problem.alias("problem")).filter("problem is not null")
    strange = evidence.join(known, "snapshot_id", "left_anti").select("id", F.lit("snapshot").alias("problem"))
    twice = evidence.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("problem"))
    return broken.unionByName(strange).unionByName(twice)
