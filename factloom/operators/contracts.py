"""Selections over tasks, documents and branches, and checks of references between tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def select_context(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows that are asked for (id). One that isn't there is an error."""
    missing = wanted.select(key).distinct().join(table.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"not found: {[r[0] for r in missing]}")
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def broken_references(rows: DataFrame, arrays: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """(id, column, missing): ids in array columns that the table behind a column doesn't have."""
    out = None
    for column, table in arrays.items():
        named = rows.select(key, F.lit(column).alias("column"), F.explode(column).alias("missing"))
        lost = named.join(table.select(F.col("id").alias("missing")), "missing", "left_anti").select(key, "column", "missing")
        out = lost if out is None else out.unionByName(lost)
    return out


def compatible_baselines(runs: DataFrame, repositories: list[str], refs: Mapping[str, str], preferred: list[str]) -> DataFrame:
    """runs (run_id, repository_id, ref): runs of just these repositories and refs; the preferred first, then the newest by name."""
    wanted = F.array_sort(F.array(*(F.lit(f"{r}@{refs[r]}") for r in repositories)))
    sets = runs.groupBy("run_id").agg(F.array_sort(F.collect_set(F.concat_ws("@", "repository_id", "ref"))).alias("_all")).filter(F.col("_all") == wanted)
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col("run_id")) if preferred else F.lit(0)
    return sets.withColumn("_rank", F.when(rank == 0, F.lit(1 << 30)).otherwise(rank)).orderBy("_rank", F.desc("run_id")).select("run_id")


def capability_matrix(plugins: DataFrame) -> DataFrame:
    """plugins (plugin_id, capabilities map): one row for each plugin and capability."""
    return plugins.select("plugin_id", F.explode("capabilities").alias("capability", "status"))


def candidate_digest(files: DataFrame) -> DataFrame:
    """files (candidate_id, path, sha256): one hash of each candidate, whatever the order of its files."""
    listed = files.groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("hashes"))
    return listed.select("candidate_id", F.sha2(F.to_json("hashes"), 256).alias("digest"))


def branch_key(ref: Column) -> Column:
    """A folder name for a branch that no other branch has."""
    return F.concat(F.regexp_replace(ref, "[^A-Za-z0-9._-]+", "-"), F.lit("-"), F.substring(F.sha2(ref, 256), 1, 8))


def workspace_changes(configured: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) of roots: pending ones are only found, missing ones only configured, others are allowed."""
    both = configured.select("path", F.lit(True).alias("_c")).join(found.select("path", F.lit(True).alias("_f")), "path", "full_outer")
    return both.select("path", F.when(F.col("_c").isNull(), "pending").when(F.col("_f").isNull(), "missing").otherwise("allowed").alias("state"))


def proposals(findings: DataFrame, changes: DataFrame, key: str = "proposal_id") -> DataFrame:
    """findings (proposal_id, classification, fact_ids, evidence_ids) with requested changes (proposal_id, change): what is known, what is
    open, and how sure it is."""
    from .summaries import proposal_confidence

    told = findings.groupBy(key).agg(F.count_if(F.col("classification") == "fact").alias("facts"), F.count_if(F.col("classification") == "inference").alias("inferences"), F.count_if(F.col("classification") == "unknown").alias("unknowns"))
    seen = findings.select(key, F.explode("evidence_ids").alias("_e")).groupBy(key).agg(F.count_distinct("_e").alias("evidence"))
    asked = changes.groupBy(key).agg(F.array_sort(F.collect_list("change")).alias("changes"))
    own = told.join(seen, key, "left").join(asked, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    return own.withColumn("confidence", proposal_confidence(F.col("evidence"), F.col("inferences") + F.col("unknowns")))
