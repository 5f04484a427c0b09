"""Differences of two sets of facts, and of two manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import content_hash, field


def _keyed(facts: DataFrame) -> DataFrame:
    digest = content_hash(F.col("value_json"))
    logical = F.coalesce(field("value_json", "path", "topic", "entity", "package"), digest)
    head = F.concat_ws(":", "kind", "component_id")
    return facts.withColumns({"_semantic": F.concat_ws(":", head, digest), "_logical": F.concat_ws(":", head, logical)})


def compare_facts(base: DataFrame, target: DataFrame, order: str = "id", complete: bool = True, strict: bool = False) -> DataFrame:
    """(change, before_id, after_id): added, removed or modified facts. An added fact is a modification of the last base fact with its
    logical key; strict pairs it with base facts that are gone only. An incomplete target removes nothing."""
    old, new = _keyed(base), _keyed(target)
    added = new.join(old.select("_semantic"), "_semantic", "left_anti")
    removed = old.join(new.select("_semantic"), "_semantic", "left_anti")
    prior = (removed if strict else old).groupBy("_logical").agg(F.max_by("id", order).alias("before_id"))
    paired = added.join(prior, "_logical", "left").select("id", "before_id")
    gone = removed.join(paired.filter("before_id is not null").select(F.col("before_id").alias("id")), "id", "left_anti") if complete else removed.limit(0)
    changed = F.when(F.col("before_id").isNotNull(), "modified").otherwise("added")
    return paired.select(changed.alias("change"), "before_id", F.col("id").alias("after_id")).unionByName(gone.select(F.lit("removed").alias("change"), F.col("id").alias("before_id"), F.lit(None).cast("string").alias("after_id")))


def manifests_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, side) of files that are not equal in path, sha256 and size on both sides."""
    columns = ["path", "sha256", "size"]
    left, right = a.select(columns), b.select(columns)
    return left.exceptAll(right).select("path", F.lit("left").alias("side")).unionByName(right.exceptAll(left).select("path", F.lit("right").alias("side")))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two file lists (path, source_hash): a renamed file is one removed and one added."""
    o, n = old.select("path", F.col("source_hash").alias("_old")), new.select("path", F.col("source_hash").alias("_new"))
    both = o.join(n, "path", "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified").alias("change"))
