"""Capabilities folded from endpoints of chunks, with what people have configured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import field
from ..functions.text import capability_slug, title

API_ROLE = "expositor de API"  # fixed value


def fold(chunks: DataFrame) -> DataFrame:
    """One row for each slug of chunks' endpoints."""
    own = chunks.filter("endpoint is not null").withColumns({"slug": capability_slug(F.col("endpoint.path")), "_entry": F.concat_ws(" ", "endpoint.method", "endpoint.path")})
    each = own.withColumn("_e", F.explode_outer("evidence_ids"))
    lists = own.groupBy("slug").agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("repository_id", "repositories"), ("_entry", "entrypoints"), ("document_path", "flows"), ("id", "document_chunk_ids"))))
    evidence = each.groupBy("slug").agg(F.array_sort(F.collect_set("_e")).alias("evidence_ids"))
    first = own.groupBy("slug", "repository_id").agg(F.min_by("evidence_ids", "id").alias("evidence_ids"))
    duties = first.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("repository_id", F.lit(API_ROLE).alias("role"), F.lit("extracted").alias("basis"), "evidence_ids"))).alias("responsibilities"))
    none = F.array().cast("array<string>")
    out = lists.join(evidence, "slug").join(duties, "slug")
    return out.select(
        F.col("slug").alias("id"), title(F.col("slug")).alias("name"), none.alias("aliases"), "repositories", "entrypoints", "flows", "responsibilities",
        F.array().cast("array<struct<from:string,to:string,status:string>>").alias("legacy_dependencies"), F.col("entrypoints").alias("contracts"), none.alias("data_resources"), "document_chunk_ids", "evidence_ids",
        F.when(F.size("evidence_ids") > 0, "high").when(F.size("document_chunk_ids") > 0, "medium").otherwise("low").alias("confidence"),
    )


def with_overrides(capabilities: DataFrame, configured: DataFrame, ownership: DataFrame, migrations: DataFrame) -> DataFrame:
    """configured (id, label, aliases, systems) may add capabilities; ownership (id, role, repository_id) and migrations (id,
    from, to, status) add to those that are there."""
    c = configured.select("id", F.col("label").alias("_label"), F.col("aliases").alias("_aliases"), F.col("systems").alias("_systems"))
    own = ownership.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("repository_id", F.regexp_replace("role", "_", " ").alias("role"), F.lit("explicit").alias("basis"), F.array().cast("array<string>").alias("evidence_ids")))).alias("_own"))
    moves = migrations.filter("`from` is not null and `to` is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("from", "to", F.when(F.col("status") == "complete", "supported").otherwise("candidate").alias("status")))).alias("_moves"))
    both = capabilities.join(c, "id", "full_outer").join(own, "id", "left").join(moves, "id", "left")
    more = lambda a, b: F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    after = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
    none = F.array().cast("array<string>")
    return both.select(
        "id", F.coalesce("_label", "name", title(F.col("id"))).alias("name"), more(F.col("aliases"), F.col("_aliases")).alias("aliases"), more(F.col("repositories"), F.col("_systems")).alias("repositories"),
        *(F.coalesce(x, none).alias(x) for x in ("entrypoints", "flows")), after("responsibilities", "_own").alias("responsibilities"), after("legacy_dependencies", "_moves").alias("legacy_dependencies"),
        *(F.coalesce(x, none).alias(x) for x in ("contracts", "data_resources", "document_chunk_ids", "evidence_ids")), F.coalesce("confidence", F.lit("low")).alias("confidence"),
    )


def with_data_resources(capabilities: DataFrame, facts: DataFrame) -> DataFrame:
    """Data that facts of a capability's repositories name beside one of its entry paths."""
    paths = capabilities.select("id", F.explode("repositories").alias("repository_id"), "entrypoints").withColumn("path", F.explode("entrypoints")).withColumn("path", F.lower(F.regexp_replace("path", "^[^ ]+ ", "")))
    data = facts.filter(F.col("kind").rlike("(?i)data|repository")).select(F.element_at(F.split("component_id", ":"), 1).alias("repository_id"), F.lower("value_json").alias("_v"), field("value_json", "entity", "resource").alias("_r")).filter("_r <> ''")
    found = paths.join(data, "repository_id").filter(F.contains("_v", F.col("path"))).groupBy("id").agg(F.array_sort(F.collect_set("_r")).alias("_data"))
    return capabilities.join(found, "id", "left").withColumn("data_resources", F.coalesce("_data", "data_resources")).drop("_data")


def responsibilities(ranked: DataFrame) -> DataFrame:
    """Who answers for the best capability of rank_capabilities()."""
    return ranked.limit(1).select(F.col("id").alias("capability_id"), F.when(F.col("confidence") == "high", "supported").otherwise("candidate").alias("status"), "repositories", "responsibilities", "legacy_dependencies", "evidence_ids")
