"""Production scope: what belongs to tests, and what stays without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of test folders and test files.
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__")
TEST_FILES = r"(?:(?:^|\.)(?:test|spec)\.[^.]+$)|(?:^test_.*\.py$)|(?:_test\.py$)|(?:(?:test|tests|spec|it|itcase)\.(?:java|kt|kts|groovy|cs)$)"


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^\\./", "")), "/"), lambda p: p != "")
    folder = F.exists(parts, lambda p: p.isin(*TEST_FOLDERS) | p.endswith(".tests"))
    # all names hold one of these, so that most paths aren't split
    likely = F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec")) | F.contains(low, F.lit("it.")) | F.contains(low, F.lit("itcase."))
    return F.coalesce(likely & (folder | F.coalesce(F.element_at(parts, -1), F.lit("")).rlike(TEST_FILES)), F.lit(False))


#: What a fact says about where it is.
_PLACES = ("source_set", "source_path", "path", "manifest", "target_path")


def production_facts(facts: DataFrame) -> DataFrame:
    """Facts outside of tests; a call into tests stays, without its target. A value is read once, by a generator, which filters that read
    its columns aren't pushed below: a filter on the value would be computed anew for each field that it names."""
    told = facts.select("*", F.json_tuple("value_json", *_PLACES).alias(*(f"_{n}" for n in _PLACES)))
    call = F.col("kind") == "symbol_call"
    inside = F.coalesce(F.lower("_source_set") == "test", F.lit(False)) | is_test_path(F.col("_source_path")) | is_test_path(F.col("_path")) | is_test_path(F.col("_manifest"))
    masked = F.to_json(F.map_concat(
        F.map_filter(F.from_json("value_json", "map<string,string>"), lambda k, v: ~k.isin("target_symbol_id", "target_class", "target_path", "resolution")),
        F.create_map(F.lit("resolution"), F.lit("unresolved")),
    ))
    kept = told.filter(~(inside | ~call & is_test_path(F.col("_target_path"))))
    return kept.withColumn("value_json", F.when(call & is_test_path(F.col("_target_path")), masked).otherwise(F.col("value_json"))).drop(*(f"_{n}" for n in _PLACES))


def graph_for_facts(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that facts bear: edges without facts or with one that is left, and nodes of such edges, of
    components of facts and of facts."""
    ids = facts.select(F.col("id").alias("_fact")).distinct()
    borne = edges.select("id", F.explode("fact_ids").alias("_fact")).join(ids, "_fact", "left_semi").select("id").distinct()
    kept = edges.filter(F.size("fact_ids") == 0).unionByName(edges.join(borne, "id", "left_semi"))
    wanted = (
        kept.select(F.explode(F.array("from", "to")).alias("id"))
        .unionByName(facts.select(F.concat(F.lit("component:"), F.element_at(F.split("component_id", ":"), 1)).alias("id")))
        .unionByName(nodes.select("id", F.explode("fact_ids").alias("_fact")).join(ids, "_fact", "left_semi").select("id"))
    )
    return nodes.join(wanted, "id", "left_semi"), kept


def is_structural(path: Column) -> Column:
    """Whether a change of the file makes a full rebuild necessary."""
    # Names of build files.
    return path.rlike(r"(?i)(?:^|/)(?:package\.json|angular\.json|pom\.xml|build\.gradle(?:\.kts)?|pyproject\.toml|requirements\.txt|web\.xml|weblogic\.xml|application\.xml|[^/]+\.csproj)$")
