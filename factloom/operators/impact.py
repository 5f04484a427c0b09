"""What a change touches, how much it weighs, and how far to look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of levels.
HIGH, MIDDLE, LOW, CRITICAL = "alta", "media", "baja", "crítica"


def impacted_documents(index: DataFrame, facts: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """index (document_id, fact_ids, edge_ids, evidence_ids): documents that hold one of the ids (id)."""
    hit = [index.select("document_id", F.explode(c).alias("id")).join(ids.select("id"), "id", "left_semi").select("document_id") for c, ids in (("fact_ids", facts), ("edge_ids", edges), ("evidence_ids", evidence))]
    return hit[0].unionByName(hit[1]).unionByName(hit[2]).distinct()


def relevant_edges(edges: DataFrame, evidence: DataFrame, components: DataFrame) -> DataFrame:
    """Edges that share evidence (id), or end at a component (id)."""
    by_evidence = edges.select(F.col("id").alias("_e"), F.explode("evidence_ids").alias("id")).join(evidence.select("id"), "id", "left_semi").select("_e")
    by_end = edges.select(F.col("id").alias("_e"), F.explode(F.array("from", "to")).alias("id")).join(components.select("id"), "id", "left_semi").select("_e")
    return edges.join(by_evidence.unionByName(by_end).distinct(), F.col("id") == F.col("_e"), "left_semi")


def related_links(links: DataFrame, chunks: DataFrame, components: DataFrame) -> DataFrame:
    """Links at a selected chunk (id) or a component (id)."""
    ids = chunks.select("id").unionByName(components.select("id")).distinct()
    touched = links.select("from", "to", "type", F.explode(F.array("from", "to")).alias("id")).join(ids, "id", "left_semi").select("from", "to", "type").distinct()
    return links.join(touched, ["from", "to", "type"], "left_semi")


def complexity(score: Column) -> Column:
    return F.when(score >= 16, HIGH).when(score >= 7, MIDDLE).otherwise(LOW)


def analyse(edges: DataFrame, chunks: DataFrame, unresolved_links: int | Column = 0) -> DataFrame:
    """One row of dimensions, score and levels. edges: relevant_edges(); chunks: the selected ones."""
    repositories = chunks.filter("repository_id <> '_workspace'").select(F.concat(F.lit("component:"), "repository_id").alias("id")).distinct()
    consumers = edges.join(repositories.withColumnRenamed("id", "from"), "from", "left_anti").agg(F.count_distinct("from").alias("consumers"))
    counts = edges.agg(F.count_if(F.col("type") == "calls_http").alias("synchronous_dependencies"), F.count_if(F.col("type").isin("publishes_to", "consumes_from")).alias("messages"), (F.count_if(F.col("status") != "supported") + unresolved_links).alias("unresolved_relations"))
    of_chunks = chunks.select(F.explode_outer("source_paths").alias("p")).agg(F.count_distinct(F.when(F.col("p").rlike("(?i)entity|repository|data"), F.col("p"))).alias("data_resources"))
    seen = chunks.select(F.explode("evidence_ids").alias("e")).agg(F.count_distinct("e").alias("evidence"))
    row = repositories.agg(F.count(F.lit(1)).alias("repositories")).crossJoin(consumers).crossJoin(counts).crossJoin(of_chunks).crossJoin(seen)  # one row each
    return levels(row)


def levels(row: DataFrame) -> DataFrame:
    """Adds score, complexity, criticality and confidence to counts."""
    score = F.expr("2 * repositories + 2 * consumers + synchronous_dependencies + messages + data_resources + 2 * unresolved_relations")
    own = row.withColumn("score", score)
    critical = F.when((F.col("consumers") >= 3) | (F.col("data_resources") >= 2), CRITICAL).when(F.col("score") >= 8, HIGH).otherwise(MIDDLE)
    sure = F.when((F.col("evidence") >= 5) & (F.col("unresolved_relations") == 0), HIGH).when(F.col("evidence") > 0, MIDDLE).otherwise(LOW)
    return own.withColumns({"complexity": complexity(F.col("score")), "criticality": critical, "confidence": sure})


def remaining_dependencies(edges: DataFrame, system: str) -> DataFrame:
    """Edges that a migration away from a system would have to move."""
    return edges.filter((F.col("from") == f"component:{system}") | (F.col("to") == f"component:{system}"))


def next_step(level: Column, sufficient: Column) -> Column:
    """The level that an investigation goes on at, and what it does there."""
    # Statuses of the ladder.
    names = ("expand_documentation", "directed_analysis", "source_evidence", "restricted_agent", "scope_expansion_required")
    at = F.greatest(F.lit(1), F.least(level, F.lit(6)))
    step = F.least(at, F.lit(5))
    return F.struct(
        F.when(sufficient, 1).otherwise(step + 1).alias("level"), F.when(sufficient, "sufficient").otherwise(F.element_at(F.array(*map(F.lit, names)), step)).alias("status"),
        (~sufficient & (step == 5)).alias("authorization_required"),
    )


def investigation_facts(facts: DataFrame, paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts (id, source_path, target_path, evidence_ids) of selected paths (path) or evidence (id)."""
    by_path = facts.select("id", F.explode(F.array("source_path", "target_path")).alias("path")).join(paths.select("path"), "path", "left_semi").select("id")
    by_evidence = facts.select("id", F.explode("evidence_ids").alias("_e")).join(evidence.select(F.col("id").alias("_e")), "_e", "left_semi").select("id")
    return facts.join(by_path.unionByName(by_evidence).distinct(), "id", "left_semi")
