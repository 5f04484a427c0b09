"""Ranked searches: documents, flows and capabilities. Each is a score over a scan and one top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import capability_tokens, flow_tokens, let, normalise, prefix_match, query_tokens

# What a hit counts.
WHOLE_METADATA, WHOLE_BODY, TERM_METADATA, TERM_BODY, ROUTE, ROUTE_TERM, SUPPORTED = 100, 60, 12, 3, 80, 35, 2
PATH_WORD, PATH_PREFIX, CONTEXT_WORD, CONTEXT_PREFIX = 8, 5, 3, 1


def top_of(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))


def _sum(values: Column, score) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + score(x))


def document_texts() -> Column:
    """The normal forms that a chunk's score reads: of what is said about it, of its content and of its endpoint."""
    route = F.concat_ws(" ", "endpoint.method", "endpoint.path")
    parts = F.concat(F.array("heading", "document_path", F.when(F.col("endpoint").isNotNull(), route)), "symbols", "source_paths")
    return F.struct(normalise(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")).alias("meta"), normalise(F.col("content")).alias("body"), normalise(route).alias("route"))


def score_documents(chunks: DataFrame, query: str, texts: Column | None = None) -> DataFrame:
    """chunks with a score over zero. texts: where document_texts() are stored, if they are."""
    exact, terms = normalise(F.lit(query)), query_tokens(F.lit(query))

    def score(x: Column) -> Column:
        whole = F.when(F.contains(x["meta"], exact), WHOLE_METADATA).when(F.contains(x["body"], exact), WHOLE_BODY).otherwise(0)
        by_term = _sum(terms, lambda t: F.when(F.contains(x["meta"], t), TERM_METADATA).when(F.contains(x["body"], t), TERM_BODY).otherwise(0))
        named = F.contains(exact, normalise(F.col("endpoint.path"))) | F.contains(exact, x["route"])
        by_route = F.when(F.col("endpoint").isNotNull(), F.when(named, ROUTE).otherwise(0) + _sum(terms, lambda t: F.when(F.contains(x["route"], t), ROUTE_TERM).otherwise(0))).otherwise(0)
        return whole + by_term + by_route + F.when(F.array_contains("confidence_states", "supported"), SUPPORTED).otherwise(0)

    # explode keeps the filter above it, so that texts are normalised once
    return chunks.withColumn("score", F.explode(F.filter(F.array(let(document_texts() if texts is None else texts, score)), lambda s: s > 0)))


def by_score(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "document_path", "id")


def search_documents(chunks: DataFrame, query: str, repository: str | None = None, limit: int = 20) -> DataFrame:
    rows = chunks if repository is None else chunks.filter(F.col("repository_id") == repository)
    return by_score(score_documents(rows, query)).limit(top_of(limit))


def find_flows(endpoints: DataFrame, query: str, component_id: str | None = None, limit: int = 20) -> DataFrame:
    """endpoints (component_id, method, path, handler, source_path) by words of a query."""
    rows = endpoints if component_id is None else endpoints.filter(F.col("component_id") == component_id)
    words = rows.withColumns({"_path": flow_tokens(F.concat_ws(" ", "method", "path")), "_context": flow_tokens(F.concat_ws(" ", "handler", "source_path"))})
    score = _sum(flow_tokens(F.lit(query)), lambda t: (
        F.when(F.array_contains("_path", t), PATH_WORD).when(F.exists("_path", lambda w: prefix_match(w, t)), PATH_PREFIX)
        .when(F.array_contains("_context", t), CONTEXT_WORD).when(F.exists("_context", lambda w: prefix_match(w, t)), CONTEXT_PREFIX).otherwise(0)
    ))
    return words.withColumn("score", score).filter("score > 0").drop("_path", "_context").orderBy(F.desc("score"), "path", "method").limit(top_of(limit))


def rank_capabilities(capabilities: DataFrame, query: str) -> DataFrame:
    """capabilities (id, name, aliases, entrypoints) with a score over zero, the best first."""
    terms = capability_tokens(F.lit(query))
    own = capabilities.withColumn("_values", F.transform(F.concat(F.array("id", "name"), "aliases", "entrypoints"), normalise))
    covered = F.size(F.filter(terms, lambda t: F.exists("_values", lambda v: F.contains(v, t))))
    exact = (normalise(F.col("id")) == F.array_join(terms, "-")) | F.exists("_values", lambda v: F.contains(v, F.array_join(terms, " ")))
    special = F.forall(terms, lambda t: F.contains(normalise(F.col("id")), t))
    hits = _sum(terms, lambda t: F.size(F.filter("_values", lambda v: F.contains(v, t))))
    score = F.when(exact, 100).otherwise(0) + F.when(special, 40 + 10 * F.size(terms)).otherwise(0) + 8 * covered + hits
    return own.withColumn("score", score).filter("score > 0").drop("_values").orderBy(F.desc("score"), F.desc(F.length("id")), "id")
