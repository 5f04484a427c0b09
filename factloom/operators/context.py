"""Contexts for a question: seeds, expansion, order, and a selection within several budgets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import estimate_tokens, let, normalise, query_tokens
from ..sources.storage import cut
from .search import search_documents
from .traverse import expand_context


@dataclass(frozen=True)
class Budget:
    tokens: int = 15_000
    documents: int = 40
    flows: int = 5
    symbols: int = 25
    documents_per_repository: int = 15


# Sections that an intent looks for, words of technical roles, and symbols that say nothing.
INTENTS = {
    "development": "flow|router|contract|method|mapper|repository|data", "migration": "flow|contract|data|integration|service|architecture",
    "impact": "call|caller|contract|integration|data|module", "responsibilities": "service|architecture|flow|integration|data",
}
TECHNICAL = ((45, "(?i)repository"), (40, "(?i)(?<![a-z0-9_])port(?![a-z0-9_])|port/(?:in|out)|port(?:in|out)"), (35, "(?i)mapper"), (30, "(?i)entity"), (20, "(?i)router|handler"))
TYPE_HEADING = r"(?i)^(?:class|interface|record|enum)\s+"
PICKS = ((r"(?i)Router(?!\w)", 1), (r"(?i)Handler(?!\w)", 1), (r"(?i)(?:UseCase|Service)(?!\w)", 1), (r"(?i)Port(?:In|Out)?(?!\w)", 1), (r"(?i)Mapper(?:Dto|DTO)?(?!\w)", 2), (r"(?i)Repository(?!\w)", 2), (r"(?i)Entity(?!\w)", 1))
PLAIN_SYMBOLS = r"(?i)\.(?:java|class)$"
COMMON_SYMBOLS = r"^(?:ServerResponse|MediaType|Mono|Flux|String|Math|Integer|Boolean|List|Logger|PageResponse|Type)(?!\w)"


def meaningful(symbols: Column) -> Column:
    return F.filter(symbols, lambda s: s.rlike("^[A-Z]") & ~s.rlike(PLAIN_SYMBOLS) & ~s.rlike(COMMON_SYMBOLS))


def priority(intent: str) -> Column:
    score = F.when(F.col("section_type").rlike(INTENTS[intent]), 10).otherwise(0)
    if intent == "development":
        text = F.array_join(F.concat("roles", "source_paths"), " ")
        score = score + F.greatest(*(F.when(text.rlike(p), n).otherwise(0) for n, p in TECHNICAL)) + F.when(F.coalesce("heading", F.lit("")).rlike(TYPE_HEADING), 60).otherwise(0)
    return score + F.when(F.col("endpoint").isNotNull(), 8).otherwise(0) + F.when(F.col("repository_id") != "_workspace", 2).otherwise(0) + F.when(F.size("evidence_ids") > 0, 1).otherwise(0)


def contextual_priority(intent: str, query: str) -> Column:
    """Needs distance (null if not reached) and seed."""
    meta = normalise(F.concat_ws(" ", "heading", "document_path", F.array_join("source_paths", " ")))
    affinity = 15 * let(meta, lambda m: F.size(F.filter(query_tokens(F.lit(query)), lambda t: F.contains(m, t))))
    return priority(intent) + affinity + F.when(F.col("distance").isNull(), 0).otherwise(F.greatest(F.lit(20), 300 - 40 * F.col("distance"))) + F.when(F.col("seed"), 1000).otherwise(0)


def structural_first(rows: DataFrame, order: str) -> DataFrame:
    """Places for development: seeds, then a few of each role's types, then all in order."""
    first = F.least(*(F.when(F.coalesce("heading", F.lit("")).rlike(TYPE_HEADING) & F.col("heading").rlike(p) & (F.col(f"_p{i}") <= n), i + 1).otherwise(99) for i, (p, n) in enumerate(PICKS)))
    out = rows
    for i, (p, _) in enumerate(PICKS):
        fits = F.coalesce(F.col("heading").rlike(TYPE_HEADING) & F.col("heading").rlike(p), F.lit(False))
        out = out.withColumn(f"_p{i}", F.sum(fits.cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = out.withColumn("_group", F.when(F.col("seed"), 0).otherwise(first))
    return ranked.withColumn(order, F.row_number().over(Window.orderBy("_group", order))).drop("_group", *(f"_p{i}" for i in range(len(PICKS))))


def select_within(candidates: DataFrame, budget: Budget, order: str = "place") -> DataFrame:
    """Candidates taken in order, each skipped that would break a budget. What is taken decides on the rest, so it is a fold
    over the ordered candidates; these are at most the 1,100 that search and expansion give, in one array."""
    own = candidates.select(order, "id", "document_path", "repository_id", (F.col("document_type") == "flow").alias("flow"), meaningful(F.col("symbols")).alias("symbols"), estimate_tokens(F.col("content")).alias("tokens"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ids"), none.alias("documents"), none.alias("repositories"), none.alias("symbols"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("flows"))

    def step(s: Column, c: Column) -> Column:
        new = ~F.array_contains(s["documents"], c["document_path"])
        of_repository = F.size(F.filter(s["repositories"], lambda r: r == c["repository_id"]))
        symbols = F.array_union(s["symbols"], c["symbols"])
        over = (
            (new & (F.size(s["documents"]) >= budget.documents)) | (new & (of_repository >= budget.documents_per_repository)) | (c["flow"] & (s["flows"] >= budget.flows))
            | (F.size(symbols) > budget.symbols) | (s["tokens"] + c["tokens"] > budget.tokens)
        )
        taken = F.struct(
            F.array_append(s["ids"], c["id"]).alias("ids"), F.when(new, F.array_append(s["documents"], c["document_path"])).otherwise(s["documents"]).alias("documents"),
            F.when(new, F.array_append(s["repositories"], c["repository_id"])).otherwise(s["repositories"]).alias("repositories"), symbols.alias("symbols"),
            (s["tokens"] + c["tokens"]).alias("tokens"), (s["flows"] + c["flow"].cast("int")).alias("flows"),
        )
        return F.when(over, s).otherwise(taken)

    listed = own.agg(F.array_sort(F.collect_list(F.struct(order, "id", "document_path", "repository_id", "flow", "symbols", "tokens"))).alias("all"))
    ids = listed.select(F.explode(F.aggregate("all", start, step)["ids"]).alias("id"))
    return candidates.join(ids, "id", "left_semi")


def limit_by_weight(rows: DataFrame, key: str, order: str, weight: str, most: int) -> DataFrame:
    """Rows of each key in order while something of `most` is left; each takes at least one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_used", F.coalesce(F.sum(F.greatest(F.lit(1), F.col(weight))).over(w), F.lit(0))).filter(F.col("_used") < most).drop("_used")


def partition_by_bytes(rows: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of each key in order, in parts of at most `most` bytes: adds `part`, from 0. A row that is larger is an error. What is
    in a part decides where the next begins, so it is a fold; it runs over rows as they come, sorted, and keeps two numbers."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, used, begun = None, 0, 0, False
        for batch in batches:
            at = batch.schema.get_field_index
            parts = []
            for k, n in zip(batch.column(at(key)).to_pylist(), batch.column(at(size)).to_pylist(), strict=True):
                if n > most:
                    raise ValueError("a row is larger than a part")
                if not begun or k != now:
                    now, part, used, begun = k, 0, 0, True
                elif used + n > most:
                    part, used = part + (used > 0), 0
                used += n
                parts.append(part)
            yield pa.record_batch([*batch.columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    return rows.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)


def missing_information(selected: DataFrame, intent: str) -> DataFrame:
    """One row: what a context lacks."""
    # How a lack is named.
    flow = ~F.bool_or(F.contains("section_type", F.lit("flow")))
    data = ~F.bool_or(F.concat_ws(" ", "section_type", F.array_join(F.concat("roles", "source_paths"), " ")).rlike("data|persist|repository"))
    rules = [(flow, "flujo de entrada relacionado"), (data, "propiedad o acceso de persistencia")]
    if intent in ("migration", "responsibilities"):
        rules.append((F.count_distinct(F.when(F.col("repository_id") != "_workspace", F.col("repository_id"))) < 2, "participación de otros sistemas"))
    return selected.agg(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for c, t in rules))).alias("missing"), F.coalesce(F.bool_or(F.col("document_type") == "flow"), F.lit(False)).alias("has_flow"))


def statistics(candidates: DataFrame, selected: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts about a context."""
    of_all = candidates.agg(F.count_distinct("document_path").alias("documents_considered"), F.count(F.lit(1)).alias("_all"))
    own = selected.agg(
        F.count_distinct("document_path").alias("documents_selected"), F.array_sort(F.collect_set(F.when(F.col("repository_id") != "_workspace", F.col("repository_id")))).alias("repositories_represented"),
        F.coalesce(F.sum(estimate_tokens(F.col("content"))), F.lit(0)).alias("estimated_tokens"), F.count(F.lit(1)).alias("_own"),
    )
    ids = selected.select(F.col("id").alias("_id"))
    open_ = links.filter("status <> 'supported'").withColumn("_l", F.xxhash64("from", "to", "type"))
    touched = open_.select("_l", F.explode(F.array("from", "to")).alias("_id")).join(ids, "_id", "left_semi").select("_l").distinct().agg(F.count(F.lit(1)).alias("unresolved_relations"))
    return of_all.crossJoin(own).crossJoin(touched).withColumn("omitted_by_budget", F.col("_all") - F.col("_own")).drop("_all", "_own")  # one row each


def prepare_context(chunks: DataFrame, links: DataFrame, query: str, intent: str, repository: str | None = None, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:
    """(selected chunks with their places, statistics): search, seeds, expansion, order, budgets."""
    ranked = cut(search_documents(chunks, query, repository, 100).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_path", "id")) - 1).select("id", "document_path", "_rank"))
    first = ranked.filter("_rank = 0").select("document_path")
    seeds = cut(ranked.join(F.broadcast(first), "document_path", "left_semi").orderBy("_rank").limit(8).select("id"))
    near = expand_context(links, chunks, seeds, 8, 1000)
    ids = near.select("id").unionByName(ranked.select("id")).distinct()
    known = chunks.join(ids, "id", "left_semi").join(near, "id", "left").join(ranked.select("id", "_rank"), "id", "left").join(seeds.withColumn("seed", F.lit(True)), "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    order = Window.orderBy(F.desc(contextual_priority(intent, query)), F.coalesce("_rank", F.lit(10_000)), estimate_tokens(F.col("content")), "id")
    candidates = known.withColumn("place", F.row_number().over(order))
    if intent == "development":
        candidates = structural_first(candidates, "place")
    candidates = cut(candidates)
    selected = cut(select_within(candidates, budget))
    told = statistics(candidates, selected, links).crossJoin(missing_information(selected, intent))
    return selected, told.withColumn("sufficient", F.col("has_flow") & (F.size("missing") == 0)).drop("has_flow")
