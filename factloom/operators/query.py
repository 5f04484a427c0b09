"""Filters and pages over facts, coverage and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import markdown_cell

# The kinds of facts of each category.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "endpoints": ("http_endpoint", "http_endpoint_fragment", "http_route_mount"),
    "dependencies": ("package_dependency", "http_client_base", "http_client_call", "module_dependency"),
    "messages": ("message_producer", "message_consumer", "message_resource"),
    "data": ("data_entity", "data_read", "data_write", "data_resource"),
    "architecture": ("source_module", "code_symbol", "symbol_call", "object_construction", "dependency_injection", "dependency_binding", "module_dependency", "ui_component", "ui_route"),
    "technologies": ("technology", "package_dependency", "build_script"),
}
PAGE, MAX_PAGE = 100, 1000


def in_category(category: str, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    if category not in categories:
        raise ValueError(f"{category} has an index of its own, or is unknown")
    return F.col("kind").isin(*categories[category])


def of_component(component: str) -> Column:
    """The component itself, or one of its parts."""
    return (F.col("component_id") == component) | F.col("component_id").startswith(f"{component}:")


def page(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int = PAGE, most: int | None = MAX_PAGE) -> DataFrame:
    """Rows offset .. offset + limit in order, each with the number of all rows and whether the page ends them. The order and the cut are one top-k; the count is an aggregate beside it."""
    limit = limit if most is None else min(limit, most)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    shown = cut.agg(F.count(F.lit(1)).alias("_n"))
    ends = total.crossJoin(shown).select("total", (offset + F.col("_n") >= F.col("total")).alias("complete"))  # one row
    return cut.crossJoin(F.broadcast(ends))


def query_facts(facts: DataFrame, category: str, component_id: str | None = None, offset: int = 0, limit: int = PAGE, order: Sequence[str] = ("id",), categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    rows = facts.filter(in_category(category, categories))
    return page(rows if component_id is None else rows.filter(F.col("component_id") == component_id), order, offset, limit)


def query_typed(table: DataFrame, repository_id: str | None = None, offset: int = 0, limit: int = PAGE, order: Sequence[str] = ("id",)) -> DataFrame:
    """A page of coverage or evidence; these have no largest page."""
    return page(table if repository_id is None else table.filter(F.col("repository_id") == repository_id), order, offset, limit, most=None)


def fact_table(rows: DataFrame) -> DataFrame:
    """Facts as lines of a Markdown table."""
    cells = [markdown_cell(c) for c in (F.col("id"), F.col("component_id"), F.col("kind"), F.col("value_json"), F.array_join("evidence_ids", ", "))]
    return rows.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


# --- keeping one of each --------------------------------------------------------------------------------------------


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, with the last value; `_first` is the place of the first."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"), F.min(order).alias("_first"))
    return packed.select("_row.*", "_first")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """The place of each row among those with its key, from 1 on."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def distinct_slugs(rows: DataFrame, slug: str, order: Sequence[str]) -> DataFrame:
    """The second row with a slug gets -2 behind it, and so on."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return rows.withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))
