"""Counts and lists about facts for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import field
from ..functions.text import markdown_cell


def by_kind(facts: DataFrame, samples: int = 5) -> DataFrame:
    """Facts of each kind, with the first evidence of a few. Only as many rows a kind are gathered as are shown."""
    counts = facts.groupBy("kind").agg(F.count(F.lit(1)).alias("facts"))
    ranked = facts.select("kind", "id", F.explode("evidence_ids").alias("e")).withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("id", "e"))).filter(F.col("_n") <= samples)
    lists = ranked.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "e"))), lambda x: x["e"]), ", ").alias("evidence"))
    return counts.join(lists, "kind", "left")


def by_layer(facts: DataFrame) -> DataFrame:
    layer = F.coalesce(field("value_json", "layer"), F.lit("unknown"))
    return facts.filter(F.col("kind").isin("source_module", "code_symbol")).groupBy(layer.alias("layer")).agg(F.count_if(F.col("kind") == "source_module").alias("modules"), F.count_if(F.col("kind") == "code_symbol").alias("symbols"))


def by_role(facts: DataFrame, most: int = 50) -> DataFrame:
    """Names of symbols of each role."""
    own = facts.filter("kind = 'code_symbol'").select(F.coalesce(field("value_json", "role"), F.lit("other")).alias("role"), field("value_json", "name").alias("name")).dropna().distinct()
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("role").orderBy("name")))
    return ranked.groupBy("role").agg(F.count(F.lit(1)).alias("symbols"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("name")))), "; ").alias("names"))


def conditional_counts(rows: DataFrame, conditions: dict[str, Column], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def proposal_confidence(evidence: Column, unresolved: Column) -> Column:
    return F.when((evidence >= 5) & (unresolved == 0), "high").when(evidence > 0, "medium").otherwise("low")


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key, each with the number that is left out."""
    w = Window.partitionBy(key)
    return rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "omitted": F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0))}).filter(F.col("_n") <= most).drop("_n")


def labelled(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Adds the label of the node that a column names; its id if there is none."""
    known = nodes.groupBy(F.col("id").alias(column)).agg(F.min("label").alias("_label"))
    return rows.join(known, column, "left").withColumn(f"{column}_label", F.coalesce("_label", column)).drop("_label")


def repository_profile(facts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(component_id, profile): what people say (component_id, profile), else what its facts are like."""
    kind = F.col("kind")
    inferred = facts.groupBy("component_id").agg(
        F.when(F.bool_or(F.lower("value_json").rlike("android|react-native|flutter|ionic")), "mobile").when(F.bool_or(kind.isin("ui_route", "ui_component")), "client")
        .when(F.bool_or(kind.isin("http_endpoint", "http_endpoint_fragment")), "service").otherwise("component").alias("_p")
    )
    if overrides is None:
        return inferred.withColumnRenamed("_p", "profile")
    return inferred.join(overrides, "component_id", "left").select("component_id", F.coalesce("profile", "_p").alias("profile"))


def flow_points(endpoints: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(component_id, direction, label, target): what comes in, what is shown, and what goes out of a service."""
    value = F.col("value_json")
    into = endpoints.select("component_id", F.lit("in").alias("direction"), F.concat_ws(" ", "method", "path").alias("label"), F.lit(None).cast("string").alias("target"))
    shown = facts.filter(F.col("kind").isin("ui_route", "ui_component")).select("component_id", F.lit("screen").alias("direction"), F.coalesce(field(value, "path", "selector", "name"), F.lit("UI")).alias("label"), F.lit(None).cast("string").alias("target"))
    ends = edges.select(F.explode("fact_ids").alias("id"), F.col("to").alias("target"))
    out = facts.filter(F.col("kind").isin("http_client_call", "http_client_base")).join(ends, "id", "left").select("component_id", F.lit("out").alias("direction"), F.coalesce(field(value, "path_expression", "uri_expression", "base_url"), F.lit("destino no resuelto")).alias("label"), "target")
    return into.unionByName(shown).unionByName(out)


def explain_service(facts: DataFrame, component: str) -> DataFrame:
    """One row about a component and its parts."""
    own = facts.filter((F.col("component_id") == component) | F.col("component_id").startswith(f"{component}:"))
    kind, value = F.col("kind"), F.col("value_json")
    n = lambda *kinds: F.count_if(kind.isin(*kinds))
    return own.agg(
        F.count(F.lit(1)).alias("facts"), n("http_endpoint", "http_endpoint_fragment").alias("endpoints"), n("http_client_call", "http_client_base").alias("integrations"), n("data_entity", "data_read", "data_write").alias("data"),
        n("code_symbol").alias("symbols"), F.array_sort(F.collect_set(F.when(kind == "technology", field(value, "technology")))).alias("technologies"), F.array_sort(F.collect_set(F.when(kind == "source_module", field(value, "layer")))).alias("layers"),
    )


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], group: str) -> DataFrame:
    """(group, table): rows of each group as a Markdown table, in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))).alias("_all"))
    return listed.select(group, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("_all", lambda x: x["_l"]), "\n")).alias("table"))


def mermaid_graph(edges: DataFrame, group: str, most: int = 80) -> DataFrame:
    """(group, diagram, omitted): the first edges of each group as a flow chart."""
    from ..functions.text import mermaid_label

    some = capped(edges, group, ["from", "to", "type"], most)
    name = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 8))
    line = F.concat(F.lit("  "), name(F.col("from")), F.lit('["'), mermaid_label(F.col("from")), F.lit('"] -->|'), mermaid_label(F.col("type")), F.lit("| "), name(F.col("to")), F.lit('["'), mermaid_label(F.col("to")), F.lit('"]'))
    listed = some.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("from", "to", "type", line.alias("_l")))).alias("_all"), F.max("omitted").alias("omitted"))
    return listed.select(group, F.concat(F.lit("graph LR\n"), F.array_join(F.transform("_all", lambda x: x["_l"]), "\n")).alias("diagram"), "omitted")
