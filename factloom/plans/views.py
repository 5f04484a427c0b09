"""The engine's tables seen in the synthetic star schema: what stands for facts, files, chunks and links there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# What an event stands for, in Spark and in SQL.
KINDS = {"view": "http_endpoint", "click": "http_client_call", "purchase": "data_write", "signup": "package_dependency", "error": "message_producer"}
METHODS = ("GET", "POST", "UNKNOWN")

#: Facts as SQL: the same columns as facts() has in its value.
FACTS_SQL = """
e AS (
  SELECT event_id, user_id, ts, value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), facts AS (
  SELECT 'fact-' || event_id AS id, CAST(user_id % 40 AS VARCHAR) AS component_id, event_id, user_id, k, ts, value, event_type,
    CASE event_type WHEN 'view' THEN 'http_endpoint' WHEN 'click' THEN 'http_client_call' WHEN 'purchase' THEN 'data_write' WHEN 'signup' THEN 'package_dependency' ELSE 'message_producer' END AS kind,
    '/k/' || k || '/' || (user_id % 50) AS path, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'UNKNOWN' END AS method
  FROM e
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts, flat: the columns of FACTS_SQL."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in KINDS.items() for x in p)), F.col("event_type"))
    own = table(spark, sf_dir, "events").withColumn("k", k)
    return own.select(
        F.concat(F.lit("fact-"), "event_id").alias("id"), (F.col("user_id") % 40).cast("string").alias("component_id"), "event_id", "user_id", "k", "ts", "value", "event_type", kind.alias("kind"),
        F.concat(F.lit("/k/"), F.col("k").cast("string"), F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, METHODS)), (F.col("event_id") % 3 + 1).cast("int")).alias("method"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts with a JSON value. A call names its path as path_expression."""
    own = events(spark, sf_dir)
    call = F.col("kind") == "http_client_call"
    value = F.to_json(F.struct(
        F.when(~call, F.col("path")).alias("path"), F.when(call, F.col("path")).alias("path_expression"), "method",
        F.when(F.col("kind") == "data_write", F.concat(F.lit("table-"), (F.col("k") % 10).cast("string"))).alias("entity"),
        F.when(F.col("kind") == "package_dependency", F.concat(F.lit("pkg-"), (F.col("k") % 20).cast("string"))).alias("package"),
        F.when(F.col("kind") == "message_producer", F.concat(F.lit("topic-"), (F.col("k") % 5).cast("string"))).alias("topic"),
    ))
    return own.select("id", "kind", "component_id", value.alias("value_json"), F.array(F.concat(F.lit("ev-"), "event_id")).alias("evidence_ids"), F.lit("driver").alias("rule_id"))


ENDINGS = (".py", ".md", ".png", ".java", ".txt", ".json", "_test.py", ".ts")
#: Documents as files, as SQL.
FILES_SQL = """
files AS (
  SELECT doc_id, source AS repository_id, text, strlen(text) AS size,
    CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 13 = 0 THEN 'tests/' ELSE 'src/' END || lang || '/d' || doc_id || list_extract(['.py', '.md', '.png', '.java', '.txt', '.json', '_test.py', '.ts'], CAST(doc_id % 8 + 1 AS INTEGER)) AS relative_path
  FROM documents
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.when(F.col("doc_id") % 17 == 0, "node_modules/").when(F.col("doc_id") % 13 == 0, "tests/").otherwise("src/")
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repository_id"), F.lit("snapshot").alias("snapshot_id"), "text", F.octet_length("text").cast("long").alias("size"), F.lit("blob").alias("kind"),
        F.concat(top, "lang", F.lit("/d"), F.col("doc_id").cast("string"), end).alias("relative_path"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the repository, the first line the heading."""
    none = F.array().cast("array<string>")
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("chunk-"), doc.cast("string")).alias("id"), doc.alias("doc_id"), F.col("source").alias("repository_id"), F.concat_ws("/", "source", "lang", F.concat(doc.cast("string"), F.lit(".md"))).alias("document_path"),
        F.when(doc % 5 == 0, "flow").otherwise("document").alias("document_type"), F.when(doc % 5 == 0, "flow:steps").otherwise("document:summary").alias("section_type"),
        F.element_at(F.split("text", "\n"), 1).alias("heading"), F.when(doc % 7 == 0, F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/api/v1/d"), (doc % 10).cast("string"), F.lit("/items")).alias("path"))).alias("endpoint"),
        F.array(F.concat(F.lit("Type"), (doc % 30).cast("string"))).alias("symbols"), none.alias("source_paths"), none.alias("roles"), F.when(doc % 3 == 0, F.array(F.concat(F.lit("ev-"), doc.cast("string")))).otherwise(none).alias("evidence_ids"),
        F.when(doc % 4 == 0, F.array(F.lit("supported"))).otherwise(none).alias("confidence_states"), F.col("text").alias("content"),
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between types of events that follow each other for a user: few nodes, many ways."""
    from pyspark.sql import Window

    own = events(spark, sf_dir).withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    counted = own.filter("next is not null and event_type <> next").groupBy(F.col("event_type").alias("from"), F.col("next").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") % 3 == 0, "supported").when(F.col("n") % 3 == 1, "candidate").otherwise("unresolved")
    return counted.select(F.concat_ws(">", "from", "to").alias("id"), "from", "to", F.lit("calls_http").alias("type"), status.alias("status"), "n")


MOVES_SQL = """
m AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
moves AS (
  SELECT event_type || '>' || nxt AS id, event_type AS f, nxt AS t, CASE count(*) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'candidate' ELSE 'unresolved' END AS status
  FROM m WHERE nxt IS NOT NULL AND event_type <> nxt GROUP BY event_type, nxt
)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stands on whom: orders on customers, customers and suppliers on nations, nations on regions (from, to)."""
    t = lambda n: table(spark, sf_dir, n)
    at = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return (
        t("orders").select(at("order", "o_orderkey").alias("from"), at("customer", "o_custkey").alias("to"))
        .unionAll(t("customer").select(at("customer", "c_custkey"), at("nation", "c_nationkey"))).unionAll(t("supplier").select(at("supplier", "s_suppkey"), at("nation", "s_nationkey")))
        .unionAll(t("nation").select(at("nation", "n_nationkey"), at("region", "n_regionkey")))
    )


PLACES_SQL = """
places AS (
  SELECT 'order:' || o_orderkey AS f, 'customer:' || o_custkey AS t FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
)"""
