"""Registered queries: each applies one operator to a whole driver table; SQL says the same on its own where it can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.ids import content_hash, field
from ..operators import architecture, capability, chunks as C, context, contracts, diff, extract, graph, impact, incremental, inventory, publish, query, resolve, scope, search, summaries, text_index, traverse
from ..sources.storage import cut, shared_dir
from . import answers, views as V
from .views import FACTS_SQL, FILES_SQL, MOVES_SQL, PLACES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- filters and pages ----------------------------------------------------------------------------------------------


@register(f"""WITH {FACTS_SQL}, f AS (SELECT * FROM facts WHERE kind IN ('http_endpoint', 'http_endpoint_fragment', 'http_route_mount')),
p AS (SELECT * FROM f ORDER BY id LIMIT 200 OFFSET 50)
SELECT id, component_id, (SELECT count(*) FROM f) AS total, 50 + (SELECT count(*) FROM p) >= (SELECT count(*) FROM f) AS complete FROM p""")
def facts_page(spark, sf):
    return query.query_facts(V.facts(spark, sf), "endpoints", offset=50, limit=200).select("id", "component_id", "total", "complete")


@register(f"""WITH {FACTS_SQL} SELECT id, kind FROM facts WHERE component_id = '7' AND kind IN ('data_entity', 'data_read', 'data_write', 'data_resource') ORDER BY id LIMIT 1000""")
def facts_of_component(spark, sf):
    return query.query_facts(V.facts(spark, sf), "data", component_id="7", limit=5000).select("id", "kind")


@register("""SELECT event_id AS id, user_id AS repository_id, (SELECT count(*) FROM events WHERE user_id = 3) AS total FROM events WHERE user_id = 3 ORDER BY event_id LIMIT 100""")
def evidence_page(spark, sf):
    own = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("repository_id"))
    return query.query_typed(own, 3).select("id", "repository_id", "total")


@register("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'svc' WHEN o_orderkey % 3 = 0 THEN 'svc:api' ELSE 'svcx' END AS component_id FROM orders) WHERE component_id = 'svc' OR starts_with(component_id, 'svc:')""")
def component_prefix(spark, sf):
    k = F.col("o_orderkey")
    own = V.table(spark, sf, "orders").select(k, F.when(k % 2 == 0, "svc").when(k % 3 == 0, "svc:api").otherwise("svcx").alias("component_id"))
    return own.filter(query.of_component("svc")).select("o_orderkey")


@register(f"""WITH {FACTS_SQL} SELECT kind, component_id, arg_max(value, event_id) AS value, arg_max(id, event_id) AS last_id, min(event_id) AS first_place FROM facts GROUP BY kind, component_id""")
def last_value_wins(spark, sf):
    return query.last_of_each(V.events(spark, sf), ["kind", "component_id"], "event_id").select("kind", "component_id", "value", F.col("id").alias("last_id"), F.col("_first").alias("first_place"))


@register("""SELECT CAST(user_id AS VARCHAR) AS f, event_type AS t, 'fact-' || min(event_id) AS kept FROM events GROUP BY 1, 2""")
def first_link_wins(spark, sf):
    own = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("f"), F.col("event_type").alias("t"), F.concat(F.lit("fact-"), "event_id").alias("kept"), "event_id")
    return query.first_of_each(own, ["f", "t"], "event_id").select("f", "t", "kept")


@register("""SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""")
def latest_run_wins(spark, sf):
    return query.latest(V.table(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@register("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS route_order FROM lineitem""")
def route_order(spark, sf):
    return query.numbered(V.table(spark, sf, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber"], "route_order").select("l_orderkey", "l_linenumber", "route_order")


@register("""WITH s AS (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '-', 'g')) AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM s)
SELECT p_partkey, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS unique_slug FROM n""")
def slug_numbers(spark, sf):
    own = V.table(spark, sf, "part").select("p_partkey", F.lower(T.safe_segment(F.col("p_brand"))).alias("slug"))
    return query.distinct_slugs(own, "slug", ["p_partkey"]).select("p_partkey", "unique_slug")


@register("""SELECT n_regionkey, n_name, greatest(count(*) OVER (PARTITION BY n_regionkey) - 3, 0) AS omitted FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 3""")
def capped_lists(spark, sf):
    return summaries.capped(V.table(spark, sf, "nation"), "n_regionkey", ["n_name"], 3).select("n_regionkey", "n_name", "omitted")


# --- inventory ------------------------------------------------------------------------------------------------------

_STATE = """
i AS (SELECT *, CASE WHEN regexp_matches(relative_path, '(^|/)node_modules/') THEN 'excluded_directory' WHEN size > 2097152 THEN 'size_limit' WHEN relative_path LIKE '%.png' THEN 'binary' END AS excluded_reason,
  CASE WHEN relative_path LIKE '%.py' THEN 'python' WHEN relative_path LIKE '%.java' THEN 'java' WHEN relative_path LIKE '%.json' THEN 'json' WHEN relative_path LIKE '%.ts' THEN 'typescript' END AS lang FROM files),
s AS (SELECT *, CASE WHEN excluded_reason IS NOT NULL THEN 'excluded' WHEN lang IS NULL THEN 'unsupported' ELSE 'processed' END AS state FROM i)"""


@register(f"""WITH {FILES_SQL}, {_STATE} SELECT repository_id, count(*) AS discovered, count(*) FILTER (state = 'excluded') AS excluded, count(*) FILTER (state <> 'excluded') AS eligible, count(*) FILTER (state = 'processed') AS processed,
count(*) FILTER (state = 'unsupported') AS unsupported, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS not_scanned FROM s GROUP BY repository_id""")
def coverage_counters(spark, sf):
    return inventory.coverage(inventory.inventory(V.files(spark, sf))).select("repository_id", "discovered", "excluded", "eligible", "processed", "unsupported", "failed", "not_scanned")


@register(f"""WITH {FILES_SQL}, {_STATE} SELECT repository_id, excluded_reason, count(*) AS n FROM s WHERE excluded_reason IS NOT NULL GROUP BY 1, 2""")
def exclusion_histogram(spark, sf):
    found = inventory.coverage(inventory.inventory(V.files(spark, sf)))
    return found.select("repository_id", F.explode("exclusion_reasons").alias("excluded_reason", "n"))


@register(f"""WITH {FILES_SQL}, {_STATE} SELECT CASE WHEN excluded_reason IS NOT NULL THEN 'other' WHEN regexp_matches(relative_path, '^tests/|_test\\.py$') THEN 'test' WHEN relative_path LIKE '%.md' THEN 'documentation' WHEN lang IS NOT NULL THEN 'source' ELSE 'other' END AS classification,
coalesce(CASE WHEN excluded_reason IS NULL THEN lang END, '-') AS language, count(*) AS n FROM s GROUP BY 1, 2""")
def file_classes(spark, sf):
    return inventory.inventory(V.files(spark, sf)).groupBy("classification", F.coalesce("language", F.lit("-")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {FILES_SQL} SELECT doc_id, regexp_matches(relative_path, '^tests/|_test\\.py$') AS is_test FROM files""")
def test_paths(spark, sf):
    return V.files(spark, sf).select("doc_id", scope.is_test_path(F.col("relative_path")).alias("is_test"))


@register(f"""WITH {FACTS_SQL} SELECT id FROM facts WHERE NOT (k % 7 = 0) AND NOT (k % 11 = 0)""")
def production_facts(spark, sf):
    own = V.events(spark, sf)
    path = F.when(F.col("k") % 7 == 0, "src/tests/a.py").when(F.col("k") % 11 == 0, "src/OrderTest.java").otherwise("src/a.py")
    return scope.production_facts(own.select("id", F.lit("code_symbol").alias("kind"), F.to_json(F.struct(path.alias("source_path"))).alias("value_json"))).select("id")


@register("""SELECT event_type AS capability, count(*) FILTER (value >= 5) AS processed, count(*) FILTER (NOT value >= 5) AS failed FROM events GROUP BY 1""")
def rule_counters(spark, sf):
    own = V.table(spark, sf, "events").select(F.col("event_type").alias("capability"), (F.col("value") >= 5).alias("processed"), F.lit(None).cast("string").alias("limitation"))
    return inventory.rule_counters(own).select("capability", "processed", "failed")


@register("""SELECT o_custkey AS repository_id, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' ELSE 'partial' END AS quality FROM orders GROUP BY 1""")
def bundle_quality(spark, sf):
    own = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.when(F.col("o_orderstatus") == "F", "implemented").otherwise("partial").alias("status"))
    return inventory.bundle_quality(own)


@register(f"""WITH {FILES_SQL} SELECT relative_path, false AS structural FROM files WHERE doc_id % 10 <> 0 UNION ALL SELECT relative_path || '/package.json', true FROM files WHERE doc_id % 10 = 0""")
def structural_paths(spark, sf):
    own = V.files(spark, sf).select(F.when(F.col("doc_id") % 10 == 0, F.concat("relative_path", F.lit("/package.json"))).otherwise(F.col("relative_path")).alias("relative_path"))
    return own.withColumn("structural", scope.is_structural(F.col("relative_path")))


# --- text -----------------------------------------------------------------------------------------------------------

_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|account[_-]?key|client[_-]?secret|private[_-]?key|authorization|credential|connection[_-]?string"


@register(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)([^\\s/@:]+):([^\\s/@]+)@', '\\1[REDACTED]@[REDACTED-HOST]/', 'g'),
'\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b', '[REDACTED ACCESS KEY]', 'g'), '\\bgh[pousr]_[A-Za-z0-9]{{20,}}\\b', '[REDACTED TOKEN]', 'g'),
'(?im)(^|[\\s,{{;])({_NAMES})\\s*[:=]\\s*(?:"[^"]*"|''[^'']*''|[^\\s,;}}]+)', '\\1\\2=[REDACTED]', 'g')) AS redacted_sha256 FROM documents""")
def redaction(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_sha256"))


@register(f"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?im)(^|[\\s,{{;])({_NAMES})\\s*[:=]\\s*(?:"[^"]*"|''[^'']*''|[^\\s,;}}]+)') OR regexp_matches(text, '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b')""")
def secrets_found(spark, sf):
    return V.table(spark, sf, "documents").filter(T.has_secret(F.col("text"))).select("doc_id")


@register("""SELECT doc_id FROM documents WHERE false""")
def secrets_left(spark, sf):
    return V.table(spark, sf, "documents").filter(T.has_secret(T.redact(F.col("text")))).select("doc_id")


@register("""WITH t AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(strip_accents(lower(text)), '[^a-z0-9_./-]+')) AS token FROM documents) WHERE length(token) > 2)
SELECT token, count(*) AS documents FROM t GROUP BY token""")
def token_index(spark, sf):
    own = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("t"))
    return C.inverted_index(own, F.col("t"), folded=True).groupBy(F.col("key").alias("token")).agg(F.count(F.lit(1)).alias("documents"))


@register("""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') AS p FROM pages)""")
def url_parts(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.url_base(F.col("url")).alias("base"), T.call_path(F.col("url")).alias("path"))


@register("""SELECT page_id, lower(regexp_replace(list_extract(list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', ''), '^/', ''), '/'), lambda p: p <> 'api' AND NOT regexp_matches(p, '^v[0-9]+$')), 1), '[^A-Za-z0-9._-]+', '-', 'g')) AS slug FROM pages""")
def page_slugs(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.capability_slug(T.call_path(F.col("url"))).alias("slug"))


@register("""SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, sha256(text) AS sha256 FROM documents""")
def size_and_hash(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("sha256"))


@register("""SELECT event_id, json_extract_string(props, '$.k') AS k, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS content_hash FROM events""")
def json_hash(spark, sf):
    return V.table(spark, sf, "events").select("event_id", field("props", "missing", "k").alias("k"), content_hash(F.col("props")).alias("content_hash"))


# --- joins ----------------------------------------------------------------------------------------------------------


@register(f"""WITH {FACTS_SQL}, ends AS (SELECT DISTINCT component_id, path, method FROM facts WHERE kind = 'http_endpoint'), calls AS (SELECT * FROM facts WHERE kind = 'http_client_call'),
m AS (SELECT c.id, count(DISTINCT e.component_id) AS n FROM calls c JOIN ends e ON e.path = c.path AND e.component_id <> c.component_id AND (c.method = 'UNKNOWN' OR e.method = 'UNKNOWN' OR e.method = c.method) GROUP BY c.id)
SELECT c.id AS fact_id, 'component:' || c.component_id AS "from", CASE WHEN n = 1 THEN 'candidate' ELSE 'unresolved' END AS status FROM calls c LEFT JOIN m ON m.id = c.id""")
def call_edges(spark, sf):
    own = V.facts(spark, sf)
    none = graph.resolve_aliases(graph.aliases_of(spark, {}), own.select(F.col("component_id").alias("repository_id")).distinct())
    edges = graph.build_edges(own.filter(F.col("kind").isin("http_endpoint", "http_client_call")), none)
    return edges.select(F.element_at("fact_ids", 1).alias("fact_id"), "from", "status")


@register(f"""WITH {FACTS_SQL} SELECT CASE kind WHEN 'data_write' THEN 'writes_data' WHEN 'package_dependency' THEN 'depends_on_package' ELSE 'publishes_to' END AS type, CASE kind WHEN 'message_producer' THEN 'candidate' ELSE 'supported' END AS status,
CASE kind WHEN 'data_write' THEN 'table-' || (k % 10) WHEN 'package_dependency' THEN 'pkg-' || (k % 20) ELSE 'topic-' || (k % 5) END AS label, count(*) AS edges, count(DISTINCT component_id) AS components FROM facts WHERE kind IN ('data_write', 'package_dependency', 'message_producer') GROUP BY ALL""")
def resource_edges(spark, sf):
    own = V.facts(spark, sf)
    none = graph.resolve_aliases(graph.aliases_of(spark, {}), own.select(F.col("component_id").alias("repository_id")).distinct())
    edges = graph.build_edges(own.filter(F.col("kind").isin("data_write", "package_dependency", "message_producer")), none)
    return edges.groupBy("type", "status", F.col("target_label").alias("label")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("from").alias("components"))


@register("""WITH a AS (SELECT lower('https://' || n_name || '.example.com:80') AS alias, n_nationkey, n_name AS target FROM nation), c AS (SELECT n_name AS id FROM nation WHERE n_nationkey % 3 <> 0)
SELECT a.alias, 'component:' || c.id AS node FROM a LEFT JOIN c ON c.id = a.target""")
def alias_nodes(spark, sf):
    own = V.table(spark, sf, "nation")
    aliases = own.select(F.concat(F.lit("https://"), "n_name", F.lit(".example.com:80/x")).alias("alias"), F.col("n_name").alias("target"))
    return graph.resolve_aliases(aliases, own.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("repository_id")))


@register(f"""WITH {FACTS_SQL}, m AS (SELECT DISTINCT component_id, '/m' || (k % 3) AS mount FROM facts WHERE kind = 'http_client_call' AND k % 9 = 0), f AS (SELECT DISTINCT component_id, method, path FROM facts WHERE kind = 'http_endpoint')
SELECT f.component_id, f.method, coalesce(m.mount, '') || f.path AS path FROM f LEFT JOIN m ON m.component_id = f.component_id""")
def mounted_routes(spark, sf):
    own = V.events(spark, sf)
    parts = own.filter("kind = 'http_endpoint'").select("id", F.lit("http_endpoint_fragment").alias("kind"), "component_id", F.to_json(F.struct("path", "method")).alias("value_json"))
    mounts = own.filter("kind = 'http_client_call' and k % 9 = 0").select("id", F.lit("http_route_mount").alias("kind"), "component_id", F.to_json(F.struct(F.concat(F.lit("/m"), (F.col("k") % 3).cast("string")).alias("path"))).alias("value_json"))
    return graph.endpoint_index(parts.unionByName(mounts))


@register(f"""WITH {FACTS_SQL}, s AS (SELECT component_id, 'C' || (k % 6) AS class_name, 'm' || (k % 11) AS name, min(id) AS symbol_id, count(*) AS n FROM facts WHERE kind = 'http_endpoint' GROUP BY 1, 2, 3),
c AS (SELECT id, component_id, 'C' || (k % 6) AS caller, 'm' || (k % 13) AS callee, CASE user_id % 3 WHEN 0 THEN 'this' WHEN 1 THEN 'C' || (k % 5) END AS receiver FROM facts WHERE kind = 'http_client_call'),
t AS (SELECT c.*, CASE WHEN receiver = 'this' THEN caller WHEN receiver IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.component_id = c.component_id AND s.class_name = c.receiver AND s.name = c.callee) THEN receiver END AS cls FROM c),
n AS (SELECT t.id, coalesce((SELECT n FROM s WHERE s.component_id = t.component_id AND s.class_name = t.cls AND s.name = t.callee), (SELECT n FROM s WHERE s.component_id = t.component_id AND s.class_name = t.caller AND s.name = t.callee),
  (SELECT sum(n) FROM s WHERE s.component_id = t.component_id AND s.name = t.callee), 0) AS candidates FROM t)
SELECT id, CAST(candidates AS BIGINT) AS candidates, CASE WHEN candidates = 1 THEN 'supported' WHEN candidates > 1 THEN 'candidate' ELSE 'unresolved' END AS resolution FROM n""")
def call_resolution(spark, sf):
    own = V.events(spark, sf)
    name = lambda p, n: F.concat(F.lit(p), (F.col("k") % n).cast("string"))
    symbols = own.filter("kind = 'http_endpoint'").select("component_id", F.col("id").alias("symbol_id"), name("C", 6).alias("class_name"), name("m", 11).alias("name"), F.col("path").alias("source_path"))
    calls = own.filter("kind = 'http_client_call'").select("id", "component_id", name("C", 6).alias("caller_class"), name("m", 13).alias("callee"), F.when(F.col("user_id") % 3 == 0, "this").when(F.col("user_id") % 3 == 1, name("C", 5)).alias("receiver"))
    none = spark.createDataFrame([], "component_id string, variable string, type string, class_name string, parameter string")
    return resolve.resolve_calls(calls, symbols, none.select("component_id", "variable", "type"), none.select("component_id", "class_name", "parameter", "type")).select("id", "candidates", "resolution")


@register("""WITH a AS (SELECT o_orderkey AS id, unnest([o_orderpriority, o_orderstatus, 'x']) AS argument, generate_subscripts([1, 2, 3], 1) - 1 AS n, 'T' || (o_custkey % 5) AS cls FROM orders), i AS (SELECT 'T' || (n_nationkey % 5) AS cls, row_number() OVER (PARTITION BY n_nationkey % 5 ORDER BY n_nationkey) - 1 AS n, n_name FROM nation)
SELECT a.id, i.n_name AS injection_point, a.argument FROM a JOIN i ON i.cls = a.cls AND i.n = a.n""")
def argument_binding(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("c").alias("component_id"), F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")).alias("type"), F.array("o_orderpriority", "o_orderstatus", F.lit("x")).alias("arguments"))
    n = V.table(spark, sf, "nation").withColumn("class_name", F.concat(F.lit("T"), (F.col("n_nationkey") % 5).cast("string")))
    i = n.select(F.lit("c").alias("component_id"), "class_name", (F.row_number().over(Window.partitionBy("class_name").orderBy("n_nationkey")) - 1).alias("ordinal"), F.col("n_name").alias("parameter"), F.lit("D").alias("type"))
    none = spark.createDataFrame([], "component_id string, variable string, type string")
    return resolve.bind_arguments(o, i, none).select("id", "injection_point", "argument")


@register("""WITH p AS (SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber AS range_id, s - 10 AS a, s + l_linenumber * 3 AS b FROM p)
SELECT p.l_orderkey, p.l_linenumber, arg_min(r.range_id, (r.b - r.a) * 1000000 + (r.a + 1000) * 100 + r.range_id) AS range_id FROM p LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND r.a <= p.s AND p.s + 1 <= r.b GROUP BY 1, 2""")
def nearest_scope(spark, sf):
    own = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("long")).alias("q"))
    points = own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_linenumber", F.col("q").alias("start"), (F.col("q") + 1).alias("end"))
    ranges = own.select("l_orderkey", F.col("l_linenumber").alias("range_id"), (F.col("q") - 10).alias("range_start"), (F.col("q") + F.col("l_linenumber") * 3).alias("range_end"))
    return resolve.nearest_enclosing(points, ranges, "l_orderkey").select("l_orderkey", "l_linenumber", "range_id")


@register("""WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, 'v' || event_id AS name FROM events WHERE event_type = 'view') SELECT c.event_id AS id, v.name FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def class_before_match(spark, sf):
    own = V.table(spark, sf, "events")
    points = own.filter("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("start"))
    marks = own.filter("event_type = 'view'").select("user_id", F.col("ts").alias("start"), F.concat(F.lit("v"), "event_id").alias("name"))
    return resolve.last_before(points, marks, "user_id").select("id", "name")


@register(f"""WITH {FACTS_SQL}, s AS (SELECT component_id, 'h' || (k % 9) AS name, id AS symbol_id, path FROM facts WHERE kind = 'data_write'), p AS (SELECT id, component_id, 'h' || (k % 9) AS name, path FROM facts WHERE kind = 'http_endpoint')
SELECT p.id, arg_min(s.symbol_id, CASE WHEN s.path = p.path THEN '0' ELSE '1' END || s.symbol_id) AS symbol_id FROM p LEFT JOIN s ON s.component_id = p.component_id AND s.name = p.name GROUP BY p.id""")
def handler_symbols(spark, sf):
    own = V.events(spark, sf)
    name = F.concat(F.lit("h"), (F.col("k") % 9).cast("string"))
    symbols = own.filter("kind = 'data_write'").select("component_id", name.alias("name"), F.col("id").alias("symbol_id"), F.col("path").alias("source_path"))
    ends = own.filter("kind = 'http_endpoint'").select("id", "component_id", F.concat(F.lit("ctl."), name).alias("handler"), F.col("path").alias("source_path"))
    return resolve.handler_symbol(ends, symbols).select("id", "symbol_id")


@register(f"""WITH {FILES_SQL}, b AS (SELECT doc_id AS id, repository_id, regexp_replace(relative_path, '(_test)?\\.[a-z]+$', '') AS base FROM files), f AS (SELECT repository_id, relative_path FROM files)
SELECT b.id, (SELECT f.relative_path FROM f WHERE f.repository_id = b.repository_id AND f.relative_path IN (b.base || '.ts', b.base || '.json', b.base) LIMIT 1) AS target_path FROM b""")
def relative_imports(spark, sf):
    own = V.files(spark, sf)
    return resolve.resolve_relative_imports(own.select(F.col("doc_id").alias("id"), "repository_id", F.regexp_replace("relative_path", "(_test)?\\.[a-z]+$", "").alias("base")), own).select("id", "target_path")


@register(f"""WITH {FACTS_SQL}, l AS (SELECT DISTINCT 'd' || (k * 7) AS target FROM facts), d AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.md' AS path FROM documents), h AS (SELECT target AS id, doc_id AS doc, row_number() OVER (PARTITION BY target ORDER BY path, doc_id) AS n FROM l JOIN d ON ends_with(path, target || '.md') OR ends_with(path, target))
SELECT id, doc FROM h WHERE n <= 3""")
def wikilinks(spark, sf):
    links = V.events(spark, sf).select(F.concat(F.lit("d"), (F.col("k") * 7).cast("string")).alias("target")).distinct().withColumn("id", F.col("target"))
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    return resolve.resolve_by_suffix(links, docs).select("id", "doc")


@register(f"""WITH {FACTS_SQL}, p AS (SELECT DISTINCT component_id, '/K/' || (k % 10) || '/' AS path FROM facts WHERE kind = 'data_write') SELECT p.component_id || p.path AS id, f.id AS fact_id FROM p JOIN facts f ON f.component_id = p.component_id AND contains(lower(f.path), lower(p.path))""")
def entry_path_facts(spark, sf):
    own = V.events(spark, sf)
    entries = own.filter("kind = 'data_write'").select(F.col("component_id").alias("repository_id"), F.concat(F.lit("/K/"), (F.col("k") % 10).cast("string"), F.lit("/")).alias("path")).distinct().withColumn("id", F.concat("repository_id", "path"))
    return resolve.facts_of_paths(entries, own.select(F.col("id").alias("fact_id"), F.col("component_id").alias("repository_id"), F.to_json(F.struct("path")).alias("value_json")))


# --- evidence and refresh -------------------------------------------------------------------------------------------


@register("""SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS evidence_id FROM lineitem WHERE l_suppkey % 5 = 0""")
def orphan_evidence(spark, sf):
    facts = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_suppkey").cast("string")).alias("evidence_ids"))
    evidence = V.table(spark, sf, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("id"))
    return incremental.orphans(facts, evidence)


@register("""WITH u AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS old_fact, CAST(count(*) AS INTEGER) AS evidence FROM u GROUP BY 1 HAVING bool_and(l_suppkey % 7 <> 0)""")
def rebased_facts(spark, sf):
    own = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    facts = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat_ws("-", F.lit("e"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))).alias("evidence_ids")).select(
        F.col("l_orderkey").cast("string").alias("id"), F.lit("k").alias("kind"), F.lit("c").alias("component_id"), F.to_json(F.struct(F.col("l_orderkey").alias("o"))).alias("value_json"), "evidence_ids", F.lit("r").alias("rule_id"))
    evidence = own.select(F.concat_ws("-", F.lit("e"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("relative_path"), F.struct(F.col("l_orderkey").alias("start"), F.col("l_linenumber").cast("long").alias("end")).alias("locator"), F.lit("r").alias("rule_id"))
    rebased = incremental.rebase_evidence(evidence, spark.createDataFrame([("s0",)], "path string"), "next")
    return incremental.rebase_facts(facts, rebased).select(field("value_json", "o").cast("long").alias("old_fact"), F.size("evidence_ids").alias("evidence"))


@register(f"""WITH RECURSIVE {PLACES_SQL}, up AS (SELECT 'region:1' AS n UNION SELECT p.f FROM places p JOIN up ON p.t = up.n) SELECT n AS path FROM up""")
def invalidation_closure(spark, sf):
    imports = V.places(spark, sf).select(F.col("from").alias("source_path"), F.col("to").alias("target_path"))
    return traverse.invalidated(spark.createDataFrame([("region:1",)], "path string"), imports)


@register("""WITH o AS (SELECT o_custkey AS path, max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS b FROM orders GROUP BY 1) SELECT CAST(path AS VARCHAR) AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o WHERE a IS DISTINCT FROM b""")
def changed_files(spark, sf):
    own = V.table(spark, sf, "orders")
    side = lambda n: own.filter(f"o_orderkey % {n} = 0").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.max("o_orderkey").cast("string").alias("source_hash"))
    return diff.changed_paths(side(2), side(3))


_DIFF = f"""WITH {FACTS_SQL}, x AS (SELECT id, event_id, kind || ':' || component_id || ':' || path || ':' || method AS s, kind || ':' || component_id || ':' || path AS l, event_id % 2 = 0 AS base FROM facts WHERE kind = 'http_endpoint'),
added AS (SELECT * FROM x a WHERE NOT base AND NOT EXISTS (SELECT 1 FROM x b WHERE b.base AND b.s = a.s)), removed AS (SELECT * FROM x a WHERE base AND NOT EXISTS (SELECT 1 FROM x b WHERE NOT b.base AND b.s = a.s)),
prior AS (SELECT l, max(id) AS before_id FROM x WHERE base GROUP BY l), p AS (SELECT a.id, prior.before_id FROM added a LEFT JOIN prior ON prior.l = a.l)
SELECT CASE WHEN before_id IS NULL THEN 'added' ELSE 'modified' END AS change, before_id, id AS after_id FROM p UNION ALL SELECT 'removed', id, NULL FROM removed WHERE id NOT IN (SELECT before_id FROM p WHERE before_id IS NOT NULL)"""


@register(_DIFF)
def fact_diff(spark, sf):
    own = V.events(spark, sf).filter("kind = 'http_endpoint'")
    rows = own.select("id", "kind", "component_id", F.to_json(F.struct("path", "method")).alias("value_json"), (F.col("event_id") % 2 == 0).alias("base"))
    return diff.compare_facts(rows.filter("base").drop("base"), rows.filter("not base").drop("base"))


@register("""SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM events WHERE (event_id % 3 = 0) <> (event_id % 5 = 0)""")
def manifest_diff(spark, sf):
    own = V.table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("path"), F.sha2("props", 256).alias("sha256"), F.octet_length("props").alias("size"))
    return diff.manifests_differ(own.filter("event_id % 3 = 0"), own.filter("event_id % 5 = 0"))


# --- graphs ---------------------------------------------------------------------------------------------------------


@register(f"""WITH RECURSIVE {MOVES_SQL}, w AS (SELECT 'signup' AS n, ['signup'] AS nodes, [CAST(NULL AS VARCHAR)] AS edges, CAST([] AS VARCHAR[]) AS st, 0 AS d UNION ALL
SELECT t, list_append(nodes, t), list_append(edges, id), list_append(st, status), d + 1 FROM w JOIN moves ON f = n WHERE NOT list_contains(nodes, t) AND n <> 'purchase' AND d < 12)
SELECT d AS depth, array_to_string(nodes, '>') AS nodes, CASE WHEN list_contains(st, 'unresolved') THEN 'unresolved' WHEN list_contains(st, 'candidate') THEN 'candidate' ELSE 'supported' END AS status FROM w WHERE n = 'purchase' ORDER BY d, array_to_string(edges[2:], '|') LIMIT 20""")
def flow_trace(spark, sf):
    found = graph.trace_flow(cut(V.moves(spark, sf)), "signup", "purchase")
    return found.select("depth", F.array_join("nodes", ">").alias("nodes"), "status")


@register(f"""WITH {MOVES_SQL} SELECT id, f AS "from", t AS "to", status FROM moves WHERE f = 'view' OR t = 'view'""")
def relations_of_node(spark, sf):
    return graph.relations(V.moves(spark, sf), "view").select("id", "from", "to", "status")


@register(f"""WITH {MOVES_SQL} SELECT f AS "from", CASE max(CASE status WHEN 'supported' THEN 1 WHEN 'candidate' THEN 2 ELSE 3 END) WHEN 1 THEN 'supported' WHEN 2 THEN 'candidate' ELSE 'unresolved' END AS status FROM moves GROUP BY 1""")
def worst_status(spark, sf):
    return V.moves(spark, sf).groupBy("from").agg(graph.worst_status().alias("status"))


@register(f"""WITH {MOVES_SQL} SELECT CASE status WHEN 'supported' THEN 'fact' WHEN 'candidate' THEN 'inference' ELSE 'unknown' END AS classification, f || ' calls_http ' || t AS statement FROM moves""")
def findings_of_edges(spark, sf):
    none = F.array().cast("array<string>")
    return graph.findings(V.moves(spark, sf).withColumns({n: none for n in ("fact_ids", "evidence_ids", "limitations")})).select("classification", "statement")


@register(f"""WITH RECURSIVE {PLACES_SQL}, calls AS (SELECT f, t FROM places WHERE f LIKE 'customer%' OR f LIKE 'nation%' OR f LIKE 'supplier%'), w AS (SELECT 'supplier:1' AS n, 0 AS d UNION SELECT t, d + 1 FROM w JOIN calls ON f = n WHERE d < 12)
SELECT n AS node, min(d) AS depth FROM w GROUP BY n""")
def call_flow(spark, sf):
    edges = V.places(spark, sf).filter("`from` not like 'order%'").withColumn("id", F.concat_ws(">", "from", "to"))
    symbols = edges.select(F.explode(F.array("from", "to")).alias("symbol_id")).distinct()
    return traverse.endpoint_flow(edges, symbols, spark.createDataFrame([("supplier:1",)], "node string"))[0]


@register("""WITH e AS (SELECT 'c' || c_custkey AS id, c_nationkey AS n FROM customer), hub AS (SELECT n FROM (SELECT n, count(*) AS d FROM e GROUP BY n)), s AS (SELECT n FROM e WHERE id = 'c1')
SELECT id, CASE WHEN id = 'c1' THEN 0 ELSE 2 END AS distance FROM e WHERE n IN (SELECT n FROM s) ORDER BY distance, id LIMIT 40""")
def context_expansion(spark, sf):
    own = V.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"))
    links = own.select(F.col("id").alias("from"), F.col("n").alias("to"), F.lit("contains_symbol").alias("type"), F.lit("supported").alias("status"))
    return traverse.expand_context(links, own.select("id"), spark.createDataFrame([("c1",)], "id string"), depth=2, limit=40)


@register(f"""WITH {FACTS_SQL}, kept AS (SELECT id FROM facts WHERE k % 4 = 0), g AS (SELECT component_id AS f, 'k' || (k % 30) AS t, list(id) AS ids FROM facts GROUP BY 1, 2) SELECT f || '>' || t AS id FROM g WHERE EXISTS (SELECT 1 FROM kept WHERE list_contains(ids, kept.id))""")
def graph_of_facts(spark, sf):
    own = V.events(spark, sf)
    edges = own.groupBy(F.col("component_id").alias("from"), F.concat(F.lit("k"), (F.col("k") % 30).cast("string")).alias("to")).agg(F.collect_list("id").alias("fact_ids")).withColumn("id", F.concat_ws(">", "from", "to"))
    nodes = edges.select(F.col("from").alias("id"), "fact_ids")
    return scope.graph_for_facts(nodes, edges, own.filter("k % 4 = 0").select("id", "component_id"))[1].select("id")


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS task FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey - 1 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) ORDER BY task LIMIT 2""")
def ready_tasks(spark, sf):
    own = V.table(spark, sf, "orders").select("o_orderkey")
    tasks = own.select(F.col("o_orderkey").cast("string").alias("task"))
    needs = own.join(own.select((F.col("o_orderkey") + 1).alias("o_orderkey")), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("task"), (F.col("o_orderkey") - 1).cast("string").alias("needs"))
    return traverse.ready_tasks(tasks, needs, own.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("task")))


# --- chunks, search, capabilities -----------------------------------------------------------------------------------


@register("""WITH c AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || regexp_replace(text, '(^|\\n)#', '\\1', 'g'), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)
SELECT conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section, role || ' ' || turn AS heading FROM conversations""")
def document_sections(spark, sf):
    own = V.table(spark, sf, "conversations")
    line = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", "(^|\n)#", "$1"))
    docs = own.groupBy(F.col("conv_id").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return C.sections(docs).select("path", F.col("section").cast("long").alias("section"), "heading")


@register(f"""WITH {FACTS_SQL} SELECT id, method AS http_method, path AS http_path, 'src/K' || k || '.java' AS source_path, 'user-' || user_id AS link, 'ev-' || event_id AS evidence_id FROM facts WHERE method <> 'UNKNOWN'""")
def chunk_features(spark, sf):
    own = V.events(spark, sf).filter("method <> 'UNKNOWN'")
    content = F.concat(F.lit("Entry "), "method", F.lit(" "), "path", F.lit(" in `src/K"), F.col("k").cast("string"), F.lit(".java:12` is supported, see [[user-"), F.col("user_id").cast("string"), F.lit("|him]] (ev-"), F.col("event_id").cast("string"), F.lit(")"))
    own = own.withColumns(C.features(content, F.lit("h")))
    return own.select("id", F.col("endpoint.method").alias("http_method"), F.col("endpoint.path").alias("http_path"), F.element_at("source_paths", 1).alias("source_path"), F.element_at("outgoing_links", 1).alias("link"), F.element_at("evidence_ids", 1).alias("evidence_id"))


@register("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'flow:steps' WHEN n_nationkey % 4 = 1 THEN 'flow:architecture' WHEN n_nationkey % 4 = 2 THEN 'flow:data' ELSE 'flow:summary' END AS section_type FROM nation""")
def section_types(spark, sf):
    k = F.col("n_nationkey") % 4
    heading = F.when(k == 0, "Pasos del flujo").when(k == 1, "Visión de ARQUITECTURA").when(k == 2, "Persistencia").otherwise(F.col("n_name"))
    return V.table(spark, sf, "nation").select("n_nationkey", C.section_type(F.lit("flow"), heading).alias("section_type"))


_CHUNKS = """c AS (SELECT doc_id, 'chunk-' || doc_id AS id, source AS repository_id, source || '/' || lang || '/' || doc_id || '.md' AS document_path, strip_accents(lower(text)) AS body,
  strip_accents(lower(string_split(text, chr(10))[1] || ' ' || source || '/' || lang || '/' || doc_id || '.md' || CASE WHEN doc_id % 7 = 0 THEN ' GET /api/v1/d' || (doc_id % 10) || '/items' ELSE '' END || ' Type' || (doc_id % 30))) AS meta,
  CASE WHEN doc_id % 7 = 0 THEN 'get /api/v1/d' || (doc_id % 10) || '/items' END AS route, text FROM documents)"""
_SCORE = f"""{_CHUNKS}, q AS (SELECT 'the and get /api/v1/d3/items type7' AS exact, ['the', 'and', 'get', '/api/v1/d3/items', 'type7'] AS terms), s AS (
SELECT c.*, CASE WHEN contains(meta, exact) THEN 100 WHEN contains(body, exact) THEN 60 ELSE 0 END + list_sum(list_transform(terms, lambda t: CASE WHEN contains(meta, t) THEN 12 WHEN contains(body, t) THEN 3 ELSE 0 END))
+ CASE WHEN route IS NULL THEN 0 ELSE CASE WHEN contains(exact, substr(route, 5)) THEN 80 ELSE 0 END + 35 * len(list_filter(terms, lambda t: contains(route, t))) END + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS score FROM c, q)"""
SEARCHED = "The and GET /api/v1/d3/items Type7"


@register(f"""WITH {_SCORE} SELECT id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, document_path, id LIMIT 100""")
def document_search(spark, sf):
    return search.search_documents(V.chunks(spark, sf), SEARCHED, limit=500).select("id", "score")


@register(f"""WITH {_SCORE} SELECT id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, document_path, id LIMIT 100""")
def indexed_search(spark, sf):
    root = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/search-{uuid.uuid4().hex}"
    return text_index.search(text_index.build(V.chunks(spark, sf), root, 8), SEARCHED, limit=500)[0].select("id", "score")


@register("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) AS gram FROM d)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def gram_counts(spark, sf):
    return text_index.gram_counts(V.table(spark, sf, "documents").select(F.lower("text").alias("text")), "text")


@register(f"""WITH {FACTS_SQL}, p AS (SELECT DISTINCT method, path, 'handler' || (k % 4) AS handler FROM facts WHERE kind = 'http_endpoint' AND component_id = '7'),
w AS (SELECT *, list_filter(string_split_regex(lower(method || ' ' || path), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS pw FROM p), q AS (SELECT ['get', '42', 'handler2', 'handler'] AS terms),
s AS (SELECT *, CAST(list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(pw, t) THEN 8 WHEN handler = t THEN 3 WHEN length(t) >= 4 AND (starts_with(handler, t) OR starts_with(t, handler)) THEN 1 ELSE 0 END)) AS INTEGER) AS score FROM w, q)
SELECT method, path, handler, score FROM s WHERE score > 0 ORDER BY score DESC, path, method LIMIT 100""")
def flow_search(spark, sf):
    own = V.events(spark, sf).filter("kind = 'http_endpoint'").select("component_id", "method", "path", F.concat(F.lit("handler"), (F.col("k") % 4).cast("string")).alias("handler"), F.lit("").alias("source_path")).distinct()
    return search.find_flows(own, "GET 42 handler2 handler", "7", 100).select("method", "path", "handler", "score")


@register("""WITH c AS (SELECT *, 'd' || (doc_id % 10) AS slug FROM documents WHERE doc_id % 7 = 0) SELECT slug AS id, upper(slug[1]) || slug[2:] AS name, count(DISTINCT source) AS repositories, count(*) AS chunks, count(*) FILTER (doc_id % 3 = 0) AS evidence, CASE WHEN count(*) FILTER (doc_id % 3 = 0) > 0 THEN 'high' ELSE 'medium' END AS confidence FROM c GROUP BY slug""")
def capability_fold(spark, sf):
    return capability.fold(V.chunks(spark, sf)).select("id", "name", *(F.size(c).cast("long").alias(n) for c, n in (("repositories", "repositories"), ("document_chunk_ids", "chunks"), ("evidence_ids", "evidence"))), "confidence")


@register("""WITH c AS (SELECT DISTINCT 'd' || (doc_id % 10) AS id FROM documents WHERE doc_id % 7 = 0), v AS (SELECT id, [id, id, 'get /api/v1/' || id || '/items'] AS vals FROM c), q AS (SELECT ['d3x', 'items'] AS terms)
SELECT id, CAST(list_sum(list_transform(terms, lambda t: len(list_filter(vals, lambda x: contains(x, t))) + CASE WHEN len(list_filter(vals, lambda x: contains(x, t))) > 0 THEN 8 ELSE 0 END)) AS INTEGER) AS score FROM v, q""")
def capability_ranking(spark, sf):
    return search.rank_capabilities(capability.fold(V.chunks(spark, sf)), "D3x para items").select("id", "score")


@register("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice / 100 AS BIGINT) AS w FROM orders), u AS (SELECT *, coalesce(sum(greatest(1, w)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o) SELECT o_custkey, o_orderkey FROM u WHERE used < 3000""")
def weight_limit(spark, sf):
    own = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 100).cast("long").alias("w"))
    return context.limit_by_weight(own, "o_custkey", "o_orderkey", "w", 3000).select("o_custkey", "o_orderkey")


@register("""WITH RECURSIVE o AS (SELECT c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey, strlen(c_name) AS b FROM customer), w AS (SELECT g, n, c_custkey, 0 AS part, b AS used FROM o WHERE n = 1 UNION ALL SELECT o.g, o.n, o.c_custkey, CASE WHEN w.used + o.b > 100 THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + o.b > 100 THEN o.b ELSE w.used + o.b END FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1)
SELECT c_custkey, part FROM w""")
def byte_parts(spark, sf):
    own = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.octet_length("c_name").alias("b"))
    return context.partition_by_bytes(own, "c_nationkey", "c_custkey", "b", 100).select("c_custkey", "part")


@register(f"""WITH RECURSIVE {_SCORE}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_path, id) AS place FROM s ORDER BY score DESC, document_path, id LIMIT 100),
t AS (SELECT place, id, repository_id, doc_id % 5 = 0 AS flow, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, 'Type' || (doc_id % 30) AS sym FROM top),
w AS (SELECT CAST(0 AS BIGINT) AS place, false AS taken, '' AS id, CAST([] AS VARCHAR[]) AS repos, CAST([] AS VARCHAR[]) AS syms, CAST(0 AS BIGINT) AS tokens, 0 AS flows UNION ALL
SELECT t.place, ok, t.id, CASE WHEN ok THEN list_append(w.repos, t.repository_id) ELSE w.repos END, CASE WHEN ok AND NOT list_contains(w.syms, t.sym) THEN list_append(w.syms, t.sym) ELSE w.syms END, CASE WHEN ok THEN w.tokens + t.tokens ELSE w.tokens END, CASE WHEN ok AND t.flow THEN w.flows + 1 ELSE w.flows END
FROM w JOIN t ON t.place = w.place + 1, LATERAL (SELECT len(w.repos) < 40 AND len(list_filter(w.repos, lambda r: r = t.repository_id)) < 15 AND NOT (t.flow AND w.flows >= 5) AND len(w.syms) + CASE WHEN list_contains(w.syms, t.sym) THEN 0 ELSE 1 END <= 25 AND w.tokens + t.tokens <= 15000 AS ok))
SELECT id FROM w WHERE taken""")
def budget_selection(spark, sf):
    best = cut(search.search_documents(V.chunks(spark, sf), SEARCHED, limit=100))  # scored once
    top = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "document_path", "id")))
    return context.select_within(top, context.Budget()).select("id")


@register("""SELECT count(DISTINCT source || '/' || lang || '/' || doc_id) AS documents_considered, count(*) FILTER (doc_id % 9 = 0) AS documents_selected, CAST(sum(ceil(strlen(text) / 4.0)) FILTER (doc_id % 9 = 0) AS BIGINT) AS estimated_tokens, count(*) FILTER (doc_id % 9 = 0 AND doc_id % 2 = 1) AS unresolved_relations, count(*) FILTER (doc_id % 9 <> 0) AS omitted_by_budget FROM documents""")
def context_statistics(spark, sf):
    own = V.chunks(spark, sf)
    links = own.select(F.col("id").alias("from"), F.concat(F.lit("x"), "id").alias("to"), F.lit("calls").alias("type"), F.when(F.col("doc_id") % 2 == 1, "candidate").otherwise("supported").alias("status"))
    return context.statistics(own, own.filter("doc_id % 9 = 0"), links).drop("repositories_represented")


# --- counts, impact, publishing -------------------------------------------------------------------------------------


@register("""WITH r AS (SELECT event_type, 'ev-' || event_id AS e, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_type AS kind, count(*) AS facts, string_agg(e, ', ' ORDER BY n) FILTER (n <= 5) AS evidence FROM r GROUP BY 1""")
def facts_by_kind(spark, sf):
    own = V.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.array(F.concat(F.lit("ev-"), "event_id")).alias("evidence_ids"))
    return summaries.by_kind(own)


@register("""SELECT 'l' || (k % 4) AS layer, count(*) FILTER (event_type = 'view') AS modules, count(*) FILTER (event_type = 'click') AS symbols FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ('view', 'click') GROUP BY 1""")
def facts_by_layer(spark, sf):
    own = V.events(spark, sf).select(F.when(F.col("event_type") == "view", "source_module").when(F.col("event_type") == "click", "code_symbol").otherwise("x").alias("kind"), F.to_json(F.struct(F.concat(F.lit("l"), (F.col("k") % 4).cast("string")).alias("layer"))).alias("value_json"))
    return summaries.by_layer(own)


@register("""WITH n AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS role, n_name AS name FROM nation) SELECT role, count(*) AS symbols, string_agg(name, '; ' ORDER BY name) AS names FROM n GROUP BY role""")
def symbols_by_role(spark, sf):
    own = V.table(spark, sf, "nation").select(F.lit("code_symbol").alias("kind"), F.to_json(F.struct(F.col("n_regionkey").cast("string").alias("role"), F.col("n_name").alias("name"))).alias("value_json"))
    return summaries.by_role(own)


@register("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 10) AS large FROM events GROUP BY 1""")
def capability_counts(spark, sf):
    t = F.col("event_type")
    return summaries.conditional_counts(V.table(spark, sf, "events"), {"views": t == "view", "clicks": t == "click", "large": F.col("value") > 10}, "user_id")


@register("""SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def value_counts(spark, sf):
    return summaries.value_counts(V.table(spark, sf, "customer"), "c_mktsegment")


@register("""SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey""")
def node_labels(spark, sf):
    nodes = V.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    own = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("n"))
    return summaries.labelled(own, nodes, "n").select("c_custkey", F.col("n_label").alias("label"))


@register(f"""WITH {FACTS_SQL} SELECT count(*) AS facts, count(*) FILTER (kind = 'http_endpoint') AS endpoints, count(*) FILTER (kind = 'http_client_call') AS integrations, count(*) FILTER (kind = 'data_write') AS data FROM facts WHERE component_id = '5'""")
def service_summary(spark, sf):
    return summaries.explain_service(V.facts(spark, sf), "5").select("facts", "endpoints", "integrations", "data")


@register(f"""WITH {FACTS_SQL} SELECT component_id, CASE WHEN bool_or(kind = 'http_endpoint') THEN 'service' ELSE 'component' END AS profile FROM facts WHERE CAST(component_id AS INTEGER) % 2 = 0 OR kind <> 'http_endpoint' GROUP BY 1""")
def repository_profiles(spark, sf):
    return summaries.repository_profile(V.facts(spark, sf).filter("cast(component_id as int) % 2 = 0 or kind <> 'http_endpoint'"))


@register("""WITH d AS (SELECT o_custkey, count(*) AS repositories, count(DISTINCT o_orderstatus) AS consumers, count(*) FILTER (o_orderpriority LIKE '1%') AS synchronous_dependencies, count(*) FILTER (o_orderpriority LIKE '2%') AS messages, count(*) FILTER (o_orderpriority LIKE '3%') AS data_resources, count(*) FILTER (o_orderstatus = 'P') AS unresolved_relations, count(*) AS evidence FROM orders GROUP BY 1), s AS (SELECT *, 2 * repositories + 2 * consumers + synchronous_dependencies + messages + data_resources + 2 * unresolved_relations AS score FROM d)
SELECT o_custkey, score, CASE WHEN score >= 16 THEN 'alta' WHEN score >= 7 THEN 'media' ELSE 'baja' END AS complexity, CASE WHEN consumers >= 3 OR data_resources >= 2 THEN 'crítica' WHEN score >= 8 THEN 'alta' ELSE 'media' END AS criticality, CASE WHEN evidence >= 5 AND unresolved_relations = 0 THEN 'alta' WHEN evidence > 0 THEN 'media' ELSE 'baja' END AS confidence FROM s""")
def impact_levels(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    own = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("repositories"), F.count_distinct(s).alias("consumers"), F.count_if(p.startswith("1")).alias("synchronous_dependencies"), F.count_if(p.startswith("2")).alias("messages"),
        F.count_if(p.startswith("3")).alias("data_resources"), F.count_if(s == "P").alias("unresolved_relations"), F.count(F.lit(1)).alias("evidence"))
    return impact.levels(own).select("o_custkey", "score", "complexity", "criticality", "confidence")


@register("""SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_partkey % 50 = 0 OR l_suppkey % 9 = 0""")
def impacted_documents(spark, sf):
    own = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_set("l_partkey").alias("fact_ids"), F.collect_set("l_suppkey").alias("edge_ids"), F.array().cast("array<bigint>").alias("evidence_ids"))
    facts, edges = V.table(spark, sf, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")), V.table(spark, sf, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("id"))
    return impact.impacted_documents(own, facts, edges, facts.limit(0))


@register("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 1 ELSE least(greatest(n_nationkey % 8, 1), 5) + 1 END AS level, CASE WHEN n_regionkey = 0 THEN 'sufficient' ELSE list_extract(['expand_documentation', 'directed_analysis', 'source_evidence', 'restricted_agent', 'scope_expansion_required'], least(greatest(n_nationkey % 8, 1), 5)) END AS status FROM nation""")
def investigation_steps(spark, sf):
    own = V.table(spark, sf, "nation").withColumn("x", impact.next_step(F.col("n_nationkey") % 8, F.col("n_regionkey") == 0))
    return own.select("n_nationkey", "x.level", "x.status")


@register("""SELECT event_id FROM events WHERE event_id % 40 = 0 OR user_id = 4 OR user_id = 9""")
def relevant_edges(spark, sf):
    own = V.table(spark, sf, "events")
    edges = own.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("from"), F.lit("x").alias("to"), F.array("event_id").alias("evidence_ids"))
    return impact.relevant_edges(edges, own.filter("event_id % 40 = 0").select(F.col("event_id").alias("id")), spark.createDataFrame([("u4",), ("u9",)], "id string")).select(F.col("id").alias("event_id"))


@register("""WITH m AS (SELECT source AS edition_id, lang || '/' || doc_id || '.md' AS path, sha256(text) AS sha256 FROM documents) SELECT edition_id, count(*) AS files, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path)) AS content_hash FROM m GROUP BY 1""")
def edition_digests(spark, sf):
    own = V.table(spark, sf, "documents").select(F.col("source").alias("edition_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return publish.edition_digest(publish.manifest(own))


@register("""SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0""")
def publishable_paths(spark, sf):
    d = F.col("doc_id")
    path = F.when(d % 3 == 0, F.concat(F.lit("../"), d.cast("string"), F.lit(".md"))).when(d % 2 == 0, F.concat(d.cast("string"), F.lit(".md"))).otherwise(F.concat(d.cast("string"), F.lit(".exe")))
    return V.table(spark, sf, "documents").filter(publish.publishable(path)).select("doc_id")


@register("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def unreferenced_content(spark, sf):
    used = V.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return publish.unreferenced(V.table(spark, sf, "part").select("p_partkey"), used, "p_partkey")


# --- extraction and streams -----------------------------------------------------------------------------------------


@register(f"""WITH {FACTS_SQL} SELECT 'k' || event_id || '.py' AS relative_path, 'python.fastapi.decorator' AS rule_id, CAST(7 AS BIGINT) AS start, path, method FROM facts WHERE kind = 'http_endpoint' AND method <> 'UNKNOWN'""")
def extracted_endpoints(spark, sf):
    own = V.events(spark, sf).filter("kind = 'http_endpoint'")
    text = F.concat(F.lit("# ñé\n\n"), F.lit("@app."), F.lower("method"), F.lit("(\""), "path", F.lit("\")\ndef f():\n    pass\n"))
    files = own.select(F.lit("r").alias("repository_id"), F.lit("s").alias("snapshot_id"), F.concat(F.lit("k"), F.col("event_id").cast("string"), F.lit(".py")).alias("relative_path"), text.alias("text"))
    found = extract.extract(files, {"python.fastapi.decorator"})
    return found.select("relative_path", "rule_id", (F.col("start") - 1).alias("start"), field("value_json", "path").alias("path"), field("value_json", "method").alias("method"))


@register("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def event_windows(spark, sf):
    from ..streaming.refresh import event_counts

    counted = event_counts(V.table(spark, sf, "events").withColumn("value", F.round(F.col("value") * 100).cast("long")))
    return counted.select("window_start", "event_type", "n", F.col("total").alias("cents"))


# --- architecture of sources ----------------------------------------------------------------------------------------


_PATHS = """p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'mod' || (doc_id % 3) || '/src/main/java/com/acme/D' || doc_id || '.java' WHEN 1 THEN 'src/test/port/in/Handler' || doc_id || '.ts' WHEN 2 THEN 'api/controller/d' || doc_id || '.js' ELSE 'docs/spec/d' || doc_id || '.md' END AS path, doc_id % 4 AS c FROM documents)"""


@register(f"""WITH {_PATHS} SELECT path, CASE c WHEN 0 THEN 'main' WHEN 2 THEN 'root' ELSE 'test' END AS source_set, CASE c WHEN 0 THEN 'mod' || (doc_id % 3) ELSE '.' END AS build_module, CASE c WHEN 0 THEN 'com.acme' END AS package, CASE c WHEN 1 THEN 'in' END AS port_direction,
CASE c WHEN 2 THEN 'api' ELSE 'root' END AS layer, CASE c WHEN 1 THEN 'port-in' WHEN 2 THEN 'controller' ELSE 'module' END AS role, CASE c WHEN 3 THEN 'documentation' ELSE 'source' END AS kind, CASE c WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' ELSE 'javascript' END AS language FROM p""")
def path_metadata(spark, sf):
    d = F.col("doc_id")
    id_ = d.cast("string")
    path = (
        F.when(d % 4 == 0, F.concat(F.lit("mod"), (d % 3).cast("string"), F.lit("/src/main/java/com/acme/D"), id_, F.lit(".java"))).when(d % 4 == 1, F.concat(F.lit("src/test/port/in/Handler"), id_, F.lit(".ts")))
        .when(d % 4 == 2, F.concat(F.lit("api/controller/d"), id_, F.lit(".js"))).otherwise(F.concat(F.lit("docs/spec/d"), id_, F.lit(".md")))
    )
    own = V.table(spark, sf, "documents").select(path.alias("path"))
    p = F.col("path")
    return own.select("path", architecture.path_metadata(p).alias("m"), architecture.layer(p).alias("layer"), architecture.role(p).alias("role"), architecture.file_kind(p).alias("kind"), architecture.source_language(p).alias("language")).select("path", "m.*", "layer", "role", "kind", "language")


@register("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Obtiene o consulta asociada a «find user by id»; invoca ' || lower(n_name) || ', map' WHEN 1 THEN 'Agrupa la responsabilidad asociada a «order mapper»' ELSE 'Ejecuta la operación asociada a «paint ' || n_nationkey || '»' END || '. Descripción derivada del código estático.' AS description FROM nation""")
def symbol_descriptions(spark, sf):
    k = F.col("n_nationkey") % 3
    none = F.array().cast("array<string>")
    told = architecture.describe(F.when(k == 1, "class").otherwise("method"), F.when(k == 0, "findUserById").when(k == 1, "OrderMapper").otherwise(F.concat(F.lit("paint_"), F.col("n_nationkey").cast("string"))), F.when(k == 0, F.array(F.lower("n_name"), F.lit("map"))).otherwise(none))
    return V.table(spark, sf, "nation").select("n_nationkey", told.alias("description"))


@register("""SELECT p_partkey, p_partkey % 5 IN (0, 3) AS architectural FROM part""")
def architectural_types(spark, sf):
    k = F.col("p_partkey") % 5
    named = F.when(k == 0, F.concat(F.lit("com.acme.Part"), F.col("p_partkey").cast("string"), F.lit("<String>"))).when(k == 1, "List<Part>").when(k == 2, "java.util.UUID").when(k == 3, "PartService").otherwise("Mono<Part>")
    return V.table(spark, sf, "part").select("p_partkey", architecture.is_architectural(named).alias("architectural"))


_TARGETS = """f AS (SELECT doc_id, source AS repository_id, CASE doc_id % 3 WHEN 0 THEN 'src/d' || doc_id || '.ts' WHEN 1 THEN 'src/d' || doc_id || '/index.js' ELSE 'main/java/com/a/K' || doc_id || '.java' END AS relative_path FROM documents)"""


@register(f"""WITH {_TARGETS}, i AS (SELECT doc_id AS id, source AS repository_id, doc_id % 2 = 0 AS java, doc_id + 40 AS to_ FROM documents) SELECT i.id, f.relative_path AS target_path FROM i LEFT JOIN f ON f.repository_id = i.repository_id AND f.doc_id = i.to_ AND (f.doc_id % 3 = 2) = i.java""")
def import_targets(spark, sf):
    d = F.col("doc_id")
    name = lambda a, n, b="": F.concat(F.lit(a), n.cast("string"), F.lit(b))
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("repository_id"))
    files = docs.select("repository_id", F.when(d % 3 == 0, name("src/d", d, ".ts")).when(d % 3 == 1, name("src/d", d, "/index.js")).otherwise(name("main/java/com/a/K", d, ".java")).alias("relative_path"))
    java = d % 2 == 0
    imports = docs.select(d.alias("id"), "repository_id", F.when(java, name("main/java/com/b/X", d, ".java")).otherwise(name("src/deep/m", d, ".ts")).alias("source_path"), F.when(java, name("com.a.K", d + 40)).otherwise(name("./../d", d + 40)).alias("specifier"))
    return architecture.import_targets(imports, files).select("id", "target_path")


@register("""WITH d AS (SELECT source AS r, 'src/d' || doc_id || '.py' AS path, 'f' || (doc_id % 50) AS name, 'f' || ((doc_id * 7) % 50) AS callee FROM documents), n AS (SELECT r, name, count(*) AS n, min(path) AS at FROM d GROUP BY 1, 2)
SELECT d.r AS component_id, d.path AS source_path, CASE WHEN n.n = 1 THEN n.at END AS target_path, CASE WHEN n.n = 1 THEN 'supported' WHEN n.n > 1 THEN 'candidate' ELSE 'unresolved' END AS resolution FROM d LEFT JOIN n ON n.r = d.r AND n.name = d.callee""")
def resolved_calls(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("def f"), (d % 50).cast("string"), F.lit("():\n    f"), (d * 7 % 50).cast("string"), F.lit("()\n"))
    files = V.table(spark, sf, "documents").select(F.col("source").alias("repository_id"), F.lit("s").alias("snapshot_id"), F.concat(F.lit("src/d"), d.cast("string"), F.lit(".py")).alias("relative_path"), text.alias("text"))
    facts = cut(extract.facts_of(extract.extract(files, {"source.symbol", "source.call"})))
    calls = architecture.resolve_facts(facts, files).filter("kind = 'symbol_call'")
    return calls.select("component_id", *(field("value_json", n).alias(n) for n in ("source_path", "target_path", "resolution")))


@register("""WITH d AS (SELECT source AS r, 'src/d' || doc_id || '.py' AS path, CASE WHEN doc_id % 11 = 0 THEN 'g' ELSE 'f' END || (doc_id % 500) AS name, 'f' || ((doc_id * 7) % 500) AS callee FROM documents), n AS (SELECT r, name, count(*) AS n, min(path) AS at FROM d GROUP BY 1, 2)
SELECT d.r AS component_id, d.path AS source_path, CASE WHEN n.n = 1 THEN n.at END AS target_path, CASE WHEN n.n = 1 THEN 'supported' WHEN n.n > 1 THEN 'candidate' ELSE 'unresolved' END AS resolution FROM d LEFT JOIN n ON n.r = d.r AND n.name = d.callee""")
def refreshed_calls(spark, sf):
    d = F.col("doc_id")
    text = lambda name: F.concat(F.lit("def "), name, (d % 500).cast("string"), F.lit("():\n    f"), (d * 7 % 500).cast("string"), F.lit("()\n"))
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("repository_id"), F.lit("s").alias("snapshot_id"), F.concat(F.lit("src/d"), d.cast("string"), F.lit(".py")).alias("relative_path"))
    rules, touched, path = {"source.symbol", "source.call"}, d % 11 == 0, field("value_json", "source_path")
    read = lambda rows, name: cut(extract.facts_of(extract.extract(rows.withColumn("text", text(F.lit(name))), rules)))
    base = cut(architecture.resolve_facts(read(docs, "f"), docs))
    stale = F.regexp_extract(path, r"(\d+)[.]py$", 1).cast("long") % 11 == 0
    told, _ = architecture.resolve_changes(cut(base.filter(~stale)), cut(base.filter(stale)), read(docs.filter(touched), "g"), docs, docs.select("repository_id", "relative_path").limit(0))
    return told.filter("kind = 'symbol_call'").select("component_id", *(field("value_json", n).alias(n) for n in ("source_path", "target_path", "resolution")))


@register("""SELECT event_id, '{"a":{"password":"[REDACTED]","list":["token=[REDACTED]","plain' || event_id || '"],"secret":"[REDACTED]"},"note":"call(x, password=[REDACTED]","n":' || event_id || '}' AS value_json FROM events""")
def nested_redaction(spark, sf):
    from ..sources.ship import ship

    ship(spark)
    id_ = F.col("event_id").cast("string")
    value = F.concat(F.lit('{"a":{"password":'), id_, F.lit(',"list":["token=x'), id_, F.lit('","plain'), id_, F.lit('"],"secret":{"z":['), id_, F.lit(']}},"note":"call(x, password=hunter'), id_, F.lit(')","n":'), id_, F.lit("}"))
    return V.table(spark, sf, "events").select("event_id", T.redact_json(value).alias("value_json"))


# --- more joins and selections --------------------------------------------------------------------------------------


@register(f"""WITH {FACTS_SQL} SELECT id AS fact_id, CASE WHEN k % 10 < 5 THEN 'component:' || (k % 10) END AS node, CASE WHEN k % 10 < 5 THEN 'supported' ELSE 'unresolved' END AS status FROM facts WHERE kind = 'http_client_call'""")
def client_base_edges(spark, sf):
    own = V.events(spark, sf)
    rows = own.filter("kind = 'http_client_call'").select("id", F.lit("http_client_base").alias("kind"), "component_id", F.to_json(F.struct(F.concat(F.lit("HTTPS://N"), (F.col("k") % 10).cast("string"), F.lit(".example.com/x")).alias("base_url"))).alias("value_json"), F.array("id").alias("evidence_ids"), F.lit("r").alias("rule_id"))
    repositories = spark.createDataFrame([(str(i),) for i in range(5)], "repository_id string")
    known = graph.resolve_aliases(graph.aliases_of(spark, {f"https://n{i}.example.com": str(i) for i in range(5)}), repositories)
    edges = graph.build_edges(rows, known)
    return edges.select(F.element_at("fact_ids", 1).alias("fact_id"), F.when(F.col("target_type") == "component", F.col("to")).alias("node"), "status")


@register(f"""WITH {FACTS_SQL}, ep AS (SELECT * FROM facts WHERE kind = 'http_endpoint'), m AS (SELECT DISTINCT component_id, k FROM facts WHERE kind = 'data_write' AND k % 3 = 0)
SELECT ep.id, CASE WHEN event_id % 2 = 0 OR m.k IS NULL THEN path ELSE '/m' || m.k || path END AS path, CASE WHEN event_id % 2 = 0 THEN 'ruta completa' WHEN m.k IS NULL THEN 'fragmento; montaje no resuelto' ELSE 'ruta compuesta estáticamente' END AS status FROM ep LEFT JOIN m ON m.component_id = ep.component_id AND m.k = ep.k AND event_id % 2 = 1""")
def endpoint_status(spark, sf):
    own = V.events(spark, sf)
    k = F.col("k").cast("string")
    ends = own.filter("kind = 'http_endpoint'").select("id", "component_id", "method", "path", F.lit("h").alias("handler"), F.concat(F.lit("src/users"), k, F.lit(".routes.ts")).alias("source_path"), (F.col("event_id") % 2 == 0).alias("whole"))
    mounts = own.filter("kind = 'data_write' and k % 3 = 0").select("component_id", F.concat(F.lit("/m"), k).alias("path"), F.concat(F.lit("Users_"), k, F.lit("Router")).alias("symbol"), F.lit("src/app.ts").alias("source_path")).distinct()
    none = spark.createDataFrame([], "component_id string, source_path string, target_path string, symbols array<string>")
    return resolve.resolve_endpoints(ends, mounts, none).select("id", "path", "status")


@register("""SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0 OR o_orderpriority LIKE '1%'""")
def reached_resources(spark, sf):
    o = V.table(spark, sf, "orders")
    facts = o.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "entry").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("source_path"))
    symbols = o.select(F.col("o_custkey").alias("symbol_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_path")).distinct()
    reached = symbols.filter("symbol_id % 7 = 0").select(F.col("symbol_id").alias("node"))
    return traverse.flow_resources(reached, symbols, facts, spark.createDataFrame([("entry",)], "path string")).select("o_orderkey")


@register("""SELECT DISTINCT user_id AS f, event_type AS t FROM events WHERE user_id % 9 = 0 OR event_type = 'error'""")
def related_links(spark, sf):
    links = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("from"), F.col("event_type").alias("to"), F.lit("x").alias("type")).distinct()
    chosen = V.table(spark, sf, "events").filter("user_id % 9 = 0").select(F.col("user_id").cast("string").alias("id")).distinct()
    return impact.related_links(links, chosen, spark.createDataFrame([("error",)], "id string")).select(F.col("from").cast("long").alias("f"), F.col("to").alias("t"))


@register("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 11 = 0""")
def selected_context(spark, sf):
    own = V.table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))
    return contracts.select_context(own, own.filter("c_custkey % 11 = 0").select("id")).select("c_custkey", "c_name")


@register("""SELECT source AS candidate_id, sha256('{' || string_agg('"' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '":"' || sha256(text) || '"', ',' ORDER BY lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) || '}') AS digest FROM documents GROUP BY 1""")
def candidate_digests(spark, sf):
    own = V.table(spark, sf, "documents").select(F.col("source").alias("candidate_id"), F.concat_ws("/", "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return contracts.candidate_digest(own)


@register("""SELECT event_id FROM events WHERE user_id % 10 = 0 OR event_id % 25 = 0 OR user_id % 7 = 1""")
def investigated_facts(spark, sf):
    own = V.table(spark, sf, "events")
    path = lambda n: F.concat(F.lit("p"), (F.col("user_id") % n).cast("string"))
    facts = own.select("event_id", F.col("event_id").alias("id"), path(10).alias("source_path"), F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("target_path"), F.array("event_id").alias("evidence_ids"))
    return impact.investigation_facts(facts, spark.createDataFrame([("p0",), ("q1",)], "path string"), own.filter("event_id % 25 = 0").select(F.col("event_id").alias("id"))).select("event_id")


@register("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '_workspace' ELSE source END AS repository_id, CASE WHEN doc_id % 4 = 3 THEN 'workspace' ELSE lang END AS ref, CASE doc_id % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'flow' WHEN 2 THEN 'class' ELSE 'map' END AS document_type FROM documents""")
def document_identities(spark, sf):
    d = F.col("doc_id")
    file = F.when(d % 4 == 0, "servicio.md").when(d % 4 == 1, F.concat(F.lit("flujos/"), d.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("clases/"), d.cast("string"), F.lit(".md")))
    path = F.when(d % 4 == 3, F.concat(F.lit("Mapas/"), d.cast("string"), F.lit(".md"))).otherwise(F.concat_ws("/", F.lit("Servicios"), "source", "lang", file))
    return V.table(spark, sf, "documents").select("doc_id", path.alias("path")).select("doc_id", *(c.alias(n) for n, c in C.document_identity(F.col("path")).items()))


@register(f"""WITH {FACTS_SQL} SELECT component_id, 'in' AS direction, method || ' ' || path AS label, NULL AS target FROM facts WHERE kind = 'http_endpoint' UNION ALL SELECT component_id, 'screen', 'S' || k, NULL FROM facts WHERE kind = 'data_write' UNION ALL SELECT component_id, 'out', path, CASE WHEN k % 2 = 0 THEN 'component:x' END FROM facts WHERE kind = 'http_client_call'""")
def flow_points(spark, sf):
    own = V.events(spark, sf)
    facts = own.filter("kind in ('data_write', 'http_client_call')").select("id", F.when(F.col("kind") == "data_write", "ui_component").otherwise(F.col("kind")).alias("kind"), "component_id", F.to_json(F.struct(F.when(F.col("kind") == "data_write", F.concat(F.lit("S"), F.col("k").cast("string"))).alias("name"), F.when(F.col("kind") == "http_client_call", F.col("path")).alias("path_expression"))).alias("value_json"))
    edges = own.filter("kind = 'http_client_call' and k % 2 = 0").select(F.array("id").alias("fact_ids"), F.lit("component:x").alias("to"))
    return summaries.flow_points(own.filter("kind = 'http_endpoint'").select("component_id", "method", "path"), facts, edges)


@register("""WITH s AS (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS systems FROM customer GROUP BY 1), m AS (SELECT count(DISTINCT c_mktsegment) AS systems, bool_or(c_custkey % 2 = 0) AS flow FROM customer WHERE c_custkey < 40)
SELECT CASE WHEN flow THEN 0 ELSE 1 END + 1 + CASE WHEN systems < 2 THEN 1 ELSE 0 END AS lacks, flow AS has_flow FROM m""")
def missing_information(spark, sf):
    own = V.table(spark, sf, "customer").filter("c_custkey < 40")
    none = F.array().cast("array<string>")
    even = F.col("c_custkey") % 2 == 0
    selected = own.select(F.when(even, "flow:steps").otherwise("class:summary").alias("section_type"), F.when(even, "flow").otherwise("class").alias("document_type"), none.alias("roles"), none.alias("source_paths"), F.col("c_mktsegment").alias("repository_id"))
    return context.missing_information(selected, "migration").select(F.size("missing").alias("lacks"), "has_flow")


@register("""SELECT c_custkey, CAST(10 * (c_custkey % 2) + 8 * CAST(c_custkey % 3 = 0 AS INTEGER) + 2 + CAST(c_custkey % 5 = 0 AS INTEGER) + CASE c_custkey % 4 WHEN 0 THEN 300 WHEN 1 THEN 260 WHEN 2 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 13 = 0 THEN 1000 ELSE 0 END + 15 * CAST(c_custkey % 7 = 0 AS INTEGER) AS INTEGER) AS priority FROM customer""")
def context_priorities(spark, sf):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = V.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 2 == 1, "x:call").otherwise("x:summary").alias("section_type"), none.alias("roles"), none.alias("source_paths"), F.when(k % 7 == 0, "Billing page").otherwise("Page").alias("heading"), F.lit("d.md").alias("document_path"),
        F.when(k % 3 == 0, F.struct(F.lit("GET").alias("method"), F.lit("/x").alias("path"))).alias("endpoint"), F.lit("r").alias("repository_id"), F.when(k % 5 == 0, F.array(F.lit("ev-1"))).otherwise(none).alias("evidence_ids"),
        F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).when(k % 4 == 2, 8).alias("distance"), (k % 13 == 0).alias("seed"),
    )
    return rows.select("c_custkey", context.contextual_priority("impact", "billing").cast("int").alias("priority"))


@register("""WITH r AS (SELECT o_custkey, max(o_orderkey) AS run FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), q AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 = 0) SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(count(o_orderkey) AS INTEGER) AS facts FROM (
SELECT o.o_custkey, o.o_orderkey FROM r JOIN orders o ON o.o_custkey = r.o_custkey AND o.o_orderkey = r.run WHERE r.o_custkey NOT IN (SELECT o_custkey FROM q) UNION ALL SELECT o_custkey, NULL FROM q) GROUP BY 1""")
def composed_workspace(spark, sf):
    from . import engine

    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("repository_id"), F.col("o_orderkey").alias("run_id"))
    facts = o.select("repository_id", "run_id", F.concat(F.lit("f"), F.col("run_id").cast("string")).alias("id"), F.lit("technology").alias("kind"), F.col("repository_id").alias("component_id"), F.lit("{}").alias("value_json"), F.array().cast("array<string>").alias("evidence_ids"), F.lit("r").alias("rule_id"))
    asked = o.filter("cast(repository_id as long) % 10 = 0").select("repository_id", F.lit(-1).cast("long").alias("run_id")).distinct()
    nodes, _ = engine.compose(spark, facts, o.filter("run_id % 2 = 0"), asked)
    return nodes.filter("type = 'component'").select("label", F.size("fact_ids").alias("facts"))


@register("""SELECT 'component:' || n_name AS node FROM nation WHERE n_nationkey = 3""")
def node_of_a_name(spark, sf):
    nodes = V.table(spark, sf, "nation").select(F.concat(F.lit("component:"), "n_name").alias("id"), F.col("n_name").alias("label"))
    name = V.table(spark, sf, "nation").filter("n_nationkey = 3").first()["n_name"]
    return spark.createDataFrame([(graph.resolve_node(nodes, f" {name.lower()} "),)], "node string")


@register("""SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE WHEN c_custkey % 50 = 0 THEN 0 WHEN c_custkey % 3 = 1 AND n <= 1 THEN 1 WHEN c_custkey % 3 = 2 AND n <= 2 THEN 5 ELSE 99 END, c_custkey) AS INTEGER) AS place FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS n FROM customer WHERE c_custkey <= 1000)""")
def structural_places(spark, sf):
    k = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").filter("c_custkey <= 1000").select("c_custkey", k.cast("int").alias("place"), F.when(k % 3 == 1, "class UserRouter").when(k % 3 == 2, "class UserMapper").otherwise("Summary").alias("heading"), (k % 50 == 0).alias("seed"))
    return context.structural_first(rows, "place").select("c_custkey", "place")


@register("""WITH d AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) SELECT 'n' || id AS id, 'N ' || id AS name, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS repositories, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS owners, CASE WHEN id % 4 = 0 THEN 'supported' END AS moved FROM d""")
def capability_overrides(spark, sf):
    ids = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).distinct()
    none = F.array().cast("array<string>")
    id_ = F.concat(F.lit("n"), F.col("n").cast("string")).alias("id")
    duty = "array<struct<repository_id:string,role:string,basis:string,evidence_ids:array<string>>>"
    caps = ids.select(id_, F.concat(F.lit("N "), F.col("n").cast("string")).alias("name"), none.alias("aliases"), F.array(F.lit("r")).alias("repositories"), none.alias("entrypoints"), none.alias("flows"), F.array().cast(duty).alias("responsibilities"), F.array().cast("array<struct<from:string,to:string,status:string>>").alias("legacy_dependencies"), none.alias("contracts"), none.alias("data_resources"), none.alias("document_chunk_ids"), none.alias("evidence_ids"), F.lit("low").alias("confidence"))
    configured = ids.filter("n % 2 = 0").select(id_, F.lit(None).cast("string").alias("label"), none.alias("aliases"), F.array(F.lit("r"), F.lit("s")).alias("systems"))
    got = capability.with_overrides(caps, configured, ids.filter("n % 3 = 0").select(id_, F.lit("business_owner").alias("role"), F.lit("r").alias("repository_id")), ids.filter("n % 4 = 0").select(id_, F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit("complete").alias("status")))
    return got.select("id", "name", F.size("repositories").alias("repositories"), F.coalesce(F.size("responsibilities"), F.lit(0)).alias("owners"), F.get("legacy_dependencies", F.lit(0))["status"].alias("moved"))


@register("""SELECT 'd' || c_custkey || '.md' AS path, CAST(p + 1 AS INTEGER) AS part, CAST(82 AS INTEGER) AS bytes FROM customer, range(5) AS r(p) WHERE p < 1 + c_custkey % 5""")
def split_sections(spark, sf):
    # pairs of paragraphs of 40 characters fit in 100 bytes, so 2 + 2 * (k % 5) paragraphs are 1 + k % 5 parts
    k = F.col("c_custkey")
    paragraphs = F.array_join(F.array_repeat(F.repeat(F.lit("x"), F.lit(40)), (2 + 2 * (k % 5)).cast("int")), "\n\n")
    docs = V.table(spark, sf, "customer").select(F.concat(F.lit("d"), k.cast("string"), F.lit(".md")).alias("path"), F.lit(1).alias("section"), F.lit("H").alias("heading"), paragraphs.alias("content"))
    return C.split_sections(docs, 100).select("path", F.col("part").cast("int").alias("part"), F.octet_length("content").alias("bytes"))


@register("""SELECT 'd' || c_custkey || '.md' AS document_path, c_custkey % 3 <> 0 AS reused FROM customer""")
def reused_chunks(spark, sf):
    k = F.col("c_custkey")
    docs = lambda end: V.table(spark, sf, "customer").select(F.concat(F.lit("d"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# T\n\ntext "), "c_name", F.when(k % 3 == 0, end).otherwise("")).alias("content"))
    before = cut(C.build_chunks(docs("a"), "one"))
    return C.build_chunks(docs("b"), "two", previous=before).select("document_path", "reused")


@register("""SELECT count(DISTINCT c_mktsegment) AS repositories, 3 AS consumers, 3 AS synchronous_dependencies, 2 AS messages, 1 AS data_resources, 1 AS unresolved_relations FROM customer WHERE c_custkey < 500""")
def impact_dimensions(spark, sf):
    own = V.table(spark, sf, "customer").filter("c_custkey < 500")
    chunks = own.select(F.col("c_mktsegment").alias("repository_id"), F.array(F.lit("src/UserRepository.java")).alias("source_paths"), F.array(F.col("c_name")).alias("evidence_ids"))
    rows = [("component:x", "calls_http", "supported"), ("component:y", "calls_http", "candidate"), ("component:BUILDING", "calls_http", "supported"), ("component:z", "publishes_to", "supported"), ("component:z", "consumes_from", "supported")]
    got = impact.analyse(spark.createDataFrame(rows, "`from` string, type string, status string"), chunks)
    return got.select(*(F.col(c).cast("long").alias(c) for c in ("repositories", "consumers", "synchronous_dependencies", "messages", "data_resources", "unresolved_relations")))


@register(f"""WITH {FACTS_SQL}, l AS (SELECT DISTINCT component_id, kind, path FROM facts WHERE kind IN ('data_write', 'http_endpoint')) SELECT 'symbol:' || component_id || ':' || path AS f, CASE kind WHEN 'data_write' THEN 'writes_to' ELSE 'exposes' END AS type, count(*) AS n FROM l GROUP BY 1, 2""")
def link_graph(spark, sf):
    own = V.events(spark, sf).filter("kind in ('data_write', 'http_endpoint')")
    value = F.to_json(F.struct(F.col("path").alias("source_path"), F.lit("t").alias("entity")))
    facts = own.select("id", "kind", "component_id", value.alias("value_json"), F.array("id").alias("evidence_ids"), F.lit("r").alias("rule_id"))
    none = C.build_chunks(spark.createDataFrame([], "path string, content string"), "run")
    links = C.build_links(none, facts)
    return links.groupBy(F.col("from").alias("f"), "type").agg(F.count(F.lit(1)).alias("n"))


#: One example for each rule: the file, its text around a key, and the field of the value that holds the key.
EXAMPLES = (
    ("express.route", "a.js", "router.get('/x{}', (q, s) => s.send(1));", "path", "/x{}"), ("express.mount", "a.js", "app.use('/m{}', r)", "path", "/m{}"), ("node.fetch.static", "a.js", "fetch('/f{}')", "path_expression", "/f{}"),
    ("node.fetch.symbolic", "a.js", "fetch(url{})", "path_expression", "url{}"), ("supabase.entity", "a.js", "sb.from('t{}')", "entity", "t{}"), ("supabase.read", "a.js", "sb.from('t{}').select('*')", "resource", "t{}"),
    ("supabase.write", "a.js", "sb.from('t{}').insert(x)", "resource", "t{}"), ("python.flask.route", "a.py", "@bp.route('/f{}', methods=['GET'])", "path", "/f{}"), ("python.django.path", "urls.py", "path('d{}', v.h)", "path", "/d{}"),
    ("python.httpx.base_url", "a.py", "httpx.Client(base_url='http://h{}')", "base_url", "http://h{}"), ("python.http.client_call", "a.py", "c.get('/c{}')", "path_expression", "/c{}"), ("python.manifest.dependency", "requirements.txt", "pkg{}==1", "package", "pkg{}"),
    ("dotnet.controller.route", "A.cs", "[HttpGet('r{}')]", "path", "r{}"), ("dotnet.controller.prefix", "A.cs", "[Route('p{}')]", "path", "p{}"), ("dotnet.minimal.api", "A.cs", "app.MapGet('/a{}', f)", "path", "/a{}"),
    ("dotnet.httpclient.base", "A.cs", "BaseAddress = new Uri('http://b{}')", "base_url", "http://b{}"), ("dotnet.ef.dbset", "A.cs", "DbSet<E{}> Items", "entity", "E{}"), ("dotnet.csproj.package", "a.csproj", "<PackageReference Include='P{}' Version='1'", "package", "P{}"),
    ("angular.route", "r.ts", "{ path: 'a{}', component: C }".replace("{ ", "{{ ").replace(" }", " }}"), "path", "a{}"), ("angular.httpclient", "s.ts", "this.http.get('/h{}')", "path_expression", "/h{}"),
    ("angular.environment", "environment.ts", "apiUrl: 'http://e{}'", "base_url", "http://e{}"), ("react.router.route", "r.tsx", "<Route path='/r{}'", "path", "/r{}"), ("react.fetch", "r.tsx", "fetch('/g{}')", "path_expression", "/g{}"),
    ("react.axios", "r.jsx", "axios.get('/x{}')", "path_expression", "/x{}"), ("jee.jaxrs.path", "A.java", "@GET @Path('/j{}')", "path", "/j{}"), ("jee.ejb", "A.java", "@Stateless class B{} ", "name", "B{}"),
    ("jee.jms.destination", "A.java", "destinationLookup = 'q{}'", "destination", "q{}"), ("jee.jndi", "a.xml", "<jndi-name>n{}</jndi-name>", "name", "n{}"), ("jee.module", "web.xml", "<context-root>c{}</context-root>", "value", "c{}"),
    ("spring.feign.client", "A.java", "@FeignClient('f{}')", "base_url", "f{}"), ("spring.jpa.entity", "A.java", "@Entity class E{} ", "entity", "E{}"), ("spring.kafka.listener", "A.java", "@KafkaListener(topics = 't{}')", "topic", "t{}"),
    ("spring.pom.dependency", "pom.xml", "<dependency><groupId>g</groupId><artifactId>a{}</artifactId></dependency>", "package", "g:a{}"), ("webflux.webclient", "A.java", "c.get().uri(u{})", "uri_expression", "u{}"),
)
_RULES_SQL = ", ".join(f"({i}, '{rule}', '{value.replace('{}', '|')}')" for i, (rule, _, _, _, value) in enumerate(EXAMPLES))


@register(f"""WITH r(i, rule_id, value) AS (VALUES {_RULES_SQL}), e AS (SELECT DISTINCT event_id % 200 AS k FROM events) SELECT rule_id, replace(value, '|', CAST(k AS VARCHAR)) AS value FROM e JOIN r ON r.i = k % {len(EXAMPLES)}""")
def rule_examples(spark, sf):
    known = spark.createDataFrame([(i, rule, path, *(text if "{{" not in text else text.replace("{{", "\u0002").replace("}}", "\u0003")).split("{}"), name) for i, (rule, path, text, name, _) in enumerate(EXAMPLES)], "i int, rule string, file string, head string, tail string, name string")
    keys = V.table(spark, sf, "events").select((F.col("event_id") % 200).alias("k")).distinct()
    own = keys.join(F.broadcast(known), F.col("k") % len(EXAMPLES) == F.col("i"))
    text = F.translate(F.concat("head", F.col("k").cast("string"), "tail"), "\u0002\u0003", "{}")
    files = own.select(F.lit("r").alias("repository_id"), F.lit("s").alias("snapshot_id"), F.concat(F.col("k").cast("string"), F.lit("/"), "file").alias("relative_path"), text.alias("text"))
    found = extract.extract(files, {e[0] for e in EXAMPLES}).join(F.broadcast(known.select(F.col("rule").alias("rule_id"), "i", "name")), "rule_id")
    mine = found.filter(F.element_at(F.split("relative_path", "/"), 1).cast("int") % len(EXAMPLES) == F.col("i"))
    value = F.coalesce(*(F.when(F.col("name") == n, field("value_json", n)) for n in sorted({e[3] for e in EXAMPLES})))
    return mine.select("rule_id", value.alias("value"))


# --- composed answers -----------------------------------------------------------------------------------------------


@register(f"""WITH RECURSIVE {PLACES_SQL}, s AS (SELECT 'order:' || o_orderkey AS start FROM orders WHERE o_orderstatus = 'P'), w AS (
  SELECT s.start, p.f, p.t, 0 AS depth FROM s JOIN places p ON p.f = s.start UNION ALL SELECT w.start, p.f, p.t, w.depth + 1 FROM w JOIN places p ON p.f = w.t WHERE w.depth < 1
) SELECT start, f, t, CAST(depth AS INTEGER) AS depth FROM w""")
def near_module_edges(spark, sf):
    edges = V.places(spark, sf).withColumn("component_id", F.lit("c"))
    at = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    starts = V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(at.alias("start"), F.lit("c").alias("component_id"), at.alias("node"))
    return traverse.near_edges(edges, starts, max_depth=2).select("start", F.col("from").alias("f"), F.col("to").alias("t"), "depth")


@register(f"""WITH RECURSIVE {PLACES_SQL}, w(n, depth) AS (SELECT 'order:1', 0 UNION ALL SELECT t, depth + 1 FROM w JOIN places ON f = n WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1))
SELECT 'step' AS part, n AS name, CAST(depth AS INTEGER) AS depth FROM w WHERE depth > 0 OR EXISTS (SELECT 1 FROM places WHERE f = n)
UNION ALL SELECT 'data', 'table of ' || n, -1 FROM w WHERE n LIKE 'nation:%'""")
def explained_endpoint(spark, sf):
    """Orders, customers, nations and regions as symbols that call each other; nations read a table."""
    p = V.places(spark, sf)
    nodes = p.select(F.col("from").alias("n")).unionByName(p.select(F.col("to").alias("n"))).distinct()
    fact = lambda rows, key, kind, value: rows.select(
        F.concat(F.lit(f"{kind}-"), key).alias("id"), F.lit(kind).alias("kind"), F.lit("c").alias("component_id"), F.to_json(value).alias("value_json"), F.array().cast("array<string>").alias("evidence_ids"), F.lit("r").alias("rule_id")
    )
    file = F.concat(F.lit("src/"), "n")
    symbols = fact(nodes, F.col("n"), "code_symbol", F.struct(F.col("n").alias("symbol_id"), F.translate("n", ":", "_").alias("name"), file.alias("source_path")))
    calls = fact(p, F.concat("from", F.lit(">"), "to"), "symbol_call", F.struct(F.col("from").alias("caller_symbol_id"), F.col("to").alias("target_symbol_id"), F.lit("supported").alias("resolution")))
    data = fact(nodes.filter("n like 'nation:%'"), F.col("n"), "data_read", F.struct(F.concat(F.lit("table of "), "n").alias("entity"), file.alias("source_path")))
    one = spark.range(1).select(F.lit("e").alias("n"))
    end = fact(one, F.col("n"), "http_endpoint", F.struct(F.lit("GET").alias("method"), F.lit("/orders/").alias("path"), F.lit("(q, s) => ctl.order_1(q)").alias("handler_expression"), F.lit("src/app").alias("source_path")))
    told = answers.explain_endpoint(symbols.unionByName(calls).unionByName(data).unionByName(end), "c", "get", "/orders")
    steps = told["steps"].select(F.lit("step").alias("part"), F.col("symbol_id").alias("name"), "depth")
    return steps.unionByName(told["data"].select(F.lit("data").alias("part"), F.col("entity").alias("name"), F.lit(-1).alias("depth")))


@register(f"""WITH {FACTS_SQL}, ep AS (SELECT *, (CASE WHEN method = 'POST' THEN 8 ELSE 0 END) + (CASE WHEN '12' IN (CAST(k AS VARCHAR), CAST(user_id % 50 AS VARCHAR)) THEN 8 ELSE 0 END) AS score FROM facts WHERE kind = 'http_endpoint' AND component_id = '7')
SELECT path, method, CAST(score AS INTEGER) AS score FROM ep WHERE score > 0 ORDER BY score DESC, path, method LIMIT 20""")
def documentable_flows(spark, sf):
    return answers.find_flows(V.facts(spark, sf), "post 12", "7").select("path", "method", "score")


@register(f"""WITH {FACTS_SQL}, own AS (SELECT * FROM facts WHERE component_id = '7')
SELECT count(*) FILTER (kind = 'http_endpoint') AS endpoints, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE user_id % 40 = 7) AS relations, len(list(DISTINCT 'pkg-' || k % 20) FILTER (kind = 'package_dependency')) AS technologies FROM own""")
def explained_service(spark, sf):
    edges = V.table(spark, sf, "events").select((F.col("user_id") % 40).alias("c"), F.col("user_id"), "event_type").distinct().select(
        F.concat(F.lit("component:"), F.col("c").cast("string")).alias("from"), F.concat_ws("-", F.lit("node"), F.col("user_id").cast("string")).alias("to"), F.col("event_type").alias("type"), F.lit("supported").alias("status"), F.array().cast("array<string>").alias("limitations")
    )
    told = answers.explain_service(V.facts(spark, sf), edges, "7")["summary"]
    return told.select("endpoints", "relations", F.size("technologies").cast("long").alias("technologies"))


@register("""WITH d AS (SELECT doc_id, 'd' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.ts' ELSE '.java' END AS source_path, 'A' || (doc_id % 7) AS c FROM documents)
SELECT source_path, source_path || '#' || c || '.foo' AS caller, 'a' || (doc_id % 5) AS callee, 3 AS start_line FROM d UNION ALL SELECT source_path, source_path || '#' || c || '.bar', 'this.x.b' || (doc_id % 3), 6 FROM d
UNION ALL SELECT source_path, source_path || '#B.baz', 'c', 8 FROM d""")
def source_calls(spark, sf):
    """Whole texts of documents as comments and strings in code: each call goes to its true caller, whatever the texts hold."""
    d = F.col("doc_id").cast("string")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    text = F.coalesce("text", F.lit(""))
    block = F.regexp_replace(F.regexp_replace(text, "[*]/", "* /"), r"[\r\n]", " ")
    line = F.regexp_replace(text, r"[\r\n]", " ")
    quoted = F.regexp_replace(text, r"[\r\n\\\\\"]", " ")
    code = F.concat(
        F.lit("class A"), n(7), F.lit(" {\n/* "), block, F.lit(" */\nfoo() { // "), line, F.lit("\na"), n(5), F.lit("(\""), quoted, F.lit("\"); }\n// "), line,
        F.lit("\nbar(x) {\nthis.x.b"), n(3), F.lit("(); } }\nclass B { baz() { c('{'); } }\n"),
    )
    path = F.concat(F.lit("d"), d, F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise(".java"))
    files = V.table(spark, sf, "documents").select(F.lit("r").alias("repository_id"), F.lit("s").alias("snapshot_id"), path.alias("relative_path"), code.alias("text"))
    facts = cut(extract.extract(files, {"source.call", "source.symbol"}))
    value = lambda x: field("value_json", x)
    calls = facts.filter("rule_id = 'source.call'").select(value("source_path").alias("source_path"), value("caller_symbol_id").alias("caller"), value("expression").alias("callee"))
    lines = facts.filter("rule_id = 'source.symbol'").select(value("symbol_id").alias("caller"), value("start_line").cast("int").alias("start_line"))
    return calls.join(lines, "caller").select("source_path", "caller", "callee", "start_line")


@register("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS graph, l_partkey % 9 AS a, l_suppkey % 9 AS b FROM lineitem), r(graph, a, b) AS (SELECT * FROM e UNION SELECT r.graph, r.a, e.b FROM r JOIN e ON e.graph = r.graph AND e.a = r.b)
SELECT graph, bool_or(a = b) AS cyclic FROM r GROUP BY graph""")
def task_cycles(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    return traverse.cyclic_graphs(lines.select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 9).alias("from"), (F.col("l_suppkey") % 9).alias("to")))


@register("""WITH RECURSIVE op AS (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL), ps AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
sn AS (SELECT DISTINCT 's' || s_suppkey AS s, 'n' || s_nationkey AS n FROM supplier WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL), nr AS (SELECT DISTINCT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation WHERE n_nationkey IS NOT NULL AND n_regionkey IS NOT NULL),
-- ends of paths from a part over its suppliers, from a supplier over its parts' other suppliers (the first 20 and as many as may lead back to one part), and from a part over both
a AS (SELECT p, r, s, [p || '>' || s, s || '>' || n, n || '>' || r] AS ids, [p, s, n, r] AS nodes FROM ps JOIN sn USING (s) JOIN nr USING (n)),
c AS (SELECT ps.s, a.p, a.r, a.ids, a.nodes, row_number() OVER (PARTITION BY ps.s, a.r ORDER BY ps.s || '>' || a.p, a.ids) AS k, count(*) OVER (PARTITION BY ps.s, a.r, a.p) AS n FROM ps JOIN a USING (p) WHERE a.s <> ps.s),
b AS (SELECT s, p, r, ids, nodes, k FROM c QUALIFY k <= 20 + max(n) OVER (PARTITION BY s, r)),
t AS (SELECT p, r, 4 AS depth, ids, nodes, row_number() OVER (PARTITION BY p, r ORDER BY ids) AS k FROM a UNION ALL
SELECT ps.p, b.r, 6, [ps.p || '>' || b.s, b.s || '>' || b.p] || b.ids, [ps.p, b.s] || b.nodes, row_number() OVER (PARTITION BY ps.p, b.r ORDER BY ps.p || '>' || b.s, b.k) AS k FROM ps JOIN b USING (s) WHERE b.p <> ps.p QUALIFY k <= 20),
q AS (SELECT op.o, t.r, t.depth, [op.o || '>' || op.p] || t.ids AS ids, [op.o] || t.nodes AS nodes FROM op JOIN t USING (p) WHERE t.k <= 20 QUALIFY row_number() OVER (PARTITION BY op.o, t.r ORDER BY t.depth, op.o || '>' || op.p, t.k) <= 20),
-- where that makes fewer than 20, all longer ones are walked
few AS (SELECT o, r FROM (SELECT DISTINCT o FROM op) CROSS JOIN (SELECT DISTINCT r FROM a) EXCEPT SELECT o, r FROM q GROUP BY o, r HAVING count(*) = 20),
e AS (SELECT o AS a, p AS b FROM op UNION ALL SELECT p, s FROM ps UNION ALL SELECT s, p FROM ps UNION ALL SELECT s, n FROM sn UNION ALL SELECT n, r FROM nr),
u(o, node, nodes, ids) AS (SELECT DISTINCT o, o, [o], []::VARCHAR[] FROM few UNION ALL SELECT u.o, e.b, list_append(u.nodes, e.b), list_append(u.ids, e.a || '>' || e.b) FROM u JOIN e ON e.a = u.node WHERE len(u.ids) < 12 AND NOT list_contains(u.nodes, e.b)),
z AS (SELECT o, r, depth, ids, nodes FROM q UNION ALL SELECT u.o, few.r, len(u.ids), u.ids, u.nodes FROM u JOIN few ON few.o = u.o AND few.r = u.node WHERE len(u.ids) > 6)
SELECT CAST(depth AS INTEGER) AS depth, array_to_string(nodes, '|') AS nodes, array_to_string(ids, '|') AS edge_ids, 'supported' AS status FROM z QUALIFY row_number() OVER (PARTITION BY o, r ORDER BY depth, ids) <= 20""")
def flow_trace_of_orders(spark, sf):
    """From each order over its parts, their suppliers, those suppliers' parts and so on, to each region: the paths of a trace, for all of them."""
    name = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    w = V.table(spark, sf, "lineitem").select(name("l_orderkey", "o").alias("o"), name("l_partkey", "p").alias("p"), name("l_suppkey", "s").alias("s"))
    l = V.table(spark, sf, "supplier").select(name("s_suppkey", "s").alias("s"), name("s_nationkey", "n").alias("n"))  # noqa: E741
    a = V.table(spark, sf, "nation").select(name("n_nationkey", "n").alias("n"), name("n_regionkey", "r").alias("r"))
    parts = [w.select("o", "p"), w.select("p", "s"), w.select("s", "p"), l.select("s", "n"), a.select("n", "r")]
    edges = reduce(DataFrame.unionAll, (x.toDF("from", "to") for x in parts)).select(F.concat("from", F.lit(">"), "to").alias("id"), "from", "to", F.lit("supported").alias("status"))
    found = graph.trace_flows(edges, w.select(F.col("o").alias("node")), a.select(F.col("r").alias("node")))
    return found.select("depth", F.array_join("nodes", "|").alias("nodes"), F.array_join("edge_ids", "|").alias("edge_ids"), "status")
