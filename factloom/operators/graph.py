"""The correlated graph: identities, edges from facts, relations and flows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ids import field, stable_id
from ..functions.text import call_base, call_path, normalise_alias, normalise_path
from ..sources.storage import cut, small_side

UNKNOWN = "UNKNOWN"
STATUSES = ("supported", "candidate", "unresolved")
# What an edge says about its limits.
NO_ALIAS_BASE = "La base URL no tiene un alias explícito configurado."
BY_ROUTE = "La relación se correlacionó por método y ruta; el montaje del router no pudo confirmarse estáticamente."
AMBIGUOUS = "La ruta coincide con más de un componente y no existe un alias explícito configurado."
NO_TARGET = "La llamada no tiene un alias explícito configurado ni una ruta única coincidente."
NO_NAMESPACE = "Entorno o namespace no resuelto."
NO_NAME = "destino-no-resuelto"


def _none() -> Column:
    return F.array().cast("array<string>")


def resolve_aliases(aliases: DataFrame, repositories: DataFrame) -> DataFrame:
    """aliases (alias, target) against repositories (repository_id): (alias, node), node null where not exactly one
    component has the id or label."""
    components = repositories.select(F.concat(F.lit("component:"), "repository_id").alias("_id"), F.col("repository_id").alias("_label")).distinct()
    named = components.select("_id", F.explode(F.array("_id", "_label")).alias("target"))
    found = aliases.join(named, "target", "left").groupBy("alias").agg(F.count_distinct("_id").alias("n"), F.min("_id").alias("_id"))
    return found.select(normalise_alias(F.col("alias")).alias("alias"), F.when(F.col("n") == 1, F.col("_id")).alias("node"))


def endpoint_index(facts: DataFrame) -> DataFrame:
    """(component_id, method, path): endpoints as they are called; a fragment once for each mount of its component."""
    value = F.col("value_json")
    own = facts.filter(F.col("kind").isin("http_endpoint", "http_endpoint_fragment")).select(
        "component_id", "kind", field(value, "path").alias("path"), field(value, "route_scope").alias("scope"),
        F.upper(F.coalesce(field(value, "method"), F.lit(UNKNOWN))).alias("method"),
    ).filter("path <> ''")
    # a list of methods is one endpoint for each of them
    methods = F.coalesce(F.from_json("method", "array<string>"), F.array("method"))
    own = own.withColumn("method", F.explode(methods))
    mounts = facts.filter(F.col("kind") == "http_route_mount").select("component_id", field(value, "path").alias("mount")).filter("mount <> ''").distinct()
    whole = (F.col("kind") == "http_endpoint") | F.coalesce(F.col("scope") == "application", F.lit(False))
    bare = own.filter(whole).select("component_id", "method", "path")
    part = own.filter(~whole).join(mounts, "component_id", "left").select("component_id", "method", F.concat_ws("/", "mount", "path").alias("path"))
    return bare.unionByName(part).select("component_id", "method", normalise_path(F.col("path")).alias("path")).distinct()


def match_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """calls (id, component_id, method, path): (id, targets, target): how many other components have an endpoint of the path whose
    method is the call's, or where either is unknown, and the one if it is one. Endpoints are reduced for each (path, method) that
    is called, to a count and the ends of the order, so that the calls of a common path meet one row each."""
    other = index.select(F.col("component_id").alias("_target"), F.col("method").alias("_method"), "path")
    fits = (F.col("method") == UNKNOWN) | (F.col("_method") == UNKNOWN) | (F.col("method") == F.col("_method"))
    met = cut(calls.select("path", "method").distinct().join(other, "path").filter(fits).select("path", "method", F.col("_target").alias("component_id")).distinct())
    ends = small_side(cut(met.groupBy("path", "method").agg(F.count(F.lit(1)).alias("_n"), F.min("component_id").alias("_low"), F.max("component_id").alias("_high"))))
    both = calls.join(ends, ["path", "method"]).join(met.withColumn("_own", F.lit(1)), ["path", "method", "component_id"], "left")
    targets = F.col("_n") - F.coalesce("_own", F.lit(0))
    target = F.when(F.col("_low") == F.col("component_id"), F.col("_high")).otherwise(F.col("_low"))
    return both.select("id", targets.alias("targets"), F.when(targets == 1, target).alias("target")).filter("targets > 0")


def build_edges(facts: DataFrame, aliases: DataFrame, scenario_id: str = "scenario", environment: str | None = None) -> DataFrame:
    """Edges of facts. aliases: of resolve_aliases(). Beside the columns of an edge, target_type and target_label name the node."""
    known = aliases.filter("node is not null").select("alias", "node")
    value = F.col("value_json")
    env = F.lit(environment).cast("string")
    base = facts.withColumn("from_", F.concat(F.lit("component:"), "component_id"))
    external = lambda label: stable_id("node", F.lit("external_service"), label)

    bases = base.filter(F.col("kind") == "http_client_base").withColumn("alias", normalise_alias(F.coalesce(field(value, "base_url"), F.lit("")))).join(known, "alias", "left")
    hit = F.col("node").isNotNull()
    of_bases = bases.select(
        "id", "from_", F.coalesce("node", external(F.col("alias"))).alias("to_"), F.lit("calls_http").alias("type"), F.when(hit, "supported").otherwise("unresolved").alias("status"),
        F.when(hit, _none()).otherwise(F.array(F.lit(NO_ALIAS_BASE))).alias("limitations"), "evidence_ids",
        F.when(hit, "component").otherwise("external_service").alias("target_type"), F.when(hit, F.col("node")).otherwise(F.regexp_replace("alias", "^$", NO_NAME)).alias("target_label"),
    )

    raw = F.coalesce(field(value, "path_expression", "uri_expression"), F.lit(""))
    calls = base.filter(F.col("kind") == "http_client_call").select(
        "id", "component_id", "from_", "evidence_ids", raw.alias("raw"), normalise_alias(call_base(raw)).alias("alias"), call_path(raw).alias("path"),
        F.upper(F.coalesce(field(value, "method"), F.lit(UNKNOWN))).alias("method"),
    ).join(known, "alias", "left")
    matched = match_calls(calls.filter("node is null and path is not null").select("id", "component_id", "method", "path"), endpoint_index(facts))
    calls = calls.join(matched, "id", "left")
    one = F.coalesce(F.col("targets") == 1, F.lit(False))
    label = F.regexp_replace(normalise_alias(F.coalesce("alias", "raw")), "^$", NO_NAME)
    of_calls = calls.select(
        "id", "from_", F.coalesce("node", F.when(one, F.concat(F.lit("component:"), "target")), external(label)).alias("to_"), F.lit("calls_http").alias("type"),
        F.when(hit, "supported").when(one, "candidate").otherwise("unresolved").alias("status"),
        F.when(hit, _none()).when(one, F.array(F.lit(BY_ROUTE))).when(F.col("targets") > 1, F.array(F.lit(AMBIGUOUS))).otherwise(F.array(F.lit(NO_TARGET))).alias("limitations"), "evidence_ids",
        F.when(hit | one, "component").otherwise("external_service").alias("target_type"), F.when(hit, F.col("node")).when(one, F.col("target")).otherwise(label).alias("target_label"),
    )

    topic = F.coalesce(field(value, "topic", "destination"), F.lit("unknown"))
    space = F.coalesce(field(value, "environment"), env)
    resource = stable_id("node", F.lit("message_resource"), space, topic)
    sends = F.col("kind") == "message_producer"
    of_messages = base.filter(F.col("kind").isin("message_producer", "message_consumer")).select(
        "id", F.when(sends, F.col("from_")).otherwise(resource).alias("from_"), F.when(sends, resource).otherwise(F.col("from_")).alias("to_"),
        F.when(sends, "publishes_to").otherwise("consumes_from").alias("type"), F.when(F.coalesce(space, F.lit("")) != "", "supported").otherwise("candidate").alias("status"),
        F.when(F.coalesce(space, F.lit("")) != "", _none()).otherwise(F.array(F.lit(NO_NAMESPACE))).alias("limitations"), "evidence_ids", F.lit("message_resource").alias("target_type"), topic.alias("target_label"),
    )

    name = F.coalesce(field(value, "resource", "entity", "package"), F.lit("unknown"))
    package = F.col("kind") == "package_dependency"
    kind = F.when(package, "package").otherwise("data_resource")
    of_resources = base.filter(F.col("kind").isin("data_read", "data_write", "package_dependency")).select(
        "id", "from_", stable_id("node", kind, env, name).alias("to_"), F.when(package, "depends_on_package").when(F.col("kind") == "data_read", "reads_data").otherwise("writes_data").alias("type"),
        F.lit("supported").alias("status"), _none().alias("limitations"), "evidence_ids", kind.alias("target_type"), name.alias("target_label"),
    )

    every = reduce(DataFrame.unionByName, (of_bases, of_calls, of_messages, of_resources))
    return every.select(
        stable_id("edge", F.lit(scenario_id), F.col("from_"), F.col("to_"), F.col("type"), F.col("id")).alias("id"), F.col("from_").alias("from"), F.col("to_").alias("to"), "type", env.alias("environment"),
        F.lit(scenario_id).alias("scenario_id"), "status", F.array("id").alias("fact_ids"), "evidence_ids", F.concat(F.lit("graph."), "type", F.lit(".v1")).alias("rule_id"), "limitations", "target_type", "target_label",
    )


def build_nodes(facts: DataFrame, repositories: DataFrame, edges: DataFrame, environment: str | None = None) -> DataFrame:
    """Components, the resources that facts declare, and the ends that edges have made."""
    env = F.lit(environment).cast("string")
    ids = facts.groupBy("component_id").agg(F.array_sort(F.collect_list("id")).alias("fact_ids"))
    components = repositories.select("repository_id").distinct().join(ids, F.col("repository_id") == F.col("component_id"), "left").select(
        F.concat(F.lit("component:"), "repository_id").alias("id"), F.lit("component").alias("type"), F.col("repository_id").alias("label"), env.alias("environment"), F.coalesce("fact_ids", _none()).alias("fact_ids")
    )
    end = F.when(F.col("type") == "consumes_from", F.col("from")).otherwise(F.col("to"))
    made = edges.filter(F.col("target_type") != "component").select(end.alias("id"), F.col("target_type").alias("type"), F.col("target_label").alias("label"), "environment", F.explode("fact_ids").alias("f"))
    value = F.col("value_json")
    kind = F.when(F.col("kind") == "message_resource", "message_resource").when(F.col("kind") == "data_resource", "data_resource").otherwise("package")
    label = F.coalesce(field(value, "topic", "destination", "resource", "package"), F.lit("unknown"))
    space = F.coalesce(field(value, "environment"), env)
    told = facts.filter(F.col("kind").isin("message_resource", "data_resource", "package_dependency")).select(stable_id("node", kind, space, label).alias("id"), kind.alias("type"), label.alias("label"), space.alias("environment"), F.col("id").alias("f"))
    rest = made.unionByName(told).groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"), F.min("environment").alias("environment"), F.array_sort(F.collect_set("f")).alias("fact_ids"))
    return components.unionByName(rest.join(components.select("id"), "id", "left_anti"))


def resolve_node(nodes: DataFrame, name: str) -> str | None:
    """The id of the node that a name means: its id, then component:name, then its label, whatever the case."""
    wanted = name.strip().lower()
    rank = F.when(F.lower("id") == wanted, 1).when(F.lower("id") == f"component:{wanted}", 2).when(F.lower("label") == wanted, 3)
    row = nodes.select("id", rank.alias("rank")).filter("rank is not null").orderBy("rank", "id").first()
    return row["id"] if row else None


def relations(edges: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """The edges at a node, or at both."""
    at = lambda n: (F.col("from") == n) | (F.col("to") == n)
    for n in (source, target):
        edges = edges if n is None else edges.filter(at(n))
    return edges


def worst_status(status: str = "status") -> Column:
    """The worst of a group's statuses; unresolved if there is none."""
    rank = F.max(F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status)))
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(rank, F.lit(len(STATUSES))).cast("int"))


def _paths(hop: DataFrame, near: DataFrame, source: str, target: str, max_depth: int, most: int, width: int) -> DataFrame | None:
    """The first `most` simple paths with `width` partial ones a hop and depth; None if that many don't decide."""
    now = hop.sparkSession.createDataFrame([(source, [source], [], [])], "node string, nodes array<string>, edge_ids array<string>, statuses array<string>")
    found, counts, dropped = [], {}, set()
    for depth in range(1, max_depth + 1):
        step = hop.join(F.broadcast(now), F.col("node") == F.col("_f")).filter(~F.array_contains("nodes", F.col("_t"))).join(near, "_t", "left")
        step = step.withColumn("least", F.when(F.col("_t") == target, depth).otherwise(F.col("d") + depth)).filter(F.col("least") <= max_depth)
        step = step.select(F.col("_t").alias("node"), F.array_append("nodes", F.col("_t")).alias("nodes"), F.array_append("edge_ids", F.col("_e")).alias("edge_ids"), F.array_append("statuses", F.col("_s")).alias("statuses"), "least")
        place = F.row_number().over(Window.partitionBy("goal").orderBy("edge_ids"))
        on = step.filter(F.col("node") != target).withColumn("goal", F.explode(F.sequence("least", F.lit(max_depth)))).withColumn("n", place).filter(F.col("n") <= width + 1)
        table = cut(on.unionByName(step.filter(F.col("node") == target).withColumns({"goal": F.lit(depth), "n": F.lit(0)})))
        told = table.agg(F.count_if(F.col("n") == 0).alias("there"), F.count(F.lit(1)).alias("all"), F.collect_set(F.when(F.col("n") > width, F.col("goal"))).alias("dropped")).first()
        found.append(table.filter("n = 0").select("nodes", "edge_ids", "statuses", F.lit(depth).alias("depth")))
        counts[depth] = told["there"]
        have = 0
        for d in range(1, depth + 1):
            have += counts[d]
            if have >= most:
                break
            if d in dropped:
                return None
        if have >= most or told["all"] == told["there"]:
            break
        dropped |= set(told["dropped"])
        now = table.filter((F.col("n") > 0) & (F.col("n") <= width)).dropDuplicates(["edge_ids"]).select("node", "nodes", "edge_ids", "statuses")
    return reduce(DataFrame.unionByName, found)


def _between(hop: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """The edges that a walk of no more than max_depth hops from source to target may use, each once. Nodes are met from both ends, one
    hop at a time at the end whose last nodes are fewer, until the hops of both are one less than a walk may have: then each edge of
    such a walk has its start near the source or its end near the target."""
    spark = hop.sparkSession
    ends = {c: spark.range(1).select(F.lit(n).alias("n"), F.lit(0).alias("d")) for c, n in (("_f", source), ("_t", target))}
    last, depth, size, all_ = dict(ends), {"_f": 0, "_t": 0}, {"_f": 1, "_t": 1}, {"_f": 1, "_t": 1}
    side = lambda table, rows: F.broadcast(table) if rows <= 200_000 else table
    while depth["_f"] + depth["_t"] < max_depth - 1:
        at = min((c for c in ends if size[c]), key=lambda c: size[c], default=None)
        if at is None:
            break
        other = "_t" if at == "_f" else "_f"
        met = hop.join(side(last[at].select(F.col("n").alias(at)), size[at]), at).select(F.col(other).alias("n")).distinct()
        depth[at] += 1
        last[at] = cut(met.join(side(ends[at].select("n"), all_[at]), "n", "left_anti").withColumn("d", F.lit(depth[at])))
        size[at] = last[at].count()
        all_[at] += size[at]
        ends[at] = ends[at].unionByName(last[at])
        if not size[at]:
            break  # what an end has met is all that it ever meets
    first, then = (side(ends[c].select(F.col("n").alias(c), F.col("d").alias(f"_d{c}")), all_[c]) for c in ("_f", "_t"))
    full = {c: not size[c] for c in ends}
    near = hop.join(first, "_f").join(then, "_t", "left")
    # a start whose hops leave no more than the target's end has walked must lead to a node met there
    fits = F.when(F.col("_d_t").isNotNull(), F.col("_d_f") + 1 + F.col("_d_t") <= max_depth).otherwise(F.lit(not full["_t"]) & (max_depth - 1 - F.col("_d_f") > depth["_t"]))
    kept = near.filter(fits).select("_e", "_f", "_t", "_s")
    if not full["_f"]:
        far = hop.join(then, "_t").join(first, "_f", "left_anti").filter(F.col("_d_t") + 1 + depth["_f"] + 1 <= max_depth)
        kept = kept.unionByName(far.select("_e", "_f", "_t", "_s"))
    return kept.distinct()


def trace_flow(edges: DataFrame, source: str, target: str, max_depth: int = 12, max_paths: int = 20, width: int | None = None) -> DataFrame:
    """(path, depth, nodes, edge_ids, status): simple directed paths, the shortest first, then by their edges' ids.

    A partial path goes on only if its hops and the distance from its end to the target fit into the depth. For each depth that it
    may end at, a hop keeps the `width` first ones by edges (four times max_paths at first), so the frontier never holds more than width
    * max_depth paths, however dense the graph: what is dropped comes behind all that is kept, and behind what that leads to. So
    the paths found are the first ones; only where dead ends leave too few of them, it begins again four times as wide.

    Edges are read some max_depth times before they are reduced to those between both ends: cut them before, where making them costs
    more than reading. Equal rows count as one edge."""
    hop = cut(_between(edges.select(F.col("id").alias("_e"), F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("status").alias("_s")), source, target, max_depth))
    back = hop.filter(F.col("_t") == target).select(F.col("_f").alias("n"), F.lit(1).alias("d"))
    reach, frontier = back.distinct(), back.distinct()
    for d in range(2, max_depth + 1):
        before = hop.join(frontier.select(F.col("n").alias("_t")), "_t").select(F.col("_f").alias("n")).distinct()
        frontier = cut(before.join(reach.select("n"), "n", "left_anti").withColumn("d", F.lit(d)))
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
    near = cut(reach.groupBy("n").agg(F.min("d").alias("d")).withColumnRenamed("n", "_t"))
    width = width or 4 * max_paths
    while (found := _paths(hop, near, source, target, max_depth, max_paths, width)) is None:
        width *= 4
    paths = found.orderBy("depth", "edge_ids").limit(max_paths)
    worst = F.when(F.array_contains("statuses", "unresolved"), "unresolved").when(F.array_contains("statuses", "candidate"), "candidate").otherwise("supported")
    return paths.select("depth", "nodes", "edge_ids", worst.alias("status"))


def _next_hop(ways: DataFrame, told: DataFrame, have: DataFrame, live: DataFrame, most: int, edges: int) -> DataFrame:
    """The edges (_f, _k, ...) over which paths of one hop more begin, for each target: told (_t, told: [target, n, open]) says how many
    paths are known behind an edge, and whether there may be more; have (_f, have: [target, have, closed]) the same of its start. In the
    edges' order it is those before which fewer than `most` are known, up to the first behind which there may be more. What is behind more
    than `edges` of them is unknown, for all of live (target). Columns had and before: known paths that come first."""
    unknown = live.agg(F.collect_list(F.struct("target", F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_f").orderBy("_k"))
    met = ways.join(told, "_t").withColumn("_i", place).filter(F.col("_i") <= edges + 1).crossJoin(F.broadcast(unknown)).join(have, "_f", "left")
    met = met.select(*ways.columns, F.explode(F.when(F.col("_i") > edges, F.col("_all")).otherwise(F.col("told"))).alias("_x"), "have").select(*ways.columns, "_x.*", "have").filter(F.col("target") != F.col("_f"))
    met = met.withColumn("_h", F.get(F.filter("have", lambda h: h["target"] == F.col("target")), F.lit(0))).filter("not coalesce(_h.closed, false)").withColumn("had", F.coalesce("_h.have", F.lit(0).cast("long")))
    first = Window.partitionBy("_f", "target").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.coalesce(F.sum(F.when(F.col("open"), F.col("n") + most).otherwise(F.col("n"))).over(first), F.lit(0).cast("long"))).filter(F.col("had") + F.col("before") < most).drop("have", "_h")


def _known(table: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """(key, name): rows (node, target, ...) as one list for each node."""
    return table.groupBy(F.col("node").alias(key)).agg(F.collect_list(F.struct("target", *columns)).alias(name))


def _all_paths(inner: DataFrame, outer: DataFrame, own: DataFrame, targets: DataFrame, max_depth: int, most: int, width: int) -> DataFrame | None:
    """trace_flows() with `width` paths a node and target; None if that many don't decide. outer: edges from sources that nothing leads
    to; inner: all others; own (node): sources among these."""
    spark, state, found = inner.sparkSession, "node string, target string, have long, closed boolean", []
    got, out, closed = spark.createDataFrame([], state), spark.createDataFrame([], state), spark.createDataFrame([], "node string, target string, n long, open boolean")
    start = F.array(F.struct(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("ids"), F.lit(0).alias("worst")))
    paths = cut(targets.select("node", F.col("node").alias("target"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("open"), start.alias("paths")))
    sources = outer.select("_f").distinct().count(), own.count()
    grown = lambda old, new, n: cut(old.unionByName(new).groupBy("node", "target").agg(F.sum("have").alias("have"), (F.max("closed") | (F.sum("have") >= n)).alias("closed")))
    begun = lambda p: F.struct(F.concat(F.array("_f"), p["nodes"]).alias("nodes"), F.concat(F.array("_e"), p["ids"]).alias("ids"), F.greatest("_w", p["worst"]).alias("worst"))
    for depth in range(1, max_depth + 1):
        behind = paths.select("node", "target", "n", "open").unionByName(closed)
        live = cut(behind.select("target").distinct())  # only to these there may be more paths
        told = cut(_known(behind, "_t", "told", "n", "open"))
        mean = paths.agg(F.avg("n")).first()[0]
        enough = 4 + int(4 * width / max(mean or 1, 1))
        if sources[0]:
            over = cut(_next_hop(outer, told, _known(out, "_f", "have", "have", "closed"), live, most, enough))
            room = F.least(F.col("n"), most - F.col("had") - F.col("before"))
            some = over.filter("n > 0").join(paths.select(F.col("node").alias("_t"), "target", "paths"), ["_t", "target"])
            some = some.select(F.col("_f").alias("source"), "target", F.lit(depth).alias("depth"), "_f", "_e", "_w", F.explode(F.slice("paths", F.lit(1), room.cast("int"))).alias("_p"))
            found.append(some.select("source", "target", "depth", begun(F.col("_p")).alias("_p")))
            out = out if over.isEmpty() else grown(out, over.select(F.col("_f").alias("node"), "target", room.alias("have"), F.col("open").alias("closed")), most)
        there = got.join(own, "node", "left_semi").unionByName(out).filter("closed")
        sure = there.join(F.broadcast(live.withColumn("live", F.lit(True))), "target", "left").agg(F.count("live").alias("n"), F.count_if(F.col("have") < most).alias("few")).first()
        if sure["few"]:
            return None
        if sure["n"] == live.count() * sum(sources):
            break
        over = cut(_next_hop(inner, told, _known(got, "_f", "have", "have", "closed"), live, width, enough))
        room = (width - F.col("had")).cast("int")
        simple = F.slice(F.filter(F.coalesce("paths", F.array()), lambda p: ~F.array_contains(p["nodes"], F.col("_f"))), F.lit(1), room)
        some = over.join(paths.select(F.col("node").alias("_t"), "target", "paths"), ["_t", "target"], "left").select("_f", "target", "had", "n", "open", "_k", F.transform(simple, begun).alias("paths"))
        open_ = F.max("open") | (F.first("had") + F.sum("n") >= width)
        some = some.groupBy(F.col("_f").alias("node"), "target").agg(F.first("had").alias("had"), open_.alias("open"), F.sort_array(F.collect_list(F.struct("_k", "paths"))).alias("paths"))
        some = some.withColumn("paths", F.slice(F.flatten("paths.paths"), F.lit(1), room))
        paths = cut(some.select("node", "target", F.size("paths").cast("long").alias("n"), "open", "had", "paths").filter("n > 0 or open"))
        closed = got.filter("closed").select("node", "target", F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
        got = grown(got, paths.select("node", "target", F.col("n").alias("have"), F.col("open").alias("closed")), width)
        if sources[1]:
            mine = paths.join(own, "node", "left_semi").filter(F.col("had") < most)
            found.append(mine.select(F.col("node").alias("source"), "target", F.lit(depth).alias("depth"), F.explode(F.slice("paths", F.lit(1), (most - F.col("had")).cast("int"))).alias("_p")))
    last = got.join(own, "node", "left_semi").unionByName(out).filter(F.col("closed") & (F.col("have") < most))
    if not last.isEmpty():
        return None
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "source string, target string, depth int, _p struct<nodes: array<string>, ids: array<string>, worst: int>")


def trace_flows(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 12, max_paths: int = 20, width: int | None = None) -> DataFrame:
    """(source, target, depth, nodes, edge_ids, status): what trace_flow() finds between each of sources (node) and each of targets (node).

    Paths are made from the targets backwards, all of them at once: the first paths of a node and target, by hops and edges, are those of
    the nodes behind its edges, in the edges' order. A node keeps the `width` first ones (a quarter more than max_paths at first) and no others, and
    what is behind the first edge whose paths aren't all known is unknown; where that leaves a source short of paths, it begins again four
    times as wide. Paths that hold the node already are left out. Sources that nothing leads to are on no other path: theirs are counted
    first and made once, at the end. Ids name edges; equal rows count as one edge."""
    worst = F.when(F.col("status") == "unresolved", 2).when(F.col("status") == "candidate", 1).otherwise(0)
    hop = edges.select(F.col("id").alias("_e"), F.col("from").alias("_f"), F.col("to").alias("_t"), worst.alias("_w")).filter("_f <> _t").repartition("_f").distinct()
    hop = cut(hop.withColumn("_k", F.row_number().over(Window.partitionBy("_f").orderBy("_e", "_t", "_w"))))
    heads, begin = small_side(cut(hop.select(F.col("_t").alias("_f")).distinct())), small_side(cut(sources.select(F.col("node").alias("_f")).distinct()))
    inner, outer = cut(hop.join(heads, "_f", "left_semi")), cut(hop.join(heads, "_f", "left_anti").join(begin, "_f", "left_semi"))
    own = small_side(cut(inner.select("_f").distinct().join(begin, "_f", "left_semi").select(F.col("_f").alias("node"))))
    ends = cut(targets.select("node").dropna().distinct())
    width = width or max_paths + (max_paths + 3) // 4
    while (found := _all_paths(inner, outer, own, ends, max_depth, max_paths, max(width, max_paths))) is None:
        width *= 4
    status = F.when(F.col("_p.worst") == 2, "unresolved").when(F.col("_p.worst") == 1, "candidate").otherwise("supported")
    return found.select("source", "target", "depth", F.col("_p.nodes").alias("nodes"), F.col("_p.ids").alias("edge_ids"), status.alias("status"))


def flow_status(paths: DataFrame) -> DataFrame:
    """The status of a whole trace: the worst of its paths; unresolved without a path."""
    return paths.agg(worst_status().alias("status"), F.count(F.lit(1)).alias("paths"))


def findings(edges: DataFrame) -> DataFrame:
    """What each edge says: a fact, an inference, or unknown."""
    label = F.when(F.col("status") == "supported", "fact").when(F.col("status") == "candidate", "inference").otherwise("unknown")
    return edges.select(stable_id("finding", F.col("id")).alias("id"), label.alias("classification"), F.concat_ws(" ", "from", "type", "to").alias("statement"), "fact_ids", "evidence_ids", "limitations")


def aliases_of(spark: SparkSession, pairs: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(pairs.items()) or [], "alias string, target string")

