"""Walks over graphs by frontiers: a hop is a join, what was reached stays out by an anti-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.storage import cut, small_side

# What is walked backwards too, and names of hubs that are walked on.
BOTH_WAYS = ("contains_symbol", "implements", "implemented_by")
HUBS = r"(?:Port(?:In|Out)?|Repository|Mapper|Entity|UseCase|Handler)(?:\.|$)"
HUB_DEGREE = 64


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, depth): what is reached from seeds (node) along edges (from, to), with the fewest hops. Without a depth it goes
    on to the fixpoint. known (node): all others are left out. A short frontier is sent to the edges and to what is known, so that a
    hop reads them and moves neither."""
    hop = edges.select(F.col("from").alias("node"), F.col("to").alias("_to"))
    within = lambda nodes: nodes if known is None else known.select("node").join(small_side(cut(nodes)), "node").distinct()
    # a hop adds a table of its own; only every sixteenth puts what there is together, so that plans stay short
    seen = frontier = cut(within(seeds.select("node").distinct()).withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = hop.join(small_side(frontier.select("node")), "node").select(F.col("_to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(within(met).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if depth % 16 else cut(seen)
        if max_nodes is not None and seen.count() >= max_nodes:
            break
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


def invalidated(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """(path): changed files (path), and all that import them, directly or not. imports (source_path, target_path)."""
    back = imports.filter("source_path is not null and target_path is not null").select(F.col("target_path").alias("from"), F.col("source_path").alias("to"))
    return reach(back, changed.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


def endpoint_flow(calls: DataFrame, symbols: DataFrame, start: DataFrame, max_depth: int = 12, max_symbols: int = 80, max_calls: int = 160) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls that are reached from start (node): calls (id, from, to, resolution), symbols (symbol_id, source_path).
    Breadth first; of one depth, the smaller ids first."""
    known = symbols.select(F.col("symbol_id").alias("node"))
    reached = cut(reach(calls, start, max_depth, max_symbols, known))
    made = calls.join(small_side(reached.filter(F.col("depth") < max_depth).select(F.col("node").alias("from"), "depth")), "from").orderBy("depth", "from", "id").limit(max_calls)
    return reached, made


def flow_resources(reached: DataFrame, symbols: DataFrame, facts: DataFrame, entry_paths: DataFrame) -> DataFrame:
    """facts (id, kind, source_path) whose file was reached, or is an entry's (path)."""
    paths = symbols.join(reached.select(F.col("node").alias("symbol_id")), "symbol_id", "left_semi").select("source_path").unionByName(entry_paths.select(F.col("path").alias("source_path"))).distinct()
    return facts.join(paths, "source_path", "left_semi")


def near_edges(edges: DataFrame, starts: DataFrame, max_depth: int = 4, max_edges: int = 30) -> DataFrame:
    """(start, from, to, depth): the first edges (component_id, from, to) that are met on the way from each start (start,
    component_id, node), nearer ones and smaller names first. All starts walk at once; an edge's depth is the hops before it."""
    ways = edges.select("component_id", F.col("from").alias("node"), F.col("to").alias("_to")).distinct()
    seen = frontier = cut(starts.select("start", "component_id", "node").distinct())
    found = None
    for depth in range(max_depth):
        met = cut(frontier.join(ways, ["component_id", "node"]).withColumn("depth", F.lit(depth)))
        found = met if found is None else found.unionByName(met)
        frontier = cut(met.select("start", "component_id", F.col("_to").alias("node")).distinct().join(seen, ["start", "component_id", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "node", "_to"))
    return found.withColumn("_n", place).filter(F.col("_n") <= max_edges).select("start", F.col("node").alias("from"), F.col("_to").alias("to"), "depth")


def expand_context(links: DataFrame, chunks: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 60, max_visited: int = 5000, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(id, distance) of chunks near seeds (id). Only technical nodes are walked on; a chunk ends a walk. Links of type
    documents and unresolved ones aren't walked; backwards only those of BOTH_WAYS. A node with more technical links than
    hub_degree is left out unless its name is a hub's."""
    used = links.filter((F.col("type") != "documents") & (F.col("status") != "unresolved")).select(F.col("from").alias("_f"), F.col("to").alias("_t"), "type")
    ids = chunks.select(F.col("id").alias("_n"))
    ways = used.select(F.col("_f").alias("node"), F.col("_t").alias("_n")).unionByName(used.filter(F.col("type").isin(*BOTH_WAYS)).select(F.col("_t").alias("node"), F.col("_f").alias("_n"))).distinct()
    ends = used.select(F.col("_f").alias("node"), F.col("_t").alias("_n")).unionAll(used.select(F.col("_t").alias("node"), F.col("_f").alias("_n")))
    degree = ends.join(ids, "_n", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("_degree")).filter((F.col("_degree") > hub_degree) & ~F.col("node").rlike(HUBS)).select(F.col("node").alias("_n"))
    marked = cut(ways.join(ids.withColumn("_chunk", F.lit(True)), "_n", "left").join(degree.withColumn("_hub", F.lit(True)), "_n", "left").select("node", "_n", F.coalesce("_chunk", F.lit(False)).alias("_chunk"), F.coalesce("_hub", F.lit(False)).alias("_hub")))
    start = cut(seeds.select(F.col("id").alias("_n")).distinct().join(ids, "_n", "left_semi").select(F.col("_n").alias("node")))
    found = start.withColumn("distance", F.lit(0))
    seen = frontier = start
    for level in range(1, min(depth, 8) + 1):
        out = marked.join(frontier, "node")
        found = found.unionByName(out.filter("_chunk").select(F.col("_n").alias("node"), F.lit(level).alias("distance")).distinct())
        frontier = cut(out.filter("not _chunk and not _hub").select(F.col("_n").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if seen.count() >= max_visited:
            break
    nearest = found.groupBy(F.col("node").alias("id")).agg(F.min("distance").alias("distance"))
    return nearest.orderBy("distance", "id").limit(limit)


#: Edges of a graph that one task may hold.
SMALL = 200_000


def _peeled(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which edges of a graph (numbers of nodes) are left when all that come from nowhere are taken off, as long as there are any."""
    n = int(max(before.max(initial=-1), after.max(initial=-1))) + 1
    waits = np.bincount(after, minlength=n)
    order = np.argsort(before, kind="stable")
    ways, starts = after[order].tolist(), np.searchsorted(before[order], np.arange(n + 1)).tolist()
    free, left = np.flatnonzero(waits == 0).tolist(), waits.tolist()
    while free:
        at = free.pop()
        left[at] = -1
        for to in ways[starts[at] : starts[at + 1]]:
            left[to] -= 1
            if not left[to]:
                free.append(to)
    return np.array(left, np.int64)[before] >= 0


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph, cyclic) of edges (graph, from, to) that come sorted by graph. All graphs that end in a batch are peeled at once, as one."""
    wait: list[pa.RecordBatch] = []

    def told(table: pa.Table) -> pa.RecordBatch:
        graph, node = table.column("graph").combine_chunks(), pa.chunked_array([*table.column("from").chunks, *table.column("to").chunks])
        first = np.append(True, pc.not_equal(graph[1:], graph[:-1]).to_numpy(zero_copy_only=False))
        of = np.cumsum(first) - 1
        codes = pc.dictionary_encode(node).combine_chunks().indices.to_numpy().astype(np.int64)
        nodes = np.unique(np.concatenate([of, of]) * (codes.max() + 1) + codes, return_inverse=True)[1]
        cyclic = np.bincount(of, _peeled(nodes[: len(of)], nodes[len(of) :]), minlength=of[-1] + 1) > 0
        return pa.record_batch([graph.filter(pa.array(first)), pa.array(cyclic)], names=["graph", "cyclic"])

    for batch in batches:
        if not batch.num_rows:
            continue
        graph = batch.column("graph")
        new = np.flatnonzero(pc.not_equal(graph, graph[batch.num_rows - 1]).to_numpy(zero_copy_only=False))
        end = int(new[-1]) + 1 if len(new) else 0  # where the last graph begins, which may go on
        if end or wait and wait[-1].column("graph")[0] != graph[0]:
            yield told(pa.Table.from_batches([*wait, batch.slice(0, end)]))
            wait = []
        wait.append(batch.slice(end))
    if wait:
        yield told(pa.Table.from_batches(wait))


def cyclic_graphs(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph, cyclic) of graphs (graph, from, to). One of no more than `small` edges is peeled by one task. In a larger one, a round
    takes off all edges that come from nowhere or lead nowhere; where that takes none off, the rest holds a cycle. Chains don't need a
    round for each node: a node with one way out gives its place to the node behind it, for nodes chosen by a coin so that no two
    neighbours go at once, which keeps all cycles and takes a part of a chain off in each round. Edges without a node at an end count
    for nothing."""
    now = cut(edges.select("graph", "from", "to").dropna(subset=["from", "to"]).distinct())
    schema = f"graph {now.schema['graph'].dataType.simpleString()}, cyclic boolean"
    at = lambda c: F.col(c).alias("from" if c == "to" else "to")
    told, rounds = None, 0
    while True:
        size = cut(now.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("from") == F.col("to")).alias("_loop")))
        few = size.filter((F.col("_n") <= small) & ~F.col("_loop"))
        both = ("graph", F.coalesce("from", "to").alias("from"), F.coalesce("to", "from").alias("to"))  # of one type
        some = now.join(few.select("graph"), "graph", "left_semi").select(*both).repartition("graph").sortWithinPartitions("graph").mapInArrow(_peel, schema)
        some = some.unionByName(size.filter("_loop").select("graph", F.lit(True).alias("cyclic")))
        large = size.filter((F.col("_n") > small) & ~F.col("_loop"))
        if large.isEmpty():
            told = some if told is None else told.unionByName(some)
            break
        now = cut(now.join(large.select("graph"), "graph", "left_semi"))
        inner = now.join(now.select("graph", at("to")).distinct(), ["graph", "from"], "left_semi").join(now.select("graph", at("from")).distinct(), ["graph", "to"], "left_semi")
        inner = cut(inner.select("graph", "from", "to"))
        left = cut(large.select("graph", "_n").join(inner.groupBy("graph").agg(F.count(F.lit(1)).alias("_left")), "graph", "left").fillna(0, ["_left"]))
        some = some.unionByName(left.filter("_left = _n or _left = 0").select("graph", (F.col("_left") > 0).alias("cyclic")))
        told = cut(some) if told is None else told.unionByName(cut(some))
        open_ = inner.join(left.filter("_left <> _n and _left > 0").select("graph"), "graph", "left_semi")
        rounds += 1
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(rounds)), F.lit(2)) == 1  # noqa: E731, B023
        way = open_.groupBy("graph", "from").agg(F.count(F.lit(1)).alias("_n"), F.max("to").alias("_to")).filter((F.col("_n") == 1) & coin("from") & ~coin("_to"))
        way = cut(way.select("graph", F.col("from").alias("_over"), "_to"))
        passed = open_.join(way.select("graph", F.col("_over").alias("from")), ["graph", "from"], "left_anti").join(way.withColumnRenamed("_over", "to"), ["graph", "to"], "left")
        now = cut(passed.select("graph", "from", F.coalesce("_to", "to").alias("to")).distinct())
    return told.groupBy("graph").agg(F.max("cyclic").alias("cyclic"))


def has_cycle(edges: DataFrame, small: int = SMALL) -> bool:
    """Whether edges (from, to) hold a cycle."""
    return bool(cyclic_graphs(edges.select(F.lit(0).alias("graph"), "from", "to"), small).filter("cyclic").count())


def ready_tasks(tasks: DataFrame, needs: DataFrame, done: DataFrame, most: int = 2) -> DataFrame:
    """The first `most` tasks (task) that aren't done (task) and need (task, needs) nothing that isn't done."""
    waiting = needs.join(done.select(F.col("task").alias("needs")), "needs", "left_anti").select("task")
    return tasks.join(done.select("task"), "task", "left_anti").join(waiting, "task", "left_anti").orderBy("task").limit(most)
