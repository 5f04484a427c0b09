"""Shapes that grow: one hot prefix, one hot file name, one long file, dense graphs, long chains. Each against plain enumeration."""

import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, resolve, scope, traverse
from factloom.plans.queries import ORACLE_SQL, QUERIES


def test_many_paths_that_begin_alike(spark):
    entries = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("shop").alias("repository_id"), F.concat(F.lit("/api/v1/k"), "id", F.lit("/")).alias("path"))
    facts = spark.range(3000).select(F.col("id").alias("fact_id"), F.lit("shop").alias("repository_id"), F.concat(F.lit('{"a":"GET /API/v1/k'), "id", F.lit("/x\",\"b\":\"/api/v1/k"), F.col("id") + 1, F.lit('/api/v1/zz"}')).alias("value_json"))
    began = time.time()
    got = sorted(map(tuple, resolve.facts_of_paths(entries, facts).collect()))
    assert got == sorted((f"e{k}", i) for i in range(3000) for k in (i, i + 1) if k < 3000) and time.time() - began < 60


def test_paths_against_brute_force(spark):
    rng = random.Random(3)
    piece = lambda: rng.choice(["/a", "/b", "/A", "/é", "x", "/a/", ""])
    entries = [(i, rng.choice(["r", "s", None]), "".join(piece() for _ in range(rng.randint(0, 3))) or None) for i in range(60)] + [(60, "r", "/a"), (61, "r", "/a")]
    facts = [(f"f{i}", rng.choice(["r", "s", "t", None]), "".join(piece() for _ in range(rng.randint(0, 9))) or None) for i in range(200)]
    got = sorted(map(tuple, resolve.facts_of_paths(spark.createDataFrame(entries, "id long, repository_id string, path string"), spark.createDataFrame(facts, "fact_id string, repository_id string, value_json string")).collect()))
    assert got == sorted((e, f) for e, r, p in entries for f, q, v in facts if r and r == q and p and v and p.lower() in v.lower())
    assert resolve.facts_of_paths(spark.createDataFrame([], "id long, repository_id string, path string"), spark.createDataFrame(facts, "fact_id string, repository_id string, value_json string")).count() == 0


def test_one_name_in_many_folders(spark):
    rng = random.Random(5)
    docs = [(i, f"{rng.choice('abc')}{rng.randint(0, 9)}/{rng.choice(['x', 'yx', 'z'])}/{rng.choice(['index.md', 'servicio.md', 'n' + str(i) + '.md'])}") for i in range(300)]
    links = [(i, rng.choice(["x/index.md", "./x/index", "../yx/servicio.md", "index.md", "a1/x/index.md", "n7", "ndex", "", "q/index.md", "a1/yx/servicio"])) for i in range(60)]
    got = sorted(map(tuple, resolve.resolve_by_suffix(spark.createDataFrame(links, "id long, target string"), spark.createDataFrame(docs, "doc long, path string")).select("id", "doc").collect()))
    want = []
    for i, t in links:
        t = t.removeprefix("./").removeprefix("../")
        want += [(i, d) for _, d in sorted((p, d) for d, p in docs if t and (p.endswith(t) or p.endswith(t + ".md")))[:3]]
    assert got == sorted(want)


def test_scopes_of_a_long_file(spark):
    n = 100_000
    ranges = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("range_id"), (F.col("id") * 10).alias("range_start"), (F.col("id") * 10 + 8).alias("range_end")).unionAll(spark.createDataFrame([("f", -1, 0, 10 * n)], "file string, range_id long, range_start long, range_end long"))
    points = spark.range(n).select("id", F.lit("f").alias("file"), (F.col("id") * 10 + 3 + F.col("id") % 2 * 4).alias("start"), (F.col("id") * 10 + 5 + F.col("id") % 2 * 4).alias("end"))
    began = time.time()
    wrong = resolve.nearest_enclosing(points, ranges, "file").filter(F.col("range_id") != F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1)).count()
    assert wrong == 0 and time.time() - began < 60


def test_scopes_against_brute_force(spark):
    rng = random.Random(8)
    ranges = [(rng.choice(["a", "b", None]), f"r{i}", *sorted(rng.sample(range(60), 2))) for i in range(80)]
    points = [(i, rng.choice(["a", "b", "c", None]), s, s + rng.randint(0, 9), "x") for i in range(150) for s in [rng.randint(0, 60)]]
    got = {r["id"]: r["range_id"] for r in resolve.nearest_enclosing(spark.createDataFrame(points, "id long, k string, start int, end int, note string"), spark.createDataFrame(ranges, "k string, range_id string, range_start int, range_end int"), "k").collect()}
    for i, k, s, e, _ in points:
        around = [(b - a, a, r) for q, r, a, b in ranges if k is not None and q == k and a <= s and e <= b]
        assert got[i] == (min(around)[2] if around else None)


def simple_paths(edges, source, target, depth):
    """All of them, by depth first search."""
    out, after = [], {}
    for e, a, b, s in edges:
        after.setdefault(a, []).append((e, b, s))

    def walk(node, nodes, ids):
        for e, b, _ in after.get(node, []):
            if b in nodes or len(ids) == depth:
                continue
            if b == target:
                out.append((len(ids) + 1, [*ids, e]))
            else:
                walk(b, [*nodes, b], [*ids, e])

    walk(source, [source], [])
    return sorted(out)


@pytest.mark.parametrize("seed, n, m, depth, most, width", [(1, 7, 20, 5, 20, None), (2, 9, 22, 6, 8, 1), (3, 12, 18, 8, 50, 2)])
def test_first_paths_against_all_paths(spark, seed, n, m, depth, most, width):
    rng = random.Random(seed)
    edges = [(f"e{i:03}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["supported", "candidate"])) for i in range(m)]
    got = graph.trace_flow(spark.createDataFrame(edges, "id string, from string, to string, status string"), "n0", "n1", depth, most, width).collect()
    assert sorted((r["depth"], r["edge_ids"]) for r in got) == simple_paths(edges, "n0", "n1", depth)[:most]


def test_a_dense_graph_keeps_its_frontier_small(spark, monkeypatch):
    n, sizes = 1000, []
    edges = spark.range(n * 40).select(F.format_string("e%06d", "id").alias("id"), F.format_string("n%03d", F.floor(F.col("id") / 40)).alias("from"), F.format_string("n%03d", F.pmod(F.floor(F.col("id") / 40) + 1 + F.pmod("id", F.lit(40)), F.lit(n))).alias("to"), F.lit("supported").alias("status"))
    put = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: [t := put(df), sizes.append(t.count()) if "goal" in t.columns else None][0])
    got = graph.trace_flow(edges, "n000", "n160", max_depth=6, max_paths=20).collect()
    own = {i: [(i * 40 + k, (i + 1 + k) % n) for k in range(40)] for i in range(n)}
    best = [(d, [f"e{x:06}" for x in p]) for d, p in [(4, p) for p in [[0 * 40 + 39, 40 * 40 + 39, 80 * 40 + 39, 120 * 40 + 39]]]]
    assert [(r["depth"], r["edge_ids"]) for r in got[:1]] == best and len(got) == 20 and own[0][39][1] == 40
    assert [r["depth"] for r in got] == [4] + [5] * 19 and max(sizes) <= (80 + 1) * 6 + 20 * 80


@pytest.mark.parametrize("small", [0, 1000])
def test_cycles_of_many_graphs(spark, small):
    rng = random.Random(small)
    rows, want = [], {}
    for g in range(40):
        n, m = rng.randint(1, 8), rng.randint(1, 9)
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        own = [(min(e), max(e)) for e in own if e[0] != e[1]] or [(0, 1)] if g % 2 else own
        reach = {(a, b) for a, b in own}
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        want[g] = any(a == b for a, b in reach)
        rows += [(g, f"t{a}", f"t{b}") for a, b in own]
    rows += [(0, None, "t1"), (1, "t0", None)]
    got = {r["graph"]: r["cyclic"] for r in traverse.cyclic_graphs(spark.createDataFrame(rows, "graph long, from string, to string"), small).collect()}
    assert got == want and len(set(want.values())) == 2


def test_a_chain_of_tasks_takes_few_rounds(spark, monkeypatch):
    cuts = []
    put = traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: [cuts.append(1), put(df)][1])
    chain = spark.range(4_000).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    assert not traverse.has_cycle(chain, small=500) and len(cuts) < 6 * 20
    assert traverse.has_cycle(chain.unionAll(spark.createDataFrame([(4_000, 0)], "from long, to long")))
    assert not traverse.has_cycle(chain)


def test_one_handler_name_of_many_symbols(spark):
    rng = random.Random(11)
    pick = lambda *of: rng.choice(of)
    symbols = [(pick("a", "b"), pick("save", "load"), f"s{i:03}", pick("x.ts", "y.ts", "z.ts", None), pick("Ctl", "Store", None)) for i in range(40)] + [("a", "one", "s900", "q.ts", "Ctl")]
    ends = [(i, pick("a", "b", "c", None), pick("ctl.save(q)", "save", "load", "st.load(q)", "ctl.one()", "zz.save()", None), pick("x.ts", "y.ts", "w.ts", None)) for i in range(120)]
    types = {"ctl": "Ctl", "st": "Nothing"}
    of_ends, of_symbols = "id long, component_id string, handler string, source_path string", "component_id string, name string, symbol_id string, source_path string, class_name string"
    variables = spark.createDataFrame([(c, *v) for c in "ab" for v in types.items()], "component_id string, variable string, type string")
    got = {r["id"]: r["symbol_id"] for r in resolve.handler_symbol(spark.createDataFrame(ends, of_ends), spark.createDataFrame(symbols, of_symbols), variables).collect()}
    for i, c, h, p in ends:
        *receiver, name = (h or "").split("(")[0].split(".")
        own = [s for s in symbols if c and s[0] == c and s[1] == name]
        kind = types.get(receiver[-1]) if receiver else None
        fits, near = [s for s in own if kind is None or s[4] == kind], min((s[2] for s in own if p and s[3] == p), default=None)
        first = min(((bool(p and s[3]), bool(p and s[3] and s[3] != p), s[2]) for s in fits), default=None)
        want = first and first[2] if len(fits) == 1 or first and first[:2] == (True, False) else near or first and first[2]
        assert got[i] == want, (i, c, h, p)
    many = spark.range(60_000).select("id", F.lit("c").alias("component_id"), F.lit("save").alias("handler"), F.concat(F.lit("f"), "id").alias("source_path"))
    began = time.time()
    found = resolve.handler_symbol(many, many.select("component_id", F.col("handler").alias("name"), F.format_string("s%06d", "id").alias("symbol_id"), "source_path"))
    assert found.filter(F.col("symbol_id") == F.format_string("s%06d", "id")).count() == 60_000 and time.time() - began < 60


def test_cycles_of_very_many_graphs(spark):
    n = 600_000
    ends = lambda a, b: F.struct(F.lit(a).alias("from"), b.alias("to"))
    small = spark.range(n).select((F.col("id") + 2).alias("graph"), F.explode(F.array(ends(1, F.lit(2)), ends(2, F.when(F.col("id") % 3 == 0, 1).otherwise(3)))).alias("e")).select("graph", "e.from", "e.to")
    long = spark.range(30_000).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("graph"), F.col("id").cast("int").alias("from"), (F.col("id") + 1).cast("int").alias("to"))  # more than a batch holds
    began = time.time()
    got = traverse.cyclic_graphs(small.unionAll(long).unionAll(spark.createDataFrame([(1, 30_000, 7)], "graph long, from int, to int")))
    wrong = got.filter(F.col("cyclic") != F.when(F.col("graph") < 2, F.col("graph") == 1).otherwise((F.col("graph") - 2) % 3 == 0))
    assert got.count() == n + 2 and wrong.count() == 0 and time.time() - began < 60


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_fact_value_is_computed_once(spark):
    of = lambda kind: F.when(F.col("id") % 2 == 0, "symbol_call").otherwise(kind)
    value = F.to_json(F.struct(F.concat(F.lit("costly"), "id").alias("path"), F.lit("T_tests\\\\it").alias("source_path"), F.when(F.col("id") % 4 == 0, "a/tests/b.ts").alias("target_path"), F.lit("s").alias("target_symbol_id")))
    facts = spark.range(8).select("id", of("http_endpoint").alias("kind"), F.lit("c").alias("component_id"), value.alias("value_json"))
    got = scope.production_facts(facts).filter("component_id = 'c' and kind <> 'x'")
    assert _plan(got).count("costly") == 1
    told = {r["id"]: json.loads(r["value_json"]) for r in got.collect()}
    assert sorted(told) == list(range(8)) and told[0]["resolution"] == "unresolved" and "target_path" not in told[0] and told[2]["target_symbol_id"] == "s"
    paths = spark.createDataFrame([(p,) for p in ("a/Tests/x", "x\\SPEC\\y", "./test/", "q.tests/a", "aIT.java", "b/fooTest.kt", "c_test.py", "x/latest/y", "git.py", "", None, "test_a.py/", "spec.ts")], "p string")
    assert [r[0] for r in paths.select(scope.is_test_path(F.col("p"))).collect()] == [True, True, True, True, True, True, True, False, False, False, False, True, True]


def test_a_hop_moves_neither_edges_nor_symbols(spark, monkeypatch):
    plans, put, n = [], traverse.cut, 2_000_000
    monkeypatch.setattr(traverse, "cut", lambda df: [plans.append(df._jdf.queryExecution().sparkPlan().toString()), put(df)][1])
    calls = spark.range(n).select("id", F.col("id").alias("from"), F.explode(F.array(F.col("id") + 1, F.col("id") + n)).alias("to"), F.lit("supported").alias("resolution"))
    reached, made = traverse.endpoint_flow(calls, spark.range(n).select(F.col("id").alias("symbol_id")), spark.createDataFrame([(n - 3,), (n,)], "node long"), max_depth=5)
    assert sorted(map(tuple, reached.collect())) == [(n - 3, 0), (n - 2, 1), (n - 1, 2)] and made.count() == 6
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


def test_rules_see_no_text_without_hints(spark, monkeypatch):
    from factloom.functions import text as T

    rows = [("plain words, tokens and keys",), ("ToKen : x",), ("a http://u:p@h/ ASIA" + "A" * 16,), ("," + "b" * 52,), (None,)]
    texts = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in texts.select(T.redact(F.col("t"))).collect()] == [rows[0][0], "ToKen=[REDACTED]", "a http://[REDACTED]@[REDACTED-HOST]/h/ [REDACTED ACCESS KEY]", ",[REDACTED]", None]
    assert [r[0] for r in texts.select(T.has_secret(F.col("t"))).collect()] == [False, True, True, True, None]
    monkeypatch.setattr(T, "SECRETS", (("(", ""), *T.SECRETS[1:]))  # a rule that can't be run
    assert texts.limit(1).select(T.redact(F.col("t"))).first()[0] == rows[0][0]


def test_a_trace_keeps_only_edges_between_its_ends(spark, monkeypatch):
    sizes, put = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: [t := put(df), sizes.append(t.count())][0])
    way = spark.createDataFrame([("a", "a", "b"), ("a", "a", "b"), ("b", "b", "c"), ("c", "c", "z")], "id string, from string, to string")
    into = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("from"), F.lit("b").alias("to"))
    got = graph.trace_flow(way.unionAll(into).withColumn("status", F.lit("supported")), "a", "z", max_depth=4)
    assert [tuple(r) for r in got.select("depth", F.array_join("edge_ids", "")).collect()] == [(3, "abc")] and max(sizes) < 100


@pytest.mark.parametrize("seed, n, m, depth, most, width", [(1, 7, 20, 5, 20, None), (2, 9, 22, 6, 3, 3)])
def test_first_paths_of_many_ends_against_all_paths(spark, seed, n, m, depth, most, width):
    rng = random.Random(seed)
    edges = [(f"e{i:03}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["supported", "candidate", "unresolved"])) for i in range(m)]
    edges += [(f"d{i:03}", f"x{rng.randrange(3)}", f"n{rng.randrange(n)}", "supported") for i in range(8)]
    sources, targets = ["x0", "x1", "x2", "n0", "n1", "away"], ["n0", "n3", "n4", "away"]
    table = lambda names: spark.createDataFrame([(x,) for x in names], "node string")
    got = graph.trace_flows(spark.createDataFrame(edges + edges[:5], "id string, from string, to string, status string"), table(sources), table(targets), depth, most, width).collect()
    said = {e: s for e, _, _, s in edges}
    for a in sources:
        for b in targets:
            own = [r for r in got if (r["source"], r["target"]) == (a, b)]
            assert sorted((r["depth"], r["edge_ids"]) for r in own) == (simple_paths(edges, a, b, depth)[:most] if a != b else []), (a, b)
            for r in own:
                assert r["nodes"][0] == a and r["nodes"][-1] == b and r["status"] == max((said[e] for e in r["edge_ids"]), key=graph.STATUSES.index)


def test_all_orders_are_traced_to_all_regions(spark, tmp_path):
    lines = [(1, 1, 1), (1, 2, 2), (2, 2, 2), (3, 1, 3), (4, 3, 3), (5, 3, 4), (6, 4, 5), (7, 5, 4), (8, 5, 1), (8, 5, 1), (9, None, 1), (None, 2, 4), (10, 6, 9), (11, 7, None)]
    places = [(1, 1), (2, 2), (3, 3), (4, 1), (5, 4), (6, 2)]
    nations = [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long"), ("supplier", places, "s_suppkey long, s_nationkey long"), ("nation", nations, "n_nationkey long, n_regionkey long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = {(f"o{o}", f"p{p}") for o, p, _ in lines if o and p}
    for _, p, s in lines:
        pairs |= {(f"p{p}", f"s{s}"), (f"s{s}", f"p{p}")} if p and s else set()
    pairs |= {(f"s{s}", f"n{n}") for s, n in places} | {(f"n{n}", f"r{r}") for n, r in nations}
    edges = [(f"{a}>{b}", a, b, "supported") for a, b in pairs]
    want = sorted((d, "|".join(ids)) for o in {a for a, _ in pairs if a[0] == "o"} for r in range(4) for d, ids in simple_paths(edges, o, f"r{r}", 12)[:20])
    assert {d for d, _ in want} == {4, 6, 8, 10}
    assert sorted(map(tuple, QUERIES["flow_trace_of_orders"](spark, str(tmp_path)).select("depth", "edge_ids").collect())) == want
    duck = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted((d, ids) for d, _, ids, _ in duck.execute(ORACLE_SQL["flow_trace_of_orders"]).fetchall()) == want
