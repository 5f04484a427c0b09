"""Scenarios of single operators and of whole runs, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import ids, text
from factloom.operators import capability, chunks, context, diff, extract, graph, impact, incremental, inventory, publish, query, resolve, scope, search, summaries, traverse
from factloom.plans import engine
from factloom.sources import files as sources


def fact(id_, kind, component, value, evidence=("ev-1",)):
    return (id_, kind, component, json.dumps(value), list(evidence), "r")


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), schema.FACTS)


def edges_of(spark, rows, repositories, aliases=None):
    known = graph.resolve_aliases(graph.aliases_of(spark, aliases or {}), spark.createDataFrame([(r,) for r in repositories], "repository_id string"))
    return graph.build_edges(rows, known)


def one(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_canonical_json_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b":1,"a":[2,{"d":1,"c":2}]}', '{"a":[2,{"c":2,"d":1}],"b":1}')], "x string, y string")
    assert df.select((ids.content_hash(F.col("x")) == ids.content_hash(F.col("y"))).alias("same")).first()["same"]


def test_alias_gives_supported_call(spark):
    rows = facts(spark, fact("f", "http_client_base", "consumer", {"base_url": "https://api.example.com/x"}))
    got = edges_of(spark, rows, ["consumer", "producer"], {"https://api.example.com": "producer"})
    assert one(got, "from", "to", "status") == [("component:consumer", "component:producer", "supported")]
    assert edges_of(spark, facts(spark), ["a"]).count() == 0


def test_mounted_route_gives_candidate(spark):
    rows = facts(
        spark, fact("c", "http_client_call", "front", {"path_expression": "${BACKEND_URL}/auth/self-register", "method": "POST"}), fact("m", "http_route_mount", "login", {"path": "/auth"}),
        fact("e", "http_endpoint_fragment", "login", {"path": "/self-register", "method": "POST", "route_scope": "router"}),
    )
    assert one(edges_of(spark, rows, ["front", "login"]), "to", "status") == [("component:login", "candidate")]


def test_ambiguous_and_missing_routes_are_unresolved(spark):
    end = lambda i, c: fact(i, "http_endpoint", c, {"path": "/x", "method": "GET"})
    rows = facts(spark, fact("c", "http_client_call", "a", {"path_expression": "/x", "method": "GET"}), fact("d", "http_client_call", "a", {"uri_expression": "/y"}), end("e", "b"), end("f", "c"), end("g", "a"))
    got = edges_of(spark, rows, ["a", "b", "c"])
    assert {(r["status"], r["limitations"][0]) for r in got.collect()} == {("unresolved", graph.AMBIGUOUS), ("unresolved", graph.NO_TARGET)}


def test_list_of_methods_is_an_endpoint_each(spark):
    rows = facts(spark, fact("e", "http_endpoint", "b", {"path": "x/", "method": ["GET", "POST"]}))
    assert one(graph.endpoint_index(rows), "method", "path") == [("GET", "/x"), ("POST", "/x")]


EDGES = [("edge-1", "frontend", "pedidos", "calls_http", "supported"), ("edge-2", "pedidos", "pagos", "calls_http", "candidate")]


def test_flow_and_relations(spark):
    e = spark.createDataFrame(EDGES, "id string, `from` string, `to` string, type string, status string")
    got = graph.trace_flow(e, "frontend", "pagos")
    assert [(r["depth"], r["nodes"], r["status"]) for r in got.collect()] == [(2, ["frontend", "pedidos", "pagos"], "candidate")]
    assert graph.flow_status(graph.trace_flow(e, "pagos", "frontend")).first()["status"] == "unresolved"
    assert one(graph.relations(e, "pedidos"), "id") == [("edge-1",), ("edge-2",)]
    n = spark.createDataFrame([("component:a", "A"), ("x", "component:a")], "id string, label string")
    assert graph.resolve_node(n, "a") == "component:a" and graph.resolve_node(n, "nobody") is None


def test_typed_pages(spark):
    table = spark.createDataFrame([(f"e{i:04}", "r") for i in range(1500)], "id string, repository_id string")
    got = query.query_typed(table, "r", limit=1200)
    assert got.count() == 1200 and not got.first()["complete"]
    own = facts(spark, *(fact(f"f{i:04}", "data_read", "c", {}) for i in range(1200)))
    assert query.query_facts(own, "data", limit=5000).count() == 1000
    with pytest.raises(ValueError):
        query.query_facts(own, "coverage")


def test_test_paths(spark):
    yes = ["src/test/A.java", "a/b.spec.ts", "tests/x.py", "test_x.py", "src/OrderIT.java", "App.Tests/x.cs"]
    no = ["src/main/A.java", "src/latest.py", "contest/a.ts"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r[0] for r in df.filter(scope.is_test_path(F.col("p"))).collect()}
    assert got == set(yes)


def test_production_scope_masks_targets(spark):
    rows = facts(spark, fact("a", "symbol_call", "c", {"source_path": "src/a.ts", "target_path": "tests/b.ts", "resolution": "supported"}), fact("b", "code_symbol", "c", {"source_path": "tests/b.ts"}))
    got = scope.production_facts(rows).collect()
    assert [r["id"] for r in got] == ["a"]
    assert json.loads(got[0]["value_json"])["resolution"] == "unresolved" and "target_path" not in json.loads(got[0]["value_json"])


def test_coverage_equation(spark):
    rows = [("r", "package.json", 10, "blob", "{}"), ("r", "src/a.ts", 10, "blob", "x"), ("r", "node_modules/x.js", 10, "blob", "x"), ("r", "a.bin", 1, "blob", None), ("r", "b.py", 1, "blob", None), ("r", ".env", 1, "blob", "x")]
    listed = inventory.inventory(spark.createDataFrame(rows, "repository_id string, relative_path string, size long, kind string, text string"))
    c = inventory.coverage(listed).first()
    assert (c["discovered"], c["excluded"], c["processed"], c["unsupported"], c["failed"]) == (6, 2, 2, 1, 1)
    assert c["discovered"] == c["excluded"] + c["eligible"] and c["eligible"] == c["processed"] + c["failed"] + c["unsupported"] + c["not_scanned"]
    assert c["exclusion_reasons"] == {"excluded_directory": 1, "credential_file": 1}


def test_redaction(spark):
    secret = "password=hunter2 x\ntoken: \"abc\"\nBearer abcdefghijklmnop\npostgres://u:p4ss@host/db\n" + "a1" * 26
    got = spark.createDataFrame([(secret,)], "t string").select(text.redact(F.col("t")).alias("t"), text.has_secret(text.redact(F.col("t"))).alias("left"), text.has_secret(F.col("t")).alias("before")).first()
    assert not any(s in got["t"] for s in ("hunter2", "abc\"", "abcdefghijklmnop", "p4ss", "a1a1"))
    assert got["before"] and not got["left"]
    value = spark.createDataFrame([('{"client_secret":"zzz","n":{"url":"https://u:qqq@h/"},"k":"v"}',)], "t string").select(text.redact_json(F.col("t"))).first()[0]
    assert "zzz" not in value and "qqq" not in value and json.loads(value)["k"] == "v"


def test_normal_form(spark):
    got = spark.createDataFrame([("ÁÉñÜ Çedilla ó",)], "t string").select(text.normalise(F.col("t"))).first()[0]
    assert got == "aenu cedilla o"


def test_diff_pairs_by_logical_key(spark):
    base = facts(spark, fact("a", "http_endpoint", "c", {"path": "/x", "method": "GET"}), fact("b", "data_read", "c", {"entity": "t"}))
    target = facts(spark, fact("a2", "http_endpoint", "c", {"path": "/x", "method": "PUT"}), fact("n", "data_read", "c", {"entity": "u"}))
    assert one(diff.compare_facts(base, target).fillna("-"), "change", "before_id", "after_id") == [("added", "-", "n"), ("modified", "a", "a2"), ("removed", "b", "-")]
    assert one(diff.compare_facts(base, target, complete=False).filter("change = 'removed'"), "change") == []
    kept = facts(spark, fact("k", "http_endpoint", "c", {"path": "/x", "method": "GET"}), fact("p", "http_endpoint", "c", {"path": "/x", "method": "POST"}))
    assert one(diff.compare_facts(base, kept).filter("after_id = 'p'"), "change") == [("modified",)]
    assert one(diff.compare_facts(base, kept, strict=True).filter("after_id = 'p'"), "change") == [("added",)]


def test_symbol_cascade(spark):
    symbols = spark.createDataFrame([("c", "s1", "Users", "save", "u.ts"), ("c", "s2", "Orders", "save", "o.ts"), ("c", "s3", None, "help", "h.ts"), ("c", "s4", "Orders", "load", "o.ts")], "component_id string, symbol_id string, class_name string, name string, source_path string")
    calls = spark.createDataFrame([("1", "c", "Orders", "this", "save"), ("2", "c", "Flow", "this.repo", "save"), ("3", "c", "Flow", None, "save"), ("4", "c", "Flow", None, "help"), ("5", "c", "Flow", "x", "nothing"), ("6", "c", "Flow", "made", "load")], "id string, component_id string, caller_class string, receiver string, callee string")
    variables = spark.createDataFrame([("c", "made", "Orders")], "component_id string, variable string, type string")
    injections = spark.createDataFrame([("c", "Flow", "repo", "Users")], "component_id string, class_name string, parameter string, type string")
    got = {r["id"]: (r["target_symbol_id"], r["resolution"]) for r in resolve.resolve_calls(calls, symbols, variables, injections).collect()}
    assert got == {"1": ("s2", "supported"), "2": ("s1", "supported"), "3": (None, "candidate"), "4": ("s3", "supported"), "5": (None, "unresolved"), "6": ("s4", "supported")}


def test_endpoint_composition(spark):
    ends = spark.createDataFrame([("1", "c", "GET", "/a", "h", "src/x.ts", True), ("2", "c", "GET", "/b", "h", "src/user.routes.ts", False), ("3", "c", "GET", "/d", "h", "src/lost.ts", False)], "id string, component_id string, method string, path string, handler string, source_path string, whole boolean")
    mounts = spark.createDataFrame([("c", "/api", "userRouter", "src/app.ts")], "component_id string, path string, symbol string, source_path string")
    none = spark.createDataFrame([], "component_id string, source_path string, target_path string, symbols array<string>")
    assert one(resolve.resolve_endpoints(ends, mounts, none), "id", "path", "status") == [("1", "/a", resolve.WHOLE), ("2", "/api/b", resolve.COMPOSED), ("3", "/d", resolve.FRAGMENT)]


def test_expansion_stops_at_chunks_and_hubs(spark):
    ids_ = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    rows = [("c1", "s:a", "contains_symbol", "supported"), ("c2", "s:a", "contains_symbol", "supported"), ("s:a", "s:b", "calls", "supported"), ("c3", "s:b", "contains_symbol", "supported"), ("c1", "c3", "documents", "supported")]
    links = spark.createDataFrame(rows, "`from` string, `to` string, type string, status string")
    seeds = spark.createDataFrame([("c1",), ("nobody",)], "id string")
    assert one(traverse.expand_context(links, ids_, seeds, 8, 10), "id", "distance") == [("c1", 0), ("c2", 2), ("c3", 3)]
    assert one(traverse.expand_context(links, ids_, seeds, 8, 10, hub_degree=0), "id") == [("c1",)]


def test_cycle(spark):
    e = lambda *r: spark.createDataFrame(list(r), "`from` string, `to` string")
    assert traverse.has_cycle(e(("a", "b"), ("b", "c"), ("c", "a"))) and not traverse.has_cycle(e(("a", "b"), ("b", "c")))


DOC = """# Servicio

Intro `src/a.ts:12` supported

## Contratos

GET /users/{id} uses [[otro|x]] and `UserService.find` ev-1

## Pasos

router and repository
"""


def test_chunks_links_and_context(spark):
    docs = spark.createDataFrame([("Servicios/users/main/servicio.md", DOC), ("Servicios/users/main/flujos/otro.md", "# Flujo GET\n\nGET /users/{id} supported")], "path string, content string")
    own = chunks.build_chunks(docs, "run").cache()
    assert own.count() == 4 and set(own.columns) == {f.split()[0] for f in schema.CHUNKS.replace("struct<method:string,path:string>", "x").split(", ")}
    contract = own.filter("section_type = 'service:contracts'").first()
    assert contract["endpoint"]["path"] == "/users/{id}" and contract["outgoing_links"] == ["otro"] and contract["evidence_ids"] == ["ev-1"] and "UserService.find" in contract["symbols"]
    assert chunks.build_chunks(docs, "next", previous=own).filter("reused").count() == 4
    links = chunks.build_links(own, facts(spark)).cache()
    assert one(links.filter("type = 'documents'"), "type") == [("documents",)]
    assert links.filter("type = 'belongs_to'").count() == 4
    found = search.search_documents(own, "GET /users/{id}")
    assert found.first()["endpoint"]["path"] == "/users/{id}"
    picked, told = context.prepare_context(own, links, "GET /users/{id}", "development")
    row = told.first()
    assert 0 < row["estimated_tokens"] <= 15_000 and picked.count() == row["documents_considered"] * 2 and row["sufficient"]
    cap = capability.fold(own).first()
    assert (cap["id"], cap["name"], cap["confidence"]) == ("users", "Users", "high")


def test_large_sections_are_cut_between_paragraphs(spark):
    docs = spark.createDataFrame([("a.md", "# H\n\n" + "\n\n".join("x" * 40 for _ in range(10)))], "path string, content string")
    got = chunks.split_sections(chunks.sections(docs), 100).orderBy("part").collect()
    assert [r["heading"] for r in got][:2] == ["H · parte 1", "H · parte 2"] and all(len(r["content"]) <= 100 for r in got)


def test_flow_search(spark):
    ends = spark.createDataFrame([("c", "GET", "/permisos-admin", "list", "a.ts"), ("c", "PUT", "/permisos-dni", "put", "b.ts")], "component_id string, method string, path string, handler string, source_path string")
    assert search.find_flows(ends, "permisos de administración").first()["path"] == "/permisos-admin"


def test_budgets_skip_and_go_on(spark):
    rows = [(1, "a", "d1", "r", "document", ["A"], "x" * 40), (2, "b", "d2", "r", "document", ["B"], "x" * 400), (3, "c", "d3", "r", "document", ["C"], "x" * 40)]
    df = spark.createDataFrame(rows, "place int, id string, document_path string, repository_id string, document_type string, symbols array<string>, content string")
    assert one(context.select_within(df, context.Budget(tokens=25)), "id") == [("a",), ("c",)]


def test_capability_overrides(spark):
    caps = spark.createDataFrame([], capability.fold(chunks.build_chunks(spark.createDataFrame([("a.md", DOC)], "path string, content string"), "r")).schema)
    got = capability.with_overrides(
        caps, spark.createDataFrame([("pagos", "Pagos", ["cobros"], ["svc"])], "id string, label string, aliases array<string>, systems array<string>"),
        spark.createDataFrame([("pagos", "business_owner", "svc")], "id string, role string, repository_id string"), spark.createDataFrame([("pagos", "old", "new", "complete")], "id string, `from` string, `to` string, status string"),
    ).first()
    assert got["confidence"] == "low" and got["responsibilities"][0]["role"] == "business owner" and got["legacy_dependencies"][0]["status"] == "supported"


JAVA = """@RestController
@RequestMapping("/users")
public class UserController {
  private final UserService service;
  @GetMapping("/{id}")
  public Mono<User> find(@PathVariable String id) { return service.find(id); }
  @PostMapping("/search")
  public List<User> search() { return service.all(); }
}"""
FLUX = """public class R { RouterFunction<ServerResponse> r(H h) { return route().path("/api", b -> b.GET("/a/{id}", h::get).POST("/b", accept(JSON), h::post)).build(); }
RouterFunction<ServerResponse> q(H h) { return RouterFunctions.route(GET("/old").and(accept(X)), h::old); } }"""
EXPRESS = 'app.use("/auth", authRouter);\nrouter.post("/self", h);\napp.get("/x", (q, s) => s.send(1));\nfetch("/y");\nsb.from("users").select("*");\nsb.from("users").insert({});\n'


def test_extraction_run(spark):
    own = sources.in_memory(spark, {"src/UserController.java": JAVA, "src/R.java": FLUX, "src/app.js": EXPRESS, "src/é.py": "# é\n@app.get('/p')\ndef f():\n    g()\n", "package.json": '{"dependencies": {"express": "1"}}', "node_modules/x.js": EXPRESS})
    run = engine.analyse("run", own)
    found = run["facts"].withColumns({n: ids.field("value_json", n) for n in ("path", "method", "route_order")})
    assert one(found.filter("rule_id = 'spring.annotated-endpoint'"), "method", "path") == [("GET", "/users/{id}"), ("POST", "/users/search")]
    assert one(found.filter("rule_id = 'webflux.functional-route'"), "route_order", "path") == [("1", "/api/a/{id}"), ("2", "/api/b"), ("3", "/old")]
    assert found.filter("kind = 'http_endpoint_fragment'").count() == 2 and found.filter("kind = 'http_route_mount'").count() == 1
    assert found.filter("rule_id = 'supabase.write'").count() == 1 and found.filter("kind = 'package_dependency'").count() == 1
    assert incremental.orphans(run["facts"], run["evidence"]).isEmpty()
    place = run["evidence"].filter("rule_id = 'python.fastapi.decorator'").first()["locator"]
    assert "# é\n@app.get('/p')\ndef f():\n    g()\n".encode()[place["start"] : place["end"]] == b"@app.get('/p'"
    shown = extract.read_evidence(run["evidence"].filter("rule_id = 'python.fastapi.decorator'"), own)
    assert shown.first()["snippet"] == "@app.get('/p')"
    with pytest.raises(ValueError):
        extract.read_evidence(run["evidence"], own, max_files=1)


def test_refresh_equals_full_run(spark):
    before = {"a.py": "@app.get('/a')\ndef f():\n    pass\n", "b.py": "@app.get('/b')\ndef g():\n    pass\n", "c.py": "x = 1\n"}
    after = before | {"a.py": "@app.get('/a2')\ndef f():\n    pass\n"}
    del after["c.py"]
    base = engine.analyse("one", sources.in_memory(spark, before, snapshot_id="s1"))
    own = sources.in_memory(spark, after, snapshot_id="s2")
    how, got = engine.refresh("two", base, own)
    full = engine.analyse("two", own)
    assert how == "incremental"
    columns = ("kind", "component_id", "value_json", "evidence_ids")
    assert one(got["facts"], *columns) == one(full["facts"], *columns)
    assert engine.refresh("three", full, own)[0] == "unchanged"
    changed = engine.compare(base, full).groupBy("change").count()
    assert {r[0] for r in changed.collect()} == {"added", "removed"}  # another path is another endpoint


def test_impact(spark):
    row = spark.createDataFrame([(2, 3, 1, 1, 2, 1, 5)], "repositories long, consumers long, synchronous_dependencies long, messages long, data_resources long, unresolved_relations long, evidence long")
    got = impact.levels(row).first()
    assert (got["score"], got["complexity"], got["criticality"], got["confidence"]) == (16, "alta", "crítica", "media")


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    files = spark.createDataFrame([("a.md", "one"), ("b/c.md", "two")], "path string, content string")
    publish.publish(files, root, "e1")
    publish.publish(files.withColumn("content", F.concat("content", F.lit("!"))), root, "e2")
    assert {r["content"] for r in publish.current(spark, root).collect()} == {"one!", "two!"}
    publish.restore(spark, root, "e1")
    assert {r["content"] for r in publish.current(spark, root).collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        publish.publish(files.withColumn("content", F.lit("password=hunter2")), root, "e3")
    newest, rest = publish.pointers(spark.createDataFrame([("a", 1), ("b", 2)], "edition_id string, published_at long"))
    assert one(newest, "edition_id") == [("b",)] and one(rest, "edition_id") == [("a",)]


def test_manifests_refuse_what_is_hostile():
    assert sources.parse_manifest("a.jsonc", '{"a": [1, 2,], // x\n "u": "http://x"}') == {"a": [1, 2], "u": "http://x"}
    assert sources.parse_manifest("a.toml", "[x]\ny = 1") == {"x": {"y": 1}}
    assert sources.parse_manifest("pom.xml", "<p><a>1</a><a>2</a></p>") == {"p": {"a": ["1", "2"]}}
    for path, bad in (("x.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a/>'), ("x.json", "[" * 70 + "]" * 70), ("x.yaml", "a: *b\n" * 30), ("x.bin", "")):
        with pytest.raises(ValueError):
            sources.parse_manifest(path, bad)


def test_git_tree(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("@app.get('/a')\n")
    (tmp_path / "l").symlink_to("a.py")
    run("add", "-A")
    run("-c", "user.name=x", "-c", "user.email=x@x", "commit", "-qm", "x")
    got = sources.with_text(sources.read_git_tree(spark, str(tmp_path), repository_id="r"))
    assert one(got, "relative_path", "kind") == [("a.py", "blob"), ("l", "symlink")]
    assert got.filter("relative_path = 'a.py'").first()["text"] == "@app.get('/a')\n"
    with pytest.raises(ValueError):
        sources.checked_ref("-x")
    listing = "100644 blob " + "a" * 40 + "      12\tx y.py\x00160000 commit " + "b" * 40 + "       -\tsub\x00"
    rows = spark.createDataFrame([(listing,)], "l string").select(F.explode(sources.parse_tree(F.col("l"))).alias("e")).select("e.*").collect()
    assert [(r["relative_path"], r["kind"], r["size"]) for r in rows] == [("x y.py", "blob", 12), ("sub", "submodule", None)]


def test_stream_equals_batch(spark, tmp_path):
    from factloom.streaming import refresh

    rows = [("r", "s", "a.py", "@app.get('/a')\n", "2024-01-01 00:00:00"), ("r", "s", "a.py", "@app.get('/a2')\n", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "repository_id string, snapshot_id string, relative_path string, text string, captured_at string").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = refresh.merge_facts(refresh.read_files(spark, f"{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    got = refresh.current_facts(spark, f"file://{tmp_path}/out").filter("kind = 'http_endpoint'")
    assert one(got.select(ids.field("value_json", "path").alias("p")), "p") == [("/a2",)]


def test_tables_and_diagrams(spark):
    e = spark.createDataFrame([("g", "a|b", "c", "calls")], "g string, `from` string, `to` string, type string")
    assert "a\\|b" in summaries.markdown_table(e, ["from", "to"], ["from"], "g").first()["table"]
    assert summaries.mermaid_graph(e, "g").first()["diagram"].startswith("graph LR\n")


APP = {
    "src/a.ts": "export class Store {\n  load(id: string) { return id; }\n}\n", "src/b.ts": "import { Store } from './a';\nexport class Flow {\n  constructor(private readonly store: Store) {}\n  run(x: string) { return this.store.load(x); }\n}\n",
    "src/main.ts": "import { Flow } from './b.js';\nconst store = new Store();\nconst flow = new Flow(store);\n", "node_modules/x.js": "fetch('/y');\n", "main/java/com/a/K.java": "package com.a;\npublic class K { void go() { help(); } void help() { } }\n",
    "main/java/com/b/L.java": "import com.a.K;\npublic class L { void x() { } }\n", "build.gradle": "implementation project(':core:api')\n", "settings.gradle": "include ':core:api', ':web'\n",
}


def repositories(spark, files, snapshot):
    both = [sources.in_memory(spark, own, snapshot_id=f"{snapshot}-{name}", repository_id=name) for name, own in files.items()]
    return both[0].unionByName(both[1])


def test_facts_know_each_other(spark):
    facts = engine.analyse("run", sources.in_memory(spark, APP))["facts"]
    get = lambda kind, *names: sorted(tuple(json.loads(r["value_json"]).get(n) for n in names) for r in facts.filter(F.col("kind") == kind).collect())
    assert get("module_dependency", "source_path", "target_path", "external") == [("main/java/com/b/L.java", "main/java/com/a/K.java", False), ("src/b.ts", "src/a.ts", False), ("src/main.ts", "src/b.ts", False)]
    assert ("load", "Store", "src/a.ts", "supported") in get("symbol_call", "callee_name", "target_class", "target_path", "resolution")
    assert ("help", "K", "main/java/com/a/K.java", "supported") in get("symbol_call", "callee_name", "target_class", "target_path", "resolution")
    assert get("dependency_binding", "consumer_class", "injection_point", "implementation_type", "argument", "resolution") == [("Flow", "store", "Store", "store", "supported")]
    assert get("build_module", "module") == [(".",), (".",), ("core/api",), ("web",)] and get("build_module_dependency", "target_module") == [("core/api",)]
    symbol = next(json.loads(r["value_json"]) for r in facts.filter("kind = 'code_symbol'").collect() if json.loads(r["value_json"])["name"] == "load")
    assert (symbol["start_line"], symbol["end_line"], symbol["source_set"], symbol["layer"], symbol["role"]) == (2, 2, "root", "root", "module") and symbol["description"].startswith("Obtiene o consulta") and "return id" in symbol["snippet"]
    assert incremental.orphans(facts, engine.analyse("run", sources.in_memory(spark, APP))["evidence"]).isEmpty()


def test_refresh_reads_importers_and_keeps_repositories_apart(spark):
    before = {"one": APP, "two": {"src/a.ts": "export class Other {}\n", "src/z.py": "x = 1\n"}}
    changed = APP | {"src/a.ts": APP["src/a.ts"].replace("load", "fetchAll"), "src/new.py": "def n():\n    pass\n", "node_modules/w.js": "fetch('/q');\n"}
    after = {"one": changed, "two": {"src/a.ts": "export class Other {}\n"}}
    base = engine.analyse("a", repositories(spark, before, "s1"))
    own = repositories(spark, after, "s2")
    how, got = engine.refresh("b", base, own)
    full = engine.analyse("b", own)
    assert how == "incremental"
    assert one(got["facts"], "id", "kind", "component_id", "value_json", "evidence_ids") == one(full["facts"], "id", "kind", "component_id", "value_json", "evidence_ids")
    columns = ("id", "repository_id", "snapshot_id", "relative_path", "source_hash", "rule_id")
    assert one(got["evidence"], *columns) == one(full["evidence"], *columns)
    for name in ("coverage", "files"):
        shared = [c for c in full[name].columns if c not in ("exclusion_reasons", "content")]
        assert sorted(map(str, (r for r in got[name].select(shared).collect()))) == sorted(map(str, (r for r in full[name].select(shared).collect())))
    calls = [json.loads(r["value_json"]) for r in got["facts"].filter("kind = 'symbol_call' and component_id = 'one'").collect()]
    assert [c["resolution"] for c in calls if c["callee_name"] == "load"] == ["unresolved"]  # b.ts calls what a.ts has no more
    imports = spark.createDataFrame([("one\u0001src/b.ts", "one\u0001src/a.ts"), ("one\u0001src/main.ts", "one\u0001src/b.ts")], "source_path string, target_path string")
    stale = incremental.plan_refresh(spark.createDataFrame([("one\u0001src/a.ts", "modified")], "path string, change string"), imports)[1]
    assert {r["path"].split("\u0001")[1] for r in stale.collect()} == {"src/a.ts", "src/b.ts", "src/main.ts"}
    assert engine.refresh("c", full, own)[0] == "unchanged"
    assert engine.refresh("d", full, repositories(spark, after | {"two": after["two"] | {"package.json": "{}"}}, "s3"))[0] == "full"


def test_values_are_redacted_at_any_depth(spark):
    cases = {
        '{"handler_expression":"login(x, password=hunter2)"}': '{"handler_expression":"login(x, password=[REDACTED]"}', '{"password":12345,"a":1}': '{"password":"[REDACTED]","a":1}', '{"secret":{"a":"zzz"}}': '{"secret":"[REDACTED]"}',
        '{"list":[{"apiKey":null},"https://u:p@h/x"]}': '{"list":[{"apiKey":"[REDACTED]"},"https://[REDACTED]@[REDACTED-HOST]/h/x"]}', '{"plain":[1,2,"three"]}': '{"plain":[1,2,"three"]}', "no json, token=abc": "no json, token=[REDACTED]",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", text.redact_json(F.col("t")).alias("v")).collect()}
    assert got == dict(enumerate(cases.values())) | {99: None}
    facts = engine.analyse("r", sources.in_memory(spark, {"a.js": "router.post('/l', login(x, password=hunter2));"}))["facts"]
    assert not facts.filter(F.contains("value_json", F.lit("hunter2"))).count()


def test_stacks_and_their_rules(spark):
    own = inventory.inventory(sources.in_memory(spark, {"package.json": '{"dependencies": {"express": "1"}}', "src/a.ts": "x", "b.py": "y", "pom.xml": "<p>org.springframework</p>", "A.java": "class A {}", "node_modules/q.cs": "z"}))
    signals = inventory.technology_signals(own)
    assert {r["technology"] for r in signals.collect()} == {"express", "spring"}
    from factloom.operators import architecture

    stacks = {r["plugin_id"]: r["evidence_paths"] for r in architecture.candidate_stacks(own, signals).collect()}
    assert stacks == {"python": ["b.py"], "java-spring": ["A.java"], "node-express": ["src/a.ts"], "source-architecture": ["src/a.ts", "A.java"]}
    assert one(inventory.technologies(own, signals), "relative_path", "technology") == [("package.json", "express"), ("package.json", "nodejs"), ("pom.xml", "java"), ("pom.xml", "spring")]
    assert extract.rules_of(["python"]) >= {"python.flask.route"} and not extract.rules_of(["python"]) & extract.rules_of(["dotnet"])
    with pytest.raises(ValueError):
        extract.rules_of(["cobol"])


def test_cached_extraction_heals(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    own = sources.in_memory(spark, {"a.py": "@app.get('/a')\ndef f():\n    pass\n", "b.py": "x = 1\n"})
    want = one(extract.extract(own), "relative_path", "rule_id", "start", "value_json")
    for _ in range(2):
        assert one(extract.extract_cached(own, root), "relative_path", "rule_id", "start", "value_json") == want
    assert spark.read.parquet(f"{root}/entries").count() == 2  # the second run has read no file
    spark.read.parquet(f"{root}/findings").limit(1).write.mode("append").parquet(f"{root}/findings")  # an entry isn't what it was
    assert one(extract.extract_cached(own, root), "relative_path", "rule_id", "start", "value_json") == want
    assert spark.read.parquet(f"{root}/entries").count() == 3


def test_configuration(spark, tmp_path):
    from factloom.sources import config

    value = {"schema_version": 3, "vault_path": "vault", "repositories": [{"id": "a", "path": "repos/a", "default_branch": "main"}, {"id": "b", "path": "repos/b", "enabled": False}]}
    config.write_config(str(tmp_path / "knowledge.yaml"), value)
    got, rows = config.read_config(spark, str(tmp_path / "knowledge.yaml"))
    assert got == value and one(rows, "repository_id", "root", "enabled") == [("a", str(tmp_path / "repos/a"), True), ("b", str(tmp_path / "repos/b"), False)]
    for bad in ({**value, "repositories": value["repositories"][:1] * 2}, {**value, "vault_path": "repos/a/x"}, {"schema_version": 2}):
        with pytest.raises(ValueError):
            config.write_config(str(tmp_path / "bad.yaml"), bad)
    (tmp_path / "old.yaml").write_text("repositories:\n  - name: a\n    path: p\n    enabled: true\n    url: https://u:p@h/x\n  - name: b\n")
    plan, decisions, conflicts = config.legacy_plan(spark, str(tmp_path / "old.yaml"))
    assert [r["id"] for r in plan["repositories"]] == ["a", "b"] and conflicts == ["repositories[1].path"] and decisions.filter("decision = 'historical' and value = '[redacted]'").count() == 1
    config.write_workspace(str(tmp_path / "w.code-workspace"), {"x": "repos/a"}, {"settings": {}})
    assert one(config.read_workspace(spark, str(tmp_path / "w.code-workspace")), "name", "path") == [("x", str(tmp_path / "repos/a"))]


def test_old_editions_go(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    files = spark.createDataFrame([("a.md", "one")], "path string, content string")
    for e in ("e1", "e2", "e3"):
        publish.publish(files, root, e)
    assert publish.retain(spark, root, 2) == ["e1"] and not (tmp_path / "out/editions/e1").exists() and publish.current(spark, root).count() == 1
