"""Composed answers on a small run: what endpoints reach, flows, migrations, proposals and documents."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import publish, resolve, traverse, vault
from factloom.plans import answers, engine
from factloom.sources import files

CODE = {
    "src/store.ts": "export class Store {\n  load(id: string) { return sb.from('orders').select('*'); }\n}\n",
    "src/flow.ts": "import { Store } from './store';\nexport class Flow {\n  constructor(private readonly store: Store) {}\n  run(x: string) { return this.store.load(x); }\n}\n",
    "src/main.ts": "import { Flow } from './flow';\nconst store = new Store();\nconst flow = new Flow(store);\napp.get('/orders/', (q, s) => flow.run(q));\napp.get('/none', (q, s) => nobody.does(q));\n",
    "package.json": '{"dependencies": {"express": "1"}}',
}


@pytest.fixture(scope="module")
def run(spark):
    got = engine.analyse("r", files.in_memory(spark, CODE))
    docs = answers.prepare_documentation(got)
    return engine.document(got, docs)


def test_handlers(spark):
    rows = [(i, "c", h, "a.ts") for i, h in enumerate(["auth, (q, s) => ctl.save(q)", "save", "async (q) => helper", "other.save (x)", "missing"])]
    ends = spark.createDataFrame(rows, "id int, component_id string, handler string, source_path string")
    symbols = spark.createDataFrame([("c", "save", "s1", "b.ts", "Other"), ("c", "save", "s2", "c.ts", "Ctl"), ("c", "helper", "s3", "a.ts", None)], "component_id string, name string, symbol_id string, source_path string, class_name string")
    variables = spark.createDataFrame([("c", "ctl", "Ctl")], "component_id string, variable string, type string")
    got = {r["id"]: r["symbol_id"] for r in resolve.handler_symbol(ends, symbols, variables).collect()}
    assert got == {0: "s2", 1: "s1", 2: "s3", 3: "s1", 4: None}


def test_endpoint(run):
    told = answers.explain_endpoint(run["facts"], "repo", "get", "/orders")
    assert [(r["class_name"], r["name"]) for r in told["steps"].orderBy("depth").collect()] == [("Flow", "run"), ("Store", "load")]
    assert [(r["kind"], r["entity"], r["operation"]) for r in told["data"].filter("kind = 'data_read'").collect()] == [("data_read", "orders", "select")]
    assert told["answer"].first()["status"] in ("supported", "partial")
    assert answers.explain_endpoint(run["facts"], "repo", "PUT", "/orders")["answer"].first()["limitations"] == [answers.NO_ENDPOINT]
    lost = answers.explain_endpoint(run["facts"], "repo", "GET", "/none")
    assert lost["answer"].first()["status"] == "partial" and lost["steps"].count() == 0


def test_service_and_flows(run):
    told = answers.explain_service(run["facts"], run["edges"], "repo")
    assert tuple(told["summary"].select("endpoints", "classes", "truncated").first()) == (2, 2, False)
    assert {r["owner"]: [m["name"] for m in r["methods"] if m["name"] != "constructor"] for r in told["classes"].collect()} == {"Flow": ["run"], "Store": ["load"]}
    assert answers.explain_service(run["facts"], run["edges"], "repo", symbols=1)["classes"].count() == 1
    assert [(r["path"], r["score"]) for r in answers.find_flows(run["facts"], "orders", "repo").collect()] == [("/orders/", 8)]
    page = answers.document_flow(run["facts"], "repo", "GET", "/orders").first()
    assert page["path"] == "Consultas/repo/get-orders.md" and "| 1 | Store | load |" in page["content"]
    with pytest.raises(ValueError):
        answers.document_flow(run["facts"], "repo", "GET", "/nowhere")


def test_documents(spark, run, tmp_path):
    docs = answers.prepare_documentation(run)
    rows = {r["path"]: r["content"] for r in docs.collect()}
    assert len(rows) == docs.count()
    at = "Servicios/repo/main/"
    assert {f"{at}{n}.md" for n in ("servicio", "codigo", "estructura", "modulos", "capas", "routers", "arquitectura")} <= rows.keys() | {f"{at}routers.md"} and "Inicio.md" in rows
    load = next(c for p, c in rows.items() if p.startswith(f"{at}metodos/store-load-"))
    assert "`Flow.run`" in load and "return sb" in load
    assert "importa" in rows[f"{at}arquitectura.md"] and "inyecta" in rows[f"{at}arquitectura.md"]
    assert publish.publish(docs.select("path", "content"), f"file://{tmp_path}/out", "e1").count() == len(rows)


def test_lock(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    with publish.locked(spark, root):
        with pytest.raises(RuntimeError):
            publish.publish(spark.createDataFrame([("a.md", "one")], "path string, content string"), root, "e1")
    publish.publish(spark.createDataFrame([("a.md", "one")], "path string, content string"), root, "e1", keep=1)
    assert publish.current(spark, root).count() == 1


def test_near_edges(spark):
    e = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("c", "b", "d"), ("c", "d", "e"), ("x", "a", "z")], "component_id string, `from` string, `to` string")
    s = spark.createDataFrame([("1", "c", "a"), ("2", "x", "a"), ("3", "c", "e")], "start string, component_id string, node string")
    got = sorted(tuple(r) for r in traverse.near_edges(e, s, max_depth=2).collect())
    assert got == [("1", "a", "b", 0), ("1", "b", "a", 1), ("1", "b", "d", 1), ("2", "a", "z", 0)]
    assert traverse.near_edges(e, s, max_edges=1).count() == 2


def test_questions(run):
    flow = answers.trace_business_flow(run, "orders")
    assert flow["entrypoints"].count() > 0
    assert answers.explain_responsibilities(run, "orders").count() == 1
    assert answers.explain_responsibilities(run, "zzzz").first()["status"] == "unresolved"
    step = answers.investigate_flow(run, "orders", 3)
    assert step["step"].count() == 1 and step["evidence"].count() <= 20
    told = answers.assess_migration(run, "move orders", "repo", "other")
    assert told["answer"].first()["status"] == "candidate" and told["impact"].count() == 1
    assert told["remaining"].count() == run["edges"].filter("`from` = 'component:repo' or `to` = 'component:repo'").count()
    row = answers.prepare_proposal(run, "migration", "move orders", ["keep contracts"]).first()
    assert row["scope"] == ["repo"] and row["decisions"] == ["keep contracts"] and len(row["phases"]) == 4 and row["confidence"] in ("high", "medium", "low")
    assert answers.prepare_proposal(run, "adr", "move orders").first()["proposal_id"] != row["proposal_id"]
    with pytest.raises(ValueError):
        answers.prepare_proposal(run, "poem", "x")
