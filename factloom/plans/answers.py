"""What a user asks of a run: endpoints, services, flows, changes, migrations, investigations, proposals and documents.

Each answer is a dict of tables, or one table; what can be large (steps, facts, relations) stays distributed. Facts are those of
production code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import field, sha256, stable_id
from ..functions.text import simple_type
from ..operators import capability, context, graph, impact, resolve, scope, search, summaries, traverse, vault
from ..operators.query import of_component
from ..sources.storage import cut
from .engine import Run, prepare_context

ENDPOINT_KINDS = ("http_endpoint", "http_endpoint_fragment", "http_route_mount", "module_dependency")  # what endpoints_of() reads
DATA_KINDS = ("data_read", "data_write", "data_entity", "data_resource")
# How what is missing or not certain is said.
NO_ENDPOINT = "No existe un endpoint extraído que coincida exactamente con método y ruta."
NO_CAPABILITY = "No se localizó una capacidad documental relacionada."
NO_OWNER = "La propiedad de negocio necesita confirmación humana en overrides.intelligence.ownership."
NO_TARGET_FLOW = "Flujo objetivo pendiente de confirmar con evidencia adicional."
MIGRATION_PHASES = ("Preparación y compatibilidad", "Transición controlada", "Verificación", "Retiro posterior a aprobación")
REACTIVE = r"\b(map|flatMap|filter|collectList|onErrorResume|switchIfEmpty|zip|then)\b"


def _none() -> Column:
    return F.lit(None).cast("string")


# --- endpoints and services -----------------------------------------------------------------------------------------


def endpoints_of(facts: DataFrame) -> DataFrame:
    """(id, component_id, method, path, handler, source_path, status) of endpoints, a fragment once for each mount; several methods
    are a row each."""
    value = F.col("value_json")
    own = facts.filter(F.col("kind").isin("http_endpoint", "http_endpoint_fragment"))
    methods = field(value, "method")
    ends = own.select(
        "id", "component_id", F.explode(F.coalesce(F.from_json(methods, "array<string>"), F.array(F.coalesce(methods, F.lit(graph.UNKNOWN))))).alias("method"), F.coalesce(field(value, "path"), F.lit("")).alias("path"),
        F.coalesce(field(value, "handler_expression"), F.lit("")).alias("handler"), field(value, "source_path").alias("source_path"),
        ((F.col("kind") == "http_endpoint") | F.coalesce(field(value, "route_scope") == "application", F.lit(False))).alias("whole"),
    )
    mounts = facts.filter("kind = 'http_route_mount'").select("component_id", field(value, "path").alias("path"), field(value, "router_symbol").alias("symbol"), field(value, "source_path").alias("source_path")).dropna()
    v = F.from_json("value_json", "source_path string, target_path string, imports array<string>")
    imports = facts.filter("kind = 'module_dependency'").select("component_id", v.alias("v")).select("component_id", "v.source_path", "v.target_path", F.col("v.imports").alias("symbols")).dropna()
    return resolve.resolve_endpoints(ends, mounts, imports)


def symbols_of(facts: DataFrame) -> DataFrame:
    names, numbers = ("symbol_id", "name", "class_name", "symbol_type", "signature", "description", "source_path", "snippet"), ("start_line", "end_line")
    told = F.json_tuple("value_json", *names, *numbers).alias(*names, *numbers)  # a value is read once
    own = facts.filter("kind = 'code_symbol'").select("component_id", "evidence_ids", told).withColumns({n: F.col(n).cast("int") for n in numbers})
    return own.filter("symbol_id is not null and name is not null")


def calls_of(facts: DataFrame) -> DataFrame:
    """(id, component_id, from, to, and what the call says)."""
    names = ("callee_name", "caller_name", "caller_class", "expression", "receiver", "target_path")
    told = F.json_tuple("value_json", "caller_symbol_id", "target_symbol_id", *names, "resolution").alias("from", "to", *names, "resolution")
    own = facts.filter("kind = 'symbol_call'").select("id", "component_id", told).withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))
    return own.filter("`from` is not null")


def variables_of(facts: DataFrame) -> DataFrame:
    value = F.col("value_json")
    return facts.filter("kind = 'object_construction'").select("component_id", F.regexp_replace(field(value, "variable"), "^this[.]", "").alias("variable"), simple_type(field(value, "constructed_type")).alias("type")).dropna()


def _route(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(path), "/+$", ""), F.lit("")), F.lit("/"))


def explain_endpoint(facts: DataFrame, component: str, method: str, path: str, max_depth: int = 12, max_symbols: int = 80, max_calls: int = 160) -> dict[str, DataFrame]:
    """endpoint, steps (symbols with the hops to them), calls, data and integrations of the files that are reached, and answer: one
    row with a status and limitations. Without such an endpoint, answer alone says so and the others are empty."""
    own = cut(scope.production_facts(facts.filter(of_component(component))))
    named = endpoints_of(own).filter((F.upper("method") == method.upper()) & (_route(F.col("path")) == _route(F.lit(path)))).orderBy("source_path", "id").limit(1)
    known, calls = cut(symbols_of(own)), cut(calls_of(own))  # each hop reads them
    endpoint = cut(resolve.handler_symbol(named, known, variables_of(own)))
    start = endpoint.filter("symbol_id is not null").select(F.col("symbol_id").alias("node"))
    reached, made = traverse.endpoint_flow(calls, known, start, max_depth, max_symbols, max_calls)
    made = cut(made)
    steps = cut(known.join(reached.withColumnRenamed("node", "symbol_id"), "symbol_id").drop("snippet", "evidence_ids"))
    value = F.col("value_json")
    placed = own.filter(F.col("kind").isin(*DATA_KINDS, "http_client_call")).withColumn("source_path", field(value, "source_path"))
    used = cut(traverse.flow_resources(reached, known, placed, endpoint.select(F.col("source_path").alias("path"))))
    operation = F.coalesce(field(value, "operation"), F.when(F.col("kind") == "data_read", "read").when(F.col("kind") == "data_write", "write").otherwise("reference"))
    data = used.filter(F.col("kind").isin(*DATA_KINDS)).select("kind", F.coalesce(field(value, "entity", "table", "resource", "name"), F.lit("dato no nombrado")).alias("entity"), operation.alias("operation"), "source_path", "evidence_ids")
    out = used.filter("kind = 'http_client_call'").select(
        F.coalesce(field(value, "method"), F.lit(graph.UNKNOWN)).alias("method"), F.coalesce(field(value, "path_expression", "uri_expression", "base_url", "target"), F.lit("destino no resuelto")).alias("target"), "source_path", "evidence_ids"
    )
    counts = made.agg(F.count_if(F.col("resolution") != "supported").alias("open"), F.count(F.lit(1)).alias("calls")).crossJoin(steps.agg(F.count(F.lit(1)).alias("symbols")))  # one row each
    found = endpoint.agg(F.count(F.lit(1)).alias("n"), F.count("symbol_id").alias("started"), F.min("handler").alias("handler")).crossJoin(counts)
    said = F.when(F.col("n") == 0, F.array(F.lit(NO_ENDPOINT))).otherwise(F.array_compact(F.array(
        F.when(F.col("started") == 0, F.concat(F.lit("No se pudo enlazar el handler «"), "handler", F.lit("» con un símbolo AST."))),
        F.when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" llamada(s) del flujo conservan resolución candidata o no resuelta."))),
        F.when(F.col("symbols") >= max_symbols, F.lit(f"El flujo se limitó a {max_symbols} símbolos para mantener una respuesta compacta.")),
        F.when(F.col("calls") >= max_calls, F.lit(f"La respuesta se limitó a {max_calls} llamadas para mantener el contexto compacto.")),
    )))
    status = F.when(F.col("n") == 0, "unresolved").when(F.size("limitations") == 0, "supported").otherwise("partial")
    answer = found.withColumn("limitations", said).select(F.lit(component).alias("component"), F.lit(method.upper()).alias("method"), F.lit(path).alias("path"), status.alias("status"), "limitations")
    return {"answer": answer, "endpoint": endpoint, "steps": steps, "calls": made, "data": data, "integrations": out}


def explain_service(facts: DataFrame, edges: DataFrame, component: str, symbols: int = 80) -> dict[str, DataFrame]:
    """summary (one row), endpoints, relations, classes with their methods, and functions without a class. Of symbols, as many are
    listed as asked for: a class takes one place at least, and functions the places that classes leave."""
    own = cut(scope.production_facts(facts.filter(of_component(component))))
    known = symbols_of(own)
    ends, me = endpoints_of(own), f"component:{component}"
    direction = F.when(F.col("from") == me, "outgoing").otherwise("incoming")
    touching = edges.filter((F.col("from") == me) | (F.col("to") == me)).select(direction.alias("direction"), "type", "from", "to", "status", "limitations")
    owner = F.coalesce("class_name", F.when(F.col("symbol_type") == "class", F.col("name")))
    value = F.col("value_json")
    tech = own.filter(F.col("kind").isin("technology", "package_dependency")).agg(F.array_sort(F.collect_set(field(value, "package", "technology", "name", "value"))).alias("technologies"))
    counts = known.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct(owner).alias("classes"))
    # one row each
    summary = counts.crossJoin(ends.agg(F.count(F.lit(1)).alias("endpoints"))).crossJoin(touching.agg(F.count(F.lit(1)).alias("relations"))).crossJoin(tech)
    rows = known.withColumn("owner", owner).withColumn("_method", F.col("class_name").isNotNull())
    # each takes a place at least, so the window sees no more rows than symbols are asked for
    ordered = rows.filter("owner is not null").groupBy("owner").agg(F.count_if("_method").alias("_methods")).orderBy("owner").limit(max(1, symbols))
    taken = ordered.withColumn("_before", F.coalesce(F.sum(F.greatest("_methods", F.lit(1))).over(Window.orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < symbols)
    numbered = rows.filter("_method").withColumn("_n", F.row_number().over(Window.partitionBy("owner").orderBy("source_path", "start_line", "symbol_id")))
    method = F.struct("_n", "name", "signature", "description", "source_path", "start_line")
    listed = taken.join(numbered, "owner", "left").filter(F.coalesce(F.col("_n") + F.col("_before") <= symbols, F.lit(True)))
    classes = listed.groupBy("owner").agg(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), method))).alias("methods"))
    used = taken.agg(F.coalesce(F.sum(F.greatest("_methods", F.lit(1))), F.lit(0)).alias("used")).first()["used"]
    alone = known.filter("class_name is null and symbol_type <> 'class'").orderBy("source_path", "start_line", "symbol_id").limit(max(0, symbols - used))
    told = summary.withColumns({"component": F.lit(component), "truncated": F.col("symbols") > symbols})
    return {"summary": told, "endpoints": ends.select("method", "path", "handler", "source_path", "status"), "relations": touching, "classes": classes, "functions": alone.select("name", "signature", "description", "source_path", "start_line")}


def find_flows(facts: DataFrame, question: str, component: str, limit: int = 20) -> DataFrame:
    """Endpoints of a component by the words of a question, the best first."""
    own = facts.filter((F.col("component_id") == component) & F.col("kind").isin(*ENDPOINT_KINDS))
    ends = endpoints_of(cut(scope.production_facts(own)))  # read once for endpoints, mounts and imports
    return search.find_flows(ends, question, component, limit).select("component_id", "method", "path", "handler", "source_path", "score")


def document_flow(facts: DataFrame, component: str, method: str, path: str) -> DataFrame:
    """(path, content): one document about an endpoint. An endpoint that isn't there is an error."""
    told = explain_endpoint(facts, component, method, path)
    answer = told["answer"].first()
    if answer["status"] == "unresolved":
        raise ValueError(answer["limitations"][0])

    def part(head: str, columns: list[str], rows: DataFrame, cells: list[Column], order: list[str], nothing: str) -> DataFrame:
        table = f"## {head}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
        listed = vault.lines(rows.withColumn("_k", F.lit(1)), "_k", cells, order, table, "text")
        return listed.agg(F.coalesce(F.min("text"), F.lit(f"{table}| {' | '.join([nothing] * len(columns))} |")).alias("text"))

    steps = part("Pasos", ["Salto", "Tipo", "Operación", "Descripción", "Archivo"], told["steps"], [F.col("depth"), F.coalesce("class_name", F.lit("Función independiente")), F.col("name"), F.col("description"), F.concat_ws(":", "source_path", "start_line")], ["depth", "symbol_id"], "No resuelto")
    calls = part("Llamadas", ["Expresión", "Resolución"], told["calls"], [F.col("expression"), F.col("resolution")], ["depth", "id"], "No detectada")
    data = part("Datos", ["Operación", "Entidad", "Archivo"], told["data"], [F.col("operation"), F.col("entity"), F.col("source_path")], ["entity", "operation"], "No detectado")
    out = part("Integraciones", ["Método", "Destino", "Archivo"], told["integrations"], [F.col("method"), F.col("target"), F.col("source_path")], ["target", "method"], "No detectada")
    limits = "\n".join(f"- {x}" for x in answer["limitations"]) or "- Sin limitaciones semánticas adicionales detectadas."
    head = told["endpoint"].select(F.concat(F.lit(f"# Entrada {method.upper()} "), "path", F.lit(f"\n\nServicio: **{component}**\nHandler observado: `"), "handler", F.lit("`\nEstado: **"), "status", F.lit("**\nArchivo de origen: `"), "source_path", F.lit("`")).alias("text"))
    whole = head
    for i, table in enumerate((steps, calls, data, out)):
        whole = whole.crossJoin(table.withColumnRenamed("text", f"text{i}"))  # one row each
    slug = told["endpoint"].select(vault.flow_slug(F.col("method"), F.col("path")).alias("slug")).first()["slug"]
    return whole.select(F.lit(f"Consultas/{component}/{slug}.md").alias("path"), F.concat_ws("\n\n", *whole.columns, F.lit(f"## Limitaciones\n\n{limits}\n")).alias("content"))


# --- questions over documents ---------------------------------------------------------------------------------------


def trace_business_flow(run: Run, question: str) -> dict[str, DataFrame]:
    """entrypoints, steps and relations of what documents say about a question."""
    selected, told = prepare_context(run, question, "responsibilities")
    parts = selected.filter("repository_id <> '_workspace'").select(F.concat(F.lit("component:"), "repository_id").alias("id")).distinct()
    entries = selected.filter("endpoint is not null").select("repository_id", "endpoint", "document_path", "place")
    steps = selected.filter(F.col("section_type").rlike("flow:steps|method:|class:")).select("repository_id", "heading", "symbols", "source_paths", "confidence_states", "place")
    return {"entrypoints": entries, "steps": steps, "relations": impact.related_links(run["links"], selected, parts), "statistics": told}


def explain_responsibilities(run: Run, question: str) -> DataFrame:
    """One row about the best capability; without one, it says so."""
    best = capability.responsibilities(search.rank_capabilities(run["capabilities"], question))
    always = run["facts"].sparkSession.range(1).select(F.lit(question).alias("question"))
    said = F.when(F.col("capability_id").isNull(), F.array(F.lit(NO_CAPABILITY))).when(F.size("responsibilities") == 0, F.array(F.lit(NO_OWNER))).otherwise(F.array().cast("array<string>"))
    return always.join(best, F.lit(True), "left").withColumns({"status": F.coalesce("status", F.lit("unresolved")), "limitations": said})  # one row each


def _in_production(run: Run) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = cut(scope.production_facts(run["facts"]))
    nodes, edges = scope.graph_for_facts(run["nodes"], run["edges"], facts)
    return facts, nodes, edges


def _impact(run: Run, edges: DataFrame, selected: DataFrame, told: DataFrame) -> DataFrame:
    parts = selected.filter("repository_id <> '_workspace'").select(F.concat(F.lit("component:"), "repository_id").alias("id")).distinct()
    evidence = selected.select(F.explode("evidence_ids").alias("id")).distinct()
    return impact.analyse(impact.relevant_edges(edges, evidence, parts), selected, told.first()["unresolved_relations"])


def assess_migration(run: Run, request: str, source: str | None = None, target: str | None = None) -> dict[str, DataFrame]:
    """answer (one row: from, to, status), current_state, remaining (relations at the system to leave), and impact. Systems that
    aren't named are those of the best capability's first legacy dependency."""
    selected, told = prepare_context(run, request, "migration")
    _, _, edges = _in_production(run)
    best = search.rank_capabilities(run["capabilities"], request).limit(1).select(F.col("id").alias("capability_id"), F.try_element_at("legacy_dependencies", F.lit(1)).alias("d")).first()
    legacy = best["d"] if best is not None else None
    source, target = source or (legacy and legacy["from"]), target or (legacy and legacy["to"])
    spark = edges.sparkSession
    status = "candidate" if source and target else "unresolved"
    answer = spark.createDataFrame([(request, best and best["capability_id"], source, target, status)], "request string, capability_id string, `from` string, `to` string, status string")
    remaining = impact.remaining_dependencies(edges, source) if source else edges.limit(0)
    state = selected.filter(F.col("document_type").isin("flow", "service")).select("repository_id", "document_path", "heading", "place")
    return {"answer": answer, "current_state": state, "remaining": remaining, "impact": _impact(run, edges, selected, told)}


def investigate_flow(run: Run, question: str, level: int = 1, max_files: int = 8, max_evidence: int = 20) -> dict[str, DataFrame]:
    """step (one row: the level to go on at), context, paths that are chosen (few), facts about them, and evidence that may be read."""
    selected, told = prepare_context(run, question, "development")
    facts, _, _ = _in_production(run)
    step = told.select(impact.next_step(F.lit(level), F.col("sufficient")).alias("s"), "missing").select("s.*", "missing")
    each = selected.select("place", F.posexplode("source_paths").alias("_n", "path")).filter(~scope.is_test_path(F.col("path")))
    paths = cut(each.groupBy("path").agg(F.min(F.struct("place", "_n")).alias("_at")).orderBy("_at").limit(max_files).select("path"))
    seen = selected.select(F.explode("evidence_ids").alias("id")).distinct()
    value = F.col("value_json")
    placed = facts.withColumns({n: field(value, n) for n in ("source_path", "target_path")})
    wanted = run["evidence"].filter(~scope.is_test_path(F.col("relative_path")))
    by_path = wanted.join(paths.withColumnRenamed("path", "relative_path"), "relative_path", "left_semi").select("id")
    allowed = by_path.unionByName(wanted.join(seen, "id", "left_semi").select("id")).distinct()
    evidence = wanted.join(allowed, "id", "left_semi").orderBy("relative_path", "id").limit(max_evidence).select("id", "repository_id", "relative_path", "locator")
    return {"step": step, "context": selected, "paths": paths, "facts": impact.investigation_facts(placed, paths, seen), "evidence": evidence}


def prepare_proposal(run: Run, kind: str, request: str, requirements: list[str] | None = None) -> DataFrame:
    """One row to be reviewed: what a change asked for touches, by what evidence, and what is open. kind: specification, migration
    or adr."""
    if kind not in ("specification", "migration", "adr"):
        raise ValueError(f"no proposal of kind {kind}")
    if not request.strip():
        raise ValueError("an empty request")
    selected, told = prepare_context(run, request, "migration" if kind == "migration" else "development")
    edges = run["edges"]
    duties = search.rank_capabilities(run["capabilities"], request).limit(1).select("id", F.transform("responsibilities", lambda r: F.concat_ws(": ", r["repository_id"], r["role"])).alias("responsibilities"))
    best = duties.first()
    named = F.concat(F.col("repository_id"), F.lit(": "), F.coalesce("heading", "document_path"))
    sets = lambda c: F.array_sort(F.collect_set(c))
    repository = F.when(F.col("repository_id") != "_workspace", F.col("repository_id"))
    stored = F.concat_ws(" ", "section_type", F.array_join("roles", " "), F.array_join("source_paths", " ")).rlike("(?i)data|repository|persist|entity")
    one = selected.agg(
        sets(repository).alias("scope"), sets(F.when(F.col("document_type") == "flow", named)).alias("current_flow"), sets(F.concat_ws(" ", "endpoint.method", "endpoint.path")).alias("contracts"),
        sets(F.when(stored, named)).alias("data_and_ownership"), sets(F.struct("repository_id", "document_path")).alias("documents"),
    )
    found = graph.findings(edges)
    seen = found.select(F.explode("evidence_ids").alias("e")).join(run["evidence"].select(F.col("id").alias("e")), "e", "left_semi").unionByName(selected.select(F.explode("evidence_ids").alias("e"))).distinct()
    operators = selected.select(F.explode(F.regexp_extract_all("content", F.lit(REACTIVE), F.lit(1))).alias("o")).agg(sets(F.col("o")).alias("reactive_behavior"))
    open_ = edges.filter("status <> 'supported'").agg(sets(F.concat(F.lit("Resolver "), "id", F.lit(" ("), "status", F.lit("): "), "from", F.lit(" "), "type", F.lit(" "), "to", F.lit("."))).alias("open"))
    # one row each; what is listed of the whole graph is counted, not listed, but for relations that aren't certain
    row = one.crossJoin(seen.agg(F.count(F.lit(1)).alias("evidence"))).crossJoin(operators).crossJoin(told.select("unresolved_relations", "missing")).crossJoin(open_ if kind == "migration" else open_.limit(1).select(F.array().cast("array<string>").alias("open")))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    target = F.when(F.size("current_flow") > 0, F.transform("current_flow", lambda f: F.concat(f, F.lit(" → aplicar cambio solicitado conservando contratos observados")))).otherwise(strings([NO_TARGET_FLOW]))
    technical = F.transform("scope", lambda r: F.concat(r, F.lit(": participante técnico observado")))
    asked = list(requirements or [])
    key = stable_id("proposal", F.lit(run.run_id), F.lit(kind), F.lit(request), strings(asked).cast("string"), F.lit(best["id"] if best else None))
    return row.select(
        key.alias("proposal_id"), F.lit(kind).alias("kind"), F.lit("review_required").alias("status"), F.lit(request.strip()).alias("objective"), "scope", "current_flow", target.alias("target_flow"),
        F.transform("scope", lambda r: F.struct(r.alias("repository_id"), F.transform(F.filter("documents", lambda d: d["repository_id"] == r), lambda d: d["document_path"]).alias("document_paths"))).alias("changes_by_repository"),
        (strings(best["responsibilities"]) if best and best["responsibilities"] else technical).alias("responsibilities"), F.filter("contracts", lambda c: c != "").alias("contracts"), "data_and_ownership", "reactive_behavior",
        F.concat(F.transform("missing", lambda m: F.concat(F.lit("Confirmar "), m, F.lit("."))), "open").alias("pending_decisions"), strings(asked).alias("decisions"), strings(MIGRATION_PHASES if kind == "migration" else ()).alias("phases"),
        "evidence", summaries.proposal_confidence(F.col("evidence"), F.col("unresolved_relations")).alias("confidence"),
    )


def prepare_documentation(run: Run, ref: str = "main") -> DataFrame:
    """(path, content, sha256): all documents of a run, ready to be published or exported."""
    facts, _, edges = _in_production(run)
    ends = cut(endpoints_of(facts))
    pages = vault.vault(facts, ends, edges, ref).unionByName(vault.code_pages(symbols_of(facts), calls_of(facts), ref)).unionByName(vault.maps(facts, ends, ref))
    return pages.withColumn("sha256", sha256(F.col("content")))
