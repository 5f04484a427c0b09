"""Documents of services, flows and types as rows (path, content), and their way into folders and archives."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import field
from ..functions.text import let, markdown_cell, normalise, safe_segment, simple_type
from .query import distinct_slugs
from .summaries import mermaid_graph

MOST_FILES = 20_000


def _folder(component: Column, ref: Column | str) -> Column:
    return F.concat(F.lit("Servicios/"), safe_segment(F.element_at(F.split(component, ":"), 1)), F.lit("/"), safe_segment(ref if isinstance(ref, Column) else F.lit(ref)), F.lit("/"))


def lines(rows: DataFrame, key: str, cells: list[Column], order: list[str], head: str, name: str) -> DataFrame:
    """One Markdown table for each key, its rows in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.coalesce(c.cast("string"), F.lit("—"))) for c in cells)), F.lit(" |"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*order, line.alias("_l")))).alias("_all"))
    return listed.select(key, F.concat(F.lit(head), F.array_join(F.transform("_all", lambda x: x["_l"]), "\n")).alias(name))


def flow_slug(method: Column, path: Column) -> Column:
    return let(normalise(F.concat_ws("-", method, path)), lambda x: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("flujo")))


def service_documents(facts: DataFrame, endpoints: DataFrame, edges: DataFrame, ref: str = "main") -> DataFrame:
    """One document for each component: what it offers, calls and is made of. endpoints (component_id, method, path, handler,
    status), edges with `from`, `to`, type, status."""
    offers = lines(endpoints, "component_id", [F.col("method"), F.col("path"), F.col("handler"), F.col("status")], ["path", "method"], "## Contratos\n\n| Método | Ruta | Handler | Estado |\n|---|---|---|---|\n", "offers")
    own = edges.withColumn("component_id", F.regexp_replace("from", "^component:", ""))
    calls = lines(own, "component_id", [F.col("type"), F.col("to"), F.col("status")], ["type", "to"], "## Integraciones\n\n| Tipo | Destino | Estado |\n|---|---|---|\n", "calls")
    kinds = facts.groupBy("component_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    made = lines(kinds, "component_id", [F.col("kind"), F.col("n")], ["kind"], "## Estructura\n\n| Tipo | Hechos |\n|---|---|\n", "made")
    drawn = mermaid_graph(own, "component_id").select("component_id", F.concat(F.lit("## Diagrama\n\n```mermaid\n"), "diagram", F.lit("\n```")).alias("drawn"))
    both = made.join(offers, "component_id", "left").join(calls, "component_id", "left").join(drawn, "component_id", "left")
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), "component_id"), "offers", "calls", "made", "drawn")
    return both.select(F.concat(_folder(F.col("component_id"), ref), F.lit("servicio.md")).alias("path"), content.alias("content"))


def flow_documents(endpoints: DataFrame, ref: str = "main") -> DataFrame:
    """One document for each endpoint; equal names get a number."""
    own = endpoints.withColumn("_s", F.concat(_folder(F.col("component_id"), ref), F.lit("flujos/"), flow_slug(F.col("method"), F.col("path"))))
    named = distinct_slugs(own, "_s", ["path", "method", "handler"])
    content = F.concat(F.lit("# "), "method", F.lit(" "), "path", F.lit("\n\nServicio: [["), _folder(F.col("component_id"), ref), F.lit("servicio|"), "component_id", F.lit("]]\n\n## Pasos\n\n1. `"), F.coalesce("handler", F.lit("—")), F.lit("` — "), "status")
    return named.select(F.concat("unique_slug", F.lit(".md")).alias("path"), content.alias("content"))


def class_documents(facts: DataFrame, ref: str = "main") -> DataFrame:
    """One document for each type, with its methods."""
    s = facts.filter("kind = 'code_symbol'").select("component_id", field("value_json", "class_name").alias("owner"), field("value_json", "name").alias("name"), field("value_json", "symbol_type").alias("type"), field("value_json", "signature").alias("signature"), field("value_json", "source_path").alias("source_path"))
    types = s.filter("owner is null and type in ('class', 'interface', 'record', 'enum')")
    methods = s.filter("owner is not null").withColumn("_k", F.concat_ws("#", "component_id", "owner"))
    listed = lines(methods, "_k", [F.col("name"), F.coalesce("signature", "name")], ["name", "signature"], "## Métodos\n\n| Método | Firma |\n|---|---|\n", "methods")
    both = types.withColumn("_k", F.concat_ws("#", "component_id", "name")).join(listed, "_k", "left")
    named = distinct_slugs(both.withColumn("_s", F.concat(_folder(F.col("component_id"), ref), F.lit("clases/"), safe_segment(F.col("name")))), "_s", ["source_path", "name"])
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), "type", F.lit(" "), "name"), F.concat(F.lit("`"), "source_path", F.lit("`")), "methods")
    return named.select(F.concat("unique_slug", F.lit(".md")).alias("path"), content.alias("content"))


def vault(facts: DataFrame, endpoints: DataFrame, edges: DataFrame, ref: str = "main") -> DataFrame:
    return service_documents(facts, endpoints, edges, ref).unionByName(flow_documents(endpoints, ref)).unionByName(class_documents(facts, ref))


def _page(component: Column, ref: str, folder: str, *names: Column) -> Column:
    """A page's path: names, and a part of a hash that keeps equal ones apart."""
    *shown, key = names
    return F.concat(_folder(component, ref), F.lit(f"{folder}/"), flow_slug(*shown), F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0001", component, key), 256), 1, 10))


def _listed(rows: DataFrame, key: list[str], line: Column, order: list[str], name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), "\n").alias(name))


def code_pages(symbols: DataFrame, calls: DataFrame, ref: str = "main") -> DataFrame:
    """A page for each function or method: what it is, calls, is called by, and looks like; and one for each component that leads to
    them. symbols (component_id, symbol_id, name, class_name, symbol_type, signature, description, source_path, start_line, end_line,
    snippet, evidence_ids), calls (component_id, from, to, expression, callee_name, caller_class, caller_name, resolution, target_path)."""
    own = symbols.filter(F.col("symbol_type").isin("method", "constructor", "function")).withColumn("_path", _page(F.col("component_id"), ref, "metodos", F.coalesce("class_name", F.lit("funcion")), F.col("name"), F.col("symbol_id")))
    out = F.concat(F.lit("- `"), F.coalesce("expression", "callee_name", F.lit("—")), F.lit("` → **"), "resolution", F.lit("**"), F.coalesce(F.concat(F.lit(" en `"), "target_path", F.lit("`")), F.lit("")))
    into = F.concat(F.lit("- `"), F.coalesce("caller_class", F.lit("función independiente")), F.lit("."), F.coalesce("caller_name", F.lit("desconocido")), F.lit("`"))
    made = _listed(calls, ["component_id", "from"], out, ["expression"], "made").withColumnRenamed("from", "symbol_id")
    met = _listed(calls.filter("`to` is not null"), ["component_id", "to"], into, ["caller_class", "caller_name"], "met").withColumnRenamed("to", "symbol_id")
    both = own.join(made, ["component_id", "symbol_id"], "left").join(met, ["component_id", "symbol_id"], "left")
    name = F.concat_ws(".", "class_name", "name")
    content = F.concat(
        F.lit("# "), F.when(F.col("class_name").isNull(), "Función").when(F.col("symbol_type") == "constructor", "Constructor").otherwise("Método"), F.lit(" "), name, F.lit("\n\n"), F.coalesce("description", F.lit("Descripción no disponible.")),
        F.lit("\n\n- Firma: `"), markdown_cell(F.coalesce("signature", "name")), F.lit("`\n- Archivo: `"), F.coalesce("source_path", F.lit("")), F.lit("`\n- Líneas: "), F.coalesce(F.col("start_line").cast("string"), F.lit("no disponible")), F.lit("–"),
        F.coalesce(F.col("end_line").cast("string"), F.lit("no disponible")), F.lit("\n- Evidencia: "), F.array_join("evidence_ids", ", "), F.lit("\n\n## Llamadas realizadas\n\n"), F.coalesce("made", F.lit("- No se observaron llamadas salientes.")),
        F.lit("\n\n## Llamado por\n\n"), F.coalesce("met", F.lit("- No se encontraron llamadores dentro del repositorio.")), F.lit("\n\n## Fragmento observado\n\n"),
        F.coalesce(F.concat(F.lit("```\n"), F.nullif("snippet", F.lit("")), F.lit("\n```")), F.lit("Fragmento no disponible.")), F.lit("\n\n[[../servicio|Volver al servicio]]\n"),
    )
    pages = both.select(F.concat("_path", F.lit(".md")).alias("path"), content.alias("content"))
    link = F.concat(F.lit("- [["), "_path", F.lit("|"), name, F.lit("]]"))
    index = _listed(own, ["component_id"], link, ["class_name", "name", "symbol_id"], "links")
    return pages.unionByName(index.select(F.concat(_folder(F.col("component_id"), ref), F.lit("codigo.md")).alias("path"), F.concat(F.lit("# Código de "), "component_id", F.lit("\n\n"), "links", F.lit("\n")).alias("content")))


def module_edges(facts: DataFrame) -> DataFrame:
    """(component_id, from, to, type): files that import files, and files whose types are given types of other files."""
    value = F.col("value_json")
    of = lambda kind, *names: facts.filter(F.col("kind") == kind).select("component_id", *(field(value, n).alias(n) for n in names))
    imports = of("module_dependency", "source_path", "target_path").dropna().select("component_id", F.col("source_path").alias("from"), F.col("target_path").alias("to"), F.lit("importa").alias("type"))
    types = of("code_symbol", "name", "symbol_type", "source_path").filter("symbol_type in ('class', 'interface', 'record', 'enum')").groupBy("component_id", "name").agg(F.min("source_path").alias("path"))
    given = of("dependency_injection", "class_name", "dependency_type").withColumn("dependency_type", simple_type(F.col("dependency_type")))
    owner, part = types.select("component_id", F.col("name").alias("class_name"), F.col("path").alias("from")), types.select("component_id", F.col("name").alias("dependency_type"), F.col("path").alias("to"))
    injected = given.join(owner, ["component_id", "class_name"]).join(part, ["component_id", "dependency_type"]).filter("`from` <> `to`").select("component_id", "from", "to", F.lit("inyecta").alias("type"))
    return imports.unionByName(injected).distinct()


def maps(facts: DataFrame, endpoints: DataFrame, ref: str = "main") -> DataFrame:
    """For each component, pages about its files, build modules, layers, routers and modules that use each other; and one page that
    leads to all components."""
    value, key = F.col("value_json"), "component_id"
    of = lambda kind, *names: facts.filter(F.col("kind") == kind).select(key, *(field(value, n).alias(n) for n in names))
    sources = of("source_module", "path", "layer", "role", "source_set", "build_module", "port_direction")
    files = of("repository_file", "path", "kind")
    counted = sources.groupBy(key, F.coalesce("build_module", F.lit(".")).alias("module")).agg(F.count(F.lit(1)).alias("n"))
    needs = of("build_module_dependency", "source_module", "target_module", "manifest")
    routes = facts.filter("kind = 'http_endpoint'").select(key, *(field(value, n).alias(n) for n in ("router_class", "handler_class", "method", "path", "handler_expression", "framework")), field(value, "route_order").cast("int").alias("route_order"))
    routes = routes.withColumn("router", F.coalesce("router_class", "handler_class", F.lit("Desconocido")))
    tables = (
        ("estructura", "Estructura", [lines(files, key, [F.col("path"), F.col("kind")], ["path"], "| Archivo | Clase |\n|---|---|\n", "text")]),
        ("modulos", "Módulos de build", [lines(counted, key, [F.col("module"), F.col("n")], ["module"], "| Módulo | Fuentes de producción |\n|---|---:|\n", "text"), lines(needs, key, [F.col("source_module"), F.col("target_module"), F.col("manifest")], ["source_module", "target_module"], "## Dependencias declaradas\n\n| Origen | Destino | Manifiesto |\n|---|---|---|\n", "more")]),
        ("capas", "Capas y roles", [lines(sources, key, [F.col(c) for c in ("layer", "role", "source_set", "build_module", "path", "port_direction")], ["path"], "| Capa | Rol | Source set | Módulo | Archivo | Puerto |\n|---|---|---|---|---|---|\n", "text")]),
        ("routers", "Routers y endpoints", [lines(routes, key, [F.col(c) for c in ("router", "route_order", "method", "path", "handler_expression", "framework")], ["router", "route_order", "path", "method"], "| Router/controlador | Orden | Método | Ruta | Handler | Framework |\n|---|---:|---|---|---|---|\n", "text")]),
        ("arquitectura", "Arquitectura", [mermaid_graph(module_edges(facts), key).select(key, F.concat(F.lit("```mermaid\n"), "diagram", F.lit("\n```"), F.when(F.col("omitted") > 0, F.concat(F.lit("\n\nRelaciones adicionales: "), F.col("omitted").cast("string"))).otherwise("")).alias("text"))]),
    )
    pages = None
    for file, title, (first, *rest) in tables:
        both = first
        for other in rest:
            both = both.join(other, key, "left")
        own = both.select(F.concat(_folder(F.col(key), ref), F.lit(f"{file}.md")).alias("path"), F.concat_ws("\n\n", F.concat(F.lit(f"# {title} de "), key), *(c for c in both.columns if c != key)).alias("content"))
        pages = own if pages is None else pages.unionByName(own)
    per = endpoints.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    services = facts.select(key).distinct().join(per, key, "left")
    line = F.concat(F.lit("- [["), _folder(F.col(key), ref), F.lit("servicio|"), key, F.lit("]] — "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" endpoint(s)"))
    start = services.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("_l")))), lambda x: x["_l"]), "\n").alias("_all"), F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    return pages.unionByName(start.select(F.lit("Inicio.md").alias("path"), F.concat(F.lit("# Inicio\n\n"), "_all", F.lit("\n")).alias("content")))


def atomic_write(path: Path, content: str) -> None:
    """A whole file or none, readable by its owner only."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def export_folder(documents: DataFrame, folder: str, most: int = MOST_FILES) -> int:
    """Files in a folder of the driver, streamed partition by partition. More than `most` is an error: larger vaults stay tables."""
    if (n := documents.count()) > most:
        raise ValueError(f"{n} files are more than {most}")
    root = Path(folder).resolve()
    for r in documents.select("path", "content").toLocalIterator():
        to = (root / r["path"]).resolve()
        if not to.is_relative_to(root):
            raise ValueError(f"{r['path']} leads out of the folder")
        atomic_write(to, r["content"])
    return n


def export_zip(documents: DataFrame, path: str, most: int = MOST_FILES) -> int:
    """The same as an archive, in path order and without times, so that equal documents give an equal archive."""
    if (n := documents.count()) > most:
        raise ValueError(f"{n} files are more than {most}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in documents.select("path", "content").orderBy("path").toLocalIterator():
            z.writestr(zipfile.ZipInfo(r["path"], (1980, 1, 1, 0, 0, 0)), r["content"])
    return n
