"""Documents into sections and chunks, what chunks hold, and the indexes and links made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import field, sha256, stable_id
from ..functions.text import let, normalise, tokens
from .resolve import resolve_by_suffix

MAX_BYTES, MAX_SYMBOLS, MAX_LEXICAL = 48_000, 100, 1000
FILE = r"^Servicios/([^/]+)/([^/]+)/(.+)$"

# Sections by words of their heading, the first that fits.
SECTIONS = (
    ("arquitect", "architecture"), ("contrat|endpoint|router", "contracts"), ("dato|persist", "data"), ("segur", "security"), ("riesg|limit", "risks"),
    ("naveg|clase|metodo", "navigation"), ("diagrama", "diagram"), ("paso|flujo", "steps"), ("integr", "integrations"), ("fragment", "snippet"), ("firma", "signature"),
    ("llamadas realizadas", "calls"), ("llamado por", "callers"), ("modulo", "modules"), ("capa", "layers"), ("estructura|arbol", "structure"),
)
LAYERS = ("application", "domain", "infrastructure", "api", "root")
ROLES = ("router", "handler", "controller", "mapper", "service", "repository", "entity", "port", "adapter")
STATES = ("supported", "candidate", "unresolved")
# What is found in a chunk's text.
ENDPOINT = r"(?<![A-Za-z0-9_])(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|UI)\s+(/[^\s`|\"\]]*)"
SOURCE_PATH = r"(?i)`([^`\n]+\.(?:java|kt|ts|tsx|js|jsx|py|cs|xml|ya?ml|json))(?::\d+)?`"
QUOTED_SYMBOL = r"`([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)`"
DOTTED_SYMBOL = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_$]*\.[A-Za-z_$][\w$]*)(?![A-Za-z0-9_])"
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
EVIDENCE_ID = r"(?<![A-Za-z0-9_])(?:evidence|ev)-[A-Za-z0-9._-]+(?![A-Za-z0-9_])"
REACTIVE = r"^(?:map|flatMap|filter|collectList|onErrorResume|onErrorMap|switchIfEmpty|zip|then|defer|just|error)$"


def sections(documents: DataFrame) -> DataFrame:
    """documents (path, content): (path, section, heading, content). A heading begins a section; what is blank is none."""
    lines = documents.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    heading = F.nullif(F.regexp_extract("text", r"^#{1,6}\s+(.+)$", 1), F.lit(""))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").isNotNull().cast("int")).over(order))
    whole = placed.groupBy("path", "section").agg(
        F.max("heading").alias("heading"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("content")
    )
    return whole.filter("content <> ''").select("path", F.col("section").cast("int").alias("section"), "heading", "content")


def split_sections(rows: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Sections of more than `most` bytes in parts, cut between paragraphs: (path, section, part, heading, content)."""
    size = F.octet_length("content")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    def add(state: Column, paragraph: Column) -> Column:
        both = F.when(state["now"] == "", paragraph).otherwise(F.concat(state["now"], F.lit("\n\n"), paragraph))
        full = (state["now"] != "") & (F.octet_length(both) > most)
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full, paragraph).otherwise(both).alias("now"))

    cut = F.aggregate(F.split("content", "\n{2,}"), empty, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    parts = rows.withColumn("_parts", F.when(size <= most, F.array("content")).otherwise(cut)).select("path", "section", "heading", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_part", "content"))
    named = F.when(F.col("_n") == 1, F.col("heading")).otherwise(F.concat(F.coalesce("heading", F.lit("Documento")), F.lit(" · parte "), (F.col("_part") + 1).cast("string")))
    return parts.select("path", "section", (F.col("_part") + 1).alias("part"), named.alias("heading"), "content")


def document_identity(path: Column) -> dict[str, Column]:
    """repository, ref and type that a document's path names."""
    inside = path.rlike(FILE)
    file = F.when(inside, F.regexp_extract(path, FILE, 3)).otherwise(path)
    kind = (
        F.when(file == "servicio.md", "service").when(file.startswith("flujos/"), "flow").when(file.startswith("clases/"), "class").when(file.startswith("metodos/"), "method")
        .when(file.startswith("diagramas/"), F.concat(F.lit("diagram:"), F.regexp_extract(file, "^diagramas/(.*)...$", 1))).when(path.startswith("Mapas/"), "map").otherwise("document")
    )
    return {
        "repository_id": F.when(inside, F.regexp_extract(path, FILE, 1)).otherwise("_workspace"),
        "ref": F.when(inside, F.regexp_extract(path, FILE, 2)).otherwise("workspace"),
        "document_type": kind,
    }


def section_type(document_type: Column, heading: Column) -> Column:

    def suffix(text: Column) -> Column:
        return reduce(lambda rest, rule: F.when(text.rlike(rule[0]), rule[1]).otherwise(rest), reversed(SECTIONS), F.lit("summary"))

    return F.concat(document_type, F.lit(":"), let(normalise(F.coalesce(heading, F.lit("summary"))), suffix))


def _words(content: Column, values: tuple[str, ...]) -> Column:
    return let(normalise(content), lambda text: F.array_compact(F.array(*(F.when(text.rlike(f"(?<![a-z0-9_]){v}(?![a-z0-9_])"), F.lit(v)) for v in values))))


def features(content: Column, heading: Column) -> dict[str, Column]:
    """What a chunk's text holds."""
    all_of = lambda pattern, group=1: F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(group)))
    method = F.regexp_extract(content, ENDPOINT, 1)
    of_heading = F.coalesce(
        F.nullif(F.regexp_extract(heading, r"(?i)^(?:class|interface|record|enum|método|constructor|función)\s+(.+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(heading, r"^([A-Z][A-Za-z0-9_$]*\.[A-Za-z_$][\w$]*)$", 1), F.lit("")),
    )
    symbols = F.array_distinct(F.concat(F.array_compact(F.array(F.trim(of_heading))), all_of(QUOTED_SYMBOL), all_of(DOTTED_SYMBOL)))
    return {
        "endpoint": F.when(method != "", F.struct(method.alias("method"), F.regexp_extract(content, ENDPOINT, 2).alias("path"))),
        "symbols": F.slice(symbols, 1, MAX_SYMBOLS),
        "source_paths": F.array_distinct(F.transform(all_of(SOURCE_PATH), lambda p: F.regexp_replace(p, r":\d+$", ""))),
        "layers": _words(content, LAYERS),
        "roles": _words(content, ROLES),
        "evidence_ids": all_of(EVIDENCE_ID, 0),
        "confidence_states": F.array_compact(F.array(*(F.when(content.rlike(f"(?i)(?<![A-Za-z0-9_]){s}(?![A-Za-z0-9_])"), F.lit(s)) for s in STATES))),
        "outgoing_links": all_of(WIKILINK),
    }


def build_chunks(documents: DataFrame, run_id: str, snapshots: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """documents (path, content) to chunks. previous: chunks whose ids stay where document, section type, heading and hash do."""
    parts = split_sections(sections(documents))
    own = parts.withColumns(document_identity(F.col("path"))).withColumn("sha256", sha256(F.col("content")))
    own = own.withColumn("section_type", section_type(F.col("document_type"), F.col("heading"))).withColumns(features(F.col("content"), F.col("heading")))
    place = F.concat_ws(".", "section", "part")
    own = own.withColumns({"run_id": F.lit(run_id), "document_path": F.col("path"), "id": stable_id("chunk", F.lit(run_id), F.col("path"), F.col("section_type"), F.col("heading"), place, F.col("sha256"))})
    if snapshots is None:
        own = own.withColumn("commit", F.lit("workspace"))
    else:
        known = snapshots.groupBy("repository_id").agg(F.max("requested_ref").alias("_ref"), F.max("commit_oid").alias("commit"))
        own = own.join(F.broadcast(known), "repository_id", "left").withColumns({"ref": F.coalesce("_ref", "ref"), "commit": F.coalesce("commit", F.lit("workspace"))})
    if previous is not None:
        keys = ["document_path", "section_type", "_heading", "sha256"]
        before = previous.withColumn("_heading", F.coalesce("heading", F.lit(""))).groupBy(*keys).agg(F.min("id").alias("_id"))
        own = own.withColumn("_heading", F.coalesce("heading", F.lit(""))).join(before, keys, "left").withColumns({"reused": F.col("_id").isNotNull(), "id": F.coalesce("_id", "id")})
    columns = "id run_id repository_id ref commit document_path document_type section_type heading endpoint symbols source_paths layers roles evidence_ids confidence_states outgoing_links content sha256".split()
    return own.select(*columns, *(["reused"] if previous is not None else []))


def inverted_index(rows: DataFrame, keys: Column, most: int | None = None, folded: bool = False) -> DataFrame:
    """(key, id) for each key of a row of more than one character; `most` keeps the first keys of a row; folded keys are in normal form.
    A table of pairs, so that a common key's list is never one row."""
    distinct = F.array_distinct(F.filter(keys if folded else F.transform(keys, normalise), lambda k: F.length(k) > 1))
    return rows.select(F.explode(distinct if most is None else F.slice(distinct, 1, most)).alias("key"), "id").distinct()


def lexical_index(chunks: DataFrame) -> DataFrame:
    return inverted_index(chunks, tokens(F.concat_ws(" ", "heading", "content")), MAX_LEXICAL, folded=True)


def document_links(chunks: DataFrame) -> DataFrame:
    """belongs_to, documents and contains_symbol links of chunks."""
    none = F.array().cast("array<string>")
    shape = lambda df, to, kind, evidence=none: df.select(F.col("id").alias("from"), to.alias("to"), F.lit(kind).alias("type"), F.lit("supported").alias("status"), none.alias("fact_ids"), evidence.alias("evidence_ids"))
    belongs = shape(chunks.filter("repository_id <> '_workspace'"), F.concat(F.lit("component:"), "repository_id"), "belongs_to")
    wanted = chunks.select("id", F.explode("outgoing_links").alias("target"))
    hits = resolve_by_suffix(wanted.select(F.concat_ws("\u0001", "id", "target").alias("id"), "target"), chunks.select(F.col("id").alias("doc"), F.col("document_path").alias("path")))
    documents = shape(hits.select(F.element_at(F.split("id", "\u0001"), 1).alias("id"), "doc"), F.col("doc"), "documents")
    symbols = chunks.select("id", "repository_id", "evidence_ids", F.explode("symbols").alias("symbol"))
    holds = shape(symbols, F.concat_ws(":", F.lit("symbol"), "repository_id", "symbol"), "contains_symbol", F.col("evidence_ids"))
    return belongs.unionByName(documents).unionByName(holds)


# The link that a kind of fact, or of edge, makes.
FACT_LINKS = {
    "symbol_call": "calls", "dependency_injection": "injects", "dependency_binding": "implements", "data_read": "reads_from", "data_write": "writes_to",
    "http_endpoint": "exposes", "http_client_call": "consumes", "message_publish": "publishes", "message_consume": "subscribes",
}
EDGE_LINKS = {"calls_http": "consumes", "publishes_to": "publishes", "consumes_from": "subscribes"}


def fact_links(facts: DataFrame) -> DataFrame:
    """Links that calls, injections, bindings and accesses make."""
    value = F.col("value_json")
    name = F.col("kind")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in FACT_LINKS.items() for x in p)), name), F.when(name.rlike("(?i)mapper"), "maps_to").when(name.rlike("(?i)repository|persist"), "persists_with"))
    callee = field(value, "callee_name")
    reactive = (name == "symbol_call") & callee.rlike(REACTIVE)
    kind = F.when(reactive, "reactive_stage").otherwise(kind)
    caller = field(value, "caller_class", "class_name")
    start = F.when(caller.isNull(), F.coalesce(field(value, "source_path"), F.col("component_id"))).otherwise(F.concat_ws(".", caller, field(value, "caller_name")))
    target = field(value, "target_class", "dependency_type")
    to = F.when(target.isNull(), F.coalesce(field(value, "target_path", "entity", "resource", "target"), F.lit("unresolved"))).otherwise(F.concat_ws(".", target, F.when(kind != "injects", callee)))
    at = lambda x: F.concat_ws(":", F.lit("symbol"), "component_id", x)
    return facts.withColumn("_type", kind).filter("_type is not null").select(
        at(start).alias("from"), F.when(reactive, F.concat(F.lit("reactor:"), callee)).otherwise(at(to)).alias("to"), F.col("_type").alias("type"),
        F.when(reactive, "supported").otherwise(F.coalesce(field(value, "resolution"), F.lit("supported"))).alias("status"), F.array("id").alias("fact_ids"), "evidence_ids",
    )


def symbol_links(facts: DataFrame) -> DataFrame:
    """Links that a symbol's declaration and text make."""
    value = F.col("value_json")
    s = facts.filter("kind = 'code_symbol'").select(
        "id", "component_id", "evidence_ids", F.coalesce(field(value, "name"), F.lit("")).alias("name"), field(value, "class_name").alias("owner"), F.coalesce(field(value, "signature"), F.lit("")).alias("signature"),
        F.coalesce(field(value, "snippet"), F.lit("")).alias("snippet"), field(value, "symbol_type").alias("kind"), field(value, "role").alias("role"),
    ).filter("name <> ''")
    full = F.when(F.col("owner").isNull() | (F.col("owner") == F.col("name")), F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))

    def made(rows: DataFrame, start: Column, to: Column, kind: Column) -> DataFrame:
        at = lambda x: F.concat_ws(":", F.lit("symbol"), "component_id", x)
        return rows.select(at(start).alias("from"), at(to).alias("to"), kind.alias("type"), F.lit("supported").alias("status"), F.array("id").alias("fact_ids"), "evidence_ids")

    def each(text: str, pattern: str, group: int = 1) -> DataFrame:
        return s.withColumn("_m", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))

    every = [
        made(s.filter("owner is not null and owner <> name"), F.col("owner"), F.concat_ws(".", "owner", "name"), F.lit("contains_symbol")),
        made(each("signature", r"(?<![\w$])(?:implements|extends)\s+([A-Za-z_$][\w$]*)"), F.col("name"), F.col("_m"), F.when(F.contains("signature", F.lit("implements")), "implements").otherwise("implemented_by")),
        made(each("signature", r"(?:R2dbcRepository|ReactiveCrudRepository|ReactiveMongoRepository|CrudRepository|JpaRepository)\s*<\s*([A-Za-z_$][\w$]*)"), F.col("name"), F.col("_m"), F.lit("persists_with")),
        made(each("snippet", r"(?<![\w$])private\s+final\s+([A-Z][A-Za-z0-9_$]*)\s+[A-Za-z_$][\w$]*\s*;").filter("kind = 'class'"), F.col("name"), F.col("_m"), F.lit("injects")),
        made(each("signature", r"(?<![\w$])([A-Z][A-Za-z0-9_$]*(?:Entity|Dto|DTO|T))(?![\w$])").filter("role = 'mapper' and _m <> coalesce(owner, name)"), full, F.col("_m"), F.lit("maps_to")),
        made(each("snippet", r"(?<![\w$])([A-Z][A-Za-z0-9_$]*\s*(?:::|\.)\s*[A-Za-z_$][\w$]*)"), full, F.regexp_replace("_m", r"\s*(?:::|\.)\s*", "."), F.when(F.col("_m").rlike("(?i)^[^.:]*mapper"), "maps_to").otherwise("calls")),
    ]
    return reduce(DataFrame.unionByName, every)


def edge_links(edges: DataFrame) -> DataFrame:
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in EDGE_LINKS.items() for x in p)), F.col("type")), F.when(F.col("type").rlike("(?i)front"), "used_by_front").otherwise("still_depends_on"))
    return edges.select("from", "to", kind.alias("type"), "status", "fact_ids", "evidence_ids")


def build_links(chunks: DataFrame, facts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All links; of equal ends and type the first source's stays."""
    sources = [document_links(chunks), symbol_links(facts), fact_links(facts), *([edge_links(edges)] if edges is not None else [])]
    ranked = reduce(DataFrame.unionByName, (df.withColumn("_n", F.lit(i)) for i, df in enumerate(sources)))
    order = F.struct("_n", "fact_ids", "evidence_ids", "status")
    return ranked.groupBy("from", "to", "type").agg(F.min(order).alias("_l")).select("from", "to", "type", "_l.status", "_l.fact_ids", "_l.evidence_ids")
