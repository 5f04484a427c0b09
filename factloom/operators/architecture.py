"""What a path says about a file, and what facts of one repository say about each other: imports, calls and bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import canonical_json, field, stable_id
from ..functions.text import let, simple_type
from ..sources.storage import cut, small_side
from .resolve import bind_arguments, resolve_calls

# Files, folders and words that give a file its kind, layer and role, and a symbol its description.
SOURCE = r"(?i)\.(?:[cm]?[jt]s|tsx|jsx|java)$"
MANIFEST = r"(?i)(^|/)(?:pom\.xml|package\.json|build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?)$"
RESOURCE = r"(?i)(^|/)src/(?:main|test)/resources/"
DOCUMENTATION = r"(?i)\.(?:md|adoc|rst)$"
TEST_FOLDER = r"(?i)(^|/)(?:test|tests|spec|specs)(/|$)"
LAYERS = ("application", "domain", "infrastructure", "infraestructure", "api", "components", "hooks", "navigation", "screens", "services", "store", "tasks", "utils", "workers", "config", "types")
ROLES = (
    "controller", "handler", "router", "route", "entry-point", "entrypoint", "usecase", "repository", "gateway", "adapter", "middleware", "validator", "mapper", "dto", "entity", "port", "routes", "service", "services",
    "util", "utils", "hook", "hooks", "component", "components", "screen", "screens", "navigation", "store", "task", "tasks", "worker", "workers", "config", "types",
)
VERBS = (
    ("get|find|load|read|fetch", "Obtiene o consulta"), ("create|add|insert|register|save", "Crea o registra"), ("update|set|change", "Actualiza"), ("delete|remove|clear|revoke", "Elimina o revoca"),
    ("validate|check|assert|verify", "Valida"), ("build|make|compose|generate", "Construye o genera"), ("map|convert|transform|to", "Transforma"), ("send|publish|emit|notify", "Envía o publica"), ("handle|process|execute|run", "Procesa"),
)
PLAIN_TYPES = (
    "byte|short|int|long|float|double|boolean|char|void|String|Integer|Long|Double|Float|Boolean|Character|BigDecimal|BigInteger|UUID|URI|URL|Date|Instant|LocalDate|LocalDateTime|OffsetDateTime|ZonedDateTime|"
    "Object|Class|List|Set|Map|Collection|Optional|Mono|Flux"
)
#: What an import of a file beside it may mean: behind the path as it is, and behind the path without a script's ending.
ENDINGS, SOURCE_ENDINGS, INDEXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts"), (".ts", ".tsx", ".mts", ".cts"), ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")


# --- paths ----------------------------------------------------------------------------------------------------------


def _none() -> Column:
    return F.lit(None).cast("string")


def path_metadata(path: Column) -> Column:
    """source_set, build_module, package and port_direction."""
    at = lambda parts, i: F.coalesce(F.get(parts, i), F.lit(""))

    def first(parts: Column, test) -> Column:
        """The first place that holds what is looked for, or -1."""
        return F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), test), F.lit(0)), F.lit(-1))

    def places(parts: Column) -> Column:
        port = first(parts, lambda i: F.lower(at(parts, i)) == "port")
        return let(first(parts, lambda i: (at(parts, i) == "src") & at(parts, i + 1).isin("main", "test")), lambda root: F.struct(
            parts.alias("parts"), root.alias("root"), first(parts, lambda i: (at(parts, i) == "java") & (i > root)).alias("java"), port.alias("port")))

    def told(p: Column) -> Column:
        parts, root, java, port = p["parts"], p["root"], p["java"], p["port"]
        return F.struct(
            F.when(root >= 0, at(parts, root + 1)).when(path.rlike(TEST_FOLDER), "test").otherwise("root").alias("source_set"),
            F.when(root > 0, F.array_join(F.slice(parts, 1, root), "/")).otherwise(".").alias("build_module"),
            F.when((java >= 0) & (F.size(parts) > java + 2), F.array_join(F.slice(parts, java + 2, F.size(parts) - java - 2), ".")).alias("package"),
            F.when((port >= 0) & at(parts, port + 1).isin("in", "out"), at(parts, port + 1)).alias("port_direction"),
        )

    # bound, as all of it would be computed anew for each folder and field
    return let(let(F.split(path, "/"), places), told)


def file_kind(path: Column) -> Column:
    return F.when(path.rlike(SOURCE) | path.rlike(r"(?i)\.(?:py|cs|kt)$"), "source").when(path.rlike(MANIFEST), "manifest").when(path.rlike(RESOURCE), "resource").when(path.rlike(DOCUMENTATION), "documentation").otherwise("configuration")


def source_language(path: Column) -> Column:
    return (
        F.when(path.rlike(r"(?i)\.java$"), "java").when(path.rlike(r"(?i)\.tsx$"), "tsx").when(path.rlike(r"(?i)\.[cm]?ts$"), "typescript")
        .when(path.rlike(r"(?i)\.py$"), "python").when(path.rlike(r"(?i)\.cs$"), "c_sharp").when(path.rlike(r"(?i)\.kt$"), "kotlin").otherwise("javascript")
    )


def layer(path: Column) -> Column:
    """The first folder that is a layer's."""
    found = F.get(F.filter(F.split(path, "/"), lambda p: F.lower(p).isin(*LAYERS)), F.lit(0))
    return F.coalesce(F.regexp_replace(found, "infraestructure", "infrastructure"), F.lit("root"))


def role(path: Column) -> Column:
    """A port with its direction, else the first of the roles that is a folder's name."""

    def told(parts: Column) -> Column:
        place = F.array_position(parts, F.lit("port")).cast("int")
        direction = F.get(parts, place)  # places count from 1, so this is the folder behind it
        found = F.get(F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains(parts, r)), F.lit(0))
        return F.when((place > 0) & direction.isin("in", "out"), F.concat(F.lit("port-"), direction)).otherwise(F.coalesce(F.regexp_replace(found, "s$", ""), F.lit("module")))

    return let(F.split(F.lower(path), "/"), told)


def describe(kind: Column, name: Column, calls: Column) -> Column:
    """A symbol in words, from its name and what it calls (a class: its methods)."""
    words = F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    return let(words, lambda w: _described(kind, w, calls))


def _described(kind: Column, words: Column, calls: Column) -> Column:
    verb = F.when(kind == "class", "Agrupa la responsabilidad").when(kind == "method", "Ejecuta la operación").otherwise("Implementa")
    for pattern, text in reversed(VERBS):
        verb = F.when(words.rlike(f"^(?:{pattern})(?![a-z0-9_])"), text).otherwise(verb)
    told = F.when(F.size(calls) > 0, F.concat(F.lit("; invoca "), F.array_join(calls, ", "))).otherwise("")
    return F.concat(verb, F.lit(" asociada a «"), words, F.lit("»"), told, F.lit(". Descripción derivada del código estático."))


def is_architectural(type_: Column) -> Column:
    """Whether a type is one of the program's own, as far as its name tells."""
    name = F.regexp_replace(simple_type(type_), "[?&]", "")
    return F.coalesce((name != "") & ~name.rlike(f"^(?:{PLAIN_TYPES})$"), F.lit(False))


def with_metadata(found: DataFrame) -> DataFrame:
    """Findings (relative_path, kind, value_json) with what their files' paths and their names say, in their values."""
    path, kind, value = F.col("relative_path"), F.col("kind"), F.col("value_json")
    meta = path_metadata(path)
    names = ("source_set", "build_module", "package", "port_direction")
    calls = F.coalesce(F.from_json(F.coalesce(F.get_json_object(value, "$.members"), F.get_json_object(value, "$.calls")), "array<string>"), F.array().cast("array<string>"))
    more = lambda m: F.struct(
        *(m[n].alias(n) for n in names), F.when(kind == "repository_file", file_kind(path)).alias("kind"), F.when(kind == "source_module", source_language(path)).alias("language"),
        *(F.when(kind != "repository_file", f(path)).alias(n) for n, f in (("layer", layer), ("role", role))),
        F.when(kind == "code_symbol", describe(field(value, "symbol_type"), field(value, "name"), calls)).alias("description"),
    )
    merged = F.concat(F.regexp_replace(value, r"\}\s*$", ""), F.lit(","), F.expr("substring(_more, 2)"))
    told = found.withColumn("_more", F.when(kind.isin("repository_file", "source_module", "code_symbol"), F.to_json(let(meta, more))))
    return told.withColumn("value_json", F.when(F.col("_more").isNotNull(), merged).otherwise(value)).drop("_more")


def candidate_stacks(files: DataFrame, signals: DataFrame, most: int = 20) -> DataFrame:
    """(plugin_id, component_id, languages, evidence_paths): the extractors that a repository calls for. files (repository_id,
    relative_path, language, excluded_reason), signals of inventory.technology_signals()."""
    # The languages that each extractor reads, and the technology that calls for it; Python needs none.
    stacks = (
        ("python", ["python"], None), ("dotnet", ["c_sharp", "xml"], "dotnet"), ("java-spring", ["java"], "spring"), ("java-webflux", ["java"], "webflux"), ("java-weblogic", ["java", "xml"], "jee"),
        ("js-angular", ["typescript"], "angular"), ("js-react", ["typescript", "tsx", "javascript"], "react"), ("node-express", ["typescript", "javascript"], "express"),
        ("source-architecture", ["javascript", "typescript", "tsx", "java"], None),
    )
    known = files.sparkSession.createDataFrame(list(stacks), "plugin_id string, languages array<string>, technology string")
    own = files.filter("excluded_reason is null and language is not null").select(F.col("repository_id").alias("component_id"), "language", "relative_path")
    each = own.join(F.broadcast(known.withColumn("language", F.explode("languages"))), "language")
    wanted = each.join(signals.select(F.col("repository_id").alias("component_id"), "technology", F.lit(True).alias("_told")), ["component_id", "technology"], "left").filter("technology is null or _told")
    place = Window.partitionBy("plugin_id", "component_id").orderBy(F.expr("array_position(languages, language)"), "relative_path")
    shown = wanted.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most)
    return shown.groupBy("plugin_id", "component_id").agg(F.first("languages").alias("languages"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "relative_path"))), lambda x: x["relative_path"]).alias("evidence_paths"))


# --- imports --------------------------------------------------------------------------------------------------------


def joined_path(path: Column) -> Column:
    """A path without . and .. in it."""
    step = lambda done, p: F.when((p == "") | (p == "."), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, repository_id, source_path, specifier) with target_path, the file of the repository that is meant."""
    return imports.join(_import_hits(imports, files), "id", "left")


def _import_hits(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target_path) of imports that mean one of these files. Every way to write a file is an equi-join: a path as a whole, or
    for Java a file's name, whose folders must then fit."""
    path, spec = F.col("source_path"), F.col("specifier")
    folder = F.regexp_replace(path, "[^/]*$", "")
    base = joined_path(F.concat(folder, spec))
    bare = F.regexp_replace(base, r"(?i)\.(?:mjs|cjs|js|jsx)$", "")
    ways = F.array(*(F.concat(base, F.lit(e)) for e in ENDINGS), *(F.concat(bare, F.lit(e)) for e in SOURCE_ENDINGS), *(F.concat(base, F.lit(e)) for e in INDEXES))
    # Python: dots in front are folders up, others part folders
    dots = F.regexp_extract(spec, "^[.]*", 0)
    inner = F.regexp_replace(F.expr("substring(specifier, length(regexp_extract(specifier, '^[.]*', 0)) + 1)"), "[.]", "/")
    start = F.when(F.length(dots) > 0, F.concat(folder, F.repeat(F.lit("../"), F.length(dots) - 1))).otherwise("")
    module = joined_path(F.concat(start, inner))
    python = F.flatten(F.transform(F.when(F.length(dots) > 0, F.array(module)).otherwise(F.array(module, F.concat(F.lit("src/"), module))), lambda m: F.array(F.concat(m, F.lit(".py")), F.concat(m, F.lit("/__init__.py")))))
    tried = imports.withColumn("_ways", F.when(path.rlike(r"(?i)\.py$"), python).when(~path.rlike(r"(?i)\.(?:java|kt|cs)$") & spec.startswith("."), ways))
    known = files.select("repository_id", "relative_path").distinct()
    by_path = tried.select("id", "repository_id", F.posexplode("_ways").alias("_n", "relative_path")).join(known, ["repository_id", "relative_path"]).groupBy("id").agg(F.min_by("relative_path", "_n").alias("target_path"))
    suffix = F.concat(F.regexp_replace("specifier", "[.]", "/"), F.lit(".java"))
    java = imports.filter(path.rlike(r"(?i)\.java$")).select("id", "repository_id", suffix.alias("_suffix")).withColumn("_name", F.element_at(F.split("_suffix", "/"), -1))
    named = known.filter(F.col("relative_path").rlike(r"(?i)\.java$")).withColumn("_name", F.element_at(F.split("relative_path", "/"), -1))
    by_name = java.join(named, ["repository_id", "_name"]).filter(F.col("relative_path").endswith(F.col("_suffix"))).groupBy("id").agg(F.min("relative_path").alias("target_path"))
    return by_path.unionByName(by_name)


# --- facts about each other -----------------------------------------------------------------------------------------


def _told(rows: DataFrame, kind: str, rule: str | None, **fields: Column) -> DataFrame:
    """Rows (component_id, evidence_ids, rule_id) as facts with these fields, null ones too."""
    value = canonical_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"}))
    own = rows.select("component_id", "evidence_ids", (F.lit(rule) if rule else F.col("rule_id")).alias("rule_id"), value.alias("value_json"))
    id_ = stable_id("fact", F.col("component_id"), F.lit(kind), F.col("value_json"), F.coalesce(F.get("evidence_ids", F.lit(0)), F.lit("")))
    return own.select(id_.alias("id"), F.lit(kind).alias("kind"), "component_id", "value_json", "evidence_ids", "rule_id")


#: Fields of calls that stay as they were read; what calls mean is added to them.
CALL_FIELDS = ("caller_symbol_id", "caller_name", "caller_class", "callee_name", "receiver", "expression", "source_path")


def _imports(facts: DataFrame) -> DataFrame:
    own = facts.filter("kind = 'module_dependency'").withColumn("v", F.from_json("value_json", "source_path string, specifier string, imports array<string>, external boolean"))
    return own.withColumns({"repository_id": F.col("component_id"), "source_path": F.col("v.source_path"), "specifier": F.col("v.specifier")})


def _symbols(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'code_symbol'").select("component_id", *(field(F.col("value_json"), n).alias(n) for n in ("symbol_id", "class_name", "name", "source_path")))


def _constructions(facts: DataFrame) -> DataFrame:
    """Constructions with the class and the arguments as bindings ask for them."""
    own = facts.filter("kind = 'object_construction'").withColumn("v", F.from_json("value_json", "variable string, constructed_type string, arguments array<string>, source_path string, start long"))
    return own.withColumns({"class_name": simple_type(F.col("v.constructed_type")), "arguments": F.transform("v.arguments", lambda a: F.trim(F.regexp_replace(a, "^this[.]", "")))})


def _variables(constructions: DataFrame) -> DataFrame:
    return constructions.select("component_id", F.regexp_replace("v.variable", "^this[.]", "").alias("variable"), F.col("v.constructed_type").alias("type")).dropna()


def _points(facts: DataFrame) -> DataFrame:
    """Parameters that classes are injected with."""
    own = facts.filter("kind = 'dependency_injection'").withColumn("v", F.from_json("value_json", "class_name string, parameter string, dependency_type string, source_path string, start long"))
    declared = F.col("v.dependency_type")
    return own.select("component_id", "v.class_name", "v.parameter", declared.alias("declared"), simple_type(declared).alias("type"), "v.source_path", "v.start").filter("class_name is not null and parameter is not null")


def _calls(facts: DataFrame) -> DataFrame:
    own = facts.filter("kind = 'symbol_call'").withColumn("v", F.from_json("value_json", ", ".join(f"{n} string" for n in CALL_FIELDS)))
    return own.withColumns({"caller_class": F.col("v.caller_class"), "receiver": F.nullif(F.trim(F.col("v.receiver")), F.lit("")), "callee": F.col("v.callee_name")})


def _resolved(asked: DataFrame, files: DataFrame, symbols: DataFrame, variables: DataFrame, points: DataFrame) -> DataFrame:
    """The facts asked for, with what their imports, calls and constructions mean among these files, symbols, variables and points."""
    imports = _imports(asked)
    told_imports = _told(
        import_targets(imports, files), "module_dependency", None, source_path=F.col("source_path"), specifier=F.col("specifier"), target_path=F.col("target_path"),
        external=F.when(F.col("source_path").rlike(r"(?i)\.(?:java|py)$"), F.col("target_path").isNull()).otherwise(~F.col("specifier").startswith(".")), imports=F.col("v.imports"),
    )
    calls = _calls(asked)
    answers = resolve_calls(calls.select("id", "component_id", "caller_class", "receiver", "callee"), symbols, variables, points.select("component_id", "class_name", "parameter", "type"))
    answers = answers.select("id", "target_symbol_id", "target_class", "target_path", "resolution")
    told_calls = _told(calls.drop("caller_class", "receiver", "callee").join(answers, "id"), "symbol_call", None, **{n: F.col(f"v.{n}") for n in CALL_FIELDS}, **{n: F.col(n) for n in ("target_symbol_id", "target_class", "target_path", "resolution")})
    order = Window.partitionBy("component_id", "class_name").orderBy("source_path", "start", "parameter")
    numbered = points.withColumn("ordinal", F.row_number().over(order) - 1).select("component_id", "class_name", "ordinal", "parameter", F.col("declared").alias("type"))
    made = _constructions(asked)
    built = made.filter(F.size("arguments") > 0).select("id", "component_id", F.col("v.constructed_type").alias("type"), "arguments")
    bound = bind_arguments(built, numbered, variables).join(made.select("id", "evidence_ids", F.col("v.source_path").alias("source_path")), "id")
    told = _told(bound, "dependency_binding", "source.binding", **{n: F.col(n) for n in ("consumer_class", "injection_point", "declared_type", "implementation_type", "argument", "source_path", "resolution")})
    rest = asked.filter(~F.col("kind").isin("module_dependency", "symbol_call", "dependency_binding")).select(told.columns)
    return rest.unionByName(told_imports).unionByName(told_calls).unionByName(told).dropDuplicates(["id"])


def resolve_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """facts with the targets of imports and calls, and with a binding for each argument of a construction. files
    (repository_id, relative_path): those that may be meant. Targets that facts have are found anew, and bindings made anew, so
    that facts of several runs can be put together first. The table of facts is read several times: cut it before."""
    return _resolved(facts, files, _symbols(facts), _variables(_constructions(facts)), _points(facts))


def _differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows aren't the same on both sides, repeats counted."""
    return small_side(cut(a.exceptAll(b).select(keys).unionAll(b.exceptAll(a).select(keys)).distinct()))


def resolve_changes(kept: DataFrame, gone: DataFrame, fresh: DataFrame, files: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What resolve_facts() gives for kept and fresh facts together, from a baseline that was resolved before: kept are its facts that
    stay, gone those of files that were read again or are no more, fresh what these files say now, and moved (repository_id,
    relative_path) the files that came or went. All but files are read several times: cut them before.

    An import is looked up again if it may mean a file that came or went; a call if a symbol of its name, its receiver's variable or
    what its class is injected with has changed; a construction if its class's parameters or a variable among its arguments have.
    The others carry over. What is looked up meets only those symbols, variables and parameters that it names, so the joins grow
    with the change; the rest of a run is read by filters against the small tables of what has changed.

    Returns the facts, and (kind, n): how many were looked up."""
    part = ["component_id"]
    names = _differences(_symbols(gone), _symbols(fresh), [*part, "name"]).withColumnRenamed("name", "callee")
    variables = _differences(_variables(_constructions(gone)), _variables(_constructions(fresh)), [*part, "variable"])
    classes = _differences(_points(gone), _points(fresh), [*part, "class_name"])
    receiver = F.trim(F.regexp_replace("receiver", "^this[.]", ""))
    calls, made = _calls(kept).withColumn("variable", receiver), _constructions(kept).filter(F.size("arguments") > 0)
    of_argument = lambda rows: rows.select("id", *part, F.explode("arguments").alias("variable"))
    hit = made.join(classes, [*part, "class_name"], "left_semi").select("id").unionAll(of_argument(made).join(variables, [*part, "variable"], "left_semi").select("id"))
    # bindings have no name of their construction but its evidence: all that shares it goes together
    places = small_side(cut(made.join(small_side(cut(hit.distinct())), "id", "left_semi").select(F.explode("evidence_ids").alias("_e")).distinct()))
    at = kept.filter(F.col("kind").isin("object_construction", "dependency_binding")).select("id", F.explode("evidence_ids").alias("_e"))
    again = (
        _import_hits(_imports(kept), small_side(cut(moved))).select("id")
        .unionAll(calls.join(names, [*part, "callee"], "left_semi").select("id")).unionAll(calls.join(variables, [*part, "variable"], "left_semi").select("id"))
        .unionAll(calls.join(classes.withColumnRenamed("class_name", "caller_class"), [*part, "caller_class"], "left_semi").select("id")).unionAll(at.join(places, "_e", "left_semi").select("id"))
    )
    again = small_side(cut(again.distinct()))
    asked = cut(kept.join(again, "id", "left_semi").filter("kind <> 'dependency_binding'").unionByName(fresh))
    asked_calls, asked_made = _calls(asked), _constructions(asked)
    wanted = lambda *rows: small_side(cut(reduce(DataFrame.unionAll, rows).distinct()))
    of_names = wanted(asked_calls.select(*part, F.col("callee").alias("name")))
    of_variables = wanted(asked_calls.select(*part, receiver.alias("variable")), of_argument(asked_made).select(*part, "variable"))
    of_classes = wanted(asked_calls.select(*part, F.col("caller_class").alias("class_name")), asked_made.select(*part, "class_name"))
    whole = kept.unionByName(fresh)
    told = _resolved(
        asked, files, _symbols(whole).join(of_names, [*part, "name"], "left_semi"), _variables(_constructions(whole)).join(of_variables, [*part, "variable"], "left_semi"),
        _points(whole).join(of_classes, [*part, "class_name"], "left_semi"),
    )
    carried = kept.join(again, "id", "left_anti")
    counted = asked.filter(F.col("kind").isin("module_dependency", "symbol_call", "object_construction")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return carried.select(told.columns).unionByName(told), counted
