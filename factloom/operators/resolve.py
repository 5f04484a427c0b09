"""Resolution of endpoints, calls, injections and imports against what a repository declares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import join_route, simple_type
from ..sources.storage import cut, small_side

# Statuses of endpoints.
WHOLE, COMPOSED, FRAGMENT = "ruta completa", "ruta compuesta estáticamente", "fragmento; montaje no resuelto"


def normalised_symbol(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "router|routes?|[-_.]", "")


def resolve_endpoints(endpoints: DataFrame, mounts: DataFrame, imports: DataFrame) -> DataFrame:
    """endpoints (id, component_id, method, path, handler, source_path, whole boolean), mounts (component_id, path, symbol,
    source_path), imports (component_id, source_path, target_path, symbols array). A mount belongs to a fragment if an import
    leads from the mount's file to the fragment's with the symbol, or if symbol and file have one name."""
    whole = endpoints.filter("whole").select("id", "component_id", "method", "path", "handler", "source_path", F.lit(WHOLE).alias("status"))
    part = endpoints.filter("not whole")
    m = mounts.select("component_id", F.col("path").alias("_mount"), F.col("symbol").alias("_symbol"), F.col("source_path").alias("_at"))
    i = imports.select("component_id", F.col("source_path").alias("_at"), F.col("target_path").alias("source_path"), F.explode("symbols").alias("_symbol")).distinct()
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), "[.][^.]+$", "")
    by_import = part.join(i, ["component_id", "source_path"]).join(m, ["component_id", "_at", "_symbol"]).select("id", "_mount", "_at", "_symbol")
    by_name = part.withColumn("_key", normalised_symbol(stem)).join(m.withColumn("_key", normalised_symbol(F.col("_symbol"))), ["component_id", "_key"]).select("id", "_mount", "_at", "_symbol")
    found = by_import.unionByName(by_name).distinct()
    rest = part.join(found, "id", "left").select(
        "id", "component_id", "method", F.when(F.col("_mount").isNotNull(), join_route(F.col("_mount"), F.col("path"))).otherwise(F.col("path")).alias("path"), "handler", "source_path",
        F.when(F.col("_mount").isNotNull(), COMPOSED).otherwise(FRAGMENT).alias("status"),
    )
    return whole.unionByName(rest)


def _candidates(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key: how many symbols it has, and the one if it is one."""
    return symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("symbol_id", "class_name", "source_path")).alias("one"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, variables: DataFrame, injections: DataFrame) -> DataFrame:
    """calls (id, component_id, caller_class, receiver, callee), symbols (component_id, symbol_id, class_name, name,
    source_path), variables (component_id, variable, type), injections (component_id, class_name, parameter, type).

    The receiver gives a class: this and super the caller's own, this.x the type injected as x, others a variable's type, else
    an injected one, else themselves if such a class has the method. Candidates are the class's methods of the name; without
    one those of the caller's class; without one all of the name. One is supported, more are candidates, none is unresolved."""
    own = F.col("receiver")
    first = F.element_at(F.split(F.regexp_replace(own, "^this[.]", ""), "[.]"), 1)
    typed = calls.withColumn("_r", F.trim(F.regexp_replace(own, "^this[.]", ""))).withColumn("_p", first)
    v = variables.groupBy("component_id", F.col("variable").alias("_r")).agg(F.max("type").alias("_v"))
    i = injections.groupBy("component_id", F.col("class_name").alias("caller_class"), F.col("parameter").alias("_p")).agg(F.max("type").alias("_i"))
    classes = symbols.filter("class_name is not null").select("component_id", F.col("class_name").alias("_s"), F.col("name").alias("callee")).distinct().withColumn("_c", F.col("_s"))
    typed = (
        typed.join(v, ["component_id", "_r"], "left").join(i, ["component_id", "caller_class", "_p"], "left")
        .withColumn("_s", simple_type(own)).join(classes, ["component_id", "_s", "callee"], "left")
    )
    target = (
        F.when(own.isin("this", "super"), F.col("caller_class")).when(own.startswith("this."), F.col("_i")).when(own.isNotNull(), F.coalesce("_v", "_i", "_c"))
    )
    typed = typed.withColumn("_class", target)
    by_class = _candidates(symbols.filter("class_name is not null").withColumnRenamed("name", "callee"), ["component_id", "class_name", "callee"])
    by_name = _candidates(symbols.withColumnRenamed("name", "callee"), ["component_id", "callee"])
    named = lambda df, key, n: df.select("component_id", F.col("class_name").alias(key), "callee", F.col("n").alias(f"_n{n}"), F.col("one").alias(f"_one{n}"))
    joined = (
        typed.join(named(by_class, "_class", 1), ["component_id", "_class", "callee"], "left")
        .join(named(by_class, "caller_class", 2), ["component_id", "caller_class", "callee"], "left")
        .join(by_name.select("component_id", "callee", F.col("n").alias("_n3"), F.col("one").alias("_one3")), ["component_id", "callee"], "left")
    )
    n = F.coalesce("_n1", "_n2", "_n3", F.lit(0))
    one = F.coalesce("_one1", "_one2", "_one3")
    return joined.select(
        "id", "component_id", "caller_class", "receiver", "callee", F.when(n == 1, one["symbol_id"]).alias("target_symbol_id"), F.when(n == 1, F.coalesce(one["class_name"], "_class")).otherwise(F.col("_class")).alias("target_class"),
        F.when(n == 1, one["source_path"]).alias("target_path"), F.when(n == 1, "supported").when(n > 1, "candidate").otherwise("unresolved").alias("resolution"), n.cast("long").alias("candidates"),
    )


def bind_arguments(constructions: DataFrame, injections: DataFrame, variables: DataFrame) -> DataFrame:
    """constructions (id, component_id, type, arguments array), injections (component_id, class_name, ordinal, parameter, type):
    the n-th argument meets the n-th injected parameter of the class, as far as both go."""
    args = constructions.select("id", "component_id", simple_type(F.col("type")).alias("class_name"), F.posexplode("arguments").alias("ordinal", "argument"))
    v = variables.groupBy("component_id", F.col("variable").alias("argument")).agg(F.max("type").alias("_v"))
    both = args.join(injections.select("component_id", "class_name", "ordinal", "parameter", F.col("type").alias("declared_type")), ["component_id", "class_name", "ordinal"]).join(v, ["component_id", "argument"], "left")
    return both.select(
        "id", "component_id", F.col("class_name").alias("consumer_class"), F.col("parameter").alias("injection_point"), "declared_type", F.coalesce("_v", simple_type(F.col("argument"))).alias("implementation_type"),
        "argument", F.when(F.col("_v").isNotNull(), "supported").otherwise("candidate").alias("resolution"),
    )


def nearest_enclosing(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """points (id, key, start, end), ranges (key, range_id, range_start, range_end): the smallest range around each point, of equals the
    first by place, then by range_id; null where there is none, and where the key is null.

    Both are sorted by key and place and swept once, without a join: a stack keeps the ranges that are still open, so a point is
    compared with those around it only, however many its key has."""
    keep, names = points.columns, ("_at", "_mark", "_end", "_range")
    kind = ranges.schema["range_id"].dataType
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) if c != key else F.col(key) for c in keep]
    long = lambda c: F.col(c).cast("long")
    open_ = ranges.select(*nothing, long("range_start"), F.lit(0), long("range_end"), F.col("range_id"))
    asked = points.select(*keep, long("start"), F.lit(1), long("end"), F.lit(None).cast(kind))
    both = asked.toDF(*keep, *names).unionAll(open_.toDF(*keep, *names))
    schema = T.StructType([*points.schema.fields, T.StructField("range_id", kind)])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            found = []
            mark = batch.column("_mark")
            for k, at, point, end, range_ in zip(*(batch.column(c).to_pylist() for c in (key, *names)), strict=True):
                if k != now:
                    now, stack = k, []
                if not point:
                    if range_ is not None and end is not None and at is not None:
                        while stack and stack[-1][0] < at:
                            stack.pop()
                        stack.append((end, at, range_))
                    continue
                around = [(e - s, s, r) for e, s, r in stack if e >= end] if k is not None and at is not None and end is not None else []
                found.append(min(around)[2] if around else None)
            of_points = batch.filter(pc.equal(mark, 1)).select(keep)
            yield pa.RecordBatch.from_arrays([*of_points.columns, pa.array(found, batch.column("_range").type)], names=[*keep, "range_id"])

    return both.repartition(key).sortWithinPartitions(key, "_at", "_mark", F.desc("_end")).mapInArrow(sweep, schema)


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str = "start") -> DataFrame:
    """points (id, key, start), marks (key, start, name): the last mark at or before each point. One sort of both, no join:
    each row takes the last mark that stands before it."""
    m = marks.select(key, F.col(at).alias("_at"), F.col("name").alias("_name"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    p = points.select(key, F.col(at).alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(1).alias("_kind"), "id")
    w = Window.partitionBy(key).orderBy("_at", "_kind", "_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.unionByName(p).withColumn("name", F.last("_name", ignorenulls=True).over(w)).filter("_kind = 1").select("id", key, F.col("_at").alias(at), "name")


def handler_reference(handler: Column) -> Column:
    """What a handler's text calls: its last dotted call, else its last argument without a call's brackets or an arrow's head."""
    flat = F.trim(F.regexp_replace(handler, r"\s+", " "))
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"  # fixed value, as in the two patterns below
    dotted = F.try_element_at(F.regexp_extract_all(flat, F.lit(rf"({name}(?: ?\. ?{name})+) ?(?=\()"), F.lit(1)), F.lit(-1))
    plain = F.regexp_replace(F.trim(F.element_at(F.split(flat, ","), -1)), r"\([^)]*\)$", "")
    return F.regexp_replace(F.coalesce(dotted, F.regexp_replace(plain, rf"^(?:async ?)?(?:\([^)]*\)|{name}) ?=> ?", "")), " ", "")


def handler_symbol(endpoints: DataFrame, symbols: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """endpoints (id, component_id, handler, source_path): the symbol that a handler names. Those fit whose class is that of the
    handler's receiver, where variables (component_id, variable, type) tell it: the one that fits, else one of the same file, which
    counts even if its class doesn't fit, else the first that fits by id."""
    parts = F.filter(F.split(handler_reference(F.col("handler")), "[.?]"), lambda p: p != "")
    asked = endpoints.withColumns({"_name": F.try_element_at(parts, F.lit(-1)), "_receiver": F.try_element_at(parts, F.lit(-2))})
    if variables is None:
        asked = asked.withColumn("_type", F.lit(None).cast("string"))
    else:
        types = variables.groupBy("component_id", F.col("variable").alias("_receiver")).agg(simple_type(F.min("type")).alias("_type"))
        asked = asked.join(types, ["component_id", "_receiver"], "left")
    classes = F.col("class_name") if "class_name" in symbols.columns else F.lit(None).cast("string")
    s = symbols.select("component_id", F.col("name").alias("_name"), "symbol_id", F.col("source_path").alias("_path"), classes.alias("_class"))
    # symbols whose name no handler has aren't grouped
    s = s.join(small_side(cut(asked.select("component_id", "_name").distinct())), ["component_id", "_name"], "left_semi")
    # symbols are reduced for each key that an endpoint may ask by, so that each endpoint meets one row, however many have a common name
    blank = F.col("_path").isNull()
    told = [F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("first"), F.min(F.when(blank, F.col("symbol_id"))).alias("blank")]
    place, row = ["component_id", "_name"], F.struct("n", "first", "blank")
    typed = {"_type": F.col("_class")}
    every, by_class = s.groupBy(*place).agg(*told).select(*place, row.alias("_every")), s.withColumns(typed).groupBy(*place, "_type").agg(*told).select(*place, "_type", row.alias("_typed"))
    near = s.withColumnRenamed("_path", "source_path").groupBy(*place, "source_path").agg(F.min("symbol_id").alias("_near"))
    near_class = s.withColumnRenamed("_path", "source_path").withColumns(typed).groupBy(*place, "source_path", "_type").agg(F.min("symbol_id").alias("_near_typed"))
    met = asked.join(every, place).join(near, [*place, "source_path"], "left")
    if variables is None:
        met = met.withColumns({"_fit": F.col("_every"), "_same": F.col("_near")})
    else:
        met = met.join(by_class, [*place, "_type"], "left").join(near_class, [*place, "source_path", "_type"], "left")
        met = met.withColumns({"_fit": F.when(F.col("_type").isNull(), F.col("_every")).otherwise(F.col("_typed")), "_same": F.when(F.col("_type").isNull(), F.col("_near")).otherwise(F.col("_near_typed"))})
    # a symbol without a path comes before those of other files
    other = F.coalesce(F.when(F.col("source_path").isNotNull(), F.col("_fit.blank")), F.col("_fit.first"))
    chosen = F.when(F.col("_fit.n") == 1, F.col("_fit.first")).when(F.col("_fit.blank").isNull() & F.col("_same").isNotNull(), F.col("_same")).otherwise(F.coalesce("_near", other))
    return endpoints.join(met.groupBy("id").agg(F.min(chosen).alias("symbol_id")), "id", "left").select(*endpoints.columns, "symbol_id")


# What a relative import may mean, in this order.
IMPORT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")


def resolve_relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, repository_id, base) with base the joined path without ending: the first of its meanings that is a file."""
    tried = imports.select("id", "repository_id", "base", F.posexplode(F.array(*map(F.lit, IMPORT_ENDINGS))).alias("_n", "_end")).withColumn("relative_path", F.concat("base", "_end"))
    found = tried.join(files.select("repository_id", "relative_path"), ["repository_id", "relative_path"]).groupBy("id").agg(F.min_by("relative_path", "_n").alias("target_path"))
    return imports.join(found, "id", "left")


def resolve_by_suffix(links: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """links (id, target), documents (doc, path): documents whose path ends with the target, or with it and .md; the first
    `most` in path order. The keys are whole targets: ends of paths, of the lengths that targets with a folder and the same file name
    have, and ends of file names, of the lengths of targets without a folder. So a name that many folders have is no hot key."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = F.regexp_replace(F.regexp_replace("target", "^\\./", ""), "^\\.\\./", "")
    want = links.withColumn("_bare", bare).filter("_bare <> ''").select("id", F.explode(F.array(F.col("_bare"), F.concat("_bare", F.lit(".md")))).alias("_full"))
    inside = F.contains(F.col("_full"), F.lit("/"))
    own = documents.select("doc", "path", last(F.col("path")).alias("_name"))
    placed = want.filter(inside)
    asked = placed.groupBy(last(F.col("_full")).alias("_name")).agg(F.collect_set(F.length("_full")).alias("_sizes"))  # a number for each length of a path
    sized = own.join(asked, "_name").select("doc", "path", F.explode(F.filter("_sizes", lambda n: n <= F.length("path"))).alias("_n"))
    by_name = placed.join(sized.select("doc", "path", F.right("path", F.col("_n")).alias("_full")), "_full")
    ends = want.filter(~inside)
    lengths = sorted(r[0] for r in ends.select(F.length("_full")).distinct().collect())  # no more than the longest name has characters
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_name"))
    keyed = own.select("doc", "path", F.explode(F.transform(cuts, lambda n: F.right("_name", n))).alias("_full"))
    hits = by_name.select("id", "doc", "path").unionByName(ends.join(keyed, "_full").select("id", "doc", "path")).distinct()
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("path", "doc"))).filter(F.col("_n") <= most).drop("_n")


#: How many parts the facts of one repository are dealt to; each gets all entry paths of the repository.
PARTS = 16


def facts_of_paths(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """entries (id, repository_id, path), facts (fact_id, repository_id, value_json): facts of the repository whose value holds the
    path, whatever the case.

    A repository's paths, which are few, are put into an Aho-Corasick automaton, and each value is read once by it: the work is
    linear in the values' lengths and in what is found, however many paths begin alike. Facts of one repository are dealt to PARTS
    parts, each with all of the paths, which come before the facts in the sorted stream of a task. A null repository, path or value and
    an empty path meet nothing."""
    own = entries.filter("repository_id is not null and path <> ''").select("repository_id", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("_part"), F.lit(0).alias("_kind"), "id", F.lit(None).cast(facts.schema["fact_id"].dataType).alias("fact_id"), F.lower("path").alias("_text"))
    values = facts.filter("repository_id is not null and value_json is not null").select(
        "repository_id", F.pmod(F.xxhash64("fact_id"), F.lit(PARTS)).cast("int").alias("_part"), F.lit(1).alias("_kind"), F.lit(None).cast(entries.schema["id"].dataType).alias("id"), "fact_id", F.lower("value_json").alias("_text"),
    )
    schema = T.StructType([T.StructField("id", entries.schema["id"].dataType), T.StructField("fact_id", facts.schema["fact_id"].dataType)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, paths, automaton = None, {}, None
        for batch in batches:
            ids, found = [], []
            for repository, part, kind, id_, fact, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (repository, part) != now:
                    now, paths, automaton = (repository, part), {}, None
                if not kind:
                    paths.setdefault(text, []).append(id_)
                elif paths:
                    if automaton is None:
                        automaton = ahocorasick.Automaton()
                        for path, own_ids in paths.items():
                            automaton.add_word(path, own_ids)
                        automaton.make_automaton()
                    for own_ids in {id(x): x for _, x in automaton.iter(text)}.values():
                        ids.extend(own_ids)
                        found.extend([fact] * len(own_ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(found, batch.column("fact_id").type)], names=["id", "fact_id"])

    both = own.unionAll(values).repartition("repository_id", "_part").sortWithinPartitions("repository_id", "_part", "_kind")
    return both.mapInArrow(read, schema).distinct()
