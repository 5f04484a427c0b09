"""Whole runs: files to facts, facts to a graph, documents to an index, and questions to answers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import architecture, capability, chunks, context, contracts, diff, extract, graph, impact, incremental, inventory, query, scope, search, text_index
from ..sources.storage import cut, redacted, small_side, write_artifact


@dataclass
class Run:
    """The tables of one run. Each is a DataFrame; nothing is read before it is asked for."""

    run_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def save(self, root: str) -> None:
        """The tables, then what the catalogue says of each: its schema, its number of rows and a digest. So a run is there once all of
        it is; one that is saved again counts from its newest entry on."""
        spark, told = next(iter(self.tables.values())).sparkSession, []
        for name, df in self.tables.items():
            own = df if "run_id" in df.columns else df.withColumn("run_id", F.lit(self.run_id))
            own = cut(own)
            write_artifact(own, root, name)
            told.append((self.run_id, name, own.schema.json(), df.columns, *_digest(own)))
        listed = spark.createDataFrame(told, "saved_run string, artifact string, schema string, columns array<string>, rows long, digest string")
        listed.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/catalogue")


def _digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and the sum of their hashes, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))).cast("decimal(20,0)")
    got = df.agg(F.count(F.lit(1)), F.sum(row).cast("string")).first()
    return got[0], got[1] or "0"


def saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, saved_at) of the runs that are there as a whole, the newest first."""
    return spark.read.parquet(f"{root}/catalogue").groupBy(F.col("saved_run").alias("run_id")).agg(F.max("saved_at").alias("saved_at")).orderBy(F.desc("saved_at"), F.desc("run_id"))


def load(spark: SparkSession, root: str, run_id: str) -> Run:
    """A saved run, for questions or as a baseline. A table that isn't what the catalogue says, facts whose evidence is missing, and
    evidence of files that aren't listed are errors. Values are redacted on reading."""
    entries = spark.read.parquet(f"{root}/catalogue").filter(F.col("saved_run") == run_id)
    newest = entries.agg(F.max("saved_at")).first()[0]
    if newest is None:
        raise ValueError(f"run {run_id} isn't in the catalogue")
    tables = {}
    for e in entries.filter(F.col("saved_at") == F.lit(newest)).collect():  # one row for each table of the run
        stored = spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{root}/{e['artifact']}").filter(F.col("run_id") == run_id)
        if _digest(stored) != (e["rows"], e["digest"]):
            raise ValueError(f"{e['artifact']} of run {run_id} isn't what was saved")
        tables[e["artifact"]] = redacted(stored).select(*e["columns"])
    if {"facts", "evidence", "files"} <= set(tables):
        lost = contracts.broken_references(tables["facts"], {"evidence_ids": tables["evidence"]}).limit(1).count()
        unlisted = tables["evidence"].join(tables["files"].select("repository_id", "relative_path"), ["repository_id", "relative_path"], "left_anti").limit(1).count()
        if lost or unlisted:
            raise ValueError(f"facts, evidence and files of run {run_id} don't fit")
    return Run(run_id, tables)


def _listed(files: DataFrame) -> DataFrame:
    """The inventory, with a hash of each file that says whether it has changed."""
    own = files if "object_id" in files.columns else files.withColumn("object_id", F.lit(None).cast("string"))
    return inventory.inventory(own).withColumn("source_hash", F.coalesce(F.sha2("text", 256), "object_id"))


def _manifest(listed: DataFrame) -> DataFrame:
    """(path, source_hash) of files that are read, a path with its repository in front."""
    return listed.filter("excluded_reason is null").select(incremental.file_key(F.col("repository_id"), F.col("relative_path")).alias("path"), "source_hash")


def _graph(run_id: str, facts: DataFrame, repositories: DataFrame, aliases: dict[str, str] | None, environment: str | None) -> dict[str, DataFrame]:
    known = graph.resolve_aliases(graph.aliases_of(facts.sparkSession, aliases or {}), repositories)
    edges = cut(graph.build_edges(facts, known, run_id, environment))
    return {"edges": edges, "nodes": graph.build_nodes(facts, repositories, edges, environment)}


def analyse(run_id: str, files: DataFrame, aliases: dict[str, str] | None = None, environment: str | None = None, rule_ids: set[str] | None = None) -> Run:
    """files (repository_id, snapshot_id, relative_path, size, kind, text) to inventory, coverage, facts with what they say about each
    other, evidence and graph."""
    spark = files.sparkSession
    listed = _listed(files)
    read = listed.filter("excluded_reason is null")
    found = cut(extract.extract(read, rule_ids))
    evidence = cut(extract.evidence_of(found))
    facts = cut(architecture.resolve_facts(cut(extract.facts_of(found)), read))
    return Run(run_id, {
        "files": listed.drop("text"), "coverage": inventory.coverage(listed), "facts": facts, "evidence": evidence,
        "diagnostics": spark.createDataFrame([], "id string, severity string, code string, scope string, message string, evidence_ids array<string>, suggested_action string"),
        **_graph(run_id, facts, files.select("repository_id").distinct(), aliases, environment),
    })


def refresh(run_id: str, baseline: Run, files: DataFrame, aliases: dict[str, str] | None = None, environment: str | None = None) -> tuple[str, Run]:
    """What changed since a baseline is read again, with all that imports it; the rest is carried over. What facts say about each other
    is found anew where the change may tell (`architecture.resolve_changes`), so that the result is a full run's."""
    listed = _listed(files)
    read = listed.filter("excluded_reason is null")
    changes = cut(diff.changed_paths(_manifest(baseline["files"]), _manifest(listed)))
    value = F.col("value_json")
    of = lambda name: incremental.file_key(F.col("component_id"), F.get_json_object(value, f"$.{name}"))
    imports = baseline["facts"].filter((F.col("kind") == "module_dependency") & F.get_json_object(value, "$.target_path").isNotNull()).select(of("source_path").alias("source_path"), of("target_path").alias("target_path"))
    how, keys = incremental.plan_refresh(changes, imports)
    inventoried = {"files": listed.drop("text"), "coverage": inventory.coverage(listed)}
    if how == "unchanged":
        return how, Run(baseline.run_id, baseline.tables | inventoried)
    if how == "full":
        return how, analyse(run_id, files, aliases, environment)
    stale = cut(keys.select(F.element_at(F.split("path", incremental.BETWEEN), 1).alias("repository_id"), incremental.path_of(F.col("path")).alias("path")))
    found = cut(extract.extract(read.join(stale.withColumnRenamed("path", "relative_path"), ["repository_id", "relative_path"], "left_semi")))
    snapshots = files.groupBy("repository_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    fresh = cut(extract.facts_of(found))
    merged = incremental.merge(baseline.tables, {"facts": fresh.limit(0), "evidence": extract.evidence_of(found), "diagnostics": baseline["diagnostics"].limit(0)}, stale, snapshots)
    left = baseline["evidence"].join(stale.withColumnRenamed("path", "relative_path"), ["repository_id", "relative_path"], "left_semi")
    left = small_side(cut(left.select(F.col("id").alias("_e"))))
    touched = small_side(cut(baseline["facts"].select("id", F.explode("evidence_ids").alias("_e")).join(left, "_e", "left_semi").select("id").distinct()))
    gone = cut(baseline["facts"].join(touched, "id", "left_semi"))
    moved = changes.filter("change <> 'modified'").select(F.element_at(F.split("path", incremental.BETWEEN), 1).alias("repository_id"), incremental.path_of(F.col("path")).alias("relative_path"))
    told, _ = architecture.resolve_changes(cut(merged["facts"]), gone, fresh, read, moved)
    facts = cut(told)
    return how, Run(run_id, baseline.tables | merged | inventoried | {"facts": facts} | _graph(run_id, facts, files.select("repository_id").distinct(), aliases, environment))


def document(run: Run, documents: DataFrame, snapshots: DataFrame | None = None, previous: DataFrame | None = None) -> Run:
    """Adds chunks, links and capabilities of documents (path, content)."""
    facts = scope.production_facts(run["facts"])
    own = cut(chunks.build_chunks(documents, run.run_id, snapshots, previous))
    links = cut(chunks.build_links(own, facts, run.tables.get("edges")))
    folded = capability.with_data_resources(capability.fold(own), facts)
    return Run(run.run_id, run.tables | {"chunks": own, "links": links, "capabilities": cut(folded)})


def prepare_context(run: Run, question: str, intent: str, repository: str | None = None, budget: context.Budget = context.Budget()) -> tuple[DataFrame, DataFrame]:
    return context.prepare_context(run["chunks"], run["links"], question, intent, repository, budget)


def analyse_change(run: Run, question: str) -> DataFrame:
    """One row: dimensions and levels of a change."""
    selected, told = prepare_context(run, question, "impact")
    parts = selected.filter("repository_id <> '_workspace'").select(F.concat(F.lit("component:"), "repository_id").alias("id")).distinct()
    evidence = selected.select(F.explode("evidence_ids").alias("id")).distinct()
    unresolved = told.first()["unresolved_relations"]
    return impact.analyse(impact.relevant_edges(run["edges"], evidence, parts), selected, unresolved)


def compare(before: Run, after: Run, complete: bool = True) -> DataFrame:
    return diff.compare_facts(before["facts"], after["facts"], complete=complete)


def ask(run: Run, category: str, **options) -> DataFrame:
    """A page of facts, coverage or evidence."""
    if category in ("coverage", "evidence"):
        return query.query_typed(run[category], **{"order": ("repository_id",) if category == "coverage" else ("id",), **options})
    return query.query_facts(run["facts"], category, **options)


def index(run: Run, root: str) -> text_index.Index:
    """An index of a run's chunks on disk, for find()."""
    return text_index.build(run["chunks"], root)


def find(run: Run, question: str, index: text_index.Index | None = None, **options) -> DataFrame:
    """The best chunks, by a scan, or by an index of them."""
    return search.search_documents(run["chunks"], question, **options) if index is None else text_index.search(index, question, **options)[0]


def compose(spark: SparkSession, facts: DataFrame, published: DataFrame, requested: DataFrame, aliases: dict[str, str] | None = None, environment: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A graph over the newest published run of each repository (repository_id, run_id), where none is requested (the same
    columns). facts carry run_id and repository_id."""
    newest = query.latest(published.select("repository_id", "run_id"), "repository_id", "run_id")
    rest = newest.join(requested.select("repository_id"), "repository_id", "left_anti")
    chosen = requested.select("repository_id", "run_id").unionByName(rest.select("repository_id", "run_id"))
    own = facts.join(chosen, ["repository_id", "run_id"], "left_semi")
    repositories = chosen.select("repository_id").distinct()
    known = graph.resolve_aliases(graph.aliases_of(spark, aliases or {}), repositories)
    edges = graph.build_edges(own, known, "workspace", environment)
    return graph.build_nodes(own, repositories, edges, environment), edges
