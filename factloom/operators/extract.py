"""Facts and evidence of files. One pass of Arrow batches over the files that a rule or a scan may read; offsets are bytes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ids import canonical_json, sha256, stable_id
from ..functions.text import value_redactor
from ..sources.ship import ship
from ..sources.storage import cut
from .architecture import with_metadata

MAX_FILE_BYTES = 2 * 1024 * 1024
RAW = "repository_id string, snapshot_id string, relative_path string, source_hash string, rule_id string, kind string, start long, end long, value_json string"


def _found(path: str, text: str, rule_ids: frozenset[str] | None) -> Iterator[tuple[str, str, int, int, dict[str, Any]]]:
    from ..functions.rules import RULES, matches, payload
    from ..functions.scans import scan

    for rule in RULES:
        if rule_ids is None or rule.id in rule_ids:
            for m in matches(rule, path, text):
                yield rule.id, rule.kind, m.start(), m.end(), payload(rule, m)
    if rule_ids is None or rule_ids - {rule.id for rule in RULES}:  # a scan is asked for
        for row in scan(path, text, rule_ids):
            if rule_ids is None or row[0] in rule_ids:
                yield row


def _rows(rule_ids: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repository_id", "snapshot_id", "relative_path", "source_hash", "rule_id", "kind", "start", "end", "value_json"]
        kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string()]
        redacted = value_redactor()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for repository, snapshot, path, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain = text.isascii()
                for rule, kind, start, end, value in _found(path, text, rule_ids):
                    if not plain:
                        start, end = len(text[:start].encode()), len(text[:end].encode())
                    own = json.dumps(redacted({"source_path": path} | value), ensure_ascii=False)
                    for to, v in zip(rows, (repository, snapshot, path, digest, rule, kind, start, end, own), strict=True):
                        to.append(v)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=names)

    return run


def extract(files: DataFrame, rule_ids: set[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files (repository_id, snapshot_id, relative_path, text) to raw findings, redacted."""
    ship(files.sparkSession)
    own = files.filter((F.octet_length("text") <= max_bytes) & F.col("text").isNotNull()).select("repository_id", "snapshot_id", "relative_path", sha256(F.col("text")).alias("source_hash"), "text")
    return own.mapInArrow(_rows(None if rule_ids is None else frozenset(rule_ids)), RAW)


#: The rules of each extractor, by the beginnings of their ids.
PLUGINS = {
    "source-architecture": ("repository.", "source.", "package."), "node-express": ("express.", "node.", "supabase."), "python": ("python.",), "dotnet": ("dotnet.",), "js-angular": ("angular.",), "js-react": ("react.",),
    "java-spring": ("spring.",), "java-webflux": ("webflux.",), "java-weblogic": ("jee.",),
}
SCANS = (
    "repository.file", "repository.build-module", "repository.build-dependency", "source.module", "source.symbol", "source.call", "source.construction", "source.injection", "source.type-relation", "source.import",
    "package.dependencies", "package.scripts", "package.runtime", "spring.annotated-endpoint", "webflux.functional-route", "webflux.reactive-pipeline",
)


def rules_of(plugins: Iterable[str]) -> set[str]:
    """The ids of all rules of these extractors; one that isn't there is an error."""
    from ..functions.rules import RULES

    wanted = set(plugins)
    if strange := wanted - PLUGINS.keys():
        raise ValueError(f"unknown extractors {sorted(strange)}")
    return {r for r in (*(rule.id for rule in RULES), *SCANS) if any(r.startswith(PLUGINS[p]) for p in wanted)}


def extract_cached(files: DataFrame, root: str, rule_ids: set[str] | None = None, version: str = "1") -> DataFrame:
    """extract(), with what files of the same path and content gave before, in tables under root. An entry counts if its findings
    are those that its checksum was made of; if not, the file is read again and the newer entry counts."""
    spark = files.sparkSession
    columns = ["rule_id", "kind", "start", "end", "value_json"]
    basis = sha256(F.lit(json.dumps([version, sorted(rule_ids) if rule_ids is not None else None])))
    own = files.filter((F.octet_length("text") <= MAX_FILE_BYTES) & F.col("text").isNotNull())
    own = own.withColumn("_key", sha256(F.concat_ws("\u0001", "relative_path", sha256(F.col("text")), basis)))
    digest = F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in columns)}))"), F.lit(0))
    schemas = {"findings": f"_key string, _batch string, {RAW.split('source_hash string, ')[1]}", "entries": "_key string, _batch string, n long, checksum long, written_at timestamp"}

    def table(name: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schemas[name]).parquet(f"{root}/{name}") if there else spark.createDataFrame([], schemas[name])

    found, entries = table("findings"), table("entries")
    sums = found.groupBy("_key", "_batch").agg(F.count(F.lit(1)).alias("n"), digest.alias("checksum"))
    sound = entries.join(sums, ["_key", "_batch", "n", "checksum"]).groupBy("_key").agg(F.max_by("_batch", "written_at").alias("_batch"))
    sound = cut(sound)
    batch = uuid.uuid4().hex
    fresh = own.join(sound, "_key", "left_anti")
    one = fresh.groupBy("_key").agg(F.first(F.struct("repository_id", "snapshot_id", "relative_path", "text")).alias("f")).select("f.*")
    raw = cut(extract(one, rule_ids))
    keyed = raw.withColumn("_key", sha256(F.concat_ws("\u0001", "relative_path", "source_hash", basis))).withColumn("_batch", F.lit(batch)).select("_key", "_batch", *columns)
    keyed.write.mode("append").parquet(f"{root}/findings")
    keyed.groupBy("_key", "_batch").agg(F.count(F.lit(1)).alias("n"), digest.alias("checksum")).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/entries")
    known = found.join(sound, ["_key", "_batch"], "left_semi").select("_key", *columns).unionByName(keyed.select("_key", *columns))
    named = own.select("repository_id", "snapshot_id", "relative_path", sha256(F.col("text")).alias("source_hash"), "_key")
    return named.join(known, "_key").select("repository_id", "snapshot_id", "relative_path", "source_hash", *columns)


def evidence_of(found: DataFrame) -> DataFrame:
    """One row for each place and rule."""
    own = found.select("repository_id", "snapshot_id", "relative_path", "source_hash", "rule_id", "start", "end").distinct()
    locator = F.struct(F.lit("bytes").alias("kind"), "start", "end", F.lit(None).cast("string").alias("key"))
    return own.select(stable_id("evidence", *(F.col(c) for c in ("snapshot_id", "relative_path", "start", "end", "rule_id"))).alias("id"), "repository_id", "snapshot_id", "relative_path", "source_hash", locator.alias("locator"), "rule_id")


def facts_of(found: DataFrame) -> DataFrame:
    """Facts of findings, which were redacted before, so that ids come from what is left; equal facts are one."""
    value = canonical_json(F.col("value_json"))
    evidence = stable_id("evidence", *(F.col(c) for c in ("snapshot_id", "relative_path", "start", "end", "rule_id")))
    own = with_metadata(found).withColumns({"value_json": value, "_e": evidence})
    return own.select(stable_id("fact", F.col("repository_id"), F.col("kind"), F.col("value_json"), F.col("_e")).alias("id"), "kind", F.col("repository_id").alias("component_id"), "value_json", F.array("_e").alias("evidence_ids"), "rule_id").dropDuplicates(["id"])


def read_evidence(evidence: DataFrame, files: DataFrame, before: int = 0, after: int = 0, max_bytes: int = 1 << 20, max_files: int = 20) -> DataFrame:
    """(id, relative_path, first_line, snippet) of evidence whose file is still the one it was taken from: the lines around its
    bytes. More files or bytes than allowed are an error."""
    own = evidence.join(files.select("repository_id", "relative_path", "text"), ["repository_id", "relative_path"]).filter(sha256(F.col("text")) == F.col("source_hash"))
    head = F.decode(F.substring(F.encode("text", "utf-8"), F.lit(1), F.col("locator.start").cast("int")), "utf-8")
    body = F.decode(F.substring(F.encode("text", "utf-8"), (F.col("locator.start") + 1).cast("int"), (F.col("locator.end") - F.col("locator.start")).cast("int")), "utf-8")
    lines = lambda c: F.size(F.split(c, "\n"))
    first = F.greatest(F.lit(1), lines(head) - before)
    taken = own.select("id", "relative_path", first.alias("first_line"), F.array_join(F.slice(F.split("text", "\n"), first, lines(head) - first + lines(body) + after), "\n").alias("snippet"))
    used = taken.agg(F.count_distinct("relative_path").alias("files"), F.coalesce(F.sum(F.octet_length("snippet")), F.lit(0)).alias("bytes")).first()
    if used["files"] > max_files or used["bytes"] > max_bytes:
        raise ValueError(f"{used['files']} files and {used['bytes']} bytes are more than may be read")
    return taken
