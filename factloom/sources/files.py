"""Snapshots of file trees, Markdown folders, manifests and JSON lines, as tables."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ids import stable_id

MAX_FILE_BYTES, MAX_ENTRIES, MAX_DEPTH = 2 * 1024 * 1024, 100_000, 64
TREE_LINE = r"^(\d{6}) (blob|commit|tree) ([0-9a-f]{40,64})\s+(-|\d+)\t([\s\S]+)$"  # fixed value: a line of a tree listing


def parse_tree(listing: Column) -> Column:
    """Entries of a NUL-separated tree listing, as an array of structs."""
    lines = F.filter(F.split(listing, "\u0000"), lambda x: x != "")

    def entry(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, TREE_LINE, k)
        kind = F.when(part(1) == "120000", "symlink").when(part(2) == "commit", "submodule").otherwise("blob")
        return F.struct(part(5).alias("relative_path"), part(3).alias("object_id"), F.try_to_number(F.when(part(4) != "-", part(4)), F.lit("999999999999")).cast("long").alias("size"), part(1).alias("mode"), kind.alias("kind"))

    return F.transform(lines, entry)


def checked_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or re.search(r"[\x00-\x20~^:?*\[\\]|\.\.", ref):
        raise ValueError(f"not a reference: {ref!r}")
    return ref


def _git(repository: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True, timeout=300).stdout


class GitTreeSource(DataSource):
    """spark.read.format("git_tree").option("repository", folder).option("ref", name): one row for each entry, with the text of
    files that may be read. Entries are dealt to tasks by ranges; each task reads its blobs in one process."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repository_id string, relative_path string, object_id string, size long, mode string, kind string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _GitTreeReader(self.options)


class _Range(InputPartition):
    def __init__(self, entries: list[tuple]):
        self.entries = entries


class _GitTreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.repository, self.ref = options["repository"], checked_ref(options.get("ref", "HEAD"))
        self.id = options.get("repositoryId", Path(self.repository).resolve().name)
        self.most, self.each = int(options.get("maxFileBytes", MAX_FILE_BYTES)), int(options.get("entriesPerTask", 500))

    def partitions(self) -> list[InputPartition]:
        lines = _git(self.repository, "ls-tree", "-rlz", self.ref).decode("utf-8", "surrogateescape").split("\0")
        found = [m.groups() for x in lines if (m := re.match(TREE_LINE, x))]
        if len(found) > MAX_ENTRIES:
            raise ValueError(f"{len(found)} entries are more than {MAX_ENTRIES}")
        return [_Range(found[k : k + self.each]) for k in range(0, len(found), self.each)] or [_Range([])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        wanted = [e for e in partition.entries if e[1] == "blob" and e[0] != "120000" and e[3] != "-" and int(e[3]) <= self.most]
        blobs: dict[str, bytes] = {}
        if wanted:
            out = subprocess.run(["git", "-C", self.repository, "cat-file", "--batch"], input="\n".join(e[2] for e in wanted).encode() + b"\n", check=True, capture_output=True, timeout=600).stdout
            at = 0
            for _ in wanted:
                end = out.index(b"\n", at)
                oid, _, n = out[at:end].decode().split(" ")
                blobs[oid] = out[end + 1 : end + 1 + int(n)]
                at = end + int(n) + 2
        for mode, kind, oid, size, path in partition.entries:
            what = "symlink" if mode == "120000" else "submodule" if kind == "commit" else "blob"
            yield self.id, path, oid, None if size == "-" else int(size), mode, what, blobs.get(oid) if what == "blob" else None


def read_git_tree(spark: SparkSession, repository: str, ref: str = "HEAD", repository_id: str | None = None) -> DataFrame:
    spark.dataSource.register(GitTreeSource)
    reader = spark.read.format("git_tree").option("repository", repository).option("ref", ref)
    return (reader if repository_id is None else reader.option("repositoryId", repository_id)).load()


def with_text(entries: DataFrame) -> DataFrame:
    """Adds text, and source_hash of the raw bytes; bytes that are no UTF-8 give no text."""
    return entries.withColumns({"source_hash": F.sha2("content", 256), "text": F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))})


def read_working_tree(spark: SparkSession, folder: str, repository_id: str, paths: list[str] | None = None) -> DataFrame:
    """Files of a folder that is written to: each is read twice, and has to be the same. Excluded and secret names are refused."""
    from ..operators.inventory import CREDENTIALS, EXCLUDED_DIRECTORIES

    root = Path(folder).resolve()
    chosen = [root / p for p in paths] if paths is not None else [p for p in sorted(root.rglob("*")) if p.is_file()]
    rows = []
    for p in chosen:
        relative = p.relative_to(root).as_posix()
        refused = set(relative.split("/")) & set(EXCLUDED_DIRECTORIES) or re.search(CREDENTIALS, relative)
        if refused and paths is None:
            continue
        if refused or not p.resolve().is_relative_to(root):
            raise ValueError(f"{relative} may not be read")
        for attempt in (1, 2):
            first, second = p.read_bytes(), p.read_bytes()
            if first == second:
                break
            if attempt == 2:
                raise IOError(f"{relative} changes while it is read")
        rows.append((repository_id, relative, None, len(first), "100644", "blob", bytearray(first)))
    return spark.createDataFrame(rows, GitTreeSource({}).schema())


def read_folder(spark: SparkSession, folder: str, repository_id: str, pattern: str = "*") -> DataFrame:
    """Any folder that Spark reads, by binaryFile: files of at most MAX_FILE_BYTES."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).filter(F.col("length") <= MAX_FILE_BYTES)
    tail = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape("/" + folder.split(":", 1)[-1].strip("/") + "/"), "")
    return found.select(F.lit(repository_id).alias("repository_id"), tail.alias("relative_path"), F.lit(None).cast("string").alias("object_id"), F.col("length").alias("size"), F.lit("100644").alias("mode"), F.lit("blob").alias("kind"), "content")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all .md files below a folder."""
    return read_folder(spark, folder, "_", "*.md").select(F.col("relative_path").alias("path"), F.col("content").cast("string").alias("content"))


def in_memory(spark: SparkSession, files: Mapping[str, str], repository_id: str = "repo", snapshot_id: str = "snapshot") -> DataFrame:
    rows = [(repository_id, snapshot_id, p, None, len(t.encode()), "100644", "blob", t) for p, t in sorted(files.items())]
    return spark.createDataFrame(rows, "repository_id string, snapshot_id string, relative_path string, object_id string, size long, mode string, kind string, text string")


def snapshot_row(entries: DataFrame, ref: str, commit: str | None = None, mode: str = "git") -> DataFrame:
    """One row for each repository: a snapshot's id comes from what it holds."""
    listed = entries.groupBy("repository_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "relative_path", "object_id", F.col("size").cast("string")))), "\n"), 256).alias("content_hash"))
    return listed.select(stable_id("snapshot", F.col("repository_id"), F.lit(ref), F.col("content_hash")).alias("id"), "repository_id", F.lit(ref).alias("requested_ref"), F.lit(commit).cast("string").alias("commit_oid"), F.lit(mode).alias("capture_mode"), "content_hash", F.lit(mode != "git").alias("dirty"))


# --- manifests ------------------------------------------------------------------------------------------------------


def _depth(value, n: int = 0) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max((_depth(v, n + 1) for v in inner), default=n)


def _without_comments(text: str) -> str:
    """JSON out of JSON with comments and commas before brackets; strings stay as they are."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


def _element(e: ET.Element):
    inner = [(c.tag.rsplit("}", 1)[-1], _element(c)) for c in e]
    if not inner:
        return (e.text or "").strip() if not e.attrib else {"@": dict(e.attrib), "#": (e.text or "").strip()}
    out: dict = {"@": dict(e.attrib)} if e.attrib else {}
    for k, v in inner:
        out.setdefault(k, []).append(v)
    return {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in out.items()}


def parse_manifest(path: str, text: str):
    """A manifest's value. Too large or too deep a file, a document type or an entity in XML, and many aliases in YAML are errors."""
    if len(text.encode()) > MAX_FILE_BYTES:
        raise ValueError("the manifest is too large")
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "json":
        value = json.loads(text)
    elif ending in ("jsonc", "code-workspace"):
        value = json.loads(_without_comments(text))
    elif ending == "toml":
        value = tomllib.loads(text)
    elif ending in ("yaml", "yml"):
        if len(re.findall(r"(?m)(?:^|[\s\[{,:-])\*[\w-]+", text)) > 20:
            raise ValueError("too many aliases")
        try:
            import yaml
        except ImportError as error:
            raise ValueError("YAML needs a parser that isn't installed") from error
        value = yaml.safe_load(text)
    elif ending in ("xml", "csproj", "config"):
        if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.IGNORECASE):
            raise ValueError("document types and entities aren't read")
        root = ET.fromstring(text)
        value = {root.tag.rsplit("}", 1)[-1]: _element(root)}
    else:
        raise ValueError(f"{path} is no manifest")
    if _depth(value) > MAX_DEPTH:
        raise ValueError("the manifest is too deep")
    return value


def read_manifests(files: DataFrame) -> DataFrame:
    """(repository_id, relative_path, value_json, error) of manifests among files with text."""
    from .ship import ship

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    values.append(json.dumps(parse_manifest(path, text), default=str, ensure_ascii=False))
                    errors.append(None)
                except Exception as error:  # a file's own fault is a row, not the end of the job
                    values.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:300])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["repository_id", "relative_path", "value_json", "error"])

    own = files.filter(F.col("text").isNotNull() & F.col("relative_path").rlike(r"(?i)\.(?:jsonc?|code-workspace|toml|ya?ml|xml|csproj)$")).select("repository_id", "relative_path", "text")
    return own.mapInArrow(run, "repository_id string, relative_path string, value_json string, error string")


def read_final_event(spark: SparkSession, path: str, schema: str, kind: str = "type", final: str = "final", most_bytes: int = 64 << 20) -> DataFrame:
    """The one final row of a JSON-lines stream. None, more than one, or too many bytes is an error."""
    lines = spark.read.text(path)
    told = lines.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).first()
    if told["bytes"] > most_bytes:
        raise ValueError("the stream is too long")
    rows = lines.select(F.from_json("value", schema).alias("x")).select("x.*").filter(F.col(kind) == final)
    if (n := rows.limit(2).count()) != 1:
        raise ValueError(f"{n} final events")
    return rows
