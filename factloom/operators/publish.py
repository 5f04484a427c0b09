"""Editions: manifests, digests, checks before publishing, and which ones stay."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import sha256
from ..functions.text import has_secret
from .diff import manifests_differ

ALLOWED = r"(?i)\.(?:md|json|mmd|svg|png|canvas)$"  # fixed value: what may be published
EXECUTABLE_LINK = r"(?i)\]\(\s*(?:javascript|data|vbscript|file):"


def manifest(files: DataFrame) -> DataFrame:
    """files (edition_id, path, content): path, sha256 and size of each file."""
    return files.select("edition_id", "path", sha256(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def edition_digest(rows: DataFrame) -> DataFrame:
    """One hash for each edition: of its paths and hashes, in path order."""
    listed = rows.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("_all"), F.count(F.lit(1)).alias("files"))
    return listed.select("edition_id", "files", F.sha2(F.array_join(F.transform("_all", lambda x: F.concat_ws(":", x["path"], x["sha256"])), "\n"), 256).alias("content_hash"))


def same_edition(a: DataFrame, b: DataFrame) -> bool:
    return manifests_differ(a, b).isEmpty()


def publishable(path: Column) -> Column:
    return path.rlike(ALLOWED) & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.startswith("/")


def issues(files: DataFrame) -> DataFrame:
    """(path, issue) of files that mustn't be published."""
    found = F.array_compact(F.array(F.when(~publishable(F.col("path")), F.lit("path")), F.when(has_secret(F.col("content")), F.lit("secret")), F.when(F.col("content").rlike(EXECUTABLE_LINK), F.lit("link"))))
    return files.select("path", F.explode(found).alias("issue"))


def pointers(editions: DataFrame, keep: int = 1) -> tuple[DataFrame, DataFrame]:
    """editions (edition_id, published_at): the newest that stay, and the others."""
    newest = editions.orderBy(F.desc("published_at"), F.desc("edition_id")).limit(keep)
    return newest, editions.join(newest.select("edition_id"), "edition_id", "left_anti")


def unreferenced(stored: DataFrame, used: DataFrame, key: str = "digest") -> DataFrame:
    """Stored content that nothing uses any more."""
    return stored.join(used.select(key), key, "left_anti")


POINTERS = "edition_id string, published_at timestamp, fence long"
LEASE_SECONDS = 3600  # how long a publisher may give no sign of life


def _name(number: int) -> str:
    return f"{number:012d}"


class Lease:
    """The right to publish to a folder. Each has a number, one more than the one before; of those who make a number's file one
    succeeds. The greatest number holds, until it is given back or `seconds` have passed since it was last renewed, by the clocks of the
    file system and of who asks. A holder that was taken for dead finds a greater number when it checks."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = LEASE_SECONDS):
        self.root, self._path = root, spark._jvm.org.apache.hadoop.fs.Path
        self._folder = f"{root}/.leases"
        self._system = self._path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            self._system.mkdirs(self._path(self._folder))
        except Exception as e:
            raise RuntimeError(f"{root} can't be locked") from e
        there = self._there()
        last = max((n for n in there if n.isdigit()), default=None)
        if last and f"{last}.done" not in there and time.time() * 1000 - there[last] < seconds * 1000:
            raise RuntimeError(f"{root} is being published to")
        self.number = int(last or 0) + 1
        if not self._make(_name(self.number)):
            raise RuntimeError(f"{root} is being published to")
        for name in there:
            self._system.delete(self._path(f"{self._folder}/{name}"), False)

    def _there(self) -> dict[str, int]:
        return {s.getPath().getName(): s.getModificationTime() for s in self._system.listStatus(self._path(self._folder))}

    def _make(self, name: str) -> bool:
        try:
            return self._system.createNewFile(self._path(f"{self._folder}/{name}"))
        except Exception as e:
            if name in self._there():
                return False
            raise RuntimeError(f"{self.root} can't be locked") from e

    def check(self) -> None:
        """Renews the lease, or fails if another one has taken over."""
        if max(n for n in self._there() if n.isdigit()) != _name(self.number):
            raise RuntimeError(f"another publisher has taken over {self.root}")
        self._system.setTimes(self._path(f"{self._folder}/{_name(self.number)}"), int(time.time() * 1000), -1)

    def give_back(self) -> None:
        self._make(f"{_name(self.number)}.done")


@contextlib.contextmanager
def locked(spark: SparkSession, root: str, seconds: float = LEASE_SECONDS):
    """One publisher at a time."""
    lease = Lease(spark, root, seconds)
    try:
        yield lease
    finally:
        lease.give_back()


class FolderTarget:
    """Editions as tables in a folder. Another place to publish to is another class with these methods: staged files can be read back
    and either become an edition as a whole or go; what is pointed to is the edition of the greatest fence, so a pointer that a
    publisher writes after another one has taken over changes nothing."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet", seconds: float = LEASE_SECONDS):
        self.spark, self.root, self.format, self.seconds = spark, root, format, seconds

    def lease(self):
        return locked(self.spark, self.root, self.seconds)

    def _at(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, edition_id: str) -> bool:
        system, path = self._at(f"editions/{edition_id}")
        return system.exists(path)

    def edition(self, edition_id: str) -> DataFrame:
        return self.spark.read.format(self.format).load(f"{self.root}/editions/{edition_id}")

    def stage(self, files: DataFrame, fence: int) -> DataFrame:
        """Files that are no edition yet, as they are read back. What publishers before this one have left is removed."""
        self.discard()
        files.write.format(self.format).save(f"{self.root}/staging/{_name(fence)}")
        return self.spark.read.format(self.format).schema(files.schema).load(f"{self.root}/staging/{_name(fence)}")

    def promote(self, fence: int, edition_id: str) -> None:
        """Staged files become an edition by one renaming."""
        system, to = self._at(f"editions/{edition_id}")
        system.mkdirs(to.getParent())
        if system.exists(to) or not system.rename(self._at(f"staging/{_name(fence)}")[1], to):
            raise IOError(f"edition {edition_id} can't be promoted")

    def discard(self, fence: int | None = None) -> None:
        system, path = self._at("staging" if fence is None else f"staging/{_name(fence)}")
        system.delete(path, True)

    def point_to(self, edition_id: str, fence: int) -> None:
        row = self.spark.createDataFrame([(edition_id, fence)], "edition_id string, fence long").withColumn("published_at", F.current_timestamp())
        row.select("edition_id", "published_at", "fence").coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")

    def published(self) -> DataFrame:
        """(edition_id, published_at): when each edition was last pointed to, by fence first."""
        rows = self.spark.read.schema(POINTERS).parquet(f"{self.root}/pointers")
        return rows.groupBy("edition_id").agg(F.max(F.struct(F.coalesce("fence", F.lit(0)).alias("fence"), "published_at")).alias("published_at"))

    def remove(self, edition_id: str) -> None:
        system, path = self._at(f"editions/{edition_id}")
        system.delete(path, True)


def publish(files: DataFrame, root: str | FolderTarget, edition_id: str, keep: int | None = None) -> DataFrame:
    """Stage an edition's files, read them again, make them an edition once they are whole, and point to it; of editions, the newest
    `keep` stay. Returns its manifest. Files that fail leave nothing behind. An edition that is there isn't written over: the same files
    are pointed to again, as after a publisher that was lost on its way, and others are an error."""
    target = root if isinstance(root, FolderTarget) else FolderTarget(files.sparkSession, root)
    found = issues(files)
    if not found.isEmpty():
        raise ValueError(f"not publishable: {[tuple(r) for r in found.limit(5).collect()]}")
    own = files.withColumn("edition_id", F.lit(edition_id))
    with target.lease() as lease:
        if target.has(edition_id):
            if not same_edition(manifest(own), manifest(target.edition(edition_id))):
                raise ValueError(f"edition {edition_id} is there with other files")
        else:
            try:
                back = target.stage(own, lease.number)
                if not same_edition(manifest(own), manifest(back)):
                    raise IOError("the edition isn't what was written")
                lease.check()
                target.promote(lease.number, edition_id)
            except BaseException:
                target.discard(lease.number)
                raise
        lease.check()
        target.point_to(edition_id, lease.number)
        if keep is not None:
            _retain(target, keep)
    return manifest(target.edition(edition_id))


def _retain(target: FolderTarget, keep: int) -> list[str]:
    _, rest = pointers(target.published(), max(1, keep))
    gone = sorted(r["edition_id"] for r in rest.select("edition_id").collect())
    for edition in gone:
        target.remove(edition)
    return gone


def retain(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Removes all editions but the newest `keep` that were published, and returns their ids (a folder each, so few). The one that
    is pointed to stays."""
    return _retain(FolderTarget(spark, root), keep)


def current(spark: SparkSession, root: str | FolderTarget) -> DataFrame:
    """The files of the edition that was published last."""
    target = root if isinstance(root, FolderTarget) else FolderTarget(spark, root)
    newest, _ = pointers(target.published())
    return target.edition(newest.first()["edition_id"])


def restore(spark: SparkSession, root: str, edition_id: str) -> None:
    """Point to an edition that is still there."""
    target = FolderTarget(spark, root)
    target.edition(edition_id)
    with target.lease() as lease:
        target.point_to(edition_id, lease.number)
