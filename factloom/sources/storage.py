"""The shared folder: tables between steps, run artifacts, and lineage cuts that outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import redact_json
from .ship import ship

ARTIFACTS = ("files", "facts", "evidence", "diagnostics", "coverage", "nodes", "edges", "chunks", "links", "capabilities", "contexts", "analyses")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if all runs on this machine, and an error on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        got = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the next step plans from a table, and a lost executor costs its
    running tasks only."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{df.sparkSession.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A table that cut() made, marked for broadcast if it has no more than `rows` rows; else Spark joins by a shuffle, whose
    skewed parts it can split."""
    return F.broadcast(table) if table.count() <= rows else table


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has cut its lineage with. Results that read them must be done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_artifact(df: DataFrame, root: str, name: str) -> None:
    """One artifact of runs, by run and repository; writing a run again replaces its own folders only."""
    if name not in ARTIFACTS:
        raise ValueError(f"unknown artifact {name}")
    keys = [c for c in ("run_id", "repository_id") if c in df.columns]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/{name}")


def read_artifact(spark: SparkSession, root: str, name: str, run_id: str | None = None, repository_ids: list[str] | None = None) -> DataFrame:
    """The rows of one run; both filters prune folders. Values are redacted on reading too."""
    df = spark.read.parquet(f"{root}/{name}")
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if repository_ids is not None:
        df = df.filter(F.col("repository_id").isin(*repository_ids))
    return redacted(df)


def redacted(df: DataFrame) -> DataFrame:
    """Rows with their values redacted, where they have any."""
    ship(df.sparkSession)
    return df.withColumn("value_json", redact_json(F.col("value_json"))) if "value_json" in df.columns else df


def append_jsonl(df: DataFrame, path: str) -> None:
    """Audit rows, added as JSON lines."""
    df.write.mode("append").json(path)
