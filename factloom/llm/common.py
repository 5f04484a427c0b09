"""Shared helpers: shipping the package to executors, shared storage, input columns."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, and bound the batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp()  # the driver serves the file from here to its executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, f"{PACKAGE.name}_{app.replace('-', '_')}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(to)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own if all runs on this
    machine, and an error on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        got = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, so that a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() made, once no later result reads it."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder. Results that read them must be done."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_side(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A table that written() made, marked for broadcast if it has no more than `rows` rows; else Spark joins by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table
