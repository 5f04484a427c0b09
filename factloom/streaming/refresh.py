"""Facts of files as they arrive: a stream of file rows, extracted as it comes and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import evidence_of, extract, facts_of
from ..operators.query import last_of_each

FILES = "repository_id string, snapshot_id string, relative_path string, text string, captured_at timestamp"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """File rows, as Parquet files come into a folder."""
    return spark.readStream.schema(FILES).parquet(folder)


def merge_facts(stream: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Facts and evidence of each micro-batch, in a folder of the batch's number: a batch that is run again replaces its own
    folder, so each file's facts are there once. Of a file that comes twice in a batch the last row counts."""

    def write(batch: DataFrame, number: int) -> None:
        last = last_of_each(batch, ["repository_id", "relative_path"], "captured_at").drop("_first")
        found = extract(last)
        for name, df in (("facts", facts_of(found)), ("evidence", evidence_of(found))):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        last.select("repository_id", "relative_path", "captured_at").write.mode("overwrite").parquet(f"{root}/seen/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts of the newest row of each file, over all batches."""
    seen = spark.read.parquet(f"{root}/seen")
    newest = last_of_each(seen.withColumn("_o", F.struct("captured_at", "batch")), ["repository_id", "relative_path"], "_o").select("repository_id", "relative_path", "batch")
    evidence = spark.read.parquet(f"{root}/evidence").join(newest, ["repository_id", "relative_path", "batch"], "left_semi").select("id", "batch")
    facts = spark.read.parquet(f"{root}/facts")
    kept = facts.select(F.col("id").alias("_f"), "batch", F.explode("evidence_ids").alias("id")).join(evidence, ["id", "batch"], "left_semi").select(F.col("_f").alias("id"), "batch").distinct()
    return facts.join(kept, ["id", "batch"], "left_semi").drop("batch").dropDuplicates(["id"])


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type in windows of event time; what is later than the watermark is left out."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
