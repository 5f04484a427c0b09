"""The corpus pipeline: toxicity, exact dedup, near-dedup, best-fit packing.

Each stage takes the table that the stage before has kept, decides over all of it and returns what stays, with the columns of
documents. The last returns the pieces of the documents and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, near_text, packing, toxicity
from factloom.llm.common import written
from factloom.llm.queries import WORD_BPE, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs, exact_dedup.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash over five-word shingles; of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return near_text.first_of_groups(docs, shingle=5, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document, and its place in a sequence of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer(WORD_BPE), end_id=0, capacity=2048), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: No stage but exact dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
