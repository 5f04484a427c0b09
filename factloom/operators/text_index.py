"""Document search over an index on disk. Terms count wherever they stand inside a text, so the index holds trigrams, not words: the
postings of a term's rarest trigrams are intersected, and the chunks that are left are scored as a scan would score them.

An index is a folder of its own below its root, with the tables `documents` (chunks and their normal forms, by number), `postings`
(gram, base, docs: chunks base + each of docs) and `grams` (gram, n), both in parts by the gram's hash and sorted within. Its row in
the root's `manifest` is written last, so a build that was lost on its way isn't there. A row of postings is of one block of texts,
BLOCK characters or one text: a gram has a row for each block that holds it, never one list, and the rows of a gram that most texts
hold are dealt to several tasks when they are written. Chunks are numbered as they are written, in a row within a file, so that sets
of them are masks of 64 chunks each: intersected and joined by mask, not by chunk, and no text is shuffled to be scored."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalise, query_tokens
from ..sources.ship import ship
from ..sources.storage import cut, small_side
from .search import by_score, document_texts, score_documents, top_of

POSTINGS, GRAMS = "gram string, base long, docs array<int>, part int", "gram string, n long, part int"
VERSION = 2  # of the layout; another one isn't read
BLOCK = 1 << 22  # characters whose trigrams are sorted at once
FILE = 33  # bits of a chunk's number within its file
SALTS = 16  # tasks that write a part
RAREST = 3  # trigrams of a term whose postings are read
FEW = 2_000  # chunks that are fetched by a list of numbers; more by a join


def grams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _named(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> list[str]:
    joined = np.stack([first, second, third], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + 3] for i in range(0, len(joined), 3)]


def block_grams(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The distinct trigrams of texts: (grams, ends, places); the places in `texts` of those that hold grams[i], each once and ascending,
    lie in places[ends[i]:ends[i + 1]]. One sort of whole numbers, made of a trigram and a place."""
    if len(texts) == 1:  # of any length: piece by piece
        codes, (own,) = np.zeros(0, np.int64), texts
        for at in range(0, len(own) - 2, BLOCK):
            c = _characters(own[at : at + BLOCK + 2])
            codes = np.union1d(codes, c[:-2] << 42 | c[1:-1] << 21 | c[2:])
        if len(codes):
            low = (1 << 21) - 1
            yield _named(codes >> 42, codes >> 21 & low, codes & low), np.arange(len(codes) + 1), np.zeros(len(codes), np.int64)
        return
    c, place = _characters("".join(texts)), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(c) < 3:
        return
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    alphabet = np.flatnonzero(seen)
    bits, of_place = (len(alphabet) - 1).bit_length(), (len(texts) - 1).bit_length()
    if 3 * bits + of_place > 63:
        half = len(texts) // 2
        for start, part in ((0, texts[:half]), (half, texts[half:])):
            yield from ((names, ends, places + start) for names, ends, places in block_grams(part))
        return
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    c = number[c]
    keys = (((c[:-2] << bits | c[1:-1]) << bits | c[2:]) << of_place | place[:-2])[place[:-2] == place[2:]]  # none across two texts
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    codes = keys >> of_place
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    of, low = codes[starts], (1 << bits) - 1
    if len(of):
        yield _named(alphabet[of >> 2 * bits], alphabet[of >> bits & low], alphabet[of & low]), np.append(starts, len(keys)), keys & ((1 << of_place) - 1)


def _blocks(texts: list[str], numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of blocks of texts, of one file each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > BLOCK or numbers[i] >> FILE != numbers[start] >> FILE):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to postings."""
    for batch in batches:
        numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for start, end in _blocks(texts, numbers):
            own = numbers[start:end] - numbers[start]
            for names, ends, places in block_grams(texts[start:end]):
                docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[places], pa.int32()))
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.full(len(names), numbers[start])), docs], names=["gram", "base", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in _blocks(texts, np.zeros(len(texts), np.int64)):
            for names, ends, _ in block_grams(texts[start:end]):
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.diff(ends), pa.int64())], names=["gram", "n"])


def gram_counts(texts: DataFrame, name: str) -> DataFrame:
    """(gram, n): how many texts hold each trigram."""
    ship(texts.sparkSession)
    return texts.select(name).dropna().mapInArrow(_counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


# --- sets of chunks: (word, mask), a bit for each of the chunks 64 * word to 64 * word + 63 ---------------------------


def _word() -> Column:
    return F.shiftright("doc", 6).alias("word")


def _bit() -> Column:
    return F.pmod("doc", F.lit(64)).cast("int")


def _masked(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc) as a set, for each of keys."""
    return docs.select(*keys, _word(), F.call_function("shiftleft", F.lit(1).cast("long"), _bit()).alias("mask")).groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def _within(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows whose doc is in a set that was cut."""
    return rows.withColumn("word", _word()).join(small_side(marks), "word").filter(F.getbit("mask", _bit()) == 1).drop("word", "mask")


def _outside(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.withColumn("word", _word()).join(small_side(marks), "word", "left").filter(F.coalesce(F.getbit("mask", _bit()), F.lit(0)) == 0).drop("word", "mask")


@dataclass(frozen=True)
class Index:
    """An index that is there as a whole."""

    folder: str
    parts: int
    documents: DataFrame
    postings: DataFrame
    grams: DataFrame


def build(chunks: DataFrame, root: str, parts: int = 64) -> Index:
    """Writes an index of chunks and makes it the root's newest. parts: folders that postings are dealt to; a lookup reads those of its
    grams, so take more for more text. Rows without an id are indexed like any other."""
    spark, name = chunks.sparkSession, f"index-{uuid.uuid4().hex}"
    ship(spark)
    folder = f"{root}/{name}"
    # dealt before normal forms are made, so that these aren't shuffled; a file is a task's, and its numbers ascend
    own = chunks.repartition(F.xxhash64("repository_id", "id", "document_path")).withColumns({"texts": document_texts(), "doc": F.monotonically_increasing_id()})
    own.write.parquet(f"{folder}/documents")
    stored = spark.read.schema(own.schema).parquet(f"{folder}/documents")
    each = stored.select("doc", F.concat_ws("\n", "texts.meta", "texts.body").alias("text")).mapInArrow(_listed, "gram string, base long, docs array<int>").withColumn("part", _part(F.col("gram"), parts))
    each.repartition("part", F.pmod(F.xxhash64("base"), F.lit(SALTS))).sortWithinPartitions("part", "gram", "base").write.partitionBy("part").parquet(f"{folder}/postings")
    written = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    counted = written.groupBy("part", "gram").agg(F.sum(F.size("docs")).alias("n"))
    counted.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{folder}/grams")
    sizes = stored.count(), written.count()
    row = spark.createDataFrame([(name, VERSION, parts, own.schema.json(), *sizes)], "name string, version int, parts int, schema string, documents long, postings long")
    row.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return load(spark, root)


def load(spark: SparkSession, root: str) -> Index:
    """The newest index of a root. One of another layout, and one whose tables don't have the rows they were written with, are errors."""
    newest = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("built_at"), F.desc("name")).first()
    if newest["version"] != VERSION:
        raise ValueError(f"{root} has the layout {newest['version']}, not {VERSION}")
    folder = f"{root}/{newest['name']}"
    documents = spark.read.schema(StructType.fromJson(json.loads(newest["schema"]))).parquet(f"{folder}/documents")
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    if (documents.count(), postings.count()) != (newest["documents"], newest["postings"]):
        raise ValueError(f"{folder} isn't what was built")
    return Index(folder, newest["parts"], documents, postings, spark.read.schema(GRAMS).parquet(f"{folder}/grams"))


def _of(table: DataFrame, some: list[str], parts: int) -> DataFrame:
    """The rows of some grams: of the folders they are dealt to, and there of the row groups that may hold them."""
    listed = table.sparkSession.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, some)), lambda g: _part(g, parts)))).first()[0]
    return table.filter(F.col("part").isin(listed) & F.col("gram").isin(some))


def lookup(index: Index, query: str) -> tuple[DataFrame | None, DataFrame]:
    """The set of chunks that may hold one of the query's terms or the query as a whole, none of them left out, or None where only a scan
    tells (a query of fewer than three characters); and what was looked up: (term, gram, n, used), n postings of each gram."""
    spark = index.documents.sparkSession
    shape = "term string, gram string, n long, used boolean"
    needles = F.array_distinct(F.array_append(query_tokens(F.lit(query)), normalise(F.lit(query))))
    terms = [r["term"] for r in spark.range(1).select(F.explode(needles).alias("term")).collect()]  # the query's own words
    if any(len(t) < 3 for t in terms):
        return None, spark.createDataFrame([], shape)
    # what holds a longer term holds the shorter one in it
    terms = [t for t in terms if not any(o != t and o in t for o in terms)]
    every = sorted({g for t in terms for g in grams(t)})
    known = {r["gram"]: r["n"] for r in _of(index.grams, every, index.parts).collect()}  # no more than the query has
    told = []
    for t in terms:
        order = sorted(grams(t), key=lambda g: (known.get(g, 0), g))
        there = all(g in known for g in order)
        told += [(t, g, known.get(g, 0), there and i < RAREST) for i, g in enumerate(order)]
    used = [(term, g) for term, g, _, on in told if on]
    if not used:
        return _masked(index.documents.select("doc").limit(0)), spark.createDataFrame(told, shape)
    ways = spark.createDataFrame(used, "term string, gram string")
    asked = ways.groupBy("term").agg(F.count(F.lit(1)).alias("asked"))
    read = _of(index.postings, sorted({g for _, g in used}), index.parts)
    by_gram = _masked(read.select("gram", "base", F.explode("docs").alias("at")).select("gram", (F.col("base") + F.col("at")).alias("doc")), "gram")
    met = by_gram.join(F.broadcast(ways), "gram").groupBy("term", "word").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("met"))
    return met.join(F.broadcast(asked), "term").filter("met = asked").groupBy("word").agg(F.bit_or("mask").alias("mask")).filter("mask <> 0"), spark.createDataFrame(told, shape)


def _size(marks: DataFrame) -> int:
    return marks.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0]


def _fetch(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of a set that was cut."""
    if _size(marks) > FEW:
        return _within(rows, marks)
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1)
    listed = marks.select(F.explode(F.transform(places, lambda i: F.col("word") * 64 + i)).alias("doc")).collect()
    return rows.filter(F.col("doc").isin([r["doc"] for r in listed]))


def search(index: Index, query: str, repository: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """What search.search_documents() finds in the indexed chunks, row for row; and what was read for it (what, n): postings, candidates
    whose texts were scored, and all chunks. Endpoints that a query names are read from their own columns, without the texts; chunks'
    contents and other columns are read for the best only."""
    spark, most = index.documents.sparkSession, top_of(limit)
    rows = index.documents if repository is None else index.documents.filter(F.col("repository_id") == repository)
    by_text, told = lookup(index, query)
    plain = [c for c in index.documents.columns if c not in ("texts", "doc")]
    report = lambda candidates: told.filter("used").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("postings").alias("what"), "n").unionAll(
        spark.createDataFrame([("candidates", candidates), ("chunks", index.documents.count())], "what string, n long"))
    best = lambda some: cut(by_score(score_documents(some, query, F.col("texts"))).limit(most).select("doc", "score"))
    shown = lambda found: by_score(rows.filter(F.col("doc").isin([r["doc"] for r in found.select("doc").collect()])).join(F.broadcast(found), "doc").select(*plain, "score")).limit(most)
    if by_text is None:
        return shown(best(rows)), report(index.documents.count())
    exact = normalise(F.lit(query))
    named = rows.filter(F.col("endpoint").isNotNull()).select("doc", "endpoint", F.col("texts.route").alias("route"))
    by_route = _masked(named.filter(F.contains(exact, normalise(F.col("endpoint.path"))) | F.contains(exact, F.col("route"))).select("doc"))
    marks = cut(by_text.unionAll(by_route).groupBy("word").agg(F.bit_or("mask").alias("mask")))
    found = best(_fetch(rows, marks))
    if found.count() < most:
        # supported chunks count without a hit, too
        others = _outside(rows.filter(F.array_contains("confidence_states", "supported")).select("doc", "document_path", "id"), marks)
        some = cut(_masked(others.orderBy("document_path", "id").limit(most).select("doc")))
        found = found.unionByName(best(_fetch(rows, some)))
    return shown(found), report(_size(marks))
