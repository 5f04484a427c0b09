"""Phrases that stand together more often than their parts would by chance, mined with count-min sketches.

Texts are lower-cased (A-Z), cut at PIECE_ENDS into pieces and those at blanks and tabs into words. Per language (null: "und"), n is the
number of words and f(phrase) the number of places within pieces where it stands, overlaps included. Candidates are phrases of
2 to `longest` words with f >= least.

1. One pass counts phrases of 1 to `longest` words in a count-min sketch, one for each task; only counts up to `least` matter, so a
   sketch travels as one byte a cell. Sketches are added up cell by cell, each cell's counters in one sorted stream that keeps one
   block, and leave a bit: at least `least` or not. A sketch never says too little, so a phrase without all its bits is rare.
2. A second pass counts exactly what is left: phrases whose bits are set and whose first and last words, one less, are left too.
   Phrases are told apart by their words, not by hashes, are counted by task before they are shuffled, and stay if f >= least.
3. Candidates that stand inside a longer candidate with share * f(candidate) <= 100 * f(longer) go. As a phrase between both stands at least
   as often as the longer one, only those one word longer need to be asked.
4. For each cut into two parts, of l and r places, the score is floor(1000 * f * n / (l * r)); the lowest counts, of equals the first cut.
   Parts of candidates are as frequent, so their counts are in the same table. Decimals of 38 digits hold all products exactly.

The sketch has `width` cells a row: by default as many as keep a cell's chance counts near a quarter of `least`, within memory_mb for
a task's sketch of two bytes a cell; a sixteenth of that is broadcast. Where that is too little for the input, more rare phrases pass the
sketch, and the second pass counts and shuffles them for nothing; the result stays the same.

Nulls: a null text is an empty one, a null language is "und". Repeated rows count each time. Ties go by f, then by phrase. Empty
table: no row. Other columns aren't read. A text of any length is one piece of work for a batch.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, ship, small_side, text_of, written

#: Characters that end a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
ROWS, BLOCK, MEMORY_MB = 3, 1 << 17, 192
#: Bytes of text that are worked on at once, and phrases that a task counts before it hands them on.
AT_ONCE, HELD = 3 << 20, 400_000
#: What is added at once, so that no cell passes 16 bits, and what a cell keeps at most.
ADDED, FULL = 65_000, 255
_END = b"."  # a piece's end among words; no word can be this
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS.encode() + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * len(PIECE_ENDS) + b" ")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Words:
    """The words of some texts of one language in a row, as numbers; ends of pieces between them."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        self.lang = lang
        self.tokens = b".".join(texts).translate(_LOWER).replace(b".", b" . ").split()
        codes, own = pd.factorize(np.array([*self.tokens, _END], object))
        self.codes, self.own, self.end = codes[:-1], own, codes[-1]
        seed = zlib.crc32(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in own), np.uint64, len(own))
        self.word = self.codes != self.end

    def places(self, longest: int, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) of phrases. keep(hashes) says which of them are left; one of two words or more is looked at only
        where both phrases of one word less are left."""
        words = self.hashes[self.codes]
        at, own = np.flatnonzero(self.word), words[self.word]
        for k in range(1, longest + 1):
            if k > 1:
                alive, full = np.zeros(len(words) + 1, bool), np.zeros(len(words), np.uint64)
                alive[at], full[at] = True, own
                at = at[alive[at + 1]]
                own = full[at] * _ODD[0]
                own ^= own >> np.uint64(31)
                own += words[at + k - 1] * _ODD[1]
                own ^= own >> np.uint64(29)
            if keep is not None:
                left = keep(own)
                at, own = at[left], own[left]
            yield k, at, own

    def phrases(self, longest: int, keep) -> Iterator[tuple[int, list[bytes], list[int]]]:
        """(length, phrases, numbers of their places) of those that keep() leaves, told apart by their words."""
        ids = np.zeros(len(self.codes), np.int64)
        for k, at, _ in self.places(longest, keep):
            numbers, distinct = pd.factorize(ids[at] * len(self.own) + self.codes[at + k - 1])
            first = np.zeros(len(distinct), np.int64)
            first[numbers[::-1]] = at[::-1]
            yield k, [b" ".join(self.tokens[i : i + k]) for i in first.tolist()], np.bincount(numbers, minlength=len(distinct)).tolist()
            ids = np.full(len(ids), -1, np.int64)
            ids[at] = numbers


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; width is a power of two."""
    return ((hashes * _ODD[row] + _ODD[(row + 1) % ROWS]) >> np.uint64(65 - width.bit_length())).view(np.int64) if width > 1 else np.zeros(len(hashes), np.int64)


class Sketch:
    def __init__(self, width: int):
        self.width, self.cells = width, np.zeros((ROWS, width), np.uint16)

    def add(self, hashes: np.ndarray) -> None:
        for row, own in enumerate(self.cells):
            at = cells(hashes, row, self.width)
            for some in (at[k : k + ADDED] for k in range(0, len(at), ADDED)):
                np.add.at(own, some, np.uint16(1))
                own[some] = np.minimum(own[some], FULL)

    def blocks(self, least: int) -> Iterator[tuple[int, int, bytes]]:
        """(row, block, counts up to `least` or FULL, packed)."""
        for row in range(ROWS):
            for b in range(0, self.width, BLOCK):
                some = np.minimum(self.cells[row, b : b + BLOCK], min(least, FULL)).astype(np.uint8)
                if some.any():
                    yield row, b // BLOCK, zlib.compress(some.tobytes(), 1)


class Frequent:
    """Bits of the cells that reach `least`; which hashes have them all."""

    def __init__(self, width: int, blocks: list[tuple[int, int, bytes]]):
        self.width, self.bits = width, np.zeros((ROWS, max(1, width // 8)), np.uint8)
        for row, block, packed in blocks:
            got = np.frombuffer(packed, np.uint8)
            self.bits[row, block * BLOCK // 8 : block * BLOCK // 8 + len(got)] = got

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for row in range(ROWS):
            c = cells(hashes[left], row, self.width)
            left = left[(self.bits[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0]
        return left


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of some texts of one language at a time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held[lang].append(text)
            size[lang] += len(text) + 64
            if size[lang] >= AT_ONCE or sum(size.values()) >= 4 * AT_ONCE:
                most = max(size, key=size.__getitem__)
                yield Words(most, held.pop(most))
                size.pop(most)
    while held:
        lang, texts = held.popitem()
        yield Words(lang, texts)


GATHERED = "lang string, n long, row int, block int, cells binary"
_GATHERED = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])


def _gather(width: int, least: int, longest: int):
    """Numbers of words by language, and the blocks of one sketch, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, total = Sketch(width), defaultdict(int)
        for words in _by_language(batches):
            total[words.lang] += int(words.word.sum())
            for _, _, hashes in words.places(longest):
                sketch.add(hashes)
        rows = [{"lang": lang, "n": n} for lang, n in total.items() if n]
        yield pa.RecordBatch.from_pylist(rows, schema=_GATHERED)
        for row, block, packed in sketch.blocks(least):
            yield pa.RecordBatch.from_pylist([{"row": row, "block": block, "cells": packed}], schema=_GATHERED)

    return run


def _added(least: int):
    """Bits of blocks, from the tasks' blocks in order of (row, block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None

        def bits() -> pd.DataFrame:
            return pd.DataFrame({"row": [key[0]], "block": [key[1]], "bits": [np.packbits(total >= min(least, FULL), bitorder="little").tobytes()]})

        for batch in batches:
            for row, block, packed in zip(batch["row"], batch["block"], batch["cells"], strict=True):
                some = np.frombuffer(zlib.decompress(packed), np.uint8)
                if (row, block) == key:
                    np.minimum(total + some, FULL, out=total)
                    continue
                if key is not None:
                    yield bits()
                key, total = (row, block), some.astype(np.uint16)
        if key is not None:
            yield bits()

    return run


_COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _count(shared, width: int, longest: int):
    """Exact counts of the phrases that the sketch leaves, added up by task; HELD of them at most are kept at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts = Frequent(width, shared.value), defaultdict(lambda: defaultdict(int))

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, k), own in counts.items():
                phrases, f = list(own), list(own.values())
                for at in range(0, len(own), 50_000):
                    some = pa.array(phrases[at : at + 50_000], pa.binary()).cast(pa.string())
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array([k] * len(some), pa.int32()), some, pa.array(f[at : at + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)
            counts.clear()

        for words in _by_language(batches):
            for k, phrases, n in words.phrases(longest, keep):
                own = counts[words.lang, k]
                for p, f in zip(phrases, n, strict=True):
                    own[p] += f
            if sum(map(len, counts.values())) >= HELD:
                yield from counted()
        yield from counted()

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, width: int | None = None, memory_mb: int = MEMORY_MB) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n) of all languages with a word."""
    if least < 1 or longest < 1:
        raise ValueError("least and longest must be at least 1")
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if width is None:  # about 0.6 phrases a byte
        most = max(1, (memory_mb << 20) // (2 * ROWS)).bit_length() - 1
        width = 1 << min(most, max(16, round(float(np.log2(max(1, 2 * size / least))))))
    # a sketch and counts for each task: more than two for a core only if each has a GB of text
    own = own.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size >> 30)))
    gathered = written(own.mapInArrow(_gather(width, least, longest), GATHERED), "gathered")
    totals = written(gathered.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    # ROWS * width bits at most come to the driver, whatever the input
    blocks = gathered.filter("row is not null").select("row", "block", "cells").repartition("row", "block").sortWithinPartitions("row", "block")
    blocks = [(r["row"], r["block"], bytes(r["bits"])) for r in blocks.mapInPandas(_added(least), "row int, block int, bits binary").collect()]
    found = own.mapInArrow(_count(spark.sparkContext.broadcast(blocks), width, longest), "lang string, words int, phrase string, f long")
    found = written(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")
    discard(gathered)
    return found, totals


def scored(phrases: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the candidates that no longer candidate holds."""
    longer = phrases.filter("words > 2")
    cut_off = F.expr("length(substring_index(phrase, ' ', 1)) + 2")
    inner = F.array(F.substring(F.col("phrase"), cut_off, F.length("phrase")), F.expr("substring_index(phrase, ' ', words - 1)"))
    own = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.lit(0).cast("long").alias("longer"))
    within = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("words") - 1, F.lit(0).cast("long"), F.col("f"))
    kept = own.unionAll(within).groupBy("lang", "phrase", "words").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    kept = written(kept.filter(F.col("a") > 0).filter(100 * F.col("longer") < share * F.col("a")).drop("longer"), "candidates")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    for side, name, size in (("first", "l", F.col("cut")), ("rest", "r", F.col("words") - F.col("cut"))):
        # single words are parts of very many phrases and few themselves: they are joined apart
        parts = phrases.select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(name), F.col("words").alias("_words"))
        one = cuts.filter(size == 1).join(small_side(parts.filter("_words = 1")), ["lang", side])
        more = cuts.filter(size > 1).join(parts.filter("_words > 1"), ["lang", side])
        cuts = one.unionByName(more).drop("_words")
    joined = cuts.join(small_side(totals), "lang")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    return joined.groupBy("lang", "phrase", "words", "a", "n").agg(least).select("lang", "phrase", "words", "a", "least.l", "least.r", "n", "least.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, width: int | None = None, memory_mb: int = MEMORY_MB) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, a (both descending) and phrase (by bytes)."""
    phrases, totals = frequent_phrases(docs, least, longest, width, memory_mb)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases, totals, share).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
