"""Line dedup by a deletion-neighbourhood join, within one edit.

A line, without white space at its ends, repeats an earlier one if both are within the edit bound: one insertion, deletion or
substitution if both have min_chars characters or more, none if not (in a short line, one character makes another word). That is a
parameter of the bound; with 0, all lines have a bound of one edit. Earlier is by (doc_id, line number, row); the earliest stays and
each line that has an earlier one within the bound goes. Empty lines stay.

Equal lines are one class from the start. A line within one edit of another shares its first or its second half with it
(in one of two places), so three half keys for each line leave those that can have a partner; only they go on, with their
texts. They emit, as hashed keys, themselves and all variants with one character deleted, the place of the deletion beside
the key. Lines with equal key and equal place are all within one substitution of each other, so each needs its earliest
there only; a variant that is a line itself links that line with the variant's owner. So no group's pairs are emitted. The
edit distance of linked lines is then verified on their texts.

Nulls: a null text is an empty one, with one empty line; a null doc_id comes before all others. Rows with one doc_id are told
apart by a digest of their texts, which also orders them, so that a row loses its own lines only. Of rows that are equal in doc_id
and text, one counts as the first, and the others lose all lines that aren't empty. Empty table: no row. Other columns pass through
dedup_lines(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, small_side, text_of, unused, written

MIN_CHARS = 20
#: White space, as Python's str.strip() takes it away.
BLANKS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Lines whose numbers are broadcast at most, to fetch their texts; beyond it, they are joined by a shuffle.
BROADCAST_LINES = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NO_ID = -(1 << 63)


def half_keys(line: str) -> list[int]:
    """Two lines that are one edit apart share a key."""
    import xxhash

    n, h = len(line), xxhash.xxh3_64_intdigest
    heads = {n // 2, (n - 1) // 2}
    tails = {n - n // 2, (n - 1) - (n - 1) // 2}
    return [h(b"<" + line[:k].encode("utf-8", "surrogatepass")) for k in heads] + [h(b">" + line[n - k :].encode("utf-8", "surrogatepass")) for k in tails]


def variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): the line itself at place -1, then the line without each of its characters."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c)
    with np.errstate(over="ignore"):
        c = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        c ^= c >> np.uint64(29)
        power = np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64) if n else c
        before = np.concatenate([[np.uint64(0)], (c * power).cumsum(dtype=np.uint64)])
        total = before[-1]
        less = before[:-1] + (total - before[1:]) * _INVERSE
        keys = np.concatenate([[total ^ np.uint64(n)], less ^ np.uint64(max(n - 1, 0))]) * np.uint64(0x94D049BB133111EB)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64), np.arange(-1, n, dtype=np.int32)


LINES = "doc_id long, row long, line int, digest binary, chars int, halves array<long>"


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, line in enumerate(text.split("\n")):
                    if line := line.strip():
                        halves = [x - (1 << 64) if x >> 63 else x for x in half_keys(line)] if len(line) >= min_chars - 1 else []
                        own = (doc, row, k, xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")), len(line), halves)
                        for to, v in zip(rows, own, strict=True):
                            to.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=["doc_id", "row", "line", "digest", "chars", "halves"])

    return run


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, doc_id, line, row) of the variants of lines (doc_id, row, line, text)."""
    for batch in batches:
        for doc, row, line, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, places = variants(text)
            at = [pa.array(np.full(len(keys), v, kind)) for v, kind in ((doc, np.int64), (line, np.int32), (row, np.int64))]
            yield pa.record_batch([pa.array(keys), pa.array(places), *at], names=["key", "place", "doc_id", "line", "row"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a later line with an earlier one, from rows sorted by (key, place, doc_id, line, row). Keeps of a key no more than
    its own line and the earliest of the place at hand, however many rows it has."""
    key = place = own = first = least = None
    columns = ["doc_id", "line", "row", "to_doc", "to_line", "to_row"]
    for batch in batches:
        out = []
        k, p, d, n, r = (batch[c].to_numpy() for c in ("key", "place", "doc_id", "line", "row"))
        # rows whose key or place is no other row's are passed over without a look
        same = np.zeros(len(k), bool)
        same[1:] |= k[1:] == k[:-1]
        same[:-1] |= k[1:] == k[:-1]
        if len(k):
            same[0] = same[-1] = True
        for i in np.flatnonzero(same).tolist():
            at = (int(d[i]), int(n[i]), int(r[i]))
            if k[i] != key:
                if own is not None and least is not None and least < own:
                    out.append((*own, *least))
                key, place, own, first, least = k[i], None, None, None, None
            if p[i] < 0:
                own = at if own is None else own
                continue
            if p[i] != place:
                place, first = p[i], at
            elif at != first:
                out.append((*at, *first))
            least = at if least is None or at < least else least
            if own is not None and own < at:
                out.append((*at, *own))
        yield pd.DataFrame(out, columns=columns).astype({c: "int32" if c.endswith("line") else "int64" for c in columns})
    if own is not None and least is not None and least < own:
        yield pd.DataFrame([(*own, *least)], columns=columns).astype({"line": "int32", "to_line": "int32"})


def _repeated(df: DataFrame, doc_id: str) -> DataFrame:
    """(_again): the doc_ids of several rows."""
    ids = df.select(F.coalesce(df[doc_id].cast("long"), F.lit(_NO_ID).cast("long")).alias("_again"))
    return written(ids.groupBy("_again").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_again"), "repeated")


def _placed(df: DataFrame, repeated: DataFrame, doc_id: str, text: str, doc: str, row: str) -> DataFrame:
    """df with the columns doc, its doc_id, and row, which tells rows with one doc_id and different texts apart."""
    at = df.withColumns({doc: F.coalesce(df[doc_id].cast("long"), F.lit(_NO_ID).cast("long")), row: F.xxhash64(text_of(df, text))})
    again = unused(at, "_again")
    joined = at.join(small_side(repeated.withColumnRenamed("_again", again)), F.col(doc) == F.col(again), "left")
    return joined.withColumn(row, F.when(F.col(again).isNull(), F.lit(0).cast("long")).otherwise(F.col(row))).drop(again)


def repeats(df: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", repeated: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, line, near): the lines that go; row: zero, or for repeated doc_ids a digest of the row's text; near: not
    equal to the earlier one."""
    spark = df.sparkSession
    ship(spark)
    placed = _placed(df.select(df[doc_id].alias("_id"), text_of(df, text).alias("text")), _repeated(df, doc_id) if repeated is None else repeated, "_id", "text", "doc_id", "row")
    own = placed.select("doc_id", "text", "row")
    lines = written(own.mapInArrow(_lines(min_chars), LINES), "lines")
    at = ["doc_id", "line", "row"]
    classes = written(
        lines.groupBy("digest").agg(F.min(F.struct(*at)).alias("first"), F.max("chars").alias("chars"), F.first("halves").alias("halves")).select("digest", "first.*", "chars", "halves"),
        "classes",
    )
    keys = classes.filter(F.size("halves") > 0).select(*at, F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    may = written(keys.join(shared, "half", "left_semi").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("picked")), "may")
    n = may.agg(F.coalesce(F.sum(F.size("picked")), F.lit(0)), F.count(F.lit(1))).first()
    fetched = own.join(F.broadcast(may) if n[0] + n[1] <= BROADCAST_LINES else may, ["doc_id", "row"])
    texts = written(fetched.select("doc_id", "row", "text", "picked").mapInArrow(_picked, "doc_id long, row long, line int, text string").dropDuplicates(at), "texts")
    keyed = texts.mapInArrow(_emitted, "key long, place int, doc_id long, line int, row long")
    links = keyed.repartition("key").sortWithinPartitions("key", "place", *at).mapInPandas(_joined, "doc_id long, line int, row long, to_doc long, to_line int, to_row long").distinct()
    a = texts.select(*at, F.col("text").alias("a"))
    b = texts.select(F.col("doc_id").alias("to_doc"), F.col("line").alias("to_line"), F.col("row").alias("to_row"), F.col("text").alias("b"))
    sure = (F.levenshtein("a", "b", 1) >= 0) & (F.char_length("a") >= min_chars) & (F.char_length("b") >= min_chars)
    earlier = links.filter("to_doc < doc_id or to_doc = doc_id and (to_line < line or to_line = line and to_row < row)")
    near = earlier.join(a, at).join(b, ["to_doc", "to_line", "to_row"]).filter(sure).select(*at).distinct()
    told = classes.join(near.withColumn("near", F.lit(True)), at, "left").select("digest", F.col("doc_id").alias("_doc"), F.col("line").alias("_line"), F.col("row").alias("_row"), F.coalesce("near", F.lit(False)).alias("near"))
    again = lines.select("doc_id", "row", "line", "digest").join(told, "digest")
    return again.filter("near or doc_id <> _doc or line <> _line or row <> _row").select("doc_id", "row", "line", "near").distinct()


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for doc, row, text, picked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = text.split("\n")
            for k in picked:
                if k < len(own):
                    for to, v in zip(rows, (doc, row, k, own[k].strip()), strict=True):
                        to.append(v)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, [pa.int64(), pa.int64(), pa.int32(), pa.string()], strict=True)], names=["doc_id", "row", "line", "text"])


def _copies(placed: DataFrame, doc: str, row: str, copy: str) -> DataFrame:
    """placed with the column copy: whether an earlier row has the same doc_id and text. Only rows of repeated doc_ids can, and
    they alone are numbered; the table is written first, so that the numbers stay."""
    number, first, to, of = (unused(placed, n) for n in ("_number", "_first", "_to_doc", "_to_row"))
    table = written(placed.withColumn(number, F.monotonically_increasing_id()), "placed")
    firsts = table.filter(F.col(row) != 0).groupBy(F.col(doc).alias(to), F.col(row).alias(of)).agg(F.min(number).alias(first), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.filter("n > 1").drop("n"), "firsts")
    joined = table.join(small_side(firsts), (F.col(doc) == F.col(to)) & (F.col(row) == F.col(of)), "left")
    return joined.withColumn(copy, F.coalesce(F.col(number) > F.col(first), F.lit(False))).drop(number, first, to, of)


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str, str] | None = None) -> DataFrame:
    """The rows of df with the text of the lines that stay, and three columns that count: lines, dropped ones and dropped ones that
    are near, not equal. Their names are _lines, _dropped and _near, with underscores behind where df has such a column, or counts."""
    n_lines, n_dropped, n_near = counts or (unused(df, n) for n in ("_lines", "_dropped", "_near"))
    if {n_lines.lower(), n_dropped.lower(), n_near.lower()} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column of a count's name")
    doc, out, near, own, row, to, of, copy = (unused(df, n) for n in ("_doc", "_gone", "_n", "_own", "_row", "_to", "_of", "_copy"))
    repeated = _repeated(df, doc_id)
    found = repeats(df, min_chars, doc_id, text, repeated).groupBy(F.col("doc_id").alias(to), F.col("row").alias(of))
    gone = found.agg(F.collect_set("line").alias(out), F.size(F.collect_set(F.when(F.col("near"), F.col("line")))).alias(near))
    placed = _placed(df, repeated, doc_id, text, doc, row)
    placed = placed.withColumn(copy, F.lit(False)) if repeated.isEmpty() else _copies(placed, doc, row, copy)
    joined = placed.withColumn(own, F.split(text_of(placed, text), "\n", -1)).join(gone, (F.col(doc) == F.col(to)) & (F.col(row) == F.col(of)), "left")
    blank = lambda x: F.length(F.regexp_replace(x, BLANKS, "")) == 0
    kept = F.when(F.col(copy), F.filter(own, blank)).when(F.col(out).isNull(), F.col(own)).otherwise(F.filter(own, lambda x, i: ~F.array_contains(F.col(out), i)))
    dropped = F.when(F.col(copy), F.size(F.filter(own, lambda x: ~blank(x)))).when(F.col(out).isNull(), 0).otherwise(F.size(out))
    columns = [F.concat_ws("\n", kept).alias(c) if c == text else F.col(c) for c in df.columns]
    return joined.select(*columns, F.size(own).alias(n_lines), dropped.alias(n_dropped), F.when(F.col(copy), 0).otherwise(F.coalesce(near, F.lit(0))).alias(n_near))
