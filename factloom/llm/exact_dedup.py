"""Exact dedup against a minimal perfect hash over historical distinct digests.

Texts are equal when they are identical after lower-casing A-Z. A digest is the SHA-256 of that form. The distinct digests
are dealt by their leading bits to shards of about SHARD_DIGESTS; each shard holds a minimal perfect hash
whose slots hold the full digest and the locator of the row that stays. A new digest is looked up in its shard's slot and
compared byte by byte: a member joins the historical group; nonmembers are grouped among themselves.

Copies are counted before any shuffle by digest, so a digest with a third of all rows is one row for each map task there.
Only digests and ids are shuffled, never texts; where every row gets its group back, that is a join that Spark can split.

Nulls: a null text is an empty one; a null doc_id never stays if another row of its group has one. Repeated rows (one
doc_id and text) are one group; exactly one of them stays. Empty table: no row. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, small_side, text_of, unused, written

SHARD_DIGESTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = 64


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def _lanes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, 8:24].copy().view("<u8")
    return both[:, 0], both[:, 1]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash by levels of bit arrays: at each level, keys that meet no other key there get its bit, and
    a key's slot is the number of bits before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def of(cls, digests: list[bytes]) -> PerfectHash:
        a, b = _lanes(digests)
        sizes, rows = [], []
        while len(a):
            if len(sizes) == _LEVELS:
                raise ValueError("digests repeat")
            size = max(2, len(a))
            at = _place(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            rows.append(alone)
            sizes.append(size)
            a, b = a[~alone[at]], b[~alone[at]]
        return cls(sizes, np.concatenate(rows) if rows else np.zeros(0, bool))

    def slots(self, digests: list[bytes]) -> np.ndarray:
        """A slot for each digest; -1 where none can be its own. A stranger may get a slot: compare what it holds."""
        out = np.full(len(digests), -1, np.int64)
        if not digests:
            return out
        a, b = _lanes(digests)
        left, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(a[left], b[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


class Shard:
    """Slots in hash order: full digest, locator of the row that stays, size of the group."""

    def __init__(self, digests: list[bytes], keep: list, size: list[int]):
        self.hash = PerfectHash.of(digests)
        slots = self.hash.slots(digests)
        order = np.empty(len(digests), np.int64)
        order[slots] = np.arange(len(digests))
        self.digests = [digests[i] for i in order]
        self.keep = [keep[i] for i in order]
        self.size = [size[i] for i in order]

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The slot of each digest, or -1: what a slot holds must be equal byte by byte."""
        slots = self.hash.slots(digests)
        return np.array([s if s >= 0 and self.digests[s] == d else -1 for s, d in zip(slots.tolist(), digests, strict=True)], np.int64)


# --- tables ---------------------------------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else. lower() does the same where all is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of each row."""
    return df.select(df[doc_id].cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_of(df, text)), 256)).alias("digest"))


GROUPS = "digest binary, keep_id long, group_size long, historical boolean"


def _looked_up(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """One shard: the groups after the new digests have joined."""
    old, new = (x if len(x) else pd.DataFrame({c: [] for c in ("digest", "keep_id", "group_size")}) for x in (old, new))
    shard = Shard([bytes(d) for d in old["digest"]], [None if pd.isna(k) else int(k) for k in old["keep_id"]], old["group_size"].tolist())
    keep, size = shard.keep, shard.size
    strangers: list[tuple] = []
    fresh = [bytes(d) for d in new["digest"]]
    found = shard.find(fresh)
    for d, at, k, n in zip(fresh, found.tolist(), new["keep_id"], new["group_size"].tolist(), strict=True):
        k = None if pd.isna(k) else int(k)
        if at < 0:
            strangers.append((d, k, n, False))
        else:
            keep[at] = k if keep[at] is None else keep[at] if k is None else max(keep[at], k)
            size[at] += n
    rows = [*zip(shard.digests, keep, size, [True] * len(size), strict=True), *strangers]
    out = pd.DataFrame(rows, columns=["digest", "keep_id", "group_size", "historical"])
    return out.astype({"keep_id": "Int64", "group_size": "int64"})


def groups(new: DataFrame, history: DataFrame | None = None, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """GROUPS of (doc_id, digest) rows, those of the history included: the largest doc_id of a digest stays."""
    ship(new.sparkSession)
    # an alias for the digest: both sides may come from one table, and cogroup needs columns of their own
    per = lambda df: df.groupBy(F.col("digest").alias("digest")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fresh = per(new)
    if history is None:
        return fresh.withColumn("historical", F.lit(False))
    old = per(history)
    # for balance only; the new digests count too, as a shard's task holds both
    total = sum(df.agg(F.approx_count_distinct("digest")).first()[0] for df in (history, new))
    shards = max(1, -(-total // shard_digests))
    # the leading bits of a digest choose its shard
    sharded = lambda df: df.withColumn("_shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)))
    return sharded(old).groupBy("_shard").cogroup(sharded(fresh).groupBy("_shard")).applyInPandas(_looked_up, GROUPS)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of df. history: (doc_id, digest) rows known before;
    without it, the rows of df with an even hash of doc_id are taken in first, as history, and the others looked up."""
    rows = written(digests(df, doc_id, text), "digests")
    if history is None:
        first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        found = groups(rows.filter(~first), rows.filter(first))
    else:
        found = groups(rows, history)
    own = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    joined = own.join(found, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(df: DataFrame, decided: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that dedup() keeps, all their columns as they are. Rows that are equal in doc_id and text are one."""
    gone = written(decided.filter("not kept").select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")), "gone")
    sha = unused(df, "_sha")
    named = df.withColumn(sha, F.sha2(normalised(text_of(df, text)), 256))
    same = lambda left, t: left[doc_id].cast("long").eqNullSafe(t["doc_id"]) & (left[sha] == t["text_sha256"])
    repeats = gone.filter("not again")
    stays = named.join(small_side(repeats), same(named, repeats), "left_anti")
    again = written(gone.filter("again").select("doc_id", "text_sha256").distinct(), "again")
    if again.isEmpty():
        return stays.select(df.columns)
    row = unused(named, "_row")
    one = stays.join(again, same(stays, again), "left_semi").groupBy(doc_id, sha).agg(F.first(F.struct(*df.columns)).alias(row))
    return stays.join(again, same(stays, again), "left_anti").select(df.columns).unionByName(one.select(f"{row}.*"))
