"""SimHash near-dedup with pivot distance tables.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of a text's shingles. Two
fingerprints link when they differ in at most BITS bits.

Equal fingerprints are one class from the start. Candidates come from masked keys: with BITS + e parts of the 64 bits, two
linked fingerprints agree in at least e parts, so they share one of the keys that keep e parts. The number of parts grows
with the table so that a key has few fingerprints. A key that still has more than HOT of them is refined, as often as that takes:
the bits that it leaves free are cut in BITS + 1 parts, of which one must agree too. No pair is lost by either, and a key ends with
at most HOT fingerprints, or 2 ** BITS where no more than BITS bits are free.

Within a key, the Hamming distances of each fingerprint to PIVOTS reference fingerprints discard pairs: the difference of
two distances to one pivot is at most the distance of the pair. Survivors are verified bit by bit. Of a key with more than
a few fingerprints only links that make a forest are passed on, as components need no more: a search goes from one
fingerprint to all that it reaches among those not yet reached.

Pivot distances alone can't choose candidates at this radius (distances to a pivot lie within 32 +- 4 for most pairs), so
they filter what the keys bring together.

Nulls: a null text is an empty one, with fingerprint zero. A row with a null doc_id links like any other and gets the smallest doc_id
that it reaches, or null if it reaches none. Ids are below NO_ID; numbers from there on name fingerprints without an id.
Repeated rows have equal fingerprints. Empty table: no row. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, small_side, text_of, written
from .components import components

BITS, PIVOTS, HOT, FEW, NO_ID = 4, 16, 2_000, 24, 1 << 62
#: Fingerprints for each key, on average, from which on keys get longer.
KEY_FILL = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def hashes_of(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; of all words where there are fewer, and none where there is no word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at blank and tab to carriage return
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_.view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return bits_of(hashes_of(text, shingle, seed))


def fingerprints(df: DataFrame, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


# --- keys -----------------------------------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """n masks that share out the bits."""
    return [sum(1 << b for b in bits[k::n]) for k in range(n)]


def masks(n: int, radius: int = BITS) -> list[int]:
    """Masks of which two fingerprints within the radius agree under one at least, for n fingerprints."""
    for extra in range(1, 5):
        chosen = [sum(c) for c in combinations(_parts(list(range(64)), radius + extra), extra)]
        if n / 2 ** min(m.bit_count() for m in chosen) <= KEY_FILL:
            break
    return chosen


def refined(mask: int, radius: int = BITS) -> list[int]:
    """Longer masks, of which two that agree under `mask` must agree under one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _parts(free, radius + 1)]


def _pivots(k: int) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, k, np.uint64, endpoint=False)


# --- links within keys ----------------------------------------------------------------------------------------------


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (i, j) link: the pivot table discards, the bits decide."""
    ok = np.arange(len(i))
    for k in range(0, table.shape[1], 4):
        if not len(ok):
            return ok
        gap = np.abs(table[i[ok], k : k + 4] - table[j[ok], k : k + 4]).max(axis=1)
        ok = ok[gap <= radius]
    return ok[np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= radius]


def _forest(fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is linked, at most one less than fingerprints."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            at = queue.pop()
            near = _near(fps, table, np.full(len(left), at), left, radius)
            if len(near):
                reached = left[near]
                queue.extend(reached.tolist())
                for r in reached.tolist():
                    yield root, r
                left = np.delete(left, near)


def _links(radius: int, pivots: int):
    refs = _pivots(pivots)

    def of(rows: pd.DataFrame) -> pa.RecordBatch:
        """rows: sorted by key, whole keys."""
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        node, mask, value = rows["node"].to_numpy(np.int64), rows["mask"].to_numpy(np.int64), rows["value"].to_numpy(np.int64)
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(fps)))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        some = np.repeat(size > 1, size)
        table = np.zeros((len(fps), pivots), np.int8)
        table[some] = np.bitwise_count(fps[some, None] ^ refs).astype(np.int8)
        few = (size > 1) & (size <= FEW)
        group = np.repeat(np.arange(len(size)), size)
        rows_few = np.flatnonzero(few[group])
        for step in range(1, FEW):
            i = rows_few[rows_few + step < len(fps)]
            i = i[group[i] == group[i + step]]
            if not len(i):
                break
            near = _near(fps, table, i, i + step, radius)
            pairs.append((node[i[near]], node[i[near] + step]))
        for g in np.flatnonzero(size > FEW):
            own = slice(first[g], first[g] + size[g])
            found = np.array(list(_forest(fps[own], table[own], radius)), np.int64).reshape(-1, 2)
            pairs.append((node[own][found[:, 0]], node[own][found[:, 1]]))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            open_ = ((held["mask"] == last["mask"]) & (held["value"] == last["value"])).to_numpy()
            if not open_.all() and len(held) >= 50_000:
                yield of(held[~open_]).to_pandas()
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield of(held).to_pandas()

    return run


def links(classes: DataFrame, radius: int = BITS, pivots: int = PIVOTS, hot: int = HOT) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints (fp long, node long), enough to join all that is linked."""
    ship(classes.sparkSession)
    chosen = masks(classes.count(), radius)
    keyed = lambda df, ms: df.select("fp", "node", F.explode(ms).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    keys = written(keyed(classes, F.array(*[F.lit(_signed(m)).cast("long") for m in chosen])), "keys")
    ready: list[DataFrame] = []
    while True:  # each turn fixes more bits, and distinct fingerprints that share all but ten bits are few
        sizes = keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        crowded = written(sizes.filter((F.col("n") > hot) & (F.bit_count("mask") < 64 - radius)), "crowded")
        chosen = [r[0] for r in crowded.select("mask").distinct().collect()]  # some of the masks so far
        if not chosen:
            break
        ready.append(keys.join(crowded, ["mask", "value"], "left_anti"))
        over = keys.join(crowded, ["mask", "value"], "left_semi")
        finer = [(m, sorted({_signed(x) for x in refined(m % (1 << 64), radius)})) for m in chosen]
        table = keys.sparkSession.createDataFrame(finer, "mask long, finer array<long>")
        keys = written(keyed(over.join(F.broadcast(table), "mask"), F.col("finer")), "keys")  # one row for each mask
    ready.append(keys)
    union = ready[0]
    for x in ready[1:]:
        union = union.unionByName(x)
    near = union.repartition("mask", "value").sortWithinPartitions("mask", "value").select("fp", "node", "mask", "value")
    return near.mapInPandas(_links(radius, pivots), "a long, b long")


def near_groups(df: DataFrame, shingle: int = 4, seed: int = 42, radius: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id that links reach."""
    rows = written(fingerprints(df, shingle, seed, doc_id, text), "fingerprints")
    named = F.coalesce(F.col("least"), F.lit(NO_ID) + F.monotonically_increasing_id())  # written, so each number stays
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", named.alias("node")), "classes")
    component = F.coalesce("component", "node")
    named = classes.join(components(links(classes, radius)), "node", "left").select("fp", F.when(component < NO_ID, component).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(df: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of df that are the first of their group in near_groups(df), all their columns as they are. Rows with one
    doc_id stay or go together; rows with a null doc_id stay."""
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return df.join(small_side(gone), df[doc_id].cast("long") == gone["_gone"], "left_anti")


def hex_of(fp: str = "fp") -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
