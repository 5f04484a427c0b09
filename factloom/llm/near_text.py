"""SimHash near-dedup that is exact for the Jaccard similarity of word shingles.

A text is the set of the XXH64 hashes of its SHINGLE words in a row (a shorter text is one shingle, one without words the empty set).
Two texts link when their sets' similarity is SIMILARITY or more; groups are what links reach.

Equal sets are one node from the start. Candidates come from two sides, and are all verified on the whole sets:

* simhash.links() over the fingerprints of the same hashes joins what differs in at most BITS bits: nearly all links of large groups
  of near copies, at a cost that is linear in a group;
* bits don't bound the similarity, so what they can't retrieve comes from prefixes: in any one order of all shingles, the first
  n - ceil(SIMILARITY * n) + 1 of a set of n hold one of the prefix of each set that is similar enough. No pair is lost. The order
  puts shingles last that are frequent in a sample of texts; the sample decides only how many candidates there are. A pair is
  compared at a key only if the key's places in both leave room for what they must share: sets of n and m share at least
  ceil(SIMILARITY / (1 + SIMILARITY) * (n + m)) shingles, and the first that a similar pair shares has as many or more behind it,
  itself included, in both. So texts that are alike only in what is common, behind too much of their own, are no candidates.

Before sets are fetched, a pair is discarded if its signatures show that it can't be similar enough: a signature counts a set's
shingles in BUCKETS buckets, and two sets share no more than the sum of the lesser counts. Only sets of pairs that are left travel.

Pairs of a key with at most FEW nodes are verified all. In a larger one, nodes that are in one group already need no look; the others
are first compared with some leaders, and then each pair that still lies in two groups is verified, unless parities of bucket counts show
that it differs in too much.

Nulls: a null text is an empty one; rows with a null doc_id stay. Rows are told apart by their sets, not by doc_id. Empty
table: no row. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import discard, ship, small_side, text_of, unused, written
from .components import components
from .simhash import bits_of, hashes_of, links as near_bits

SHINGLE, SIMILARITY, BITS = 5, 0.8, 4
FEW, LEADERS, ROUNDS, BUCKETS = 24, 8, 3, 512
#: Texts that the order of shingles is taken from, and how many of these hold a shingle that counts as frequent.
ORDERED, FREQUENT = 20_000, 3


#: A shingle of a node's prefix: the size of the node's set, and how many come before it in the order.
KEYED = ["key", "node", "size", "place"]


def shingles(text: str, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(hashes_of(text, shingle, seed).view(np.int64))


def node_of(own: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(own.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signature(own: np.ndarray) -> bytes:
    """How many of a set's shingles fall in each bucket; empty, which tells nothing, where a bucket has more than a byte holds."""
    counts = np.bincount((own.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_be_similar(a: list[bytes], b: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs of signatures leave room for the similarity."""
    blank = bytes(BUCKETS)
    x, y = (np.frombuffer(b"".join(s or blank for s in side), np.uint8).reshape(-1, BUCKETS) for side in (a, b))
    shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    both = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
    unknown = np.array([not s or not t for s, t in zip(a, b, strict=True)], bool)
    return unknown | (shared * (1 + similarity) >= both * similarity - 1e-6)


#: Words of 64 bits that hold the parities of a signature's buckets.
WORDS = [f"p{i}" for i in range(BUCKETS // 64)]


def parities(signatures: DataFrame) -> DataFrame:
    """(node, WORDS) of signatures (node, sig): a bit for each bucket, 1 for an odd count; null for an empty signature. What two sets
    share changes both bits alike, so they differ in at least as many shingles as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = batch.column(1).to_pylist()
            bits = np.frombuffer(b"".join(s or bytes(BUCKETS) for s in sigs), np.uint8).reshape(-1, BUCKETS) & 1
            words, blank = np.packbits(bits, axis=1).view(np.int64), np.array([not s for s in sigs], bool)
            yield pa.record_batch([batch.column(0), *(pa.array(words[:, i], mask=blank) for i in range(len(WORDS)))], names=["node", *WORDS])

    return signatures.select("node", "sig").mapInArrow(run, ", ".join(["node long", *(f"{w} long" for w in WORDS)]))


def prefix(own: np.ndarray, frequent: np.ndarray, count: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, as many as a similar set must share one of."""
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        rank = np.where(frequent[at] == own, count[at], 0)
    return own[np.lexsort((own, rank))[: n - math.ceil(n * similarity - 1e-9) + 1]]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _frequent(rows: DataFrame, text: str, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that FREQUENT texts or more of about ORDERED hold, ascending, and how many do."""
    some = rows.filter(F.pmod(F.col("_node"), F.lit(max(1, n // ORDERED))) == 0) if n > ORDERED else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "", shingle) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["s"])

    counted = some.select(text).mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    found = counted.orderBy(F.desc("n"), "s").limit(200_000).orderBy("s").toArrow()
    return found.column("s").to_numpy(), found.column("n").to_numpy()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, size, place) sorted by key and node, each (key, node) once, of keys with several nodes."""
    last, kept = None, False  # the last row so far, which waits for the next
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if last is not None:
            rows = [np.append(x, c) for x, c in zip(last, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        rows = [c[new] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.append(kept, same) | np.append(same, False)
        yield pa.record_batch([pa.array(c[:-1][keep[:-1]]) for c in rows], names=KEYED)
        last, kept = [c[-1:] for c in rows], bool(keep[-1])
    if kept:
        yield pa.record_batch([pa.array(c) for c in last], names=KEYED)


def near_fingerprints(rows: DataFrame, radius: int = BITS) -> DataFrame:
    """(a, b): pairs of nodes of rows (_node long, _fp long) that join what differs in at most `radius` bits."""
    own = written(rows.select("_node", F.col("_fp").alias("fp")).distinct(), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("_node").alias("node")), "classes")
    same = own.join(classes, "fp").filter("_node <> node").select(F.col("_node").alias("a"), F.col("node").alias("b"))
    return near_bits(classes, radius).unionByName(same)


def links(rows: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, few: int = FEW, radius: int = BITS) -> DataFrame:
    """(a, b): links between the nodes of rows (_node long, _fp long, _sig binary, text), enough to join all that is linked."""
    near = near_fingerprints(rows, radius)
    frequent, count = _frequent(rows, text, rows.count(), shingle)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "", shingle) for t in batch.column(1).to_pylist()]
            own = [prefix(s, frequent, count, similarity) for s in sets]
            lens = [len(x) for x in own]
            node = np.repeat(batch.column(0).to_numpy(), lens)
            size = np.repeat(np.array([len(s) for s in sets], np.int32), lens)
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(x, dtype=np.int32) for x in lens)])
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), pa.array(node), pa.array(size), pa.array(place)], names=KEYED)

    schema = "key long, node long, size int, place int"
    dealt = rows.select("_node", text).mapInArrow(keyed, schema).repartition("key").sortWithinPartitions("key", "node")
    met = written(dealt.mapInArrow(_shared, schema), "shared")
    own = written(met.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"), "shared")
    signatures = written(rows.select(F.col("_node").alias("node"), F.col("_sig").alias("sig")).dropDuplicates(["node"]), "signatures")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = may_be_similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(t or "", shingle).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        def with_both(some: DataFrame, table: DataFrame, value: str) -> DataFrame:
            a, b = table.select(F.col("node").alias("a"), F.col(value).alias("x")), table.select(F.col("node").alias("b"), F.col(value).alias("y"))
            return some.join(a, "a").join(b, "b").select("a", "b", "x", "y")

        met = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        left = written(with_both(met, signatures, "sig").mapInArrow(likely, "a long, b long"), "likely")
        discard(met)
        needed = written(left.select(F.explode(F.array("a", "b")).alias("_needed")).distinct(), "needed")
        texts = rows.select("_node", text).join(small_side(needed), F.col("_node") == F.col("_needed"), "left_semi").dropDuplicates(["_node"])
        sets = written(texts.mapInArrow(held, "node long, set binary"), "sets")
        found = written(with_both(left, sets, "set").mapInArrow(verify, "a long, b long"), "similar")
        for table in (left, needed, sets):
            discard(table)
        return found

    room = F.least(F.col("size") - F.col("place"), F.col("to_size") - F.col("to_place"))
    sized = (F.least("size", "to_size") >= F.greatest("size", "to_size") * F.lit(similarity) - 1e-6) & (room >= (F.col("size") + F.col("to_size")) * F.lit(similarity / (1 + similarity)) - 1e-6)
    small = own.filter(F.col("n") <= few)
    to = [F.col("size").alias("to_size"), F.col("place").alias("to_place")]
    other = small.select("key", F.col("node").alias("b"), *to)
    found = verified(small.withColumnRenamed("node", "a").join(other, "key").filter("a < b").filter(sized).select("a", "b").unionByName(near))
    large = own.filter(F.col("n") > few)
    for turn in range(ROUNDS + 1):
        if large.isEmpty():
            break
        group = components(found).withColumnRenamed("component", "group")
        # the first round knows the links of fingerprints and of small keys; groups that a key holds but one of need no look
        named = written(large.drop("group").join(group, "node", "left").withColumn("group", F.coalesce("group", "node")), "named")
        main = named.groupBy("key", "group").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.count(F.lit(1)).alias("groups"))
        large = written(named.join(main.filter("groups > 1"), "key").drop("groups"), "large")
        if turn < ROUNDS:
            draw = F.xxhash64("node", F.pmod("key", F.lit(LEADERS)), F.lit(turn))
            of = F.when(F.col("group") == F.col("main"), draw)  # a leader of the largest group
            led = large.groupBy("key").agg(F.min_by(F.struct("node", "size", "place"), of).alias("to")).select("key", F.col("to.node").alias("b"), F.col("to.size").alias("to_size"), F.col("to.place").alias("to_place"))
            pairs = large.withColumnRenamed("node", "a").join(led, "key").filter(F.col("group") != F.col("main")).filter(sized)
        else:
            large = written(large.join(parities(signatures), "node"), "large")
            apart = large.filter(F.col("group") != F.col("main")).select("key", F.col("node").alias("b"), *to, F.col("group").alias("to_group"), *(F.col(w).alias(f"to_{w}") for w in WORDS))
            differ = reduce(Column.__add__, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"to_{w}"))) for w in WORDS))
            close = differ <= (F.col("size") + F.col("to_size")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
            pairs = large.withColumnRenamed("node", "a").join(apart, "key").filter("group <> to_group and (a < b or group = main)").filter(sized & F.coalesce(close, F.lit(True)))
        found = written(found.unionByName(verified(pairs.select("a", "b"))), "similar")
        large = large.drop("main")
    return found


def first_of_groups(df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, few: int = FEW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with the smallest doc_id of their group, all their columns as they are; rows with a null doc_id stay."""
    ship(df.sparkSession)
    node, fp, sig = unused(df, "_node"), unused(df, "_fp"), unused(df, "_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [hashes_of(t or "", shingle) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            nodes, sigs = pa.array([node_of(x) for x in sets], pa.int64()), pa.array([signature(x) for x in sets], pa.binary())
            fps = pa.array(np.array([bits_of(h) for h in hashes], np.uint64).view(np.int64))
            yield pa.record_batch([*batch.columns, nodes, fps, sigs], names=[*batch.schema.names, node, fp, sig])

    more = [T.StructField(node, T.LongType()), T.StructField(fp, T.LongType()), T.StructField(sig, T.BinaryType())]
    marked = written(df.mapInArrow(run, T.StructType([*df.schema.fields, *more])), "nodes")
    rows = marked.select(marked[doc_id].cast("long").alias("_id"), text_of(marked, text).alias("text"), F.col(node).alias("_node"), F.col(fp).alias("_fp"), F.col(sig).alias("_sig"))
    group = components(links(rows, "text", shingle, similarity, few))
    ids = rows.select("_id", "_node").distinct()
    named = ids.join(group.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    least = named.groupBy("component").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).filter("first < last")
    # by doc_id and set: rows with that doc_id and a text of another group stay
    gone = written(named.join(least, "component").filter("_id > first").select(F.col("_id").alias("_gone"), F.col("_node").alias("_of")), "gone")
    return marked.join(small_side(gone), (marked[doc_id].cast("long") == gone["_gone"]) & (marked[node] == gone["_of"]), "left_anti").select(*df.columns)
