"""Token-id files: canonical length-limited Huffman codes, decoded by table in independent blocks.

Encoding: the texts are dealt to ranges of ascending doc_ids; each is encoded once, and a range's ids are kept as blocks of whole
documents. Global id counts (at most one number for each id of the vocabulary) give one canonical code of at most MAX_BITS bits.
Each block is then written with that code.

A file is a folder with two Parquet tables (Spark's committer makes them safe against lost tasks, and any file system that Spark
writes to will do). `code` has a row (id, length) for each id that occurs; a canonical code needs no more. `blocks` has a row for
each block:

  part, block      place of the block, in ascending order of its doc_ids
  start            ids of all blocks before it
  doc_ids, n_ids   its documents and their ids, end id included
  checkpoints      bit offset of every STRIDE-th id, so that decoding can begin there
  bits             the codes, most significant bit first

A decoder needs the folder only (open_token_file). It decodes all strides of a block side by side with one table lookup an id.

Nulls: a null text is an empty one; rows with a null doc_id come first. Rows with one doc_id (or none) are written one after the
other, in an order that their texts alone decide; as many as there are, they are dealt to several ranges. Empty table: no block,
no code. Other columns aren't read. More distinct ids than codes of MAX_BITS bits are an error.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, ship, shared_dir, text_of, written
from .encoding import encoder

MAX_BITS = 18
BLOCK_IDS = 1 << 16
STRIDE = 256
#: Bytes of text for each range.
RANGE_BYTES = 24 << 20

RAW = "part int, block int, before long, doc_ids array<long>, n_ids array<int>, ids binary"
BLOCKS = "part int, block int, start long, doc_ids array<long>, n_ids array<int>, checkpoints array<long>, bits binary"


# --- code -----------------------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code with no code over max_bits: Huffman, or package-merge where that is too long."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    if len(counts) > 1 << max_bits:
        raise ValueError(f"{len(counts)} ids don't fit codes of {max_bits} bits")
    order = sorted(counts, key=lambda s: (counts[s], s))
    n = len(order)
    heap = [(counts[s], i) for i, s in enumerate(order)]
    parent, made = [0] * (2 * n - 1), n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = made
        heapq.heappush(heap, (a + b, made))
        made += 1
    depth = [0] * made
    for i in range(made - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    if max(depth[:n]) > max_bits:
        depth = _package_merge(np.array([counts[s] for s in order], dtype=np.int64), max_bits)
    return {s: int(depth[i]) for i, s in enumerate(order)}


def _package_merge(weights: np.ndarray, max_bits: int) -> list[int]:
    """weights ascending. A coin of each id for each length; the n - 1 cheapest pairs at the last level decide. Only how
    many single coins a level's prefix holds is kept, which is enough as weights are sorted."""
    n = len(weights)
    singles: list[np.ndarray] = []
    row, flag = weights.copy(), np.ones(n, bool)
    singles.append(np.cumsum(flag))
    for _ in range(max_bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        flag = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        order = np.argsort(both, kind="stable")
        row, flag = both[order], flag[order]
        singles.append(np.cumsum(flag))
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for level in reversed(singles):
        if take <= 0:
            break
        own = int(level[take - 1])
        lengths[:own] += 1
        take = 2 * (take - own)
    return lengths.tolist()


class Code:
    """A canonical code from its lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        self.max_bits = max(lengths.values(), default=1)
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        self.symbols = np.array(order, dtype=np.int64)
        lens = np.array([lengths[s] for s in order], dtype=np.int64)
        spans = np.left_shift(1, self.max_bits - lens) if len(lens) else lens
        first = np.cumsum(spans) - spans
        size = int(self.symbols.max()) + 1 if len(order) else 1
        self.code = np.zeros(size, np.uint64)
        self.length = np.zeros(size, np.int64)
        if len(order):
            self.code[self.symbols] = (first >> (self.max_bits - lens)).astype(np.uint64)
            self.length[self.symbols] = lens
        # the decoder's table: the id and length for each possible run of max_bits bits
        self.table_id = np.zeros(1 << self.max_bits, np.uint32)
        self.table_length = np.ones(1 << self.max_bits, np.uint8)
        self.table_id[: int(spans.sum())] = np.repeat(self.symbols, spans)
        self.table_length[: int(spans.sum())] = np.repeat(lens, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STRIDE-th id."""
        length = self.length[ids]
        at = np.cumsum(length) - length
        total = int(at[-1] + length[-1]) if len(ids) else 0
        word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
        both = self.code[ids] << shift
        high, low = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        words = (total + 31) // 32 + 1
        # codes don't overlap, so that adding is the same as or-ing; sums stay below 2**53
        out = np.bincount(word, weights=high.astype(np.float64), minlength=words)[:words]
        out += np.bincount(word + 1, weights=low.astype(np.float64), minlength=words)[:words]
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::STRIDE]

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """All strides at once: one step reads one id of each."""
        if not n:
            return np.zeros(0, np.uint32)
        pad = np.frombuffer(bits + b"\0" * (12 + -len(bits) % 4), ">u4").astype(np.uint64)
        windows = (pad[:-1] << np.uint64(32)) | pad[1:]
        at = np.asarray(checkpoints, np.int64).copy()
        lanes = len(at)
        out = np.empty((lanes, STRIDE), np.uint32)
        drop = np.uint64(64 - self.max_bits)
        last = n - (lanes - 1) * STRIDE
        for k in range(STRIDE):
            if k == last:  # the last stride may be shorter
                at = at[:-1]
                if not len(at):
                    break
            key = ((windows[at >> 5] << (at & 31).astype(np.uint64)) >> drop).astype(np.int64)
            out[: len(at), k] = self.table_id[key]
            at += self.table_length[key]
        return out.reshape(-1)[:n]

    def decode_from(self, bits: bytes, n: int, checkpoints: np.ndarray, first: int, count: int) -> np.ndarray:
        """count ids from the first-th on, without those before its checkpoint."""
        k = first // STRIDE
        end = min(n, first + count)
        got = self.decode(bits, end - k * STRIDE, np.asarray(checkpoints)[k : (end - 1) // STRIDE + 1]) if end > first else np.zeros(0, np.uint32)
        return got[first - k * STRIDE :]


# --- writing --------------------------------------------------------------------------------------------------------


def _raw_blocks(path: str, end_id: int | None, block_ids: int):
    """Encodes a range's texts, which come in order, and gives whole documents in a row until a block has block_ids ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, pack, part = encoder(path), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        block = before = size = 0
        docs, held = [], []

        def close():
            nonlocal block, before, docs, held, size
            n = [len(h) // enc.width for h in held]
            row = (part, block, before, docs, n, pack.compress(b"".join(held)))
            block, before, docs, held, size = block + 1, before + sum(n), [], [], 0
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, RAW_TYPES, strict=True)], names=RAW_NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(enc.encode(text) + tail)
                docs.append(doc)
                size += len(held[-1]) // enc.width
                if size >= block_ids:
                    yield close()
        if held:
            yield close()

    return run


RAW_NAMES = ["part", "block", "before", "doc_ids", "n_ids", "ids"]
RAW_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def encode_ids(df: DataFrame, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of zstd-compressed ids in doc_id order, as a table; `before` counts the ids of a block's range before it."""
    ship(df.sparkSession)
    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # cut by doc_id and, within one, by a hash of the text: a doc_id that many rows have fills several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.octet_length("text")]
    dealt = own.repartitionByRange(max(1, -(-size // RANGE_BYTES)), *order).sortWithinPartitions(*order, "text")
    return written(dealt.mapInArrow(_raw_blocks(tokenizer, end_id, block_ids), RAW), "ids", codec="none")


def _id_counts(batches: Iterator[pa.RecordBatch], width: int, vocab: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack, total = zstandard.ZstdDecompressor(), np.zeros(vocab, np.int64)
    for batch in batches:
        ids = [np.frombuffer(unpack.decompress(i.as_py()), f"<u{width}") for i in batch.column(0)]
        if ids:
            total += np.bincount(np.concatenate(ids), minlength=vocab)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _coded_blocks(lengths: dict[int, int], starts: dict[int, int], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code, unpack = Code(lengths), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, block, before, docs, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits, checkpoints = code.encode(np.frombuffer(unpack.decompress(ids), f"<u{width}"))
                row = (part, block, starts[part] + before, docs, n, checkpoints, bits)
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], names=NAMES)

    return run


NAMES = ["part", "block", "start", "doc_ids", "n_ids", "checkpoints", "bits"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]


def write_token_file(df: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes a token file at a path that has none (one in the shared folder, if none is given), and returns the path."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    enc = encoder(tokenizer)
    width, vocab = enc.width, enc.vocab_size
    ids = encode_ids(df, tokenizer, end_id, doc_id, text)
    counts = ids.select("ids").mapInArrow(lambda b: _id_counts(b, width, vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r[0]: r[1] for r in counts.collect()})  # at most one row for each id of the vocabulary
    starts, total = {}, 0
    for part, n in sorted(ids.groupBy("part").agg(F.sum(F.expr("aggregate(n_ids, 0L, (a, x) -> a + x)"))).collect()):  # one row for each range
        starts[part], total = total, total + n
    spark.createDataFrame(sorted(lengths.items()), "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    ids.mapInArrow(_coded_blocks(lengths, starts, width), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(ids)
    return path


def open_token_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """(blocks, the code's lengths) as a file has them; the lengths are at most 2 ** MAX_BITS rows."""
    ship(spark)
    lengths = {r["id"]: r["length"] for r in spark.read.schema("id int, length int").parquet(f"{path}/code").collect()}
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), lengths


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>)"""
    blocks, lengths = open_token_file(spark, path)
    return blocks.mapInArrow(_decoded(lengths, ids=True), "doc_id long, start long, n_tokens long, ids array<int>")


def digest_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): what a file holds of each document."""
    blocks, lengths = open_token_file(spark, path)
    return blocks.mapInArrow(_decoded(lengths, ids=False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decoded(lengths: dict[int, int], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_ids"], np.int64)
                got = code.decode(row["bits"], int(n.sum()), np.array(row["checkpoints"], np.int64))
                ends = np.cumsum(n)
                parts = np.split(got, ends[:-1])
                last = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())) if ids else pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"])

    return run
