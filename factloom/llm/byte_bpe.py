"""Byte-level BPE as a monoid: a text is encoded and decoded up a tree.

A pattern cuts a text into matches, each of which is encoded by itself. Within a match, encodings of neighbouring byte strings are
the elements of a monoid and join() is its product: it encodes the tokens next to the boundary again, in a window that grows until
what lies outside of it is known to stay. A match is halved down to LEAF bytes and joined on the way back, and matches are joined by
concatenation, as no merge crosses them. Decoding concatenates up a tree of its own.

When a window is wide enough: a sequence of two or more tokens is the encoding of its bytes if and only if each two neighbours are the
encoding of theirs. (Up to the first merge across a boundary, merging the whole does within two neighbours just what merging them
alone does, in the same order, so it can't be the first to cross.) So when the window's first token may stand behind the token before
the window, and the token behind it may stand behind its last, nothing outside changes. If the test fails on a side, the window takes
in twice as many tokens there.

Nulls: a null text is an empty one, without a token, and null ids are none; other columns pass through, whatever their names.
Repeated rows are encoded one by one. Empty table: no row. A match of any length takes n log n steps for each level of its tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import merged
from .common import ship, text_of, unused

#: Bytes of a leaf, which is merged at once, and branches of a node of the decoding tree.
LEAF, BRANCHES = 4, 64
#: Matches and short byte strings whose tokens a worker keeps; bounds of memory, no result hangs on them.
CACHE, SHORT = 500_000, 16
_NEVER = float("inf")


class ByteBpe:
    """ranks: token -> id, lower ids merge first. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.matches = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.short: dict[bytes, list[bytes]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}, pattern)

    def _merge(self, data: bytes) -> list[bytes]:
        if (got := self.short.get(data)) is None:
            rank = self.ranks.get
            got = [data[i : i + 1] for i in range(len(data))]
            if len(data) > SHORT:
                return merged(got, lambda a, b: rank(a + b, _NEVER))
            while len(got) > 1:
                own = [rank(a + b, _NEVER) for a, b in zip(got, got[1:])]
                if (least := min(own)) == _NEVER:
                    break
                i = own.index(least)
                got[i : i + 2] = [got[i] + got[i + 1]]
            if len(self.short) < CACHE:
                self.short[data] = got
        return got

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether b may follow a: together they are encoded as just these two."""
        return self._merge(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of what left and right encode, one behind the other."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self._merge(b"".join(left[-i:] + right[:j]))
            before = i == len(left) or self.stands(left[-i - 1], window[0])
            behind = j == len(right) or self.stands(window[-1], right[j])
            if before and behind:
                return left[:-i] + window + right[j:]
            if not before:
                i = min(2 * i, len(left))
            if not behind:
                j = min(2 * j, len(right))

    def tree(self, data: bytes) -> list[bytes]:
        """The tokens of a byte string, by halves."""
        if len(data) <= self.leaf:
            return self._merge(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def _of_match(self, match: str) -> bytes:
        data = match.encode("utf-8", "surrogatepass")
        tokens = [data] if data in self.ranks else self.tree(data)  # a match that is a token is that token
        ids = np.array([self.ranks[t] for t in tokens], "<i4").tobytes()
        if len(self.known) < CACHE and len(match) <= 48:
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, other = self.known.get, self._of_match
        return np.frombuffer(b"".join([known(m) or other(m) for m in self.matches(text)]), "<i4")

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up a tree; an unknown id raises KeyError."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[k : k + BRANCHES]) for k in range(0, len(level), BRANCHES)]
        return level[0] if level else b""


_loaded: dict[tuple[str, str], ByteBpe] = {}


def _coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of their texts (array of int) as one column more."""
    ship(docs.sparkSession)
    name, own = unused(docs, ids), unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            found = [coder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, "<i4"), *found])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], name])

    # rows travel with numbered columns, so that any names may repeat
    frame = docs.select(*(docs[c] for c in docs.columns), text_of(docs, text).alias(own))
    return frame.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False), False)]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids stand for as one column more."""
    ship(encoded.sparkSession)
    name, own = unused(encoded, decoded), unused(encoded, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            out = pa.array([coder.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], name])

    frame = encoded.select(*(encoded[c] for c in encoded.columns), F.col(f"`{ids}`").alias(own))
    return frame.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType(), False)]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents that are encoded and decoded again."""
    back = decode(encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids"), path, pattern)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
