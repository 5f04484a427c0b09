"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model. The normaliser reads a text's characters and writes a blank as the mark of a word's begin;
at its start it writes one such mark. The pieces' machine has a state for each beginning of a piece (read from its last character on,
so that what ends at a place is found in one walk), and writes a piece's id where one is whole. Byte fallback reads a character that
no piece covers and writes its bytes' ids. Composed with an input (Transducer.arcs), they give a lattice: its states are the places
of the input, an arc (from, to, piece) reads what lies between them. Transducer.shortest relaxes the arcs from left to right, which
is the tropical-semiring shortest path, as the lattice has no cycle.

For unigram models an arc weighs minus its piece's score. A byte-pair model isn't a sum of weights, but what may stand side by
side in its results is local: behind piece a, the arc of piece b weighs 0 if merging the characters of both gives just (a, b), and
infinity otherwise. Each place has exactly one path of finite weight, and it is what merging gives. One case isn't local: runs of
blanks, whose pieces all have one score and go by place; the beginning of such a word is merged (n log n steps).

No piece holds a word's begin after another character (compiling checks that), so that paths can be cut there. Workers keep the
paths of words they have met. Models with a character map or with blanks that go are refused with an error.

Nulls: a null text is an empty one with no piece; a null doc_id is kept. Repeated rows are encoded one by one. Empty table:
no row. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PrefixCoder, backwards, ending_at, merged
from .common import ship, text_of
from .encoding import CACHE_LIMIT, _Kept

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Transducer:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the normaliser of this model isn't one that is compiled here")
        sp = self.library
        size = sp.get_piece_size()
        self.vocab_size = size
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in normal}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces reach over a word's begin")
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.id), default=1)
        self.merges = model.trainer_spec.model_type == 2
        #: what each id writes; other ids write nothing
        self.out = [b""] * size
        for p, i in self.id.items():
            self.out[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        none, score = float("inf"), self.score
        self._rank = lambda a, b: -score[a + b] if a + b in score else none
        if self.merges:
            self.coder = PrefixCoder(set(self.id), self._rank)
        self.trie = self.coder.inner if self.merges else backwards(self.id)
        self.heavy = 10 - min(score.values(), default=0)
        self._words = _Kept(lambda w: self._path(MARK + w), CACHE_LIMIT)
        self._chunks = _Kept(self._path, CACHE_LIMIT // 8)

    def _arcs(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def _path(self, chunk: str) -> bytes:
        """The shortest path's ids."""
        pieces = merged(list(chunk), self._rank) if self.merges and chunk.startswith(MARK * 2) else self.shortest(chunk)
        return np.array([i for p in pieces for i in self._arcs(p)], self.dtype).tobytes()

    def arcs(self, chunk: str, to: int) -> list[int]:
        """Where the lattice's arcs into a place come from, the longest piece first. The last one reads a character that no piece
        covers, if it is one."""
        found = ending_at(self.trie, chunk, to)
        if not found or found[-1] < to - 1:
            found.append(to - 1)
        return found

    def weight(self, before: str, piece: str) -> float:
        """Of an arc, behind the piece that stands before it (none at the start)."""
        if self.merges:
            return 0.0 if not before or self.coder.follows(before, piece) else math.inf
        return -self.score[piece] if piece in self.score else self.heavy

    def shortest(self, chunk: str) -> list[str]:
        """The pieces of the lightest path. Of equal ones, the one whose last piece is the longest."""
        cost, last, weight = [0.0], [""], self.weight
        for to in range(1, len(chunk) + 1):
            least, piece = math.inf, chunk[to - 1]
            for k in self.arcs(chunk, to):
                total = cost[k] + weight(last[k], own := chunk[k:to])
                if total < least:
                    least, piece = total, own
                    if self.merges:
                        break  # no other path of finite weight comes here
            cost.append(least)
            last.append(piece)
        pieces, at = [], len(chunk)
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        return pieces[::-1]

    def _lightest(self, chunk: str) -> list[str]:
        """The shortest path by the scores alone, as in a unigram model."""
        own = copy(self)
        own.merges, own.trie, own.heavy = False, backwards(self.score), 10 - min(self.score.values(), default=0)
        return own.shortest(chunk)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
            return np.frombuffer(b"".join(map(self._chunks.__getitem__, chunks)), self.dtype)
        return np.frombuffer(b"".join(map(self._words.__getitem__, text.split(" "))), self.dtype)

    def decode(self, ids) -> str:
        """The text that ids write. Bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row. One pass, no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([t.encode(x).astype(np.int32) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, same): what encoding gives, and whether decoding its ids gives the text back."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            n, crc, same = [], [], []
            for x in batch.column(1).to_pylist():
                ids = t.encode(x)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(t.decode(ids) == x.replace(MARK, " "))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "same"])

    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, same boolean")
