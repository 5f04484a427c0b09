"""Exact token counts at every prefix, by dynamic programming.

word_bpe tokenizers cut a text (after NFC, lower case and white space) into words that are encoded one by one. One pass from left
to right keeps the tokens of the words that are closed, and of the open word the last token and the number of tokens of each of its
prefixes (bpe.PrefixCoder), so it gives the count of every prefix of the text, as if each were a text of its own:

* which characters are letters, numbers, white space or neither is asked of the tokenizer itself, once for each character;
* characters that a later one may combine with are normalised together, and a prefix that ends between them takes what it has;
* 's, 't, 're, 've, 'm, 'll and 'd are one word once they are whole, and two before;
* a special string is one token once it is whole, and ordinary text before.

White space cuts words, so a text's table is put together from the tables of its chunks, and workers keep those that they have met.
prefix_tables() stores the places where the count changes; it answers truncation and budgets without encoding again.

Nulls: a null text is an empty one with no token; a null doc_id is kept. Repeated rows are counted one by one. Empty table:
no row. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import PrefixCoder
from .common import ship, text_of
from .encoding import CACHE_LIMIT, _PLAIN, _WORD_LEVEL, Encoder, _Kept, byte_alphabet

#: White space, as tokenizers see it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[^{SPACE}]+")
#: Characters that only some of Python's and the tokenizer's functions take as white space.
_STRANGE = re.compile("[\x1c-\x1f]")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_LAST = itemgetter(-1)


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that can be the second of a composition."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for code in range(0x11_0000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def clusters(text: str) -> Iterator[tuple[int, int]]:
    """Places of characters with all that may combine with them."""
    if text.isascii():
        yield from ((i, i + 1) for i in range(len(text)))
        return
    start, seconds = 0, _seconds()
    for i in range(1, len(text) + 1):
        if i == len(text) or not (text[i] in seconds or unicodedata.combining(text[i])):
            yield start, i
            start = i


class _Scan:
    """The words of a text so far. closed: tokens of those that are over; kind, symbols: the open word; last, count: its prefixes."""

    def __init__(self, counter: Counter):
        self.counter = counter
        self.closed, self.kind, self.symbols, self.short = 0, "", "", ""
        self.last, self.count = [""], [0]

    def kept(self) -> tuple:
        return self.closed, self.kind, self.symbols, self.short, self.last, self.count, len(self.last)

    def back(self, state: tuple) -> None:
        self.closed, self.kind, self.symbols, self.short, self.last, self.count, n = state
        del self.last[n:], self.count[n:]

    def tokens(self) -> int:
        """Tokens if the text ended here."""
        if not self.symbols:
            return self.closed
        coder = self.counter.coder
        return self.closed + self.count[coder.ended(self.symbols, len(self.symbols), self.last)[1]] + 1

    def close(self) -> None:
        self.closed, self.kind, self.symbols, self.last, self.count = self.tokens(), "", "", [""], [0]

    def push(self, c: str) -> None:
        """One more character of the normal form."""
        kind, c_symbols = self.counter.kinds[c], self.counter.symbols[c]
        if kind == "space":
            self.close()
            self.short = ""
            return
        short = self.short + c
        if short in CONTRACTIONS:  # its beginning stood for one or two words so far
            self.closed = self.before
            self.symbols, self.last, self.count = "".join(map(self.counter.symbols.__getitem__, short)), [""], [0]
            self.counter.coder.grow(self.symbols, self.last, self.count)
            self.close()
            self.short = ""
            return
        begun = kind != self.kind or kind == "number"
        if begun:
            self.close()
            self.kind = kind
        if self.short and any(x.startswith(short) for x in CONTRACTIONS):
            self.short = short
        elif begun and c == "'":
            self.short, self.before = c, self.closed
        else:
            self.short = ""
        self.symbols += c_symbols
        self.counter.coder.grow(self.symbols, self.last, self.count)


class Counter:
    """Counts of the tokens of a text and of its prefixes, for a tokenizer file of the word_bpe kind."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        if self.encoder.byte_level:
            raise ValueError("prefix counts are for tokenizers that encode word by word")
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError("special strings of this kind aren't counted here")
        ranks = {(a, b): i for i, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        none = float("inf")
        self.coder = PrefixCoder(set(model["vocab"]), lambda a, b: ranks.get((a, b), none), end=model["end_of_word_suffix"] or "")
        self.normal: Callable[[str], str] = self.encoder.library.normalizer.normalize_str
        self.alphabet = byte_alphabet()
        self.kinds = _Kept(self._kind, CACHE_LIMIT)
        self.symbols = _Kept(lambda c: "".join(self.alphabet[b] for b in c.encode("utf-8", "surrogatepass")), CACHE_LIMIT)
        #: word or chunk -> the counts of its prefixes, from the first character on
        self.words = _Kept(self._word, CACHE_LIMIT // 2)
        self.latin = {i: self.symbols[chr(i)] for i in range(256)}
        self.chunks = _Kept(self._chunk, CACHE_LIMIT // 2)
        specials = sorted(self.encoder.specials, key=len, reverse=True)
        if any(a in b for a in specials for b in specials if a != b):
            raise ValueError("a special string holds another one")
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def _kind(self, c: str) -> str:
        cut = self.encoder.library.pre_tokenizer.pre_tokenize_str
        if _CHUNK.fullmatch(c) is None:
            return "space"
        return "letter" if len(cut("a" + c)) == 1 else "other" if len(cut("!" + c)) == 1 else "number"

    def _scan(self, text: str, scan: _Scan) -> Iterator[int]:
        """Counts of the prefixes of a text without special strings, behind what the scan holds."""
        for start, end in clusters(text):
            state = scan.kept()
            for i in range(start + 1, end + 1):
                if i > start + 1:
                    scan.back(state)
                for c in self.normal(text[start:i]):
                    scan.push(c)
                yield scan.tokens()

    def _scanned(self, text: str) -> list[int]:
        return list(self._scan(text, _Scan(self)))

    @staticmethod
    def _packed(counts: list[int]) -> bytes | list[int]:
        """Bytes where they are enough, as they are for all that is kept."""
        return bytes(counts) if not counts or max(counts) < 256 else counts

    def _word(self, word: str) -> bytes | list[int]:
        """One plain word in lower case: its prefixes are one word each, but those of a contraction."""
        if word in CONTRACTIONS:
            return self._packed(self._scanned(word))
        symbols, coder = word.translate(self.latin), self.coder
        last, count = coder.prefixes(symbols)
        ends = range(1, len(word) + 1) if word.isascii() else np.cumsum([len(self.latin[ord(c)]) for c in word]).tolist()
        return self._packed([count[coder.ended(symbols, e, last)[1]] + 1 for e in ends])

    def _chunk(self, chunk: str) -> bytes | list[int]:
        """A chunk without white space: of plain letters and signs, its words' tables one behind the other."""
        if not _PLAIN.fullmatch(chunk) or _STRANGE.search(chunk):
            return self._packed(self._scanned(chunk))
        words = _WORD_LEVEL.findall(chunk.lower())
        if len(words) == 1:
            return self.words[words[0]]
        counts: list[int] = []
        for w in words:
            before = counts[-1] if counts else 0
            counts += [before + n for n in self.words[w]]
        return self._packed(counts)

    def _parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(place, part, whether it is a special string)."""
        at = 0
        for m in self.special.finditer(text) if self.special is not None and "<" in text else ():
            yield at, text[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        yield at, text[at:], False

    def count(self, text: str) -> int:
        total = 0
        for _, part, special in self._parts(text):
            total += 1 if special else sum(map(_LAST, self._tables(part)[1]))
        return total

    def _tables(self, part: str) -> tuple[list[str], list]:
        """The chunks of a text without special strings, and their tables."""
        own = _CHUNK.findall(part) if _STRANGE.search(part) else part.split()
        return own, list(map(self.chunks.__getitem__, own))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1] ... text."""
        out = np.zeros(len(text) + 1, np.int64)
        total = 0
        before = ""
        for at, part, special in self._parts(text):
            if special:  # up to its last character, it goes on with the text before
                scan = _Scan(self)
                open_ = re.search(f"[^{SPACE}]*\\Z", before)[0]
                base = total - (self.chunks[open_][-1] if open_ else 0)
                for _ in self._scan(open_, scan):
                    pass
                out[at + 1 : at + len(part)] = [base + n for n in self._scan(part[:-1], scan)]
                total += 1
                out[at + len(part)] = total
                before = ""
                continue
            i, before = at, part
            for chunk, table in zip(*self._tables(part), strict=True):
                start = text.index(chunk, i)
                out[i + 1 : start + 1] = total
                out[start + 1 : start + len(chunk) + 1] = table if isinstance(table, list) else np.frombuffer(table, np.uint8)
                out[start + 1 : start + len(chunk) + 1] += total
                total, i = total + table[-1], start + len(chunk)
            out[i + 1 : at + len(part) + 1] = total
        return out

    def steps(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): the lengths of prefixes at which the count changes, from 0 on, and the count from there."""
        counts = self.prefix_counts(text)
        at = np.flatnonzero(np.diff(counts, prepend=-1))
        return at, counts[at]

    def truncated(self, text: str, budget: int) -> int:
        """The longest prefix of at most `budget` tokens, in characters."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens, characters): of the whole text, and of its longest prefix of at most `budget` tokens. The chunks' totals tell
        in which chunk the budget ends, and its table tells where."""
        if self.special is not None and self.special.search(text):
            counts = self.prefix_counts(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
        own, tables = self._tables(text)
        totals = np.fromiter(map(_LAST, tables), np.int64, len(tables)).cumsum()
        n = int(totals[-1]) if len(totals) else 0
        if n <= budget:
            return n, len(text)
        k = int(np.searchsorted(totals, budget, side="right"))  # the first chunk that goes beyond; what is behind it does too
        before = int(totals[k - 1]) if k else 0
        start = next(m.start() for j, m in enumerate(_CHUNK.finditer(text)) if j == k)
        return n, start + max((i + 1 for i, x in enumerate(tables[k]) if before + x <= budget), default=0)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([c.fitting(t, limit) for t in texts], np.int64).reshape(-1, 2)
            size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.record_batch(
                [batch.column(0), pa.array(size), pa.array(found[:, 0]), pa.array(found[:, 0] > limit), pa.array(found[:, 1])], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            )

    return run


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of each row; fit_chars: the characters of the longest prefix of at most
    `limit` tokens. One pass, no shuffle."""
    ship(df.sparkSession)
    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return own.mapInArrow(_counted(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chars long, ends array<int>, counts array<int>): the count of every prefix of each text, as the lengths at which it
    changes and the counts from there on, to answer for any budget later."""
    ship(df.sparkSession)
    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tables = [c.steps(t) for t in texts]
            arrays = [pa.array([t[k].astype(np.int32) for t in tables], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), *arrays], names=["doc_id", "chars", "ends", "counts"])

    return own.mapInArrow(run, "doc_id long, chars long, ends array<int>, counts array<int>")


def fits(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_tokens, over_limit, end): of prefix_tables() alone; end: the characters of the longest prefix of at most `budget`
    tokens."""
    inside = F.expr(f"array_max(filter(transform(counts, (n, i) -> if(n <= {int(budget)}, i, -1)), i -> i >= 0))")
    n = F.element_at("counts", -1).cast("long")
    end = F.when(inside + 1 < F.size("ends"), F.get("ends", inside + 1) - 1).otherwise(F.col("chars"))
    return tables.select("doc_id", n.alias("n_tokens"), (n > budget).alias("over_limit"), end.cast("long").alias("end"))


def tokens_at(tables: DataFrame, length: str) -> DataFrame:
    """(doc_id, tokens): of prefix_tables() with a column of lengths in characters: the tokens of the prefix that is so long."""
    at = F.expr(f"size(filter(ends, e -> e <= {length}))")
    return tables.select("doc_id", F.element_at("counts", at).cast("long").alias("tokens"))
