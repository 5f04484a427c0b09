"""Exact, cached encoding with the tokenizers library.

Both pre-tokenizers used here cut a text at single blanks, so the ids of a text are the ids of its blank-separated
chunks in a row. Chunks repeat, so a worker keeps the ids of those it has met (a bounded cache that never changes a
result). A chunk that is new is cut into pre-tokens and given to the library's model. A text in which blanks alone
don't decide (rare white space, runs of blanks, special strings) goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a worker keeps: words, and chunks of more than one pre-token.
CACHE_LIMIT, CHUNK_LIMIT = 800_000, 150_000
#: White space other than blank and newline; a text with any of it isn't cut here.
RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTER}]*")
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+")
_BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """A bounded cache: key -> make(key)."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < self.limit and len(key) <= 48:
            self[key] = value
        return value


class _Words(_Kept):
    """Keeps single words only; what holds more than one pre-token goes to `other`."""

    def __init__(self, make, other, limit: int):
        super().__init__(make, limit)
        self.other = other

    def __missing__(self, key: str):
        return super().__missing__(key) if key.isalpha() and _PLAIN.fullmatch(key) else self.other(key)


class Encoder:
    """encode(text) -> ids as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_level = self.library.normalizer is None
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 65536 else "<u4")
        self.width = self.dtype.itemsize
        alphabet = byte_alphabet()
        self._latin = {i: "".join(alphabet[b] for b in chr(i).encode()) for i in range(256)}
        lead = " " if self.byte_level else ""
        self._words = _Words(lambda w: self._of_model(lead + (w if self.byte_level else w.lower())), lambda w: self._chunks[lead + w], CACHE_LIMIT)
        self._chunks = _Kept(self._of_chunk, CHUNK_LIMIT)
        self._pretokens = _Kept(self._of_model, CHUNK_LIMIT)

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _of_model(self, pretoken: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(pretoken.translate(self._latin))])

    def _of_pretoken(self, p: str) -> bytes:
        if self.byte_level:
            return self._words[p[1:]] if p[0] == " " and p[1:].isalpha() else self._pretokens[p]
        return self._words[p] if p.isalpha() else self._pretokens[p]

    def _of_chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        return b"".join(map(self._of_pretoken, _BYTE_LEVEL.findall(chunk) if self.byte_level else _WORD_LEVEL.findall(chunk.lower())))

    def cuts(self, text: str) -> bool:
        """Whether blanks alone decide."""
        return not (any(s in text for s in self.specials) or any(c in text for c in RARE_SPACE))

    def encode(self, text: str) -> bytes:
        if not self.cuts(text):
            return self.whole(text)
        if not self.byte_level:
            return b"".join(map(self._words.__getitem__, text.split()))
        if "  " in text or "\n \n" in text or text.endswith("\n "):
            return b"".join(map(self._chunks.__getitem__, _BYTE_CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return self._chunks[first] + b"".join(map(self._words.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
