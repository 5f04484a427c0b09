"""Collocations against brute force: counts, cuts, subsumption, order, sketches of any width."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import collocations as c


def slow(rows, least, longest=5, share=100, top=2000):
    """rows: (lang, text). All phrases counted, all pairs of candidates compared."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q)))
    out = []
    for lang in sorted(n):
        own = {p: a for (x, p), a in candidates.items() if x == lang}
        found = []
        for p, a in own.items():
            if any(inside(p, q) and 100 * b >= share * a for q, b in own.items()):
                continue
            cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            k = cut[1]
            found.append((-cut[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "time", "é", "É", "日本", "a\xa0b", "x\x1cy", "z\x00", "q" * 50]
    out = [(None, None), ("en", ""), (None, "a b a b a b"), ("und", "a b a b"), ("en", " \t "), ("fr", "un deux trois quatre cinq six. " * 9), ("", "a b a b a b"), ("de", "x")]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", "\x0b", "\x0c", ";:"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return out + out[20:30] * 2 + [("en", "of time the " * 3000)]


def frame(spark, rows):
    names = ("word", "words", "phrase", "f", "n", "row", "block", "cells", "LANGUAGE", "a", "score", "cut")
    return spark.createDataFrame([(*r, *names) for r in rows], "lang string, text string, " + ", ".join(f"{x} string" for x in names)).repartition(5)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("least, longest, share, top, width", [(3, 5, 100, 2000, None), (3, 5, 100, 7, 1 << 16), (5, 3, 60, 2000, 8), (3, 4, 90, 2000, 64), (1, 2, 100, 50, None), (300, 5, 100, 9, None)])
def test_collocations(spark, rows, least, longest, share, top, width):
    assert got(c.collocations(frame(spark, rows), least, longest, share, top, width)) == sorted(slow(rows, least, longest, share, top))


def test_no_rows_and_no_words(spark):
    assert got(c.collocations(frame(spark, [("en", "x")]).limit(0), least=1)) == []
    assert got(c.collocations(frame(spark, [("en", None), (None, " . ")]), least=1)) == []
    with pytest.raises(ValueError):
        c.frequent_phrases(frame(spark, [("en", "x")]), least=0)


def test_small_batches_and_flushed_phrases(spark, rows, monkeypatch):
    """Whatever is worked on at once, each text is counted once."""
    import pyarrow as pa

    monkeypatch.setattr(c, "AT_ONCE", 500)
    monkeypatch.setattr(c, "HELD", 3)
    texts = [(x or "und", t or "") for x, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in texts]), pa.array([r[1] for r in texts])], names=["lang", "text"])
    total, n = Counter(), Counter()
    for b in c._count(spark.sparkContext.broadcast([(r, 0, b"\xff" * 8) for r in range(3)]), 64, 1)(iter([batch])):
        for r in b.to_pylist():
            total[r["lang"], r["phrase"]] += r["f"]
    for b in c._gather(64, 3, 5)(iter([batch])):
        n.update({r["lang"]: r["n"] for r in b.to_pylist() if r["lang"] is not None})
    want, all_words = Counter(), Counter()
    for lang, text in texts:
        own = re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want.update((lang, w) for w in own)
        all_words[lang] += len(own)
    assert total == want and n == +all_words


def test_sketches_never_say_too_little():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    drawn = [rng.choice(hashes, 4000, p=np.arange(1, 501) / np.arange(1, 501).sum()) for _ in range(5)]
    for width in (8, 64, 4096):
        blocks = {}
        for own in drawn:
            sketch = c.Sketch(width)
            sketch.add(own)
            for row, block, packed in sketch.blocks(40):
                blocks.setdefault((row, block), []).append(packed)
        import pandas as pd

        frames = [pd.DataFrame({"row": [k[0]] * len(v), "block": [k[1]] * len(v), "cells": v}) for k, v in sorted(blocks.items())]
        added = [tuple(r) for f in c._added(40)(iter(frames)) for r in f.itertuples(index=False)]
        left = set(hashes[c.Frequent(width, added)(hashes)].tolist())
        counts = Counter(np.concatenate(drawn).tolist())
        often = {h for h, n in counts.items() if n >= 40}
        assert often <= left and (width < 4096 or len(left) < len(often) + 20)


def test_products_may_pass_64_bits(spark):
    rng = random.Random(9)
    n = 9 * 10**12
    f = {("a",): 8 * 10**11, ("b",): 7 * 10**11 + 1, ("c",): 10**9 + 7, ("a", "b"): 6 * 10**11 + 3, ("b", "c"): 10**9 + 5, ("a", "b", "c"): 10**9 + 1}
    f |= {(x,): rng.randint(10**3, 10**12) for x in "defgh"}
    f |= {(x, y): rng.randint(100, min(f[x,], f[y,])) for x in "defgh" for y in "defgh"}
    phrases = spark.createDataFrame([("en", len(p), " ".join(p), a) for p, a in f.items()], "lang string, words int, phrase string, f long")
    rows = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in c.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()}
    for p, a in f.items():
        if len(p) > 1:
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            assert rows[" ".join(p)] == (f[p[:k]], f[p[k:]], score)
