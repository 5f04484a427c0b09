"""Periodic runs and byte-level BPE against brute force and the library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factloom.llm import byte_bpe, periodic_runs, queries  # noqa: E402

CLASH = ("ids", "decoded", "_text", "_ids", "runs", "strongest", "collapsed", "n_words")


def slow_runs(w, least, exponent):
    """Each period, each stretch; the smallest period by trying all smaller ones."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if len(own) >= max(least, exponent * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5])
    w = [b"abcde"[c : c + 1] for c in (rng.randrange(k) for _ in range(n))]
    if n > 5 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // (2 + rng.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least, exponent", [(24, 3), (3, 3), (6, 3), (2, 2), (5, 2), (12, 4)])
def test_runs_of_words(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(600):
        w = odd_words(rng)
        want = slow_runs(w, least, exponent)
        assert periodic_runs.automaton_runs(w, least, exponent) == want
        assert periodic_runs.runs(w, least, exponent) == want


def test_runs_of_long_texts():
    rng = random.Random(3)
    assert periodic_runs.runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    block = [b"%d" % rng.randrange(10**6) for _ in range(3000)]
    assert periodic_runs.runs(block * 40) == [(0, 120_000, 3000)]
    assert periodic_runs.runs(block * 2 + [b"x"] + block) == [] and periodic_runs.runs([]) == []
    with pytest.raises(ValueError):
        periodic_runs.automaton_runs([b"a"], exponent=1)


def slow_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(kept)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_op12(spark, sf):
    want = {r["doc_id"]: slow_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert got == want and any(r[0] for r in want.values())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a\x0bb\x0cc\x1cd\xa0e", "x y " * 40, "  ".join("ab"), "the end " + "no " * 30 + "é " * 30]
    texts += [b" ".join(odd_words(rng)).decode() for _ in range(60)] + ["q r s " * 20] * 3
    rows = [(i * 7, t, *("c" * len(CLASH))) for i, t in enumerate(texts)] + [(None, "z " * 50, *("d" * len(CLASH))), (7, "", *("e" * len(CLASH)))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3).cache()


def test_runs_of_odd_rows(odd):
    got = sorted((str(r["doc_id"]), *map(str, (r[c] for c in RUN_COLUMNS))) for r in periodic_runs.digests(periodic_runs.with_planted_runs(odd)).collect())
    assert got == sorted((str(d), *map(str, slow_row(d, t))) for d, t in odd.select("doc_id", "text").collect())
    full = periodic_runs.find_runs(odd)
    assert full.columns == ["doc_id", "text", *CLASH, "n_words_", "runs_", "strongest_", "collapsed_"]
    assert {r["ids"] for r in full.collect()} == {"c", "d", "e"}
    assert periodic_runs.digests(periodic_runs.with_planted_runs(odd.limit(0))).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------------------------------

PIECES = ["a", "ab", "the", " ", "  ", "\n", "é", "日本", "🙂", "!!", "==", "0", "12", "ing", "tion", "s", "S", "'s", "\x00", "<|endoftext|>", "aaaa", "zz"]


def library(path, pattern=public_tokenizers.PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.ByteBpe.load(path, pattern).ranks, special_tokens={})


@pytest.mark.parametrize("name", [queries.BYTE_RANKS, "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_tree_is_the_library_s(name, leaf):
    rng = random.Random(leaf)
    path = public_tokenizers.path(name)
    coder, lib = byte_bpe.ByteBpe.load(path, public_tokenizers.PATTERN), library(path)
    coder.leaf = leaf
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    texts += ["a" * 5000, "ab" * 3000, "=" * 4097, "日" * 2000, "".join(rng.choice("aeionst") for _ in range(20000)), " " * 3001 + "x"]
    for t in texts:
        ids = coder.encode(t).tolist()
        assert ids == lib.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_join_is_a_product():
    """Any cut of a byte string gives the same tokens, and joining is associative, with merges that reach far over the boundary too."""
    rng = random.Random(2)
    for _ in range(300):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + rng.choice([4, 30]):
            ranks.setdefault(b"".join(rng.choice([t for t in ranks if set(t) <= set(b"abc")]) for _ in range(2)), len(ranks))
        coder = byte_bpe.ByteBpe(ranks, ".+", leaf=1)
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 40)))
        whole = coder._merge(data)
        for k in range(len(data) + 1):
            assert coder.join(coder._merge(data[:k]), coder._merge(data[k:])) == whole
        a, b, c = (coder._merge(x) for x in (data[: len(data) // 3], data[len(data) // 3 : len(data) // 2], data[len(data) // 2 :]))
        assert coder.join(coder.join(a, b), c) == coder.join(a, coder.join(b, c)) == whole == coder.tree(data)
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, ".")


def slow_ids(lib, text):
    ids = lib.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode_bytes(ids)).hexdigest()


def test_query_op13(spark, sf):
    lib = library(public_tokenizers.path(queries.BYTE_RANKS))
    want = {r["doc_id"]: slow_ids(lib, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op13_byte_bpe"](spark, sf).collect()} == want


def test_bytes_of_odd_rows(odd):
    path = public_tokenizers.path(queries.BYTE_RANKS)
    lib = library(path)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.digests(odd, path, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(d), *slow_ids(lib, t)) for d, t in odd.select("doc_id", "text").collect())
    encoded = byte_bpe.encode(odd, path, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "ids_"]
    back = byte_bpe.decode(encoded, path, public_tokenizers.PATTERN, ids="ids_")
    assert back.columns == [*encoded.columns, "decoded_"] and all(r["decoded_"] == (r["text"] or "").encode() for r in back.collect())
    nulls = encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {bytes(r["decoded"]) for r in byte_bpe.decode(nulls, path, public_tokenizers.PATTERN).collect()} == {b""}
    assert byte_bpe.digests(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0
