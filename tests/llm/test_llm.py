"""The training-data operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factloom.llm import bpe, components, embed_dedup, encoding, exact_dedup, license_scan, line_dedup, packing, piece_transducer, queries, simhash, token_counts, token_file, toxicity  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE, queries.PIECE_BPE))
#: Columns with names that operators use within.
CLASH = ("part", "digest", "kept", "_sha", "_gone", "_keep", "node", "fp", "component_id", "_doc", "_own", "label", "score", "h", "w", "_row", "ids")
rng = random.Random(7)
WORDS = [a + b for a in ("the", "ing", "or", "é", "nd", "st") for b in ("an", "re", "ç", "ly", "tion", "")]
LONG = " ".join(rng.choice(WORDS) for _ in range(6000))
ODD = ["", "   ", "\n\n", "a", "A b c", "a b C", "Hello <|endoftext|> world", "x  y   z\n \n q\t.", "日本語 текст 🙂", "don't I'LL we're 1234 $%&", "​ zero\xa0wide", "\x00", LONG, LONG + " x", LONG.upper()]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    own = [*ODD, *(sentence(rng.randint(1, 60)) for _ in range(60))]
    own += [own[20], own[20].upper(), own[21], own[22] + " more", None, None]
    return own


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), *["c"] * len(CLASH)) for i, t in enumerate(texts)]
    rows += [(rows[25][0], rows[25][1], "en", "s", 1, *["d"] * len(CLASH)), (None, "no id", "en", "s", 1, *["e"] * len(CLASH))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- encoding, files, counts, pieces --------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_the_library_s(path, texts):
    e = encoding.Encoder(path)
    alphabet = [*" \n\n  abcéÉ'sre.,!3_\"", "é", " ", "日"]
    more = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(1500)]
    for t in [*filter(None, texts), *more]:
        assert e.ids(t).tolist() == e.library.encode(t, add_special_tokens=False).ids, t[:60]


def test_code_is_optimal_and_limited():
    counts = {i: int(1.7**i) + 1 for i in range(30)}
    free, tight = token_file.code_lengths(counts, 40), token_file.code_lengths(counts, 8)
    assert max(tight.values()) <= 8 and sum(2.0 ** -n for n in tight.values()) <= 1
    cost = lambda c: sum(counts[s] * n for s, n in c.items())
    assert cost(free) <= cost(tight) <= cost({s: 5 for s in counts})
    small = {0: 5, 1: 2, 2: 1, 3: 1, 4: 1}
    best = min(sum(small[s] * n for s, n in zip(small, lens, strict=True)) for lens in product((1, 2, 3), repeat=5) if sum(2.0 ** -n for n in lens) <= 1)
    assert sum(small[s] * n for s, n in token_file.code_lengths(small, 3).items()) == best
    assert token_file.code_lengths({}) == {} and token_file.code_lengths({9: 3}) == {9: 1}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    ids = np.array([min(int(rng.expovariate(0.01)), 3000) for _ in range(n)], np.uint16)
    code = token_file.Code(token_file.code_lengths(dict(zip(*np.unique(ids, return_counts=True), strict=True))))
    bits, checkpoints = code.encode(ids)
    assert (code.decode(bits, n, checkpoints) == ids).all()
    for first, count in ((0, 10), (300, 20), (n - 3, 3)):
        if 0 <= first < n:
            assert (code.decode_from(bits, n, checkpoints, first, count) == ids[first : first + count]).all()


def test_token_file(docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    spark = docs.sparkSession
    path = token_file.write_token_file(docs, BYTE, end_id=2, path=f"file://{tmp_path}/tokens")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file.digest_token_file(spark, path).collect())
    own = sorted(((-1 if d is None else d), library.encode(t, add_special_tokens=False).ids + [2]) for d, t in pairs(docs))
    at, want = 0, []
    for d, ids in own:
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    read = token_file.read_token_file(spark, path).orderBy("start").collect()
    assert [r["ids"] for r in read] == [ids for _, ids in own]
    empty = token_file.write_token_file(nothing, BYTE, end_id=2)
    assert token_file.digest_token_file(spark, empty).count() == 0


def test_token_file_is_read_from_its_files_alone(docs, tmp_path):
    import pyarrow.parquet as pq

    path = token_file.write_token_file(docs, BYTE, end_id=2, path=f"file://{tmp_path}/tokens")
    code = token_file.Code(dict(zip(*(pq.read_table(f"{tmp_path}/tokens/code")[c].to_pylist() for c in ("id", "length")), strict=True)))
    found = []
    for r in sorted(pq.read_table(f"{tmp_path}/tokens/blocks").to_pylist(), key=lambda r: (r["part"], r["block"])):
        assert r["start"] == sum(map(len, found))
        ids = code.decode(r["bits"], sum(r["n_ids"]), np.array(r["checkpoints"]))
        found += [x.tolist() for x in np.split(ids, np.cumsum(r["n_ids"])[:-1])]
    assert found == [r["ids"] for r in token_file.read_token_file(docs.sparkSession, path).orderBy("start").collect()]
    with pytest.raises(Exception):
        token_file.write_token_file(docs, BYTE, end_id=2, path=path)  # there is one


def test_token_file_with_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(token_file, "RANGE_BYTES", 1000)
    rows = [(None, sentence(12)) for _ in range(120)] + [(5, sentence(12)) for _ in range(80)] + [(i, sentence(3)) for i in range(4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_file.write_token_file(df, BYTE, end_id=2)
    got = token_file.read_token_file(spark, path).orderBy("start").collect()
    assert token_file.open_token_file(spark, path)[0].filter("doc_ids[0] is null").select("part").distinct().count() > 1
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    e = encoding.encoder(BYTE)
    assert sorted((d, r["ids"]) for d, r in zip(ids, got, strict=True)) == sorted((-1 if d is None else d, e.ids(t).tolist() + [2]) for d, t in rows)


def test_token_counts(docs, nothing):
    library = encoding.Encoder(WORD).library
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, WORD, 100).collect()}
    for d, t in pairs(docs):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[d, len(t.encode())] == (n, n > 100)
    assert token_counts.count_tokens(nothing, WORD).count() == 0


PREFIXED = ["I'll don't!!'re ab12 $%x <|endo", "Über straße naïve. Don't", "a  b\n c ", "é <|endoftext|> x", "", "a <|endoftext|> b", "hello\x1cworld", "don<|startoftext|>'re", "Kı̇ İx ΑΣ ﬁ Å",
            "日本語の テキスト123", "한국어 각", "x\ty\u00a0z\u2003'v 've '' 'll", "क्षत्रिय ก็ำ", "e\u0301\u0323<|endoftext|>\u0301e"]


def test_prefix_counts_answer_for_every_prefix():
    c = token_counts.counter(WORD)
    count = lambda t: len(c.encoder.library.encode(t, add_special_tokens=False).ids)
    alphabet = [*" \n\tabcéÉ'srevtmdl.,!3<|>", "e\u0301", "\u0301", "日", "\x1c", "\xa0", "İ", "Σ", "ß", "한", "ᄒ", "ᅡ", "ᆫ", "🙂", "<|endoftext|>", "½"]
    for t in [*PREFIXED, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(300))]:
        want = [count(t[:i]) for i in range(len(t) + 1)]
        assert c.prefix_counts(t).tolist() == want and c.count(t) == want[-1]
        for budget in (0, 3, 6):
            longest = max(i for i, n in enumerate(want) if n <= budget)
            assert c.truncated(t, budget) == longest and c.fitting(t, budget) == (want[-1], longest)


def test_long_texts_are_counted_in_one_pass():
    import time

    c, began = token_counts.counter(WORD), time.time()
    for t in ("a\tlong word's end " * 6000, "abcde" * 400, "日本語" * 2000):
        counts = c.prefix_counts(t)
        assert counts[-1] == len(c.encoder.library.encode(t, add_special_tokens=False).ids) and len(counts) == len(t) + 1
    assert time.time() - began < 20


def test_prefix_tables_fit_budgets(spark):
    own = [*PREFIXED, "the thing and the rest of it", None]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    c = token_counts.counter(WORD)
    tables = token_counts.prefix_tables(df, WORD).cache()
    for budget in (0, 3, 5):
        for r in token_counts.fits(tables, budget).collect():
            counts = c.prefix_counts(own[r["doc_id"]] or "")
            assert (r["n_tokens"], r["over_limit"], r["end"]) == (counts[-1], counts[-1] > budget, np.flatnonzero(counts <= budget)[-1])
    for length in (0, 1, 4):
        for r in token_counts.tokens_at(tables.withColumn("length", F.least(F.lit(length), "chars")), "length").collect():
            t = own[r["doc_id"]] or ""
            assert r["tokens"] == len(c.encoder.library.encode(t[:length], add_special_tokens=False).ids)


def test_prefix_coder_is_plain_merging():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("c", "c"): 3, ("cc", "a"): 4}
    rank = lambda a, b: ranks.get((a, b), math.inf)
    coder = bpe.PrefixCoder({"a", "b", "c", *("".join(p) for p in ranks)}, rank)
    for _ in range(400):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        last, count = coder.prefixes(w)
        for i in range(len(w) + 1):
            want = bpe.merged(list(w[:i]), rank)
            assert count[i] == len(want) and last[i] == (want[-1] if want else "")


def test_pieces_are_the_library_s(docs, nothing, texts):
    t = piece_transducer.transducer(PIECE)
    more = ["".join(rng.choice("  \n aabeth▁éあ.1,") for _ in range(30)) for _ in range(800)]
    for x in [*filter(None, texts), *more]:
        ids = t.encode(x)
        assert ids.tolist() == t.library.encode(x)
        assert t.decode(ids) == x.replace("▁", " ")
    got = piece_transducer.round_trips(docs, PIECE).collect()
    assert len(got) == docs.count() and all(r["same"] for r in got)
    back = piece_transducer.decode(piece_transducer.encode(docs, PIECE), PIECE)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((d or -1, x) for d, x in pairs(docs))
    assert piece_transducer.round_trips(nothing, PIECE).count() == 0


def test_long_runs_of_blanks():
    t = piece_transducer.transducer(PIECE)
    for x in (" " * 20_000 + "x", "a" + " " * 5_001, " " * 33):
        assert t.encode(x).tolist() == t.library.encode(x)


def test_each_place_has_one_finite_path():
    t = piece_transducer.transducer(PIECE)
    for word in ("▁transducer", "▁ñandúes", "▁日本x🙂", "▁1234"):
        reached = [{""}]
        for to in range(1, len(word) + 1):
            reached.append({word[k:to] for k in t.arcs(word, to) for before in reached[k] if t.weight(before, word[k:to]) == 0})
        assert all(len(x) == 1 for x in reached)


def test_unigram_paths_are_lightest():
    t = piece_transducer.transducer(PIECE)
    score, longest = t.score, t.longest
    try:
        t.score, t.longest = {"a": -3.0, "b": -3.0, "ab": -4.0, "aba": -9.0, "ba": -3.5}, 3
        assert t._lightest("aba") == ["a", "ba"] and t._lightest("abab") == ["ab", "ab"] and t._lightest("axb") == ["a", "x", "b"]
    finally:
        t.score, t.longest = score, longest


# --- packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("draw", [lambda: rng.randint(1, 99), lambda: rng.randint(30, 75), lambda: rng.choice([34, 33, 51, 49, 60])])
def test_local_search_never_loses(draw):
    lengths = [draw() for _ in range(400)]
    before = packing.best_fit(lengths, 100)
    after = packing.pack_lengths(lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert -(-sum(lengths) // 100) <= len(after) <= len(before)


def test_local_search_saves_a_bin():
    lengths = [60, 60, 45, 35, 40, 40, 20]
    start = [[0, 3], [1, 6], [2, 4], [5]]
    assert len(packing.improve(start, lengths, 100)) == 3


def gaining(bins, lengths, capacity):
    """Whether a move, a one-for-one or a two-for-one exchange of two bins raises the squared fill."""
    held = [sorted(lengths[i] for i in b) for b in bins]
    kinds = {(sum(h), tuple(h)): min(2, held.count(h)) for h in held if sum(h) < capacity}
    for s, t in product(kinds, kinds):
        outs = [*s[1], *map(sum, combinations(s[1], 2))] if s != t or kinds[s] > 1 else []
        for k, out in enumerate(outs):
            for back in t[1] if k >= len(s[1]) else (0, *t[1]):
                gain = out - back
                if 0 < gain <= capacity - t[0] and t[0] + gain > s[0]:
                    return True
    return False


def test_local_search_ends_where_nothing_gains():
    lengths = [n for n, k in ((900, 500), (800, 500), (700, 500), (600, 500), (548, 1000)) for _ in range(k)]
    before, after = packing.best_fit(lengths, 2048), packing.pack_lengths(lengths, 2048)
    assert sorted(i for b in after for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in after)
    assert len(after) < len(before) == 1167 and (not gaining(after, lengths, 2048) or len(after) == -(-sum(lengths) // 2048))
    draw = random.Random(5)
    for low, high in ((200, 900), (500, 1000), (1, 2000)):
        lengths = [draw.randint(low, high) for _ in range(150)]
        after = packing.pack_lengths(lengths, 2048)
        assert sorted(i for b in after for i in b) == list(range(150)) and all(sum(lengths[i] for i in b) <= 2048 for b in after)
        assert not gaining(after, lengths, 2048) or len(after) == -(-sum(lengths) // 2048)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    found = packing.pieces(docs, WORD, end_id=0, capacity=128)
    got = packing.pack(found, 128, group_pieces=40).collect()
    want = [(d or -1, k, s, len(x[s : s + 128]), crc(x[s : s + 128])) for d, t in pairs(docs) for x in [library.encode(t, add_special_tokens=False).ids + [0]] for k, s in enumerate(range(0, len(x), 128))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(packing.pieces(nothing, WORD, end_id=0), 2048).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(i, sentence(20)) for i in range(12)], "doc_id long, text string")
    made = packing.pack(packing.pieces(df, WORD, 0, 64), 64)
    got = packing.sequences(made, packing.pieces(df, WORD, 0, 64, with_ids=True)).collect()
    assert sum(r["length"] for r in got) == made.agg(F.sum("length")).first()[0] and all(r["length"] == len(r["ids"]) <= 64 for r in got)


# --- duplicates -----------------------------------------------------------------------------------------------------


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_perfect_hash_is_minimal_and_checked():
    own = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    shard = exact_dedup.Shard(own, list(range(3000)), [1] * 3000)
    slots = shard.find(own)
    assert sorted(slots.tolist()) == list(range(3000)) and [shard.keep[s] for s in slots] == list(range(3000))
    assert (shard.find([hashlib.sha256(f"x{i}".encode()).digest() for i in range(3000)]) == -1).all()
    assert exact_dedup.Shard([], [], []).find(own[:3]).tolist() == [-1] * 3


def test_exact_dedup(docs, nothing):
    got = exact_dedup.dedup(docs).collect()
    groups = {}
    for d, t in pairs(docs):
        groups.setdefault(lowered(t), []).append(d)
    want = []
    for t, ds in groups.items():
        keep = max((d for d in ds if d is not None), default=None)
        kept = False
        for d in sorted(ds, key=lambda d: (d is None, d)):
            want.append((d or -1, keep or -1, len(ds), d == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept = kept or d == keep
    key = lambda r: (r[4], r[0], not r[3])
    assert sorted(((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    kept = exact_dedup.kept_rows(docs, exact_dedup.dedup(docs))
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {lowered(r["text"] or "") for r in kept.select("text").collect()} == set(groups)
    assert exact_dedup.dedup(nothing).count() == 0 and exact_dedup.kept_rows(nothing, exact_dedup.dedup(nothing)).count() == 0


def test_history_takes_part(spark):
    new = spark.createDataFrame([(5, "a"), (6, "B")], "doc_id long, text string")
    old = exact_dedup.digests(spark.createDataFrame([(1, "A"), (9, "b")], "doc_id long, text string"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(new, history=old).collect()}
    assert got == {5: (5, 2, True), 6: (9, 2, False)}


def reached(links, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed = changed or least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components(spark):
    n = 120
    links = [(i, i + 1) for i in range(0, 40)] + [(50, i) for i in range(60, 90)] + [(rng.randint(0, n), rng.randint(0, n)) for _ in range(20)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reached(links, range(n + 1))
    assert got == {x: want[x] for p in links for x in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, nothing):
    got = simhash.near_groups(docs).select("doc_id", simhash.hex_of().alias("f"), "component_id").collect()
    own = [(d, slow_fingerprint(t)) for d, t in pairs(docs)]
    assert sorted((r["doc_id"] or -1, r["f"]) for r in got) == sorted((d or -1, f"{f:016x}") for d, f in own)
    ids = sorted({d for d, _ in own if d is not None})
    links = [(a, b) for (a, x), (b, y) in combinations(own, 2) if a is not None and b is not None and (x ^ y).bit_count() <= 4]
    want = reached(links, ids)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    left = simhash.first_of_groups(docs, simhash.near_groups(docs))
    assert left.columns == docs.columns and left.filter("doc_id is not null").select("doc_id").distinct().count() == len(set(want.values()))
    assert simhash.near_groups(nothing).count() == 0


@pytest.mark.parametrize("hot", [2_000, 8])
def test_simhash_links_lose_none(spark, hot):
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(70)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    found = {(r["a"], r["b"]) for r in simhash.links(df, hot=hot).collect()}
    every = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert reached(found, range(len(fps))) == reached(every, range(len(fps)))


def test_masks_cover_the_radius():
    for n in (10, 10**6, 10**9, 10**11):
        chosen = simhash.masks(n)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in chosen)
            m = next(m for m in chosen if not d & m)
            assert any(not d & x for x in simhash.refined(m))


def test_line_dedup(spark):
    base = [sentence(9) for _ in range(25)]
    near = [b[:7] + rng.choice(["", "#", b[7] + "#"]) + b[8:] for b in base]
    two = [b[:5] + "##" + b[5:] for b in base]
    rows = [(i, "\n".join(rng.sample([*base, *near, *two], 6) + ["", "Von.", "Vos."])) for i in range(20)] + [(None, base[0]), (21, None), (22, base[1] + "\n" + base[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda d: (d is not None, d or 0)
    lines = sorted(((order(d), k), l.strip()) for d, t in rows for k, l in enumerate((t or "").split("\n")))

    def within_one(a, b):
        if a == b or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 20:
            return a == b
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]

    gone = {at for i, (at, l) in enumerate(lines) if l and any(m and within_one(l, m) for _, m in lines[:i])}
    got = {(order(None if r["doc_id"] == line_dedup._NO_ID else r["doc_id"]), r["line"]) for r in line_dedup.repeats(df).collect()}
    assert got == gone
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in rows:
        kept = [l for k, l in enumerate((t or "").split("\n")) if (order(d), k) not in gone]
        assert out[d]["text"] == "\n".join(kept) and out[d]["_lines"] - out[d]["_dropped"] == len(kept)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rows_with_one_id_lose_their_own_lines_only(spark):
    x, y, z, w = "the line that is repeated", "only the first row has this", "only the second row has this", "a line with its own words here"
    rows = [(None, f"{x}\n{y}"), (None, f"{z}\n{x}"), (None, f"{w}\n{w}"), (7, f"{y}\nseven has this line alone"), (7, f"a text of seven's other row\n{z}#"), (7, f"{w[:-1]}\nthe third row of seven stays")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([f"{x}\n{y}", z, w, "seven has this line alone", "a text of seven's other row", "the third row of seven stays"])


def test_line_dedup_on_odd_rows(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_dropped", "_near"] and out.count() == docs.count()


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    rows = []
    for i in range(300):
        v = base[i % 30] + r.normal(size=16) * (0.05 if i % 2 else 0.4)
        rows.append((i, [float(x) for x in (v * r.uniform(0.1, 9))], int(i % 3)))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], None), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1), (305, [1.0, None], 1), (306, [1.0, 0.0], 1), (307, [2.0, 0.0], 1), (308, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("weight", F.lit(1))
    for tile in (1500, 7):
        got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embed_dedup.near_vectors(df, 0.98, tile=tile).collect()}
        ok = {i: np.array(v) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
        label = {i: l for i, _, l in rows}
        links = [(a, b) for a, b in combinations(sorted(ok), 2) if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98]
        least = reached(links, label)
        want = {i: (sum(i in p for p in links), least[i], least[i] == i) for i in label}
        assert got == want
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


# --- licences and toxicity ------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, nothing):
    mit, apache = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["apache-2.0"]
    changed = " ".join(w for i, w in enumerate(apache.split()) if i % 30)
    rows = [(1, f"{sentence(40)}\n{mit.upper()}\n{sentence(30)}"), (2, f"{sentence(700)} {changed}"), (3, "Released under\n the  MIT License."), (4, sentence(50)), (5, ""), (6, None), (7, "Licensed under the Apache License"), (8, f"{mit} {mit}"), (9, "Permission is hereby granted")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(df).collect()}
    assert got == {(d, k) for d, t in rows for k in license_scan.brute(t)}
    assert {(1, "mit"), (3, "mit-line"), (8, "mit")} <= got and not {d for d, _ in got} & {4, 5, 6, 9}
    plan = license_scan.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(nothing).count() == 0
    assert license_scan.scan(df, {"none": "too short"}).count() == 0


def test_automaton_is_edit_distance():
    def distance(a, b):  # with swaps of neighbours
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["idiot", "scum", "pathetic", "disgusting", "loser", "idiots"]
    auto = toxicity.Automaton(terms, [])
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w)) if w else 0
                k = rng.randrange(4)
                if k == 0 and w:
                    del w[i]
                elif k == 1:
                    w.insert(i, rng.choice("aeiot"))
                elif k == 2 and w:
                    w[i] = rng.choice("aeiot")
                elif len(w) > i + 1:
                    w[i], w[i + 1] = w[i + 1], w[i]
            word = "".join(w)
            near = min((distance(word, x), x) for x in terms if distance(word, x) <= toxicity.bound(x)) if any(distance(word, x) <= toxicity.bound(x) for x in terms) else None
            got = auto.look(word)
            assert (got is None) == (near is None) and (got is None or got[1] == near[0]), word
    assert toxicity.Automaton([], ["vequ"]).look("vequaire") == ("vequ", 0) and toxicity.Automaton([], ["vequ"]).look("vxquaire") is None


def test_context_tells_quotation_from_abuse():
    s = toxicity.Scorer(toxicity.Model({"idiot": 6.0, "moron": 6.0}, base=-4.0, slope=1.2))
    plain, near = s.score("you are an idiot and more"), s.score("you are an idoit and more")
    quoted, told = s.score('the note had "you idiot there" in it'), s.score("someone was called idiot by them")
    assert plain > near > 0.5 > quoted and told < 0.5 and s.score("") == s.score("a calm text") < 0.5
    assert s.score("id1ot") > 0.5 > s.score("idyllic")


def test_toxicity_is_learned(spark, nothing):
    bad = ["grubvex", "snarlop", "blorpid"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1 if toxic else 0))
    rows += [(600, "an grubvx here", "x"), (601, None, "x"), (602, "", "x"), (None, "grubvex", "x")]
    labels += [(5, None), (None, 1), (0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _toxic string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(bad) <= set(model.weights)
    got = {r["doc_id"]: r for r in toxicity.scores(df, model).collect()}
    truth = dict(labels[:600])
    held = [r for d, r in got.items() if d is not None and d < 600 and r["held_out"]]
    assert len(held) > 80 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert got[600]["predicted"] == 1 and got[601]["score"] == got[602]["score"] < 0.5 and got[None]["predicted"] == 1
    left = toxicity.without_toxic(df, model)
    assert left.columns == df.columns and left.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.scores(nothing, toxicity.Model()).count() == 0
    assert toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def five_words(t):
    words = t.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("few", [24, 2])
def test_near_texts_lose_no_pair(spark, few):
    from factloom.llm import near_text

    draw = random.Random(3)
    own = []
    for n in [30, 60, 200] * 5:
        base = [draw.choice(WORDS) + str(draw.randrange(99)) for _ in range(n)]
        for _ in range(8):
            words = list(base)
            for _ in range(draw.randint(0, n // 40 + 1)):
                words[draw.randrange(n)] = "changed" + str(draw.randrange(99))
            own.append((" ".join(words) + " a passage that many of these texts have in common word for word"))
    own += ["", " ", "a b", "A b", "one two three four five", "one two three four five six"]
    rows = [(i, t) for i, t in enumerate(own)] + [(3, "another text with a doc_id that is a copy's, which stays"), (None, own[0]), (None, None)]
    sets = [five_words(t) for t in own]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    linked = [(i, j) for i, j in combinations(range(len(own)), 2) if alike(sets[i], sets[j])]
    bits = [slow_fingerprint(t) for t in own]
    assert sum((bits[i] ^ bits[j]).bit_count() > 4 for i, j in linked) > 20  # these pass a radius of 4
    least = reached(linked, range(len(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_text.first_of_groups(df, few=few)
    assert got.columns == df.columns
    want = [(i, own[i]) for i in range(len(own)) if least[i] == i] + rows[-3:]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert near_text.first_of_groups(df.limit(0)).count() == 0


def test_a_clean_near_form_is_exempt_by_itself(spark):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(30)]
        words[draw.randrange(30)] = "grubvex" if i % 6 == 0 else "rubvex" if i % 6 == 1 else "calm"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    model.stems = []  # near forms only
    model.weights = {"grubvex": 6.0}
    s = toxicity.Scorer(model)
    assert s.evidence("a rubvex") == 0 < s.evidence("a grubbvex") < s.evidence("a grubvex")


# --- queries and pipeline -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = c.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    own = [(r["doc_id"], r["text"]) for r in docs.collect() if scorer.score(r["text"]) < 0.5]
    groups = {}
    for d, t in own:
        groups.setdefault(lowered(t), []).append(d)
    own = [(max(ds), t) for t, ds in groups.items()]
    sets = [(d, five_words(t)) for d, t in own]
    near = lambda x, y: (x | y and 5 * len(x & y) >= 4 * len(x | y)) or not x | y  # noqa: E731  # similarity of 0.8 or more
    least = reached([(a, b) for (a, x), (b, y) in combinations(sets, 2) if near(x, y)], [d for d, _ in sets])
    got = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == set(least.values())
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


# --- every registered query against brute force ----------------------------------------------------------------------


def slow_lines(rows):
    """(text, n_lines, n_dropped, n_near) of rows (doc_id, text) with distinct ids, by comparing all lines."""
    def near(a, b):
        if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]

    first, by_half, out = {}, {}, {}
    for d, t in sorted(rows):
        kept, gone, close = [], 0, 0
        for k, raw in enumerate((t or "").split("\n")):
            line = raw.strip()
            if not line:
                kept.append(raw)
                continue
            halves = [("<", line[: len(line) // 2]), ("<", line[: (len(line) - 1) // 2]), (">", line[len(line) - (len(line) - len(line) // 2) :]), (">", line[len(line) - (len(line) - 1 - (len(line) - 1) // 2) :])]
            if line in first:
                gone += 1
                close += first[line]
                continue
            first[line] = any(near(line, other) for h in halves for other in by_half.get(h, ()))
            for h in halves:
                by_half.setdefault(h, []).append(line)
            if first[line]:
                gone, close = gone + 1, close + 1
            else:
                kept.append(raw)
        out[d] = ("\n".join(kept), len((t or "").split("\n")), gone, close)
    return out


@pytest.fixture(scope="module")
def whole(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_query_op1(spark, sf, whole):
    library, at, want = encoding.Encoder(BYTE).library, 0, {}
    for d, t in sorted(whole):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op1_token_file"](spark, sf).collect()} == want


def test_query_op2(spark, sf, whole):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_toxicity"](spark, sf).collect()}
    assert set(got) == {d for d, _ in whole} and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    lexicon = [t for t in model.weights if t not in model.stems]

    def distance(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    def slow_score(t):  # each word against each term
        chunks, total = t.split(), 0.0
        quoted = toxicity.quoted_chunks(t)
        for i, c in enumerate(chunks):
            best = 0.0
            for w in toxicity.words_of(c):
                stem = next((s for s in sorted(model.stems, key=len) if w.startswith(s)), None)
                near = [(distance(w, x), x) for x in lexicon if abs(len(w) - len(x)) <= toxicity.bound(x)]
                hit = (0, stem) if stem else min(((n, x) for n, x in near if n <= toxicity.bound(x)), default=None)
                if hit and w not in model.exempt:
                    best = max(best, model.weights[hit[1]] * (toxicity.NEAR if hit[0] else 1.0))
            told = i in quoted or any(w in toxicity.REPORTING for x in chunks[max(0, i - 3) : i] for w in toxicity.words_of(x))
            total += best * (toxicity.QUOTED if told else 1.0)
        return 1 / (1 + math.exp(-(model.base + model.slope * min(total, toxicity.CAP))))

    for d, t in sorted(whole, key=lambda r: len(r[1] or ""))[:60]:
        assert got[d]["score"] == pytest.approx(slow_score(t or ""), abs=1e-9)


def test_query_op3(spark, sf, whole):
    library = encoding.Encoder(WORD).library
    got = queries.QUERIES["op3_packing"](spark, sf).collect()
    want = [(d, k, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for d, t in whole for x in [library.encode(t or "", add_special_tokens=False).ids + [0]] for k, s in enumerate(range(0, len(x), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1].tolist()] for b in bins.values())
    lengths = [w[3] for w in want]
    # pieces longer than half a sequence can't share one; what is too long to stand beside piece k can't take it in
    need = max(sum(n > 2048 - k for n in lengths) + max(sum(2048 - k >= n > 1024 for n in lengths), -(-sum(n for n in lengths if k <= n <= 2048 - k) // 2048)) for k in range(1025))
    assert need <= len(bins) <= need + 1


def test_query_op4(spark, sf, whole):
    library = piece_transducer.transducer(PIECE).library
    want = {d: (len(x), crc(x)) for d, t in whole for x in [library.encode(t or "")]}
    got = queries.QUERIES["op4_sentencepiece"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_pieces"], r["ids_crc32"]) for r in got} == want and all(r["same"] for r in got)


def test_query_op5(spark, sf, whole):
    fps = {d: slow_fingerprint(t or "") for d, t in whole}
    least = reached([(a, b) for (a, x), (b, y) in combinations(fps.items(), 2) if (x ^ y).bit_count() <= 4], fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op5_simhash"](spark, sf).collect()} == {d: (f"{f:016x}", least[d]) for d, f in fps.items()}


def test_query_op6(spark, sf, whole):
    library = encoding.Encoder(WORD).library
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_token_counts"](spark, sf).collect()}
    for d, t in whole:
        t, r = t or "", got[d]
        n = count(t)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
        end = r["fit_chars"]
        assert end == len(t) if n <= 2048 else count(t[:end]) <= 2048 < min(count(t[:k]) for k in range(end + 1, end + 30))


def test_query_op7(spark, sf, whole):
    got = {(r["doc_id"], r["license"]): r["containment"] for r in queries.QUERIES["op7_license_scan"](spark, sf).collect()}
    want = {(d, k): c for d, t in whole for k, c in license_scan.brute(t).items()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in got)


def test_query_op8(spark, sf, whole):
    want = {d: (n, gone, near, hashlib.sha256(t.encode()).hexdigest()) for d, (t, n, gone, near) in slow_lines(whole).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_near"], r["text_sha256"]) for r in queries.QUERIES["op8_line_dedup"](spark, sf).collect()} == want


def test_a_star_of_many_leaves(spark):
    own = spark.range(1, 100_001).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, 0).otherwise(200_000).cast("long").alias("b"))
    joint = own.unionAll(spark.createDataFrame([(200_000, 300_000), (300_000, 4)], "a long, b long"))
    got = components.components(joint)
    assert got.count() == 100_003 and got.select("component").distinct().collect()[0][0] == 0


def test_packing_against_the_optimum():
    draw = random.Random(2)

    def optimum(lens, capacity):
        n = len(lens)
        total = [0] * (1 << n)
        for m in range(1, 1 << n):
            total[m] = total[m & (m - 1)] + lens[(m & -m).bit_length() - 1]
        best = [0] * (1 << n)
        for m in range(1, 1 << n):
            low = m & -m
            rest, sub, best[m] = m ^ low, m ^ low, n
            while True:
                if total[sub | low] <= capacity:
                    best[m] = min(best[m], 1 + best[m ^ low ^ sub])
                if not sub:
                    break
                sub = (sub - 1) & rest
        return best[-1]

    sums = np.zeros(3, int)
    for _ in range(25):
        lens = [draw.randint(15, 60) for _ in range(9)]
        sums += [optimum(lens, 100), len(packing.pack_lengths(lens, 100)), len(packing.best_fit(lens, 100))]
    assert sums[0] == sums[1] <= sums[2]


def test_kicks_free_large_pieces():
    draw = random.Random(4)
    lengths = [draw.choice([draw.randint(1, 400), draw.randint(900, 1400)]) for _ in range(3000)]
    start = packing.best_fit(lengths, 2048, as_given=True)
    searched = packing.improve(start, lengths, 2048)
    after = packing.pack_lengths(lengths, 2048)
    assert len(after) <= len(searched) < len(start) and sorted(i for b in after for i in b) == list(range(3000))


def test_rows_of_one_id_have_their_own_windows(spark):
    mit = license_scan.TEMPLATES["mit"]
    part = " ".join(mit.split()[: int(len(mit.split()) * 0.6)])
    for rows in ([(None, part), (None, mit)], [(None, mit), (None, part)], [(4, part), (4, mit)]):
        got = [(r["doc_id"], r["license"], r["containment"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
        assert got == [(rows[0][0], "mit", 1.0)]


def test_line_counts_with_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one line of text that repeats\n\nx", "a"), (1, "one line of text that repeats\n\nx", "b"), (None, "q", "c"), (None, "q", "d"), (2, "x\ny", "e")], "doc_id long, text string, _lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_lines", "_lines_", "_dropped", "_near"]
    got = sorted((r["doc_id"] or 0, r["text"], r["_dropped"]) for r in out.collect())
    assert got == sorted([(0, "q", 0), (0, "", 1), (1, "one line of text that repeats\n\nx", 0), (1, "", 2), (2, "y", 1)])
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, counts=("_LINES", "a", "b"))


def test_short_lines_can_have_a_bound_too(spark):
    df = spark.createDataFrame([(1, "abc\nabd\nxyz"), (2, "ab\nxy\nq")], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup_lines(df, min_chars=0).orderBy("doc_id").collect()] == ["abc\nxyz", "q"]
    assert [r["text"] for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()] == ["abc\nabd\nxyz", "ab\nxy\nq"]


def test_vectors_without_an_id_count(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 2)]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(-1, 1, 5), (5, 1, 5), (-1, 0, -1), (-1, 0, -1)])


def test_grids_of_any_number_of_axes_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(12, 8))
    x = [(base[i % 12] + draw.normal(size=8) * 0.08).tolist() for i in range(240)]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in combinations(range(240), 2) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.98]
    least, n = reached(links, range(240)), np.bincount(np.array(links).reshape(-1), minlength=240)
    for axes in (1, 2, 4):
        monkeypatch.setattr(embed_dedup, "_cheapest", lambda *_: axes)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df, tile=40).collect()} == {i: (n[i], least[i]) for i in range(240)}


def test_marks_are_paired_by_place():
    s = toxicity.Scorer(toxicity.Model({"idiot": 6.0}, base=-4.0, slope=1.2))
    assert all(s.score(t) > 0.5 for t in ('"Hi" idiot "bye"', "in other words you idiot", 'a " stray and idiot', "don’t be an idiot, it’s late", 'he sat "\nidiot "'))
    assert all(s.score(t) < 0.5 for t in ('he wrote "what an idiot" there', "« idiot »", "a “total idiot” he"))


def test_signatures_discard_no_similar_pair():
    from factloom.llm import near_text

    draw = np.random.default_rng(6)
    for _ in range(200):
        a = draw.integers(-(2**62), 2**62, draw.integers(0, 600))
        b = np.concatenate([a[draw.random(len(a)) < draw.uniform(0.5, 1)], draw.integers(-(2**62), 2**62, draw.integers(0, 80))])
        ok = near_text.may_be_similar([near_text.signature(a)], [near_text.signature(b)], 0.8)[0]
        both = len(np.intersect1d(a, b))
        assert ok or both / max(1, len(a) + len(b) - both) < 0.8
    many = np.arange(300 * 512)
    assert near_text.signature(many) == b"" and near_text.may_be_similar([b""], [near_text.signature(many[:9])], 0.8)[0]
    assert not near_text.may_be_similar([near_text.signature(many[:300])], [near_text.signature(many[300:600])], 0.8)[0]


def test_rows_without_an_id_link_fingerprints(spark):
    """A (1), B (null), C (2), with A and B, B and C near, A and C not: one component. And null rows alone, and near each other."""
    draw = random.Random(12)
    base, chains = " ".join(draw.choice(WORDS) for _ in range(300)), []
    while len(chains) < 3:
        words = base.split()
        texts = [base]
        for _ in range(2):
            words = [*words]
            words[draw.randrange(len(words))] = draw.choice(WORDS)
            texts.append(" ".join(words))
        a, b, c = (slow_fingerprint(t) for t in texts)
        if 0 < (a ^ b).bit_count() <= 4 and 0 < (b ^ c).bit_count() <= 4 < (a ^ c).bit_count():
            chains.append(texts)
        base = " ".join(draw.choice(WORDS) for _ in range(300)) if draw.random() < 0.2 else base
    rows = [(1, chains[0][0]), (None, chains[0][1]), (2, chains[0][2]), (None, None), (None, "alone " + LONG[:400])]
    rows += [(None, chains[1][0]), (None, chains[1][1]), (9, chains[1][2])] + [(None, t.upper() + " q w e r t z u i") for t in chains[2]]
    fps = [slow_fingerprint(t or "") for _, t in rows]
    least = reached([(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(rows)))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[least[i]] = min(d, ids.get(least[i], d))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda d, f, c: (d or 0, f % (1 << 64), c or 0)
    assert sorted(key(r["doc_id"], r["fp"], r["component_id"]) for r in got) == sorted(key(d, fps[i], ids.get(least[i])) for i, (d, _) in enumerate(rows))


def test_texts_with_a_common_passage_are_few_candidates(spark, monkeypatch):
    from factloom.llm import near_text

    passage = " ".join(f"w{i}" for i in range(85))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(15))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(40)]  # near copies of the first
    seen, put = [], near_text.written
    monkeypatch.setattr(near_text, "written", lambda df, name, *a, **k: [t := put(df, name, *a, **k), seen.append(t.count()) if name == "pairs" else None][0])
    got = near_text.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(300)) and sum(seen) < 3_000
