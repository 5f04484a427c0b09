"""Periodic runs of words: stretches that repeat with a smallest period, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, EXPONENT * q) that no neighbouring
word extends keeping period q. Each is found once, as follows. The automaton's states are taken in order of falling length, and each
hands the ordered set of its end positions to its link, the smaller set going into the larger. Where that makes two positions a and b
new neighbours at a state of length n, n is the longest suffix that the texts ending at a and b share. With d = b - a <= n the two
occurrences overlap or touch: a square of period d, whose extension to the left is the state's length itself. To the right it goes on
while words d apart are equal; only the seed at the run's last word is taken (the word behind b differs from the one behind a), as the
run's other seeds lead there. d is the smallest period, as with a smaller one another end would lie between. So a run of length n + d
comes from one seed, without reading it again.

Before that, stretches that can't hold a run are passed over: each SPAN words of a run stand in the text again, so hashes of all
SPAN words, sorted, leave maximal stretches of such repeats. A hash may say too much, never too little. For exponents below 3 that
doesn't hold and all words go to the automaton. A state keeps only ends of at least the length that the shortest run needs.

Words are what lies between ASCII white space (blank, 09 to 0D). Nulls: a null text is an empty one, without words and runs; other
columns pass through, whatever their names. Repeated rows are taken one by one. Empty table: no row. A text takes memory for two
states a word of its longest stretch with repeats, and n log n set operations.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship, text_of, unused

LEAST, EXPONENT = 24, 3
Run = tuple[int, int, int]  # start, length, period
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class _Automaton:
    """The suffix automaton of a sequence: for each state its length, link and, for prefixes, where they end."""

    def __init__(self, words: Sequence):
        length, link, after, ends = [0], [-1], [{}], [-1]
        last = 0
        for i, w in enumerate(words):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            after.append({})
            ends.append(i)
            at = last
            while at >= 0 and w not in after[at]:
                after[at][w] = new
                at = link[at]
            if at >= 0:
                to = after[at][w]
                if length[to] != length[at] + 1:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    after.append(after[to].copy())
                    ends.append(-1)
                    link[to] = twin
                    while at >= 0 and after[at].get(w) == to:
                        after[at][w] = twin
                        at = link[at]
                    to = twin
                link[new] = to
            last = new
        self.length, self.link, self.ends = length, link, ends


def _merged(a: list[int], b: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered sets as one, and the pairs of new neighbours. The smaller goes into the larger."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) * 8 > len(a):
        a = sorted(a + b)
    else:
        for x in b:
            insort(a, x)
    pairs = []
    for k, x in enumerate(b):
        i = bisect_left(a, x)
        if i and (k == 0 or a[i - 1] != b[k - 1]):
            pairs.append((a[i - 1], x))
        if i + 1 < len(a) and (k + 1 == len(b) or a[i + 1] != b[k + 1]):
            pairs.append((x, a[i + 1]))
    return a, pairs


def automaton_runs(words: Sequence, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of a sequence, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has an exponent of two or more")
    found: list[Run] = []
    shared = -(-least * (exponent - 1) // exponent)  # what a run has beside one period, at least
    auto = _Automaton(words)
    length, link = auto.length, auto.link
    # ordered ends, negated: a prefix's own end is the first one of its state, so it comes last
    sets: list[list[int] | None] = [None] * len(length)

    def seed(behind: int, ahead: int, common: int) -> None:
        a, b = -ahead, -behind
        d = b - a
        if d * (exponent - 1) <= common and common + d >= least and (b + 1 == len(words) or words[a + 1] != words[b + 1]):
            found.append((a - common + 1, common + d, d))

    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        if length[state] < shared:
            break
        own, sets[state] = sets[state] or [], None
        if (end := auto.ends[state]) >= 0:
            if own:
                seed(own[-1], -end, length[state])
            own.append(-end)
        to = link[state]
        if length[to] >= shared:
            if sets[to] is None:
                sets[to] = own
            else:
                sets[to], pairs = _merged(sets[to], own)
                for x, y in pairs:
                    seed(x, y, length[to])
    return sorted(found, key=lambda r: (r[0], r[2]))


def _span(least: int, exponent: int) -> int:
    """The number of words whose repeats a run can't be without: all of its spans stand in it again if 2 q + span - 1 words always fit."""
    most = (least + 5) // 3 if exponent >= 3 else 0
    return 1 << (most.bit_length() - 1) if most >= 2 else 0


def stretches(words: Sequence[bytes], least: int, exponent: int) -> list[tuple[int, int]]:
    """Where runs can lie: maximal stretches [start, end) of words whose spans all stand in the text more than once."""
    span, n = _span(least, exponent), len(words)
    if n < least:
        return []
    if not span:
        return [(0, n)]
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    width = 1
    while width < span:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-width] >> np.uint64(29)) ^ (h[width:] * np.uint64(0xC2B2AE3D27D4EB4F))
        width *= 2
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(h) + 2, np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edges = np.flatnonzero(np.diff(twice))
    return [(a, b + span - 1) for a, b in edges.reshape(-1, 2).tolist() if b - a + span - 1 >= least]


def runs(words: Sequence[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    found = [(a + s, n, q) for a, b in stretches(words, least, exponent) for s, n, q in automaton_runs(words[a:b], least, exponent)]
    # a run that a stretch's end cuts off is shorter than `least`, so each is whole here
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period, exactly; of equals the first, then the one of the smallest period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: Sequence[bytes], found: list[Run]) -> bytes:
    """The words that no run holds behind its first period, with a blank between."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


COLUMNS = ("n_words", "runs", "strongest", "collapsed")


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with four columns more: n_words (long), runs (array of start, length, period, by start, then period), strongest (one of them,
    or null) and collapsed (the text without repeated periods). Underscores are put behind names that docs has."""
    ship(docs.sparkSession)
    names = [unused(docs, c) for c in COLUMNS]
    frame = docs.select(*(docs[c] for c in docs.columns), text_of(docs, text).alias(unused(docs, "_text")))
    kinds = [T.LongType(), T.ArrayType(RUN, False), RUN, T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k, c == "strongest") for n, k, c in zip(names, kinds, COLUMNS, strict=True))])
    struct = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def as_struct(r: Run) -> dict:
            return dict(zip(RUN.names, r, strict=True))

        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                words = t.split()  # bytes are split at just these six characters
                found = runs(words, least, exponent)
                best = strongest(found)
                rows.append((len(words), [as_struct(r) for r in found], best and as_struct(best), collapsed(words, found)))
            own = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.list_(pa.field("element", struct, nullable=False)), struct, pa.binary()))]
            own[3] = own[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], *names])

    return frame.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs in which a tenth of the texts go over into a period: with h = crc32 of the key in digits, a multiple of 10, and g = h / 10,
    words from number g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them. A null key plants nothing."""
    words = F.filter(F.split(text_of(docs, text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(docs[key].cast("string").cast("binary"))

    def changed(w: Column) -> Column:  # w is bound once, see below
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        many = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(many, F.lit(1), (n - a).cast("int"))), " ")

    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(F.lit("")))[0]
    return docs.withColumn(text, F.when(h % 10 == 0, planted).otherwise(docs[text]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of documents."""
    found = find_runs(docs.select("doc_id", "text"))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
