"""Toxicity by a learned lexicon: Levenshtein automata intersected with a trie, and context windows.

Learning (fit): labelled rows, at most SAMPLE of them chosen by a hash of doc_id, give for each word and each stem (a word's
first 4 to 6 letters) the toxic and the clean texts that hold it. Terms are chosen that hardly ever occur in clean texts, until
each toxic text of the sample holds COVER of them or no term gains LEAST texts that aren't copies of each other; a stem that
one longer term nearly always continues gives way to it. A term is a word of three letters or more. The bound on the sample is the
only one, and it bounds the lexicon: at most COVER * SAMPLE / LEAST terms, and the near forms that the sample holds.

Scanning: the terms stand in a trie. Levenshtein automata of all terms, run along the trie, are made deterministic as words
ask for it, so a word costs one step a letter and most words end in the dead state after a few. Words of 5 to 7 letters are
found at one edit (a swap of neighbours counts as one), from 8 letters on at two; stems and shorter words as they are. Near
forms that clean texts of the sample hold are exempt, each by itself; the term's other near forms are still found.

Scoring: a hit counts its term's weight, near forms NEAR of it. A hit between a pair of quotation marks that are no more than WINDOW
words before and behind it, or up to three words behind a verb of reporting, is a quotation, which counts QUOTED of it. Marks are
paired from the beginning of each line, so a mark that stands alone quotes nothing. The sum goes through a logistic curve that is
fitted on the sample.

Nulls: a null text is an empty one; empty texts get the score of no hit; a null doc_id is kept and never learned from; labels
with null doc_id or toxic are left out, and of several labels for a doc_id, or for one text, the largest counts. Repeated rows are scored one by
one. Without a toxic and a clean labelled row there is no term and the score is the curve's at no hit. Other columns are never
read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, text_of, written
from .encoding import _Kept

SAMPLE, COVER, LEAST = 20_000, 4, 3
#: Evidence from which on more makes no difference.
CAP = 8.0
NEAR, QUOTED, WINDOW = 0.7, 0.25, 6
STEMS = (4, 5, 6)
#: Verbs that report what someone else said.
REPORTING = frozenset("said says quote quoted quotes quoting called calls wrote writes reported cited dit dijo sagte".split())
#: What closes each opening quotation mark. An apostrophe closes nothing but its like.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
_LINE = re.compile(r"[^\n]+")
_CHUNK = re.compile(r"\S+")
_WORD = re.compile(r"[\w@$*!|]+")
_EDGE = "_@$*!|"
CACHE = 700_000


def words_of(chunk: str) -> list[str]:
    """Lower-case words of a chunk; signs that stand for letters stay inside of a word."""
    return [w for x in _WORD.findall(chunk.lower()) if (w := x.strip(_EDGE))]


# --- automaton ------------------------------------------------------------------------------------------------------


def bound(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """The words within each term's bound, and the words that begin with a stem. look(word) -> (term, edits) or None."""

    STATES = 100_000

    def __init__(self, terms: list[str], stems: list[str]):
        self.bound = {t: bound(t) for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.terms: dict[int, str] = {}
        self.stems: dict[int, str] = {}
        self.reach = [0]  # the largest bound below each node
        for t, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            at, k = 0, 0 if is_stem else self.bound[t]
            self.reach[0] = max(self.reach[0], k)
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], k)
            (self.stems if is_stem else self.terms)[at] = t
        self.start = self._closed({(0, 0, "")})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple[str, int] | None] = {}

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With letters of the trie left out of the word; a state that another one of fewer edits covers goes."""
        todo, least = list(states), {}
        while todo:
            node, e, pending = todo.pop()
            if least.get((node, pending), 9) <= e:
                continue
            least[node, pending] = e
            if not pending:
                todo += [(n, e + 1, "") for n in self.children[node].values() if e < self.reach[n]]
        return frozenset((n, e, p) for (n, p), e in least.items())

    def _step(self, states: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int, str]] = set()
        for node, e, pending in states:
            if pending:  # a swap: the letter read before comes second in the trie
                first = self.children[node].get(c)
                if first is not None and (second := self.children[first].get(pending)) is not None:
                    out.add((second, e, ""))
                continue
            for x, n in self.children[node].items():
                if x == c:
                    out.add((n, e, ""))
                elif e < self.reach[n]:
                    out.add((n, e + 1, ""))
            if e < self.reach[node]:
                out |= {(node, e + 1, ""), (node, e + 1, c)}
        return self._closed(out)

    def look(self, word: str) -> tuple[str, int] | None:
        at = self.start
        for c in word:
            nxt = self.steps.get((at, c))
            if nxt is None:
                nxt = self._step(at, c)
                if len(self.steps) < self.STATES:
                    self.steps[at, c] = nxt
            at = nxt
            if not at:
                return None
            for node, e, p in at if self.stems else ():
                if not e and not p and node in self.stems:
                    return self.stems[node], 0
        if at not in self.ends:
            hits = [(e, self.terms[n]) for n, e, p in at if not p and n in self.terms and e <= self.bound[self.terms[n]]]
            self.ends[at] = min(hits)[::-1] if hits else None
        return self.ends[at]


def quoted_chunks(text: str) -> set[int]:
    """The numbers of the chunks between white space that lie between a pair of quotation marks near them."""
    quoted: set[int] = set()
    at = 0  # chunks before the line
    for line in _LINE.finditer(text):
        own = _CHUNK.findall(line[0])
        closes, opened = "", 0
        for i, chunk in enumerate(own):
            for k, c in enumerate(chunk):
                # within a word an apostrophe is part of it
                if c in closes and not (c == "’" and chunk[k + 1 : k + 2].isalpha()):
                    quoted.update(at + j for j in range(opened, i + 1) if j - opened <= WINDOW and i - j <= WINDOW)
                    closes = ""
                elif not closes and c in QUOTES:
                    closes, opened = QUOTES[c], i
        at += len(own)
    return quoted


# --- model ----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    stems: list[str] = field(default_factory=list)
    exempt: frozenset[str] = frozenset()
    base: float = -4.0
    slope: float = 1.5


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        stems = set(model.stems)
        self.automaton = Automaton([t for t in model.weights if t not in stems], model.stems)
        self.chunks = _Kept(self._chunk, CACHE)

    def _chunk(self, chunk: str) -> float:
        """The evidence in a chunk, without its context."""
        best = 0.0
        for w in words_of(chunk):
            hit = self.automaton.look(w)
            if hit and w not in self.model.exempt:
                best = max(best, self.model.weights[hit[0]] * (NEAR if hit[1] else 1.0))
        return best

    def evidence(self, text: str) -> float:
        chunks = text.split()
        found = list(map(self.chunks.__getitem__, chunks))
        if not any(found):
            return 0.0
        quoted = quoted_chunks(text)
        reported = lambda i: any(w in REPORTING for c in chunks[max(0, i - 3) : i] for w in words_of(c))
        return sum(e * (QUOTED if i in quoted or reported(i) else 1.0) for i, e in enumerate(found) if e)

    def score(self, text: str) -> float:
        x = self.model.base + self.model.slope * min(self.evidence(text), CAP)
        return 1 / (1 + math.exp(-x))


# --- learning -------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def _candidates(text: str) -> set[str]:
    words = {w for c in set(text.split()) for w in words_of(c) if len(w) >= 3}
    return words | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """labels: (doc_id, toxic). At most `sample` labelled rows outside of held_out() are learned from."""
    ship(df.sparkSession)
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_toxic")).dropna()
    chosen = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own = df.select(df[doc_id].cast("long").alias("_id"), text_of(df, text).alias("text"))
    rows = written(own.join(F.broadcast(chosen), "_id").groupBy("text").agg(F.max("_toxic").alias("_toxic")), "labelled")  # at most `sample` ids are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (toxic if y else clean).update(_candidates(t))
        toxic[""] += 0
        terms = [t for t in toxic]
        yield pa.record_batch([pa.array(terms), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
        rest = [t for t in clean if t not in toxic]
        yield pa.record_batch([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([clean[t] for t in rest], pa.int64())], names=["term", "toxic", "clean"])

    n = {bool(r["_toxic"]): r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return Model()
    counted = rows.mapInArrow(count, "term string, toxic long, clean long").filter("term <> ''").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    rare = F.col("clean") * 50 * bad <= F.col("toxic") * good  # fifty times as frequent in toxic texts
    top = counted.filter((F.col("toxic") >= LEAST) & rare).withColumn("w", weight).orderBy(F.desc("toxic"), "clean", F.length("term"), "term").collect()  # words of the sample
    weights = {r["term"]: r["w"] for r in top}
    terms = _covering({r["term"]: r["toxic"] for r in top}, rows)
    stems = [t[1:] for t in terms if t[0] == "^"]
    model = Model({t.removeprefix("^"): float(weights[t]) for t in terms}, stems)
    model.exempt = _benign(rows, model)
    evidence = rows.mapInArrow(_evidence(model), "e double, y int").groupBy("y", F.round("e", 1).alias("e")).count().orderBy("y", "e").collect()
    model.base, model.slope = _curve([(r["e"], r["y"], r["count"]) for r in evidence])
    return model


def _covering(count: dict[str, int], rows: DataFrame) -> list[str]:
    """Terms, the most frequent first, that a toxic text without COVER terms so far holds. Texts come as lists of the
    candidates in them and a mark that near copies share, and are at most the sample's."""
    terms = list(count)
    place = {t: i for i, t in enumerate(terms)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [_candidates(x) for x in batch.column(0).to_pylist()]
            got = [sorted(place[t] for t in x if t in place) for x in all_]
            mark = [min((zlib.crc32(t.encode()) for t in x), default=0) for x in all_]
            yield pa.record_batch([pa.array(got, pa.list_(pa.int32())), pa.array(mark, pa.int64())], names=["terms", "mark"])

    texts = rows.filter("_toxic > 0").select("text").mapInArrow(held, "terms array<int>, mark long").orderBy("mark", "terms").collect()
    by_term: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(texts):
        for t in x[0]:
            by_term[t].append(i)
    longer: dict[str, str] = {}
    for t in sorted(terms, key=lambda t: (len(t.removeprefix("^")), t[0] != "^")):
        word = t.removeprefix("^")
        for k in STEMS:
            s = "^" + word[:k]
            if len(word) >= k and s != t and s in count and count[t] >= 0.95 * count[s]:
                longer[s] = t
    need, chosen, stems = [COVER] * len(texts), [], []
    for t in sorted(by_term, key=lambda t: (-len(by_term[t]), t)):
        word = terms[t].removeprefix("^")
        if terms[t] in longer or any(word.startswith(s) for s in stems):
            continue  # a longer term, or a shorter stem, has it
        if len({texts[i][1] for i in by_term[t] if need[i] > 0}) >= LEAST:
            chosen.append(terms[t])
            if terms[t][0] == "^":
                stems.append(word)
            for i in by_term[t]:
                need[i] -= 1
    return chosen


def _benign(rows: DataFrame, model: Model) -> frozenset[str]:
    """Near forms that clean texts hold."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(model), Counter()
        for batch in batches:
            for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in {w for c in set(t.split()) for w in words_of(c)}:
                    if (hit := scorer.automaton.look(w)) and hit[1]:
                        seen[w, hit[0]] += 1 if not y else 0
        yield pa.record_batch([pa.array([w for w, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "term", "clean"])

    found = rows.mapInArrow(near, "word string, term string, clean long").groupBy("word", "term").agg(F.sum("clean").alias("clean")).filter("clean > 0").select("word").distinct().collect()  # words of the sample
    return frozenset(r["word"] for r in found)


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.record_batch([pa.array([scorer.evidence(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1).cast(pa.int32())], names=["e", "y"])

    return run


def _curve(seen: list[tuple[float, int, int]]) -> tuple[float, float]:
    """A logistic curve of the evidence by Newton steps, with a prior that keeps it finite: no hit lies near 0.02, and the
    weight of one rare term is enough."""
    x = np.array([[1.0, min(e, CAP)] for e, _, _ in seen])
    y, n = np.array([float(v > 0) for _, v, _ in seen]), np.array([float(c) for _, _, c in seen])
    prior, w = np.array([-4.0, 1.5]), np.array([-4.0, 1.5])
    tight = np.diag([4.0, 4.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + tight @ (w - prior)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + tight, gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(min(w[0], -0.5)), float(max(w[1], 0.2))


# --- scoring --------------------------------------------------------------------------------------------------------


def scores(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row. One pass, no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_scorers: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """A worker keeps the scorer, and with it the words it has met, from task to task."""
    key = repr((sorted(model.weights.items()), sorted(model.stems), sorted(model.exempt), model.base, model.slope))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df whose score is below 0.5, all their columns as they are."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text) if at is None else at
            stays = [scorer.score(t or "") < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return df.mapInArrow(run, df.schema)
