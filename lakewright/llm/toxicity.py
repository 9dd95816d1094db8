"""Toxicity scoring: Levenshtein automata over a lexicon trie, weighed by context.

* A lexicon is learned from labelled texts: stems (word beginnings of 4-10
  characters) far more frequent, by document, in toxic texts than in others.
* All terms share one trie.  The Levenshtein automaton of every term, intersected
  with the trie, is determinised lazily: a state is the set of (trie node, edits)
  reached, and a word is accepted as an exact hit (it begins with a term) or as a
  misspelling: the whole word is within 1 edit of a term of 5-7, 2 of 8 or more
  characters, or its beginning within 1 edit of a term of 8 or more (inflected forms).
  Most words die after a few characters, whatever the lexicon's size.
* Each hit is weighed by a window of ``WINDOW`` words to either side: quotation
  marks or reporting verbs around it make it a quotation (weight ``QUOTED``)
  rather than abuse (1).
* A misspelt hit is evidence for its term, at the fixed share ``MISSPELT`` of an exact
  hit, and so can only raise a score.  Forms near a term that the clean learning texts
  use as words of their own (not far more frequent in toxic ones) are no misspellings.
* A logistic model on the weighed evidence, its weights not negative, gives the score.

Learning uses a bounded sample: at most about ``SAMPLE`` labelled texts of each
class (chosen by hash of the id; of rows of one id the least text), only from rows whose
crc32(doc_id) mod 5 is not 0.  Of near copies in the sample one is kept for each class, as
their chance words would pass for marks of a class.  The lexicon has every stem of the sample that passes the
test.  Scoring is one pass without shuffle over whole texts of all rows.  Labels,
lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no hits and get the model's score of
an empty text; a null doc_id is hashed as the empty text and has no label;
several labels of an id count as their greatest; repeated rows are scored each.
Without any labelled toxic text every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import crc_bucket, map_arrow, table
from lakewright.llm.ngram_join import signer

SAMPLE = 4000
WINDOW, QUOTED = 8, 0.3
#: Evidence of a misspelt hit against an exact one.  Fixed: labelled texts hold too few to fit it.
MISSPELT = 0.8
STEM = range(4, 11)
#: Bands and rows of the MinHash that finds near copies in the sample: 0.9997 of those of similarity 0.8.
COPIES = (8, 2)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»…–—¿¡"
#: Marks and verbs (lower case) that announce somebody else's words.
QUOTE_MARKS = frozenset('"“”„«»')
REPORTING = frozenset("said says say called calls call wrote writes quoted quote quoting told reported sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split())


class Lexicon:
    """The lazily determinised product of the terms' Levenshtein automata with their trie."""

    START_STATES = 100_000

    def __init__(self, terms: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [-1]
        self.reach: list[int] = [0]
        for t in terms:
            most, node = self.edits(t), 0
            self.reach[0] = max(self.reach[0], most)
            for ch in t:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.allowed.append(-1)
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], most)
            self.allowed[node] = most
        self.reset()

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 8 else 2

    def reset(self) -> None:
        self.states: dict[tuple, list] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> list | None:
        """[whether a term is complete without edits, whether one is in reach of a word that ends
        here, transitions, key, whether one is of a word that goes on]; None if dead."""
        todo = list(nodes)
        while todo:  # leaving out a character of a term
            n = todo.pop()
            e = nodes[n] + 1
            for c in self.child[n].values():
                if e <= self.reach[c] and e < nodes.get(c, 99):
                    nodes[c] = e
                    todo.append(c)
        if not nodes:
            return None
        key = tuple(sorted(nodes.items()))
        got = self.states.get(key)
        if got is None:
            allowed = [(self.allowed[n], e) for n, e in key]
            got = self.states[key] = [any(e == 0 <= a for a, e in allowed), any(e <= a for a, e in allowed), {}, key, any(e <= 1 < a for a, e in allowed)]
        return got

    def _next(self, state: list, ch: str) -> list | None:
        nodes: dict[int, int] = {}
        for n, e in state[3]:
            for c, m in self.child[n].items():
                cost = e + (c != ch)
                if cost <= self.reach[m] and cost < nodes.get(m, 99):
                    nodes[m] = cost
            if e + 1 <= self.reach[n] and e + 1 < nodes.get(n, 99):
                nodes[n] = e + 1
        state[2][ch] = got = self._state(nodes)
        return got

    def match(self, word: str) -> int:
        """2 if word begins with a term, 1 if it is or begins with a misspelt one, else 0."""
        if len(self.states) > self.START_STATES:
            self.reset()
        state, near = self.start, 0
        for ch in word:
            nxt = state[2].get(ch, 0)
            state = self._next(state, ch) if nxt == 0 else nxt
            if state is None:
                return near
            if state[0]:
                return 2
            if state[4]:
                near = 1
        return 1 if state[1] else near


class Scorer:
    """Features and score of a text under a learned model."""

    def __init__(self, terms: list[str], weights: list[float] | None, ordinary: frozenset[str] = frozenset()) -> None:
        self.lexicon, self.weights, self.ordinary, self.known = Lexicon(terms), weights, ordinary, {}

    def kind(self, token: str) -> int:
        got = self.known.get(token)
        if got is None:
            word = token.strip(_STRIP)
            got = self.lexicon.match(word)
            if got == 1 and word in self.ordinary:
                got = 0
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[token] = got
        return got

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of 1 + the evidence (weighed exact hits and MISSPELT of the weighed misspellings), log of
        1 + the weighed misspellings alone (told only, no part of the score), and evidence a hundred words."""
        words = (text or "").lower().split()
        known, kind = self.known, self.kind
        hits = {}
        for w in set(words):
            k = known.get(w)
            if (kind(w) if k is None else k):
                hits[w] = kind(w)
        if not hits:
            return 0.0, 0.0, 0.0
        sums = [0.0, 0.0, 0.0]
        for i, w in enumerate(words):
            if k := hits.get(w):
                sums[k] += QUOTED if self.quoted(words, i) else 1.0
        evidence = sums[2] + MISSPELT * sums[1]
        return math.log1p(evidence), math.log1p(sums[1]), min(100.0 * evidence / len(words), 10.0)

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        opens = any(not QUOTE_MARKS.isdisjoint(w) for w in before)
        return (opens and any(not QUOTE_MARKS.isdisjoint(w) for w in after)) or any(w.strip(_STRIP) in REPORTING for w in before)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)[::2], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stems(text: str | None) -> set[str]:
    out = set()
    for w in {w.strip(_STRIP) for w in (text or "").lower().split()}:
        for n in STEM:
            if len(w) >= n:
                out.add(w[:n])
    return out


def _count_stems(batches):
    seen = (Counter(), Counter())

    def told():
        terms = list(seen[0] | seen[1])
        counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], ["term", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(_stems(text.as_py()))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield told()
    yield told()


def _count_near(terms):
    """Numbers of toxic and clean texts that hold each form within a term's edits."""

    def run(batches):
        lexicon, seen = Lexicon(terms), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(w for w in {w.strip(_STRIP) for w in (text.as_py() or "").lower().split()} if lexicon.match(w) == 1)
        forms = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([c[w] for w in forms], pa.int64()) for c in (seen[1], seen[0]))], ["form", "toxic", "clean"])

    return run


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Stems that significantly mark toxic texts; of nested ones the longest that loses
    at most a twentieth of the texts, and none that a shorter chosen stem covers."""
    good = {}
    p, q = n_toxic / (n_toxic + n_clean), n_clean / (n_toxic + n_clean)
    for t, a, b in counts:
        g = 2 * ((a * math.log(a / ((a + b) * p)) if a else 0) + (b * math.log(b / ((a + b) * q)) if b else 0))
        if g >= 30 and math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)) >= 2:
            good[t] = (a, g)
    longer: dict[str, int] = {}
    for t, (a, _) in good.items():
        if len(t) > STEM.start:
            longer[t[:-1]] = max(longer.get(t[:-1], 0), a)
    kept: set[str] = set()
    for t in sorted(good, key=len):
        if any(t[:n] in kept for n in range(STEM.start, len(t))):
            continue
        if longer.get(t, 0) < 0.95 * good[t][0]:
            kept.add(t)
    return sorted(kept)


def _apart(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """The least id of each class among texts that share a band, directly or through others."""
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, _, bands in rows:
        for b in bands:
            root[top(("band", b))] = top(i)
    kept: dict = {}
    for i, toxic, _ in sorted(rows):
        kept.setdefault((top(i), toxic), i)
    return sorted(kept.values())


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """Ridge logistic regression by Newton's method, refitted without columns of a negative
    weight (theirs is 0), so that no hit lowers a score; the intercept is moved to the prior."""
    w = _newton(x, y)
    while (w[1:] < 0).any():
        x = x * (w[1:] > 0)
        w = _newton(x, y)
    share = y.mean()
    w[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return w.tolist()


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [0.5] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[float] | None, frozenset[str]]:
    """Terms, weights and ordinary forms near terms from at most about sample labelled texts of each class."""
    truth = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .where(crc_bucket(F.col("_id")) != 0)
    )
    n = {r["_toxic"]: r["n"] for r in truth.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return [], None, frozenset()
    chance = F.when(F.col("_toxic") == 1, F.lit(sample / n[1])).otherwise(F.lit(sample / n[0]))
    taken = truth.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) < chance * (1 << 20))
    # Bounded by the sample: twice SAMPLE ids in expectation.
    chosen = docs.select(F.col("doc_id").cast("long").alias("_of"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), F.col("_of") == F.col("_id"))
    chosen = chosen.groupBy("_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic"))
    signed = map_arrow(chosen.select("_id", F.col("_toxic").cast("long"), "text"), signer(5, *COPIES), "doc_id long, mark long, key binary, bands array<long>, n_grams long")
    apart = docs.sparkSession.createDataFrame([(i,) for i in _apart([(r.doc_id, r.mark, r.bands or ()) for r in signed.collect()])], "_of long")
    chosen = chosen.join(F.broadcast(apart), F.col("_id") == F.col("_of")).select("text", "_toxic").persist()
    try:
        seen = {r["_toxic"]: r["n"] for r in chosen.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
        if not seen.get(1) or not seen.get(0):
            return [], None, frozenset()
        counts = (
            map_arrow(chosen, _count_stems, "term string, toxic long, clean long")
            .groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("toxic") >= 3) & (F.col("toxic") * seen[0] > 4.0 * F.col("clean") * seen[1]))
            .collect()
        )
        terms = choose_terms([tuple(r) for r in counts], seen[1], seen[0])

        near = map_arrow(chosen, _count_near(terms), "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        ordinary = frozenset(r["form"] for r in near.where(F.col("toxic") * seen[0] <= 4.0 * F.col("clean") * seen[1]).select("form").collect())

        def feature_rows(batches):
            scorer = Scorer(terms, None, ordinary)
            for batch in batches:
                x = [scorer.features(t) for t in batch.column(0).to_pylist()]
                cols = list(zip(*x, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in cols), batch.column(1).cast(pa.int32())], ["a", "b", "c", "toxic"])

        rows = map_arrow(chosen, feature_rows, "a double, b double, c double, toxic int").collect()
    finally:
        chosen.unpersist()
    # Task order is not fixed: sort, so that the sums are the same each time.
    data = np.array(sorted(tuple(r) for r in rows))
    return terms, fit_logistic(data[:, [0, 2]], data[:, 3], n[1] / (n[0] + n[1])), ordinary


def _scores(model):
    def run(batches):
        scorer = Scorer(*model)
        for batch in batches:
            got = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", crc_bucket(F.col("doc_id")) == 0)
    return map_arrow(rows, _scores(model), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model, at):
    def run(batches):
        scorer = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the learned score does not reject; columns as they are."""
    model = learn(docs, labels)
    return map_arrow(docs, _keep(model, docs.columns.index("text")), docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
