"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is parsed
greedily: from each phrase's start the automaton is followed as long as the text
goes on occurring in the language's sample, i.e. for the longest match, then the next
phrase starts.  Few phrases a character mean low cross entropy; counts are divided by
the rate that the language's own held-back sample shows, and the least wins.  A language whose
sample is under half the largest one, or that has under 200 bytes held back, takes the median of the
measured rates: it wins the texts that it parses into fewest phrases, and no others.

Automata and texts are sequences of UTF-8 bytes (lower case), so no character of any
script is merged with another.  Transitions are completed by the restart of a phrase, so a
step is one table look-up that also tells how many phrases ended.  Many stretches of text
are stepped at once: long texts are cut into stretches of ``STRETCH`` bytes, each begun
``WARM`` bytes early to guess the state at its cut; where the stretch before ends in another
state, it is parsed again from that one, until all agree.  The result is that of one
parse from first to last byte.

Learning uses a bounded sample: of each language about ``TEXTS`` rows (chosen by hash of
the id), taken whole up to ``BYTES`` bytes, and ``ALL_BYTES`` for all languages together;
texts over an eighth of that are taken only if shorter ones do not fill it, and the last is
cut where it is full.  Only rows with a language whose crc32(doc_id) mod 5 is not 0 are
used.  lang, source and doc_id are never inputs of a prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0, as
is everything if nothing was learned; ids may be null (hashed as the empty text) or
repeat; rows are judged each on their own; ties go to the first language by name; very long
texts are parsed whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.llm._common import crc_bucket, map_arrow, table

BYTES, ALL_BYTES, TEXTS = 40_000, 200_000, 64
STRETCH, WARM = 512, 48


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nexts, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def _raw(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Parser:
    """Cross-parses texts against the samples of all languages."""

    def __init__(self, samples: dict[str, str], held_back: dict[str, list[str]] | None = None) -> None:
        self.langs = sorted(samples)
        raw = {lang: np.frombuffer(_raw(samples[lang]), dtype=np.uint8) for lang in self.langs}
        #: Bytes that no sample has share code 0, which no automaton can read.
        used = np.unique(np.concatenate(list(raw.values()))) if raw else np.zeros(0, dtype=np.uint8)
        self.code, self.width = np.zeros(256, dtype=np.int32), len(used) + 1
        self.code[used] = np.arange(1, self.width)
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            nexts = suffix_automaton(self.code[raw[lang]].tolist())
            # Entry: 4 * next state + phrases ended.  Without a transition the phrase ends and
            # the next starts here; a byte that even the root lacks is a phrase of its own.
            root = np.full(self.width, 4 * base, dtype=np.int32)
            for c, s in nexts[0].items():
                root[c] = 4 * (base + s)
            lacks = np.ones(self.width, dtype=np.int32)
            lacks[list(nexts[0])] = 0
            table_ = np.tile(root + 1 + lacks, (len(nexts), 1))
            table_[0] = root + lacks
            for s, moves in enumerate(nexts):
                for c, t in moves.items():
                    table_[s, c] = 4 * (base + t)
            tables.append(table_)
            self.roots.append(base)
            base += len(nexts)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
        self.rate = np.ones(len(self.langs))
        measured: dict[int, float] = {}
        largest = max(map(len, raw.values()), default=0)
        for i, lang in enumerate(self.langs):
            texts = [self.codes(t) for t in (held_back or {}).get(lang, ())]
            # A small sample parses even its own language badly: its rate would flatter it.
            if 2 * len(raw[lang]) >= largest and (size := sum(map(len, texts))) >= 200:
                measured[i] = self.phrases(texts)[:, i].sum() / size
        if measured:
            self.rate[:] = np.median(list(measured.values()))
            self.rate[list(measured)] = list(measured.values())

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(_raw(text), dtype=np.uint8)]

    def _step(self, every: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after, and phrases ended in, the stretches every[start : start + length], each from its state."""
        order = np.argsort(-length, kind="stable")
        begin, state, count = start[order], state[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")  # stretches longer than j
        for j, m in enumerate(live.tolist()):
            got = self.table.take(state[:m] * self.width + every[begin[:m] + j])
            count[:m] += got & 3
            np.right_shift(got, 2, out=state[:m], casting="unsafe")
        out = np.empty_like(state), np.empty_like(count)
        out[0][order], out[1][order] = state, count
        return out

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Numbers of phrases, a row per text and a column per language."""
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(coded)), pieces)
        every = np.concatenate(coded) if len(coded) else np.zeros(0, dtype=np.int32)
        offset = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, length = offset[owner] + within * STRETCH, np.minimum(sizes[owner] - within * STRETCH, STRETCH)
        n, k = len(owner), len(self.langs)
        # Flat arrays, language by language.
        start, length, later, root = np.tile(start, k), np.tile(length, k), np.tile(within > 0, k), np.repeat(np.array(self.roots, dtype=np.int64), n)
        begun = root.copy()
        warm = np.flatnonzero(later)
        begun[warm] = self._step(every, start[warm] - WARM, np.full(len(warm), WARM), root[warm])[0]
        end, count = self._step(every, start, length, begun)
        while len(wrong := np.flatnonzero(later[1:] & (begun[1:] != end[:-1])) + 1):
            begun[wrong] = end[wrong - 1]
            end[wrong], count[wrong] = self._step(every, start[wrong], length[wrong], begun[wrong])
        last = np.append(~later[1:], True)[: len(later)]
        count += last & (end != root)
        out = np.zeros((len(coded), k), dtype=np.int64)
        np.add.at(out, owner, count.reshape(k, n).T)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        coded, block, size = [], [], 0
        for i in [*at, None]:
            if i is not None:
                block.append(i)
                coded.append(self.codes(texts[i]))
                size += len(coded[-1])
            if block and (i is None or size > 1 << 21):
                got = self.phrases(coded) / self.rate
                for r, k in enumerate(block):
                    best = int(np.argmin(got[r]))
                    rest = np.delete(got[r], best)
                    langs[k] = self.langs[best]
                    scores[k] = float(np.clip(1 - got[r, best] / rest.min(), 0, 1)) if len(rest) else 1.0
                coded, block, size = [], [], 0
        return langs, scores


_WORKER: dict = {}


def _predict(samples, held_back):
    def run(batches):
        if _WORKER.get("samples") != samples:
            _WORKER.update(samples=samples, parser=Parser(samples, held_back))
        parser = _WORKER["parser"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                langs, scores = parser.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(docs: DataFrame) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Sample and held-back texts of each language, bounded as the module says."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null").where(crc_bucket(F.col("doc_id")) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}, {}
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(6)), F.lit(1 << 30))
    limit = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 4 * TEXTS / n) * (1 << 30)))])[F.col("lang")]
    # No more than BYTES of a text can be used.
    few = rows.withColumn("place", place).where(F.col("place") < limit).select("lang", "place", F.substring("text", 1, BYTES).alias("text"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("k") <= 2 * TEXTS)
    size = min(BYTES, ALL_BYTES // len(counts))
    got: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
    for r in sorted(few.collect(), key=lambda r: (r["lang"], len(r["text"]) > size // 8, r["k"])):
        texts = got[r["k"] % 4 == 0].setdefault(r["lang"], [])
        if (left := size - sum(len(_raw(t)) for t in texts)) > 0:
            texts.append(_raw(r["text"] + "\n")[:left].decode("utf-8", "ignore"))
    return {k: "".join(v) for k, v in got[0].items() if "".join(v).strip()}, got[1]


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    samples, held_back = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", crc_bucket(F.col("doc_id")) == 0)
    return map_arrow(rows, _predict(samples, held_back), "doc_id long, held_out boolean, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
