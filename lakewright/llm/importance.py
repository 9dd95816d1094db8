"""Importance resampling of raw text towards a target by hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hash buckets (single words and word
pairs, ASCII case folded) are counted: one over all texts (raw), one over the
target texts (labelled quality 1).  A text's log importance weight is the sum over
its n-grams of log target(bucket) - log raw(bucket).  With Gumbel noise added, the
``share`` of all rows with the greatest keys is a sample without replacement in
proportion to the weights.

Counting is one pass with sums per bucket before the shuffle; the models are
``BUCKETS`` numbers each.  The target is fitted on at most about ``SAMPLE``
labelled texts (chosen by hash of the id), the raw model on all texts.  The k-th
greatest key is found exactly by counting ever finer bins, so nothing is sorted
globally and no task or driver holds more than 4096 counts.

Defined results: null and empty texts have no n-grams and weight 0; ids may be null
or repeat; noise depends on id, text and seed alone, so equal rows have equal keys and
rows tied with the k-th key are all selected; without target labels all weights are 0.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import cut, map_arrow, table
from lakewright.llm._words import U, hash_words, ngrams, slices, tokens

BUCKETS, SAMPLE, SHARE, SEED = 1 << 14, 20_000, 0.5, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _buckets(offsets, data):
    """(bucket of every n-gram, bounds by row) for words, then for pairs."""
    starts, ends, first = tokens(offsets, data)
    h = hash_words(_LOWER[data], starts, ends)
    _, pairs, bounds = ngrams(h, first, 2)
    shift = U(64 - int(math.log2(BUCKETS)))
    return (((h * U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), first), ((pairs >> shift).astype(np.int64), bounds)


def _count(batches):
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, offsets, data in slices(batch.column(0)):
            for bucket, bounds in _buckets(offsets, data):
                raw += np.bincount(bucket, minlength=BUCKETS)
                mine = np.repeat(marks[lo:hi], np.diff(bounds))
                target += np.bincount(bucket[mine], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """log target(bucket) - log raw(bucket) for each bucket, add-one smoothed."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("_q")).where("_q = 1")
    n = good.count()
    good = good.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20)).select("_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("_of"), F.col("text").cast("string").alias("text"))
    # Bounded by the sample.
    marked = texts.join(F.broadcast(good), F.col("_of") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("target"))
    counts = map_arrow(marked, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _weigh(ratios):
    def run(batches):
        for batch in batches:
            ids, noise = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, offsets, data in slices(batch.column(1)):
                weight, grams = np.zeros(hi - lo), np.zeros(hi - lo, dtype=np.int64)
                for bucket, bounds in _buckets(offsets, data):
                    # Sums row by row, not from the running total: equal texts get equal weights.
                    for r in np.flatnonzero(np.diff(bounds)):
                        weight[r] += ratios[bucket[bounds[r] : bounds[r + 1]]].sum()
                    grams += np.diff(bounds)
                u = (noise[lo:hi].astype(np.float64) + 0.5) / (1 << 40)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(grams), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], ["doc_id", "n_grams", "log_weight", "gumbel_key"]
                )

    return run


def kth_greatest(rows: DataFrame, key: str, k: int, bins: int = 1 << 12) -> float | None:
    """The k-th greatest of a double column without nulls or NaN, exactly; None if k < 1.

    The range that holds it is split into bins and counted again and again, until all
    values in it are equal; a round is one aggregation to at most ``bins`` rows.
    """
    if k < 1:
        return None
    while True:
        lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
        if k > n:
            return None
        if lo == hi or k == n:
            return lo
        if k == 1:
            return hi
        width = (hi - lo) / bins or math.ulp(hi)
        place = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(bins))
        for b, m in sorted(rows.groupBy(place.alias("b")).count().collect(), reverse=True):
            if k <= m:
                rows = rows.where(place == b)
                break
            k -= m


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected for every row of docs."""
    ratios = log_ratios(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed)), F.lit(1 << 40)).alias("noise"),
    )
    keyed = cut(map_arrow(rows, _weigh(ratios), "doc_id long, n_grams long, log_weight double, gumbel_key double"))
    least = kth_greatest(keyed, "gumbel_key", math.ceil(share * keyed.count()))
    return keyed.withColumn("selected", F.col("gumbel_key") >= F.lit(math.inf if least is None else least))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
