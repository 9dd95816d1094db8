import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm import importance as I
from lakewright.llm._words import hash_words

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("noise", T.StringType()), T.StructField("target", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def buckets(text):
    """Hash buckets of a text's words and pairs, one text at a time."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    (a, _), (b, _) = I._buckets(np.array([0, len(data)]), data)
    return a.tolist() + b.tolist()


def test_weights_match_plain_counts(spark):
    r = random.Random(1)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(r.randint(1, 50))), "x", None) for i in range(120)]
    rows += [(None, None, None, None), (500, "", None, "y"), rows[3]]
    labels = [(i, i % 2, 0) for i in range(120)] + [(3, 0, 0), (None, 1, None), (4, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = I.resample(docs, marks, share=0.4).collect()
    raw, target = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS)
    for i, t, *_ in rows:
        for b in buckets(t):
            raw[b] += 1
            target[b] += i is not None and i < 120 and i % 2
    ratios = np.log((target + 1) / (target.sum() + I.BUCKETS)) - np.log((raw + 1) / (raw.sum() + I.BUCKETS))
    want = {i: sum(ratios[b] for b in buckets(t)) for i, t, *_ in rows}
    assert len(got) == len(rows)
    for x in got:
        assert math.isclose(x["log_weight"], want[x["doc_id"]], abs_tol=1e-8) and x["n_grams"] == len(buckets(next(t for i, t, *_ in rows if i == x["doc_id"])))
    keys = sorted((x["gumbel_key"] for x in got), reverse=True)
    assert {x["gumbel_key"] for x in got if x["selected"]} == set(keys[: math.ceil(0.4 * len(rows))])
    chosen = [x["doc_id"] for x in got if x["selected"] and x["doc_id"] is not None and x["doc_id"] < 120]
    assert sum(i % 2 for i in chosen) > 0.9 * len(chosen)


def test_words_hash_alike_wherever_they_stand():
    a = np.frombuffer(b"xx word", dtype=np.uint8)
    b = np.frombuffer(b"word", dtype=np.uint8)
    assert hash_words(a, np.array([3]), np.array([7])) == hash_words(b, np.array([0]), np.array([4]))


def test_kth_greatest(spark):
    r = random.Random(2)
    values = [r.choice([1.0, 2.5, -3.0, r.uniform(-1e6, 1e6), r.gauss(0, 1e-9)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 17, 250, 499, 500):
        assert I.kth_greatest(df, "v", k) == ordered[k - 1]
    assert I.kth_greatest(df, "v", 0) is None and I.kth_greatest(df, "v", 501) is None


def test_noise_is_gumbel(spark):
    rows = [(i, None, None, None) for i in range(4000)]
    got = I.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).agg(F.avg("gumbel_key"), F.var_pop("gumbel_key"), F.max(F.abs("log_weight"))).first()
    assert abs(got[0] - 0.5772) < 0.1 and abs(got[1] - math.pi**2 / 6) < 0.25 and got[2] == 0


def test_empty(spark):
    assert I.resample(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []
