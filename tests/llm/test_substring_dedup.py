import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from lakewright.llm import substring_dedup as sd
from lakewright.llm._fm_index import FMIndex, matching_statistics

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("place", T.StringType()), T.StructField("found", T.StringType())])
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    low = lambda d: (d is not None, d or 0)
    docs = sorted({(low(d), t or "") for d, t, *_ in rows})
    by_id = {}
    for d, t in docs:
        by_id.setdefault(d, []).append(t)
    assert all(len(v) == 1 for v in by_id.values()), "one text per id here"
    first, gone = {}, {}
    for d, t in docs:
        w = WORD.findall(t)
        cut = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in first:
                cut[i : i + 20] = [True] * 20
            else:
                first[k] = (d, i)
        gone[d] = (w, cut)
    out = []
    for d, *_ in rows:
        w, cut = gone[low(d)]
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((d, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "the", "the", "of"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(18, 70))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(0, 50))]
            if r.random() < 0.1:
                w += [r.choice("ab")] * r.randint(15, 60)
            if r.random() < 0.1:
                w += ["x", "y", "z"] * r.randint(6, 12)
        rows.append((i * 3, r.choice([" ", "\n", " \t"]).join(w), "p", "f"))
    rows += [(1, rows[9][1], None, None), (4, rows[9][1], None, None), (5, None, None, None), (7, "", None, None), (None, rows[20][1], None, None), rows[30], rows[30]]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 10_000), (2, 3), (3, 0)])
def test_matches_brute_force(spark, seed, hot):
    rows = made(seed)
    got = sd.deduplicated(spark.createDataFrame(rows, SCHEMA), shard_words=600, hot=hot).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_rows_without_an_id(spark):
    """Three hundred texts without an id beside copies and repeated rows of them."""
    r = random.Random(5)
    say = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    rows = [(None, say(30), None, None) for _ in range(300)] + [(4, say(25), None, None)]
    rows += [rows[0], (9, rows[7][1], None, None), (10, "lead " + rows[8][1], None, None)]
    got = sd.deduplicated(spark.createDataFrame(rows, SCHEMA), shard_words=3000).collect()
    removed = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in got)
    assert removed == [(False, 0, 0)] * 301 + [(True, 4, 0), (True, 9, 30), (True, 10, 30)]


def test_index_is_smaller_than_a_suffix_array():
    r = np.random.default_rng(4)
    text = np.concatenate([[0], np.tile(r.integers(1, 1 << 12, 20_000), 3), [0]])
    assert FMIndex(text).n_bytes < 8 * len(text)


def test_empty_table(spark):
    assert sd.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matching_statistics_find_first_place():
    r = np.random.default_rng(3)
    text = np.concatenate([[0], r.integers(1, 3, 200), [0], r.integers(1, 4, 300), [0]])
    starts, sizes = np.array([1, 202]), np.array([200, 300])
    got = matching_statistics(FMIndex(text, 5), text, starts, sizes)
    places = {}
    for s, n in zip(starts, sizes, strict=True):
        for i in range(s, s + n - 4):
            places.setdefault(tuple(text[i : i + 5]), i)
    for s, n in zip(starts, sizes, strict=True):
        for i in range(s, s + n):
            assert got[i] == (places[tuple(text[i : i + 5])] if i <= s + n - 5 else -1)
