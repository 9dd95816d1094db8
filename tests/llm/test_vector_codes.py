"""Vector codes against a full scan of every codebook."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import vector_codes as vc


def plain(rows, parts, entries, rounds):
    """(vec_id, label, codes, error) and the codebooks by full scans in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            got = defaultdict(list)
            for c, code in zip(cut, codes, strict=True):
                got[code[p]].append(c[p])
            books[p] = [[sum(v) // len(v) for v in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    last = [[nearest(c[p], p) for p in range(parts)] for c in cut]
    out = [(i, label, "".join(f"{k:02x}" for _, k in r), sum(d for d, _ in r)) for (i, _, label), r in zip(kept, last, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, parts, entries, rounds):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = vc.coded(frame, parts, entries, rounds).collect()
    want, sha = plain(rows, parts, entries, rounds)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert sorted(map(tuple, got), key=str) == sorted(((i, code, error, sums[label], sha) for i, label, code, error in want), key=str)


def test_equals_full_scans(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([1, 2, None])) for i in range(300)]
    check(spark, rows, 4, 16, 2)
    check(spark, rows, 2, 64, 3)


def test_ties_copies_and_rows_that_go(spark):
    rng = random.Random(6)
    few = [[rng.randint(-3, 3) / 256 for _ in range(8)] for _ in range(12)]  # small integers: many equal distances and equal entries
    rows = [(i, rng.choice(few), i % 3) for i in range(200)]
    rows += [(500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [math.nan] + [1.0] * 7, 1), (503, [math.inf] * 8, None)]
    rows += [(7, rows[7][1], 0), (7, rows[7][1], 0)]  # a repeated row outside the first entries
    check(spark, rows, 4, 6, 2)


def test_fewer_vectors_than_entries_and_null_ids(spark):
    check(spark, [(None, [0.5, -0.5], None), (3, [0.25, 1.0], None), (1, [-2.0, 7.0], 4)], 2, 64, 2)


def test_undefined_vectors_are_dropped(spark):
    rows = [(1, [0.5] * 4, 1), (2, [0.5] * 6, 1), (3, [], 1), (4, [0.5] * 5, 1), (5, [3e30] * 4, 1), (6, [0.25] * 4, 1)]
    got = vc.coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 2, 4, 1)
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 6]


def test_empty_table_and_bounds(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string, at long")
    assert vc.coded(empty).count() == 0
    with pytest.raises(ValueError, match="256"):
        vc.coded(empty, entries=300)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.sampled_from([2, 30, 5000]))
def test_exponion_search_is_exact_from_any_start(seed, k, spread):
    rng = np.random.default_rng(seed)
    books = vc.Codebooks(rng.integers(-spread, spread, (3, k, 2)))
    x, start = rng.integers(-spread, spread, (40, 3, 2)), rng.integers(0, k, (40, 3))
    far = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3)
    for previous in (start, None):
        codes, errors = books.nearest(x, previous)
        assert (codes == far.argmin(2)).all()
        assert (errors == far.min(2)).all()
