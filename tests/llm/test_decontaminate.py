import random

import numpy as np
import pytest
from pyspark.sql import types as T

from lakewright.llm import decontaminate as D

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("start", T.StringType())])
ITEMS = "item_id long, text string, doc_id string"


def best(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuéß") for _ in range(r.randint(1, 9))) for _ in range(n))


def spoil(r, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        i = r.randrange(len(out))
        k = r.randrange(3)
        out[i : i + (k != 0)] = [r.choice("xyz ")] if k != 2 else []
    return "".join(out)


def test_distance_is_exact():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(1, n))) for n in (20, 60))
        d, start, end = D.locate(a, b, len(a))
        assert d == best(a, b) and best(a, b[start:end]) == d and 0 <= start <= end <= len(b)
        assert D.locate(a, b, d - 1) is None or d == 0


def test_walk_keys_of_equal_windows_agree():
    a = np.frombuffer(b"zz the quick brown fox jumps over the lazy dog and more words follow here", dtype=np.uint8)
    for walk in D._walks(*D.WALKS) + D._walks(*D.SHORT_WALKS):
        assert D.walk_keys(a, np.array([3]), walk)[:2] == D.walk_keys(a[3:], np.array([0]), walk)[:2]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1])
def test_finds_edited_items_and_leaves_clean_texts(spark, share):
    r = random.Random(int(share * 100))
    items = [(i, words(r, r.randint(15, 50)), "d") for i in range(20)]
    rows, hidden = [], set()
    for i in range(120):
        text = words(r, r.randint(0, 150))
        if i % 3 == 0:
            n = r.randrange(20)
            text = f"{text} {spoil(r, items[n][1], share)} {words(r, 20)}"
            hidden.add((i, n))
        rows.append((i, text, "x", None))
    got = D.benchmark_matches(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    found = {(g["doc_id"], g["item_id"]) for g in got}
    assert found <= hidden and len(found) >= 0.98 * len(hidden)
    for g in got[:15]:
        item, text = items[g["item_id"]][1], rows[g["doc_id"]][1]
        assert g["distance"] == best(item, text) <= D.MAX_EDITS * len(item) and best(item, text[g["start"] : g["end"]]) == g["distance"]
    kept = D.without_benchmark(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert kept.columns == SCHEMA.names and {x["doc_id"] for x in kept.collect()} == set(range(120)) - {d for d, _ in found}


def recall(pairs):
    """Share of the (item, edited copy) within MAX_EDITS that are found between other words."""
    r = random.Random(8)
    items = D.Items(list(enumerate(i for i, _ in pairs)))
    texts = [f"{words(r, 10)} {copy} {words(r, 10)}" for _, copy in pairs]
    within = {n for n, (i, _) in enumerate(pairs) if D.edit_place(i, texts[n], int(D.MAX_EDITS * len(i)))}
    raw = [t.encode() for t in texts]
    found = items.matches(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))
    return len(within & {row for row, n, *_ in found if n == row}) / len(within)


def test_recall_at_the_greatest_share_and_with_spread_edits():
    r = random.Random(20)
    items = [words(r, r.randint(15, 50)) for _ in range(150)]
    even = lambda t, step: "".join("#" if i % step == step // 2 else c for i, c in enumerate(t))
    assert recall([(t, spoil(r, t, 0.2)) for t in items]) >= 0.97
    assert recall([(t, even(t, 8)) for t in items]) >= 0.97
    assert recall([(t, even(t, 6)) for t in items]) >= 0.95
    short = [words(r, 5) for _ in range(150)]
    assert recall([(t, t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :]) for t in short]) >= 0.95


@pytest.mark.parametrize("n, least", [(3, 0.95), (5, 0.85), (8, 0.95), (12, 0.97), (20, 0.97), (40, 0.97)])
def test_recall_by_length(n, least):
    r = random.Random(n)
    items = [words(r, n) for _ in range(100)]
    assert recall([(t, spoil(r, t, 0.15)) for t in items]) >= max(least, 0.93)
    assert recall([(t, spoil(r, t, 0.2)) for t in items]) >= least


def test_tiny_items_are_found_completely():
    r = random.Random(3)
    items = list({words(r, 2)[:20].strip() for _ in range(40)})
    items = [t for t in items if 2 <= len(t) and len(t.encode()) < D.TINY]
    texts = [f"{words(r, 6)} {spoil(r, t, 0.2)} {words(r, 6)}" for t in items]
    raw = [t.encode() for t in texts]
    got = {(a, b): d for a, b, d, *_ in D.Items(list(enumerate(items))).matches(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))}
    for a, text in enumerate(texts):
        for b, item in enumerate(items):
            d = best(item, text)
            assert got.get((a, b)) == (d if d <= int(0.2 * len(item)) else None)


def test_finds_items_inside_runs_without_spaces():
    r = random.Random(40)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    code = lambda n: "".join(r.choice("abcdefghij/.-_0123456789") for _ in range(n))
    items = [f(n) for f in (han, code) for n in (30, 40, 80) for _ in range(10)]
    texts = [(han if n < 30 else code)(70) + t + (han if n < 30 else code)(50) for n, t in enumerate(items)]
    raw = [t.encode() for t in texts]
    found = D.Items(list(enumerate(items))).matches(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))
    assert found == [(n, n, 0, 70, 70 + len(t)) for n, t in enumerate(items)]


def test_odd_rows(spark):
    r = random.Random(9)
    item = words(r, 30)
    docs = [(1, "a " + item, None, None), (1, "a " + item, None, None), (None, item, None, None), (2, None, None, None), (3, "", None, None), (4, "has tiny one inside", None, None), (5, "has t1ny 0ne", None, None)]
    items = [(10, item, None), (11, item, None), (10, item, None), (12, None, None), (13, "", None), (None, item, None), (14, "tiny one", None)]
    got = D.benchmark_matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    key = lambda x: (x["doc_id"] or 0, x["item_id"] or 0, x["start"], x["distance"])
    assert sorted(map(key, got)) == sorted([(d, i, s, 0) for d, s in ((1, 2), (1, 2), (0, 0)) for i in (0, 10, 11)] + [(4, 14, 4, 0)])
    none = spark.createDataFrame([], ITEMS)
    assert D.benchmark_matches(spark.createDataFrame(docs, SCHEMA), none).collect() == [] and D.without_benchmark(spark.createDataFrame(docs, SCHEMA), none).count() == 7
    assert D.benchmark_matches(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEMS)).collect() == []


def test_counting_by_hash_loses_no_match():
    """Every candidate that is within the allowed edits survives the count for all candidates at once."""
    r = random.Random(31)
    items = [words(r, r.randint(5, 40)) for _ in range(60)]
    found = D.Items(list(enumerate(items)))
    raw, at = "", []
    for n, t in enumerate(items):
        raw += words(r, 5) + " "
        at.append((0, n, len(raw)))
        raw += spoil(r, t, 0.19) + " "
    grams = D._grams(D._points(raw))
    where = np.array(at)
    kept = found._plausible(where, grams, np.zeros(len(at), dtype=np.int64), np.full(len(at), len(raw)))
    within = {n for _, n, start in at if D.edit_place(items[n], raw[start - 5 : start + 2 * len(items[n])], found.most(n))}
    assert within <= set(kept[:, 1].tolist()) and len(within) > 40


def test_index_of_many_items_is_that_of_each():
    r = random.Random(32)
    items = [words(r, r.randint(5, 30)) for _ in range(20)] + ["x", "漢字" * 40]
    together = D.Items(list(enumerate(items)))
    text = " ".join(words(r, 8) + " " + spoil(r, t, 0.1) for t in items)
    one = lambda i: {(n, d, s) for _, n, d, s, _ in i.matches(np.array([0, len(text.encode())]), np.frombuffer(text.encode(), dtype=np.uint8))}
    alone = set()
    for n, t in enumerate(items):
        alone |= {(n, d, s) for _, d, s in one(D.Items([(n, t)]))}
    assert one(together) == alone
