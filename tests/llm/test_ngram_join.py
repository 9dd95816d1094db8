import random

import numpy as np
from pyspark.sql import types as T

from lakewright.llm import ngram_join
from lakewright.llm._graph import connected

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType())])


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t, *_ in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out, group = [], list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and group[j] < group[i]:
                    group[i], changed = group[j], True
    low = lambda ids: min([x for x in ids if x is not None], default=None)
    for i, (d, *_) in enumerate(rows):
        if not sets[i]:
            out.append((d, d, 0, d, 0))
            continue
        cls = low(rows[j][0] for j in range(n) if sets[j] == sets[i])
        grp = low(rows[j][0] for j in range(n) if group[j] == group[i])
        out.append((d, cls, sum(link[i]), grp, len(sets[i])))
    return out


def made(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 120, 300]))]
        for _ in range(r.choice([1, 2, 3, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w), "x", None))
            i += 1
    rows += [(i, None, None, "l"), (i + 1, "", "", ""), (None, rows[5][1], None, None), (3, rows[3][1], "again", "y")]
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_matches_brute_force_with_small_blocks(spark):
    rows = made()
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), block=4).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_one_stays_of_each_group(spark):
    rows = made(2)
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    judged = brute(rows)
    groups = {x[3] for x in judged if x[4]}
    assert len([r for r in kept if grams(r.text)]) == len(groups)
    assert {r.doc_id for r in kept if grams(r.text)} == groups
    assert len([r for r in kept if not grams(r.text)]) == len([r for r in rows if not grams(r[1])])
    assert kept[0].asDict().keys() == {"doc_id", "text", "key", "label"}


def test_unlinked_rows_of_a_shared_or_null_id_stay(spark):
    r = random.Random(4)
    text = [" ".join(f"v{r.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    # a null id copies row 3; id 7 copies row 3 and has a text of its own; null ids copy each other;
    # id 1 is the least of two groups.  Beside them: unique texts and empties of the same ids.
    rows = [(3, text[0]), (None, text[0]), (7, text[0]), (7, text[1]), (7, ""), (None, text[2]), (None, None), (None, "")]
    rows += [(None, text[3]), (None, text[3]), (None, text[4]), (1, text[5]), (11, text[5]), (1, text[6]), (12, text[6]), (1, text[7])]
    want = [(3, text[0]), (7, text[1]), (7, ""), (None, text[2]), (None, None), (None, ""), (None, text[3]), (None, text[4]), *((1, t) for t in text[5:])]
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(map(tuple, kept), key=order) == sorted(want, key=order)


def test_long_chain_is_compared_by_bucket(spark):
    # Each text overlaps its neighbours, so all are one component, but few share a bucket.
    r = random.Random(6)
    words = [f"c{r.randrange(10**6)}" for _ in range(1300)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100]), "", "") for i in range(200)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_pairs_of_an_earlier_band_are_left_to_it():
    sets = [np.arange(100, dtype=np.uint64) for _ in range(3)]
    before = np.array([[1], [1], [2]])
    counts, forest = ngram_join.links_within(sets, np.full(3, -1), np.array([1, 10, 100]), 0.8, before)
    assert counts.tolist() == [100, 100, 11] and len(forest) == 2


def test_many_near_copies_and_null_ids(spark):
    # 1,500 near copies of one text and 500 rows without an id; every near copy has an edit of its own.
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        w = list(base)
        w[r.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(None, f"alone {i} " + " ".join(f"z{r.randrange(10**6)}" for _ in range(30))) for i in range(498)]
    rows += [(None, rows[-1][1]), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(docs).collect()
    near = [x for x in got if x.doc_id is not None]
    sets = [grams(t) for _, t in rows[:40]]
    some = {x.doc_id: x.n_links for x in near}
    every = [grams(t) for _, t in rows]
    for i, s in enumerate(sets):
        assert some[i] == sum(len(s & o) >= 0.8 * len(s | o) for o in every) - 1
    assert {x.group_id for x in near} == {0}
    assert sorted(x.n_links for x in got if x.doc_id is None)[:-1] == [0] * 497 + [1] * 2
    assert ngram_join.one_per_group(docs).count() == 1 + 498


def test_columns_without_an_order_or_with_dots(spark):
    rows = [(1, "a b c d e f", {"k": 1}, "x"), (1, "a b c d e f", {"k": 1}, "w"), (2, "a b c d e f", {"k": 2}, "y"), (3, "other words", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>, `a.b` string")
    kept = ngram_join.one_per_group(docs).collect()
    assert sorted((r.doc_id, r["a.b"]) for r in kept if r.doc_id == 1) == [(1, "w")] and len(kept) == 2


def test_components_of_chains_stars_and_nothing(spark):
    r = random.Random(8)
    names = r.sample(range(10**6), 300)
    chain = list(zip(names[:150], names[1:150], strict=False))
    star = [(names[150], n) for n in names[151:250]]
    edges = spark.createDataFrame([*chain, *star, (names[260], names[261]), (None, 5), (7, 7)], "a long, b long")
    got = {x.node: x.label for x in connected(edges).collect()}
    assert len({got[n] for n in names[:150]}) == len({got[n] for n in names[150:250]}) == 1
    assert len(set(got.values())) == 3 and len(got) == 252
    assert connected(edges.where("a is null")).collect() == []


def test_empty_table(spark):
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_reaches_recall():
    bands, rows = ngram_join.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 150
