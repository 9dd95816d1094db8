import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from lakewright.llm import order_minhash as O
from lakewright.llm._words import U, mix

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType()), T.StructField("place", T.StringType())])


def slow(text):
    """The same sketch, element by element, each of its own order."""
    k = min(len(text), O.K)
    if not text:
        return [0] * O.SKETCHES
    one = lambda x: int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])
    seen, elements = {}, []
    for i in range(len(text) - k + 1):
        g = one(sum((ord(c) + 1) * int(O._POWERS[j]) for j, c in enumerate(text[i : i + k])) + k) >> 24
        n = seen[g] = seen.get(g, -1) + 1
        elements.append((one((g << 24) + n * 0xD1B54A32D192ED03) >> 24, i))
    out = []
    for sketch in range(O.SKETCHES):
        order = lambda x: ((x[0] - (sketch << 34)) % (1 << 40), x[1])  # noqa: B023, E731
        chosen = [e for e, _ in sorted(sorted(elements, key=order)[: O.PICK], key=lambda x: x[1])]
        if len(chosen) == 1:
            out.append((one(chosen[0] ^ 0x5851F42D4C957F2D) & 0xFFFF) or 1)
        else:
            out.append((one(one(chosen[0]) + chosen[1]) & 0xFFFF) or 1)
    return out


def test_matches_element_by_element():
    r = random.Random(1)
    for t in ["", "a", "abcdefg", "abcdefgh", "ab" * 60, "é🙂" * 9] + ["".join(r.choice("abc de") for _ in range(r.randint(1, 400))) for _ in range(30)]:
        assert O.fingerprint(O._points(t)).tolist() == slow(t), t


def test_likeness_follows_edits_and_order():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    f = lambda w: O.fingerprint(O._points(" ".join(w)))
    base, swapped = f(words), f(words[200:] + words[:200])
    one = O.likeness(base, f(words[:100] + ["zzzzzz"] + words[101:]))
    half = O.likeness(base, f(words[:200] + ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]))
    assert one > 0.9 > half > O.likeness(base, f([w[::-1] for w in words])) and O.likeness(base, base) == 1.0
    # The same k-mers in another order: only a sketch that keeps order tells them apart.
    assert O.likeness(base, swapped) < 0.8


def test_short_texts_keep_order_too():
    """A moved block lowers the likeness of 100 characters as sketches of independent orders do."""
    r = random.Random(12)

    def independent(a, b, n=600):
        def tuples(t):
            seen, out = {}, []
            for i in range(len(t) - O.K + 1):
                k = seen[t[i : i + O.K]] = seen.get(t[i : i + O.K], -1) + 1
                out.append((t[i : i + O.K], k))
            return out

        x, y = tuples(a), tuples(b)
        same = 0
        for _ in range(n):
            order = {e: r.random() for e in {*x, *y}}
            pick = lambda z: [e for _, _, e in sorted((i, 0, e) for i, e in enumerate(z) if e in set(sorted(z, key=order.get)[: O.PICK]))]  # noqa: B023, E731
            same += pick(x) == pick(y)
        return same / n

    got, want = [], []
    for _ in range(12):
        t = "".join(r.choice("abcdefghij") for _ in range(100))
        moved = t[50:] + t[:50]
        got.append(O.likeness(O.fingerprint(O._points(t)), O.fingerprint(O._points(moved))))
        want.append(independent(t, moved, 60))
    assert abs(sum(got) - sum(want)) / 12 < 0.1 and max(got) < 0.75


def test_ranges_of_ids(spark):
    """An outlier, the least and greatest long, and one id or null in a third of the rows."""
    ids = [*range(600), 1 << 60, -(1 << 63), (1 << 63) - 1, *[77] * 300, *[None] * 300]
    rows = [(i, f"text {i} {k % 7}", None, None) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA)
    dealt = O.next_documents(docs).groupBy("part").count().collect()
    assert max(r["count"] for r in dealt) < 200 and len(dealt) >= 12
    order = sorted(set(ids), key=lambda i: (i is not None, i or 0))
    first = {i: min(t for j, t, *_ in rows if j == i) for i in order}
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]) for r in O.fingerprints(docs).collect())
    want = []
    for i, t, *_ in rows:
        q, other = len(t) // 4, first[order[(order.index(i) + 1) % len(order)]]
        want.append((i is not None, i or 0, hashlib.sha256((t[: len(t) - q] + other[:q]).encode()).hexdigest()))
    assert got == sorted(want)


def test_pairs_with_the_next_document(spark):
    r = random.Random(3)
    texts = ["", None, "x", "same text here", "same text here"] + ["".join(r.choice("abcdé 🙂") for _ in range(r.randint(0, 200))) for _ in range(60)]
    ids = [None, *r.sample(range(0, 10**6), len(texts) - 1)]
    rows = [(i, t, "p", "q") for i, t in zip(ids, texts, strict=True)] + [(ids[7], texts[7], None, None), (ids[8], "zz other text", None, None)]
    order = sorted({i for i, *_ in rows}, key=lambda i: (i is not None, i or 0))
    first = {i: min((t or "") for j, t, *_ in rows if j == i) for i in order}
    got = O.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    left = [(x["doc_id"], x["n_chars"], x["edited_sha256"], x["fingerprint"], x["near_edited"], x["near_next"]) for x in got]
    for i, t, *_ in rows:
        t = t or ""
        other = first[order[(order.index(i) + 1) % len(order)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        a, b, c = (O.fingerprint(O._points(x)) for x in (t, edited, other))
        left.remove((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), O.as_text(a), O.likeness(a, b), O.likeness(a, c)))
    assert not left


def test_lone_and_empty(spark):
    assert O.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = O.fingerprints(spark.createDataFrame([(5, "abcdefgh", None, None)], SCHEMA)).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
