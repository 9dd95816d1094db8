"""Candidates of an item are judged together, and as each alone would be."""

import random

import numpy as np

from lakewright.llm import decontaminate as D


def _alone(items, n, grams, at, first, last):
    """By the definition: grams of the item that the text has no farther away than edits may shift."""
    own, most = items.grams(n)[4].tolist(), items.most(n)
    lo, hi = max(first, at - most), min(last - 2, at + len(own) + most)
    kept = sum(any(lo <= p < hi and grams[p] == g for p in range(at + i - most, at + i + most + 1)) for i, g in enumerate(own))
    return kept >= len(own) - 3 * most


def test_candidates_are_judged_together_as_alone():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (8, 20, 60)]
    items = D.Items(list(enumerate(texts)))
    rows = []
    for t in texts * 2:
        spoilt = "".join(c if rng.random() > 0.1 else rng.choice("xyz") for c in t)
        rows.append(" ".join(word() for _ in range(30)) + " " + spoilt + " " + t[: len(t) // 2])
    grams, starts = D._grams(D._points("".join(rows))), np.cumsum([0] + [len(r) for r in rows])
    found = np.array([(r, n, rng.randint(int(starts[r]) - 5, int(starts[r + 1]))) for r in range(len(rows)) for n in range(3) for _ in range(25)]
                     + [(r, r % 3, int(starts[r]) + rows[r].index(" ") + d) for r in range(len(rows)) for d in range(0, 160, 4)])
    got = items._similar(found, grams, starts[found[:, 0]], starts[found[:, 0] + 1])
    assert got.tolist() == [_alone(items, n, grams.tolist(), at, int(starts[r]), int(starts[r + 1])) for r, n, at in found.tolist()]
    assert got.any() and not got.all()


def test_few_windows_are_told_apart_by_fewer_outputs():
    walk = D._walks(*D.SHORT_WALKS)[0]
    assert D._early(walk, D.FEW) < D._early(walk, D.FEW + 1)
