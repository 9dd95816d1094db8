"""Windows walked by look-ups are those walked step by step, at a look-up for each byte instead of each step."""

import random

import numpy as np
import pytest

from lakewright.llm import decontaminate as D


def _outputs(data, start, walk):
    """The sampled outputs of a window by the definition, and the byte its walk ends on."""
    mul, add, sampled = (x.tolist() for x in walk)
    data, out = data[start : start + len(mul) + 1] + bytes(len(mul) + 1), []
    at = 0
    for m, a, s in zip(mul, add, sampled, strict=True):
        if s:
            out.append(data[at])
        at += (data[at] * m + a) % 256 >> 7
    return bytes(out), start + at


def _words(r, n, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n))


def _case(n):
    r = random.Random(n)
    items = [(i, _words(r, 10, "abcdeé")[:95]) for i in range(n)]
    texts = [_words(r, 30, "abcdeéß漢") + " " + "".join(c if r.random() > 0.1 else "x" for c in t) + " " + t[:50] for _, t in items]
    raw = [t.encode() for t in texts]
    return items, np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8)


@pytest.mark.parametrize("n", [20, 120])
def test_candidates_are_the_windows_of_equal_outputs(n):
    items, offsets, data = _case(n)
    index = D.Items(items)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    assert {len(t.keys) > D.FEW for t in index.tables} == {n > 100}
    want, whole = set(), data.tobytes()
    # Items lie end to end, as a walk may end on the byte after its item.
    ends, own = np.cumsum([0] + [len(t.encode()) for _, t in items]), np.frombuffer("".join(t for _, t in items).encode(), dtype=np.uint8)
    for table in index.tables:
        places = {}
        for s in D.window_starts(ends, own).tolist():
            i = int(np.searchsorted(ends, s, side="right")) - 1
            out, end = _outputs(own.tobytes(), s, table.walk)
            if end <= ends[i + 1]:
                places.setdefault(out, []).append((i, len(own[ends[i] : s].tobytes().decode())))
        for s in D.window_starts(offsets, data).tolist():
            row = int(np.searchsorted(offsets, s, side="right")) - 1
            want |= {(row, i, int(before[s]) - at) for i, at in places.get(_outputs(whole, s, table.walk)[0], [])}
    assert set(map(tuple, index.candidates(offsets, data, before).tolist())) == want and len(want) > n


def test_look_ups_are_fewer_than_steps(monkeypatch):
    items, offsets, data = _case(120)
    index, looked, walk = D.Items(items), [0], D._pass

    def counted(table, state, columns, **kwargs):
        columns = [np.array(c) for c in columns]
        looked[0] += len(state) * len(columns)
        walk(table, state, columns, **kwargs)

    monkeypatch.setattr(D, "_pass", counted)
    index.candidates(offsets, data, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]))
    # Before: a look-up for each step to the first outputs, and more for windows that passed them.
    assert looked[0] < 0.9 * len(D.window_starts(offsets, data)) * sum(t.stages[0][1] for t in index.tables)
