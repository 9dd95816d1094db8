"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

The CGK walk copies a string to an output of fixed length: at output step j it
writes the current byte and then moves on by the random bit R_j(byte).  Two
strings at edit distance k stay, with good probability, at Hamming distance
O(k**2), because after an edit both walks meet again.  Here

* windows start at every word of a text and at every word of every item, and at every
  code point of words over ``LONG`` bytes (scripts without spaces, URLs, code);
* each repetition walks with its own R and keys the window by some sampled outputs
  (``WALKS``: steps, samples, repetitions).  A key shared with an item's window says where
  in the text the item would begin.  Items under ``SHORT`` bytes have few windows and
  get the shorter and more walks of ``SHORT_WALKS`` besides;
* around every such place an item-sized window (plus the allowed edits) is
  verified.  A match keeps most of the item's q-grams near their places: they are counted by hash for all
  candidates at once, then exactly (neither rejects a match that keeps the key's place), and last comes Myers'
  bit-parallel edit distance over code points, which is exact.

An item is missed if no window survives in any repetition, so the search is not complete.
Measured at ``MAX_EDITS``, a fifth of the characters edited: random edits are found to 0.9 at 5 words and to 0.98 or more
from 8 words on; substitutions of every fifth character, which spoil every window, to 0.67 at 5 words, 0.85 at 8, 0.97 at 12, 0.71 at
20 (items of 100 bytes and more have the longer walks only) and 0.97 at 40.  Fewer samples find more: with 10 of 24
outputs the short items reach 0.83 to 1, at 2.7 times the candidates.  Items under ``TINY`` bytes are cut into one more
piece than edits are allowed, so that one occurs unedited, and all pieces' places are verified: complete.

Windows walk by look-ups, one for each byte they pass, from states that those of the same first bytes share.
The index is built in arrays, all items at once, and kept in the Python worker from task to task.
The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_BYTES`` on
average, each broadcast and held against all rows, so its size is bounded whatever the
benchmark's; the corpus is read once for each block.

Defined results: null and empty texts hold nothing; null or empty items are
never found; a null id stays null; equal items are each reported; repeated rows
are reported each.  Among equally good places the first is told.  Very long texts are searched
whole; extra columns are ignored, or kept by `without_benchmark`; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import cut, map_arrow, table
from lakewright.llm._words import U, mix, slices, tokens

#: (steps, sampled outputs, repetitions) of the walks, for all items and more for those under SHORT bytes.
WALKS, SHORT_WALKS, SHORT = (40, 12, 8), (24, 12, 12), 100
MAX_EDITS = 0.2
TINY = 24
LONG = 16
BLOCK_BYTES = 4 << 20
#: Outputs after which windows that no item has are dropped: of indexes with FEW windows or less, and of others.
EARLY_FEW, EARLY, FEW = 6, 7, 512
_TILE, _GRAM, _HASHED, _RANGES = 1 << 17, 3, 1 << 12, 1 << 16
#: No item of TINY bytes or more has as many stretches: its length and twice its edits, by its edits.
_STRETCHES = 16


def _walks(steps: int, samples: int, repeats: int, seed: int = 8):
    """Per repetition: multipliers and offsets of R_j, and which outputs are sampled."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(repeats):
        mul = rng.integers(0, 128, steps, dtype=np.uint8) * 2 + 1
        add = rng.integers(0, 256, steps, dtype=np.uint8)
        sampled = np.zeros(steps, dtype=bool)
        sampled[rng.choice(steps, samples, replace=False)] = True
        out.append((mul.astype(np.uint8), add, sampled))
    return out


def window_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte starts of all words, and of all code points of words over LONG bytes."""
    starts, ends, _ = tokens(offsets, data)
    long = ends - starts > LONG
    if not long.any():
        return starts
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts[long]] += 1
    step[ends[long]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    inside &= (data & 0xC0) != 0x80
    inside[starts] = True
    return np.flatnonzero(inside)


#: A window's state in one number: from the lowest bit 16 bits of the step in rows of 256 bytes, 8 bits of the bytes it has passed,
#: 40 bits of the hash of its sampled outputs.
_STEP, _PASSED, _HASH = U(0xFFFF), U(16), U(24)
#: Bytes of a window's beginning, and bytes after it that are fetched once for all walks.
_BEGIN, _SHARED = 4, 12


def _codes(walk) -> np.ndarray:
    """What each byte adds to a state as each step's output: drawn numbers, so windows of the same sampled
    outputs have the same sum and others almost surely another."""
    sampled = walk[2]
    out = np.zeros((len(sampled), 256), dtype=U)
    out[sampled] = (mix(np.arange(1, sampled.sum() * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15)) << _HASH).reshape(-1, 256)
    return out


def _early(walk, windows: int) -> int:
    """The step after which enough outputs are sampled to tell most windows from so many."""
    return _after(walk, EARLY if windows > FEW else EARLY_FEW)


def _after(walk, outputs: int) -> int:
    return int(np.flatnonzero(walk[2])[outputs - 1]) + 1


def _stages(walk, windows: int) -> list[int]:
    """The steps after which windows that no item has are dropped: early, half the outputs later, at the end."""
    few = EARLY if windows > FEW else EARLY_FEW
    return [_early(walk, windows), _after(walk, (few + int(walk[2].sum())) // 2), len(walk[0])]


def walk_states(data: np.ndarray, starts: np.ndarray, walk, stops: list[int], begun: np.ndarray | None = None) -> list[np.ndarray]:
    """The states of the windows at starts after each of the stops; begun is told the states after each step to the first of them."""
    mul, add, _ = walk
    padded, codes, out = np.concatenate([data, np.zeros(len(mul) + 1, dtype=np.uint8)]), _codes(walk), []
    pos, state = starts.astype(np.int64), np.zeros(len(starts), dtype=U)
    for j in range(len(mul)):
        c = padded[pos]
        state += codes[j][c] + U(256)
        move = (c * mul[j] + add[j]) >> np.uint8(7)
        pos += move
        state += move.astype(U) << _PASSED
        if begun is not None and j < stops[0]:
            begun[_begun(state)] = True
        if j + 1 in stops:
            out.append(state.copy())
    return out


def walk_keys(data: np.ndarray, starts: np.ndarray, walk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows at starts by the first sampled outputs and by all, and the byte each walk ends on."""
    early, end = walk_states(data, starts, walk, [_early(walk, len(starts)), len(walk[0])])
    return early >> _HASH, end >> _HASH, starts + _passed(end)


def _passes(walk, begin: int, end: int) -> np.ndarray:
    """What a byte adds to a state that meets it at each step from begin on: all its outputs until the walk moves on
    or has made step end.  So a window takes one look-up for each byte it passes, about half its steps."""
    mul, add, _ = walk
    codes, byte = _codes(walk), np.arange(256, dtype=np.uint8)
    table = np.zeros((end + 1, 256), dtype=U)
    for j in range(end - 1, begin - 1, -1):
        move = (byte * mul[j] + add[j]) >> np.uint8(7)
        table[j] = codes[j] + U(256) + np.where(move, U(1) << _PASSED, table[j + 1])
    return table.ravel()


def _pass(table: np.ndarray, state: np.ndarray, columns) -> None:
    """Take states over columns of bytes, in place.  States at the table's last step stay."""
    at, more = np.empty(len(state), dtype=U), np.empty(len(state), dtype=U)
    for column in columns:
        np.bitwise_and(state, _STEP, out=at)
        at += column
        np.take(table, at.view(np.int64), out=more, mode="wrap")
        state += more


def _passed(state: np.ndarray) -> np.ndarray:
    return ((state >> _PASSED) & U(0xFF)).view(np.int64)


def _finish(table: np.ndarray, end: int, rounds: int, state: np.ndarray, padded: np.ndarray, starts: np.ndarray) -> None:
    """Take states to the table's last step, in place: some rounds with all, then with those that need more."""
    late = np.flatnonzero((state & _STEP) < U(end << 8))
    while len(late):
        rest = state.take(late, mode="clip")
        _pass(table, rest, _following(padded, starts.take(late, mode="clip") + _passed(rest), rounds))
        state[late] = rest
        late, rounds = late.take(np.flatnonzero((rest & _STEP) < U(end << 8)), mode="clip"), 3


def _following(padded: np.ndarray, pos: np.ndarray, rounds: int):
    for _ in range(rounds):
        yield padded.take(pos, mode="clip")
        pos += 1


class _Keys:
    """The keys of all items' windows under one walk."""

    def __init__(self, walk, data: np.ndarray, starts: np.ndarray, limits: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        """Items' windows at starts, if their walks end within limits."""
        stops, many = _stages(walk, len(starts)), len(starts) > FEW
        #: Which states windows of few items have on the way to the first stop.
        self.begun = None if many else np.zeros(1 << 20, dtype=bool)
        states = walk_states(data, starts, walk, stops, self.begun)
        whole = starts + _passed(states[-1]) <= limits
        keys, items, places = (states[-1] >> _HASH)[whole], items[whole], places[whole]
        order = np.lexsort((places, items, keys))
        self.walk, self.keys = walk, keys[order]
        #: Item number and code point of every window, by key.
        self.places = np.stack([items[order], places[order]], axis=1).astype(np.int32)
        #: Per stop its steps, look-ups, and the first bits of the hashes that items' windows have after it.
        self.stages, begin = [], 0
        for end, state in zip(stops, states, strict=True):
            seen = np.zeros(1 << 18, dtype=bool)
            seen[(state[whole] >> U(46)).view(np.int64)] = True
            self.stages.append((begin, end, _passes(walk, begin, end), seen))
            begin = end

    def beginnings(self, bytes_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The states of windows that begin with such bytes, once those are passed, and whether items can have such windows."""
        state = np.zeros(len(bytes_[0]), dtype=U)
        _pass(self.stages[0][2], state, bytes_)
        return state, None if self.begun is None else self.begun.take(_begun(state), mode="clip")

    def hits(self, padded: np.ndarray, starts: np.ndarray, columns: list[np.ndarray], which: np.ndarray, begun: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, index into places) of windows with equal keys; which are their beginnings, columns the bytes
        after those.  Windows whose first outputs no item has are dropped on the way."""
        if self.begun is None:
            left, state = np.arange(len(starts)), begun[0].take(which, mode="clip")
            _pass(self.stages[0][2], state, columns[: -(-2 * self.stages[0][1] // 3) - _BEGIN])
        else:
            left = np.flatnonzero(begun[1].take(which, mode="clip"))
            state = begun[0].take(which.take(left, mode="clip"), mode="clip")
        for begin, end, table, seen in self.stages:
            _finish(table, end, -(-3 * (end - begin) // 5) if begin else 3, state, padded, starts.take(left, mode="clip"))
            good = np.flatnonzero(seen.take((state >> U(46)).view(np.int64), mode="clip"))
            left, state = left.take(good, mode="clip"), state.take(good, mode="clip")
        key = state >> _HASH
        first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = last - first
        return np.repeat(left, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _begun(state: np.ndarray) -> np.ndarray:
    """20 bits of a state's hash and step."""
    return ((state >> U(44)) ^ ((state & _STEP) * U(0x9E3779B1) & U(0xFFFFF))).view(np.int64)


def edit_place(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of item inside text, the first such end, or
    None if it needs more than most edits.  Myers' algorithm on one big integer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        hp, hn = down | ~(d | up) & full, up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(d | hp) & full, hp & d
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def locate(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence, shortest on a tie of starts."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if (found := edit_place(item, text, most)) is None:
        return None
    distance, end = found
    back = edit_place(item[::-1], text[:end][::-1], distance)
    return distance, end - (back[1] if back else len(item)), end


class Items:
    """A block of benchmark items, hashed for search."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        by_text: dict[str, list] = {}
        for i, t in rows:
            if t:
                by_text.setdefault(t, []).append(i)
        self.texts = list(by_text)
        self.ids = [sorted(set(v), key=lambda x: (x is None, x or 0)) for v in by_text.values()]
        raw = [t.encode() for t in self.texts]
        self.tiny, self._grams = None, {}
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.allowed = np.array([self.most(n) for n in range(len(self.texts))], dtype=np.int64)
        walks = [(w, False) for w in _walks(*WALKS)]
        if any(TINY <= len(b) < SHORT for b in raw):
            walks += [(w, True) for w in _walks(*SHORT_WALKS)]
        for n, b in enumerate(raw):
            if len(b) < TINY:
                self._add_tiny(n, self.texts[n])
        if self.tiny:
            self.tiny.make_automaton()
        # All longer items end to end; a walk that leaves its item is no window.
        numbers = np.array([n for n, b in enumerate(raw) if len(b) >= TINY], dtype=np.int64)
        data = np.frombuffer(b"".join(raw[n] for n in numbers), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(raw[n]) for n in numbers], dtype=np.int64)])
        starts = window_starts(offsets, data)
        item = np.searchsorted(offsets, starts, side="right") - 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        place = points[starts] - points[offsets[item]]
        few = np.diff(offsets)[item] < SHORT if len(numbers) else np.zeros(0, dtype=bool)
        self.tables = []
        for walk, short in walks:
            those = np.flatnonzero(few) if short else np.arange(len(starts))
            table = _Keys(walk, data, starts[those], offsets[item[those] + 1], numbers[item[those]], place[those])
            if len(table.keys):
                self.tables.append(table)

    def grams(self, n: int) -> tuple[np.ndarray, ...]:
        """The q-grams of an item, made when it is first asked for: by hash, as bits the stretches of as many places as edits are
        allowed within reach of which it has one; their places in the order of their hashes, and where those of each hash
        begin; and in their own order the hashes and the q-grams."""
        if n not in self._grams:
            grams, most = _grams(_points(self.texts[n])), max(self.most(n), 1)
            own, at = _hashed(grams), np.arange(len(grams))
            near = np.zeros((_STRETCHES, _HASHED), dtype=bool)
            for k in range(3):
                near[np.minimum(at // most + k, (at + 2 * self.most(n)) // most), own] = True
            mask = (near * (1 << np.arange(_STRETCHES))[:, None]).sum(axis=0).astype(np.uint16)
            begin = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=_HASHED))])
            self._grams[n] = mask, np.argsort(own, kind="stable").astype(np.int32), begin.astype(np.int32), own.astype(np.int16), grams
        return self._grams[n]

    def _near(self, found: np.ndarray, hashed: np.ndarray, first: np.ndarray, last: np.ndarray):
        """For the candidates, in parts of bounded memory, (which, a row of text places for each, which of these have by hash a q-gram
        that the item has about there).  Collisions and coarse places only add some; first and last bound the candidates' rows."""
        n, at = found[:, 1], found[:, 2]
        most, share = self.allowed[n], 1 / np.maximum(self.allowed[n], 1)
        lo, hi = np.maximum(first, at - most), np.minimum(last - _GRAM + 1, at + self.sizes[n] + most)
        items, which = np.unique(n, return_inverse=True)
        masks = np.concatenate([np.zeros(0, dtype=np.uint16), *(self.grams(i)[0] for i in items.tolist())])
        # Candidates with places of like number together.
        width = np.maximum(hi - lo, 0)
        order = np.argsort(width, kind="stable")
        a = 0
        while a < len(order):
            b = min(len(order), a + max(1, _RANGES // max(1, int(width[order[a]]))))
            while b - a > 1 and (b - a) * width[order[b - 1]] > 2 * _RANGES:
                b = (a + b) // 2
            those = order[a:b]
            place = lo[those, None] + np.arange(width[those[-1]])
            # Halves between whole numbers by whole numbers: never so near a whole number that rounding matters.
            stretch = ((place - ((at - most)[those, None] - 0.5)) * share[those, None]).astype(np.uint16)
            hit = masks.take(hashed.take(place, mode="clip") + which[those, None] * _HASHED, mode="clip") >> stretch
            yield those, place, ((hit & np.uint16(1)) > 0) & (place < hi[those, None])
            a = b

    def _plausible(self, found: np.ndarray, grams: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Candidates around which the text has as many of the item's q-grams, near their places, as a match must keep: counted by
        hash and for all candidates at once; first and last bound their rows.  No match is lost."""
        need = self.sizes[found[:, 1]] - (_GRAM - 1) - _GRAM * self.allowed[found[:, 1]]
        good = need <= 0
        for those, _, hit in self._near(found, _hashed(grams), first, last):
            good[those] |= hit.sum(axis=1) >= need[those]
        return found[good]

    def _add_tiny(self, n: int, t: str) -> None:
        """One more piece than edits are allowed: one of them occurs unedited."""
        self.tiny = self.tiny or ahocorasick.Automaton()
        count = self.most(n) + 1
        cuts = [len(t) * i // count for i in range(count + 1)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            there = self.tiny.get(t[i:j], None)
            if there is None:
                self.tiny.add_word(t[i:j], there := [])
            there.append((n, j))

    def most(self, n: int) -> int:
        return int(MAX_EDITS * len(self.texts[n]))

    def candidates(self, offsets: np.ndarray, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Distinct (row, item, code point where the item would begin), counted over all rows;
        before counts the code points before each byte."""
        starts = window_starts(offsets, data)
        padded = np.concatenate([data, np.zeros(max((len(t.walk[0]) for t in self.tables), default=0) + _BEGIN + _SHARED, dtype=np.uint8)])
        # Texts have few different beginnings of windows: each is walked once.
        four = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))[starts] if len(starts) else np.zeros(0, dtype=np.uint32)
        four, which = np.unique(four, return_inverse=True)
        bytes_ = [(four >> np.uint32(8 * i) & np.uint32(0xFF)).astype(U) for i in range(_BEGIN)]
        begun = [t.beginnings(bytes_) for t in self.tables]
        found = []
        for lo in range(0, len(starts), _TILE):
            tile, part = starts[lo : lo + _TILE], which[lo : lo + _TILE]
            columns = [padded[tile + i].astype(U) for i in range(_BEGIN, _BEGIN + _SHARED)]
            for table, those in zip(self.tables, begun, strict=True):
                at, place = table.hits(padded, tile, columns, part, those)
                if len(at):
                    found.append(np.stack([tile[at], table.places[place, 0], before[tile[at]] - table.places[place, 1]], axis=1))
        if not found:
            return np.zeros((0, 3), dtype=np.int64)
        got = np.concatenate(found)
        got[:, 0] = np.searchsorted(offsets, got[:, 0], side="right") - 1
        return np.unique(got, axis=0)

    def matches(self, offsets: np.ndarray, data: np.ndarray):
        """(row, item number, distance, start, end): code points within the row's text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = before[offsets].tolist()
        found = self.candidates(offsets, data, before)
        text = grams = None
        if len(found):
            text = data.tobytes().decode("utf-8", "replace")
            grams = _grams(_points(text))
            found = self._plausible(found, grams, before[offsets[found[:, 0]]], before[offsets[found[:, 0] + 1]])
            found = found[self._similar(found, grams, before[offsets[found[:, 0]]], before[offsets[found[:, 0] + 1]])]
        for row, n, at in found.tolist():
            most, size = self.most(n), len(self.texts[n])
            # Verified places reach two allowances either way, so a candidate within one of the last adds nothing.
            if at <= done.get((row, n), -1 << 60) or best.get((row, n), (1,))[0] == 0:
                continue
            first, last = bounds[row], bounds[row + 1]
            done[row, n] = at + most
            lo = max(first, at - 2 * most)
            if got := locate(self.texts[n], text[lo : max(lo, min(last, at + size + 2 * most))], most):
                told = (got[0], lo - first + got[1], lo - first + got[2])
                if told < best.get((row, n), (1 << 60,)):
                    best[row, n] = told
        if self.tiny:
            for row in range(len(offsets) - 1):
                text, done = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace"), {}
                for end, pieces in self.tiny.iter(text):
                    for n, j in pieces:
                        at, most = end + 1 - j, self.most(n)
                        if at <= done.get(n, -1 << 60) or best.get((row, n), (1,))[0] == 0:
                            continue
                        done[n] = at + most
                        first = max(0, at - 2 * most)
                        if found := locate(self.texts[n], text[first : max(0, at) + len(self.texts[n]) + 2 * most], most):
                            told = (found[0], first + found[1], first + found[2])
                            if told < best.get((row, n), (1 << 60,)):
                                best[row, n] = told
        return sorted((row, n, *told) for (row, n), told in best.items())

    def _similar(self, found: np.ndarray, grams: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Positional q-gram lemma: each edit spoils at most q of the item's q-grams; the others occur
        in the text no farther from where the item would have them than edits may shift.  All candidates are judged
        together; first and last bound their rows."""
        most, size = self.allowed[found[:, 1]], self.sizes[found[:, 1]]
        need = size - (_GRAM - 1) - _GRAM * most
        items, which = np.unique(found[:, 1], return_inverse=True)
        of = [self.grams(n) for n in items.tolist()]
        offset = np.cumsum([0] + [len(x[4]) for x in of])
        order, begins, whole = (np.concatenate([np.zeros(0, dtype=d), *(x[k] for x in of)]) for k, d in ((1, np.int32), (2, np.int32), (4, np.int64)))
        hashed, good = _hashed(grams), need <= 0
        for those, place, hit in self._near(found, hashed, first, last):
            cell = np.flatnonzero(hit)
            row, place = cell // hit.shape[1], place.ravel().take(cell)
            cand = those.take(row)
            # Every place of the text with every place of the item of the same hash: the n-th pair is of cell and place of the item.
            slot = hashed.take(place) + which.take(cand) * (_HASHED + 1)
            begin = begins.take(slot)
            times = begins.take(slot + 1) - begin
            pair = np.repeat(np.arange(len(cell)), times)
            at = order.take(np.arange(len(pair)) + np.repeat(offset.take(which.take(cand)) + begin - np.cumsum(times) + times, times))
            far = np.repeat(place - found[:, 2].take(cand), times) - at
            kept = np.flatnonzero(np.abs(far, out=far) <= np.repeat(most.take(cand), times))
            pair, at = pair.take(kept), at.take(kept)
            same = whole.take(offset.take(which.take(cand)).take(pair) + at) == grams.take(place).take(pair)
            seen = np.zeros((len(those), int(size[those].max())), dtype=bool)
            seen[row.take(pair[same]), at[same]] = True
            good[those] |= seen.sum(axis=1) >= need[those]
        return good


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashed(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(U) * U(0x9E3779B97F4A7C15)) >> U(52)).astype(np.int64)


def _grams(points: np.ndarray) -> np.ndarray:
    """Every q-gram of code points as a number."""
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:] if len(p) >= _GRAM else p[:0]


_PAIRS = "doc_id long, item_id long, distance long, start long, end long"


_WORKER: dict = {}


def _items(block) -> Items:
    """A block's index, kept in the Python worker until it meets another block."""
    if _WORKER.get("block") != block.id:
        _WORKER.clear()
        _WORKER.update(block=block.id, items=Items(block.value[1]))
    return _WORKER["items"]


def _pairs(block):
    def run(batches):
        items = _items(block)
        for batch in batches:
            ids = batch.column(0)
            for lo, _, offsets, data in slices(batch.column(1)):
                rows = [(ids[lo + row].as_py(), i, d, s, e) for row, n, d, s, e in items.matches(offsets, data) for i in items.ids[n]]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def _clean(block, at: int):
    def run(batches):
        items = _items(block)
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column(at)):
                keep = np.ones(hi - lo, dtype=bool)
                keep[[m[0] for m in items.matches(offsets, data)]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return run


@dataclass(frozen=True)
class Block:
    """A broadcast block of items under a name of its own."""

    id: str
    rows: object

    @property
    def value(self):
        return self.id, self.rows.value


def _blocks(benchmark: DataFrame):
    """The distinct items in blocks of about BLOCK_BYTES, each as a broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and text != ''").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]
        yield Block(uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(rows))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs and item it holds within MAX_EDITS of the item's
    length: doc_id, item_id, edit distance, and where (code points, end exclusive)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark):
        part = map_arrow(texts, _pairs(block), _PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as they are."""
    for i, block in enumerate(_blocks(benchmark)):
        # One block a stage, so that a worker holds one index at a time.
        docs = cut(docs) if i else docs
        docs = map_arrow(docs, _clean(block, docs.columns.index("text")), docs.schema)
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
