"""Word hashes: equal for equal words only, wherever they stand."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import ngram_join, substring_dedup
from lakewright.llm._words import hash_words, tokens


def hashes(raw: bytes) -> list[int]:
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _ = tokens(np.array([0, len(data)]), data)
    return hash_words(data, starts, ends).tolist()


def thue_morse(n: int) -> tuple[str, str]:
    """Two words for which polynomials modulo 2**64 agree."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\0é漢"), min_size=1, max_size=90).filter(lambda w: not w.isspace()), min_size=1, max_size=20))
def test_hashes_agree_exactly_for_equal_words(words):
    got = hashes(" ".join(words).encode())
    assert len(got) == len(words)
    assert len(set(got)) == len(set(words))
    assert got == [hashes(w.encode())[0] for w in words]


def test_words_of_all_sizes_around_the_lanes():
    words = ["x" * n for n in range(1, 80)] + ["x" * n + "\0" for n in range(1, 70)]
    assert len(set(hashes(" ".join(words).encode()))) == len(words)


def test_thue_morse_words_are_told_apart(spark):
    a, b = thue_morse(11)
    assert len({*hashes(f"{a} {b}".encode())}) == 2
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicated(docs).collect()} == {1: 0, 2: 0, 3: 20}
    five = spark.createDataFrame([(1, f"{a} c d e f"), (2, f"{b} c d e f"), (3, f"{a} c d e f")], "doc_id long, text string")
    kept = ngram_join.one_per_group(five)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
