"""Token alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "Ein Löwe läuft über die Straße, ça coûte 12,50 €",
    "",
    None,
    "double  spaces\tand\nlines <|endoftext|> <s> </s> <unk>",
    "日本語のテキストと emoji 🎉🎉",
    "The quick brown fox jumps over the lazy dog.",
    " leading and trailing ",
    "a",
    "▁ is a piece mark",
    "x" * 3000 + " supercalifragilistic" * 400,
]


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(sides, text):
    """n_a, n_b, written groups, links of one text, token by token."""
    a, b = sides
    byte = ta._byte_of_char()
    if not text:
        return 0, 0, "", []
    raw, got = (" " + text).encode(), []
    got.append([(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids])
    got.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    if any(b"".join(x for _, x in g) != raw for g in got):
        return 0, 0, "", []
    ends = []
    for g in got:
        at, out = 0, []
        for _, x in g:
            at += len(x)
            out.append(at)
        ends.append(out)
    groups, links, last = [], [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        now = [e.index(end) + 1 for e in ends]
        groups.append("|".join(",".join(str(i) for i, _ in g[s:t]) for g, s, t in zip(got, last, now, strict=True)))
        links.append((got[0][now[0] - 1][0], got[1][now[1] - 1][0]))
        last = now
    return len(got[0]), len(got[1]), ";".join(groups), links


def test_counts_and_groups_are_those_of_a_plain_walk(spark, sides):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "The quick fox", "y")], "doc_id long, text string, pair string").repartition(3)
    got = {r["doc_id"]: r for r in ta.aligned(docs, A, B).collect()}
    assert len(got) == len(TEXTS) + 1
    each = {i: plain(sides, t) for i, t in [*enumerate(TEXTS), (None, "The quick fox")]}
    counts = Counter(x for *_, links in each.values() for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i, (n_a, n_b, groups, links) in each.items():
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(links), len(links)), i
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r["n_best"] == sum(counts[x] == best[x[1]] for x in links)
        assert r["count_sum"] == sum(counts[x] for x in links)
        assert r["n_overlaps"] == max(0, n_a + n_b - len(links))  # each stretch between two ends is one overlapping pair


def test_written_groups_and_pairs(spark, sides):
    docs = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    row = ta.alignments(docs, A, B, groups=True).first()
    _, _, groups, links = plain(sides, TEXTS[1])
    assert row["groups"] == groups
    assert dict(zip(row["pairs"], row["times"], strict=True)) == {a * 2**32 + b: n for (a, b), n in Counter(links).items()}


def test_both_join_paths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    small = sorted(map(tuple, ta.aligned(docs, A, B).collect()))
    monkeypatch.setattr(ta, "sized", lambda df: df.hint("shuffle_merge"))
    assert sorted(map(tuple, ta.aligned(docs, A, B).collect())) == small


def test_empty_table(spark):
    assert ta.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_ranks_and_merges_give_the_same_ids(text):
    global _SIDE
    side = _SIDE = globals().get("_SIDE") or ta.ByteLevel(open(A, "rb").read())
    assert side.fast is not None
    assert side.fast.encode_ordinary(text) == side.full.encode(text, add_special_tokens=False).ids
