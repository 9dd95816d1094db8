import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from lakewright.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


@pytest.fixture(scope="module")
def both():
    ranks = B.read_ranks(PATH)
    return B.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(r, n):
    alphabet = "aabeeinot \n\t .,'sté漢字🙂　\xa0 \x1c01the  er<|endoftext|>"
    return "".join(r.choice(alphabet) for _ in range(n))


def test_encodes_as_the_library(both):
    mine, theirs = both
    r = random.Random(0)
    texts = [noise(r, r.randint(0, 60)) for _ in range(4000)] + ["".join(chr(r.choice([r.randrange(0x20, 0xD7FF), r.randrange(0x1F300, 0x1FAFF)])) for _ in range(80)) for _ in range(100)]
    for t in texts:
        packed = mine.encode(t)
        assert np.frombuffer(packed, dtype="<u4").tolist() == theirs.encode_ordinary(t), repr(t)
        assert mine.decode(packed) == t.encode()


def test_other_patterns_and_ranks():
    r = random.Random(9)
    ranks = B.read_ranks(PATH)
    for pattern in (r"\p{L}+(?: \p{L}+)?|\s+|.", r"[^\n]+|\n", P.PATTERN + "|x"):
        mine, theirs = B.Encoder(ranks, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for t in ["the quick brown fox", "a b c d", *(noise(r, 80) for _ in range(300))]:
            assert np.frombuffer(mine.encode(t), dtype="<u4").tolist() == theirs.encode_ordinary(t), (pattern, t)
    # "abc" cannot be reached by merges, yet a piece that is a token stays whole.
    small = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    assert np.frombuffer(B.Encoder(small, P.PATTERN).encode("abc abcd"), dtype="<u4").tolist() == tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=small, special_tokens={}).encode_ordinary("abc abcd")


def test_every_prefix_and_append(both):
    mine, theirs = both
    data = " unbelievably".encode()
    piece = B.Piece(mine.v)
    for i in range(len(data)):
        piece.append(data[i : i + 1])
        assert piece.tokens() == theirs._encode_single_piece(data[: i + 1])
    whole = B.Piece(mine.v, data)
    assert [whole.tokens(i) for i in range(1, len(data) + 1)] == [theirs._encode_single_piece(data[:i]) for i in range(1, len(data) + 1)]


def test_edits_reencode_nearby_only(both):
    mine, theirs = both
    r = random.Random(3)
    for _ in range(400):
        text = noise(r, r.randint(0, 90))
        e = B.Encoded(mine, text)
        a = r.randint(0, len(text))
        b = r.randint(a, min(len(text), a + 5))
        new = noise(r, r.randint(0, 5))
        e.edit(a, b, new)
        assert e.text == text[:a] + new + text[b:]
        assert np.frombuffer(e.packed, dtype="<u4").tolist() == theirs.encode_ordinary(e.text)
    long = B.Encoded(mine, "the quick brown fox " * 500)
    assert long.edit(5000, 5003, "cat") < 10


def test_query_rows(spark, both):
    _, theirs = both
    texts = ["hello world", "", None, "  two  spaces ", "x" * 5000, "hello world"]
    rows = [(i if i else None, t, "k") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in B.encoded(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN).collect()}
    for i, t, _ in rows:
        ids = np.array(theirs.encode_ordinary(t or ""), dtype="<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = B.with_tokens(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN).collect()
    assert tokens[0].asDict().keys() == {"doc_id", "text", "n_tokens", "token_ids"}
    assert all(r["token_ids"] == theirs.encode_ordinary(r["text"] or "") for r in tokens)
    assert B.encoded(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []
