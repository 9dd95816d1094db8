import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm import language_id as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def naive(sample, text):
    """Greedy longest matches by substring search, over the bytes of the whole text."""
    sample, part, n, i = sample.lower().encode(), text.lower().encode(), 0, 0
    while i < len(part):
        j = i + 1
        while j <= len(part) and part[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_match_substring_search():
    r = random.Random(1)
    make = lambda a, n: "".join(r.choice(a) for _ in range(n))
    samples = {"x": make("abcd ", 700), "y": make("bcde ", 500), "z": make("語文字漢🙂 a", 300)}
    parser = L.Parser(samples)
    texts = [make("abcdef 字漢🙂é", r.choice([1, 5, 300, 1300, 4000])) for _ in range(25)] + ["", "zzz", samples["x"][100:300], samples["x"] * 5, samples["z"] * 9]
    got = parser.phrases([parser.codes(t) for t in texts])
    assert got.tolist() == [[naive(samples[k], t) for k in ("x", "y", "z")] for t in texts]


def test_scripts_of_many_characters_are_told_apart():
    r = random.Random(2)
    words = lambda lo: ["".join(chr(r.randrange(lo, lo + 2500)) for _ in range(r.randint(1, 3))) for _ in range(250)]
    one, two, smile = words(0x4E00), words(0x4E00), words(0x1F300)
    say = lambda w, n: "".join(r.choice(w) for _ in range(n))
    parser = L.Parser({"one": say(one, 900), "smile": say(smile, 900), "two": say(two, 900)})
    texts = [say(w, 120) for w in (one, smile, two) for _ in range(20)]
    langs, scores = parser.judge(["abc " + t for t in texts])
    assert langs == ["one"] * 20 + ["smile"] * 20 + ["two"] * 20 and min(scores) > 0.2


def test_automaton_accepts_exactly_the_substrings():
    nexts = L.suffix_automaton([1, 2, 1, 1, 2, 3])
    words, todo = set(), [((), 0)]
    while todo:
        w, s = todo.pop()
        words.add(w)
        todo += [((*w, c), t) for c, t in nexts[s].items()]
    seq = (1, 2, 1, 1, 2, 3)
    assert words == {seq[i:j] for i in range(7) for j in range(i, 7)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95


def test_odd_rows(spark):
    rows = [(i, "alpha beta gamma delta " * 9, "aa", None) for i in range(20)] + [(100 + i, "uno dos tres cuatro " * 9, "bb", "s") for i in range(20)]
    rows += [(200, None, "aa", None), (201, "", None, None), (202, "123 !!", "bb", None), (None, "alpha beta", None, None), (1, "tres dos", None, None)]
    got = L.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(200, "und"), (201, "und"), (202, "und"), (None, "aa"), (1, "bb"), (1, "aa")} <= by and all(0 <= r["score"] <= 1 for r in got)
    nothing = L.predict(spark.createDataFrame([(1, "text", None, None)], SCHEMA)).collect()
    assert nothing[0]["lang_pred"] == "und" and L.predict(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 3, 5, 12])
def test_a_language_of_few_short_texts_takes_none_from_others(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    few = [f"zuqo wixu jeqa {k} vyxo quze jixa wuqy" * (1 + 6 * (k % 2)) for k in range(n)]
    more = spark.createDataFrame([(10**6 + 4 * k + 1, t, "zz") for k, t in enumerate(few)] + [(10**7, "zuqo quze wixu jixa vyxo jeqa", None)], "doc_id long, text string, lang string")
    got = L.predict(docs.unionByName(more)).cache()
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / total > 0.95
    assert got.where("doc_id = 10000000").first()["lang_pred"] == "zz"
