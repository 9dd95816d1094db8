import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm import toxicity as X

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.StringType()), T.StructField("score", T.StringType())])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    r = random.Random(5)
    terms = ["idiot", "moron", "pathetic", "vequ", "lowei", "abcabcab", "aaaaa"]
    lexicon = X.Lexicon(terms)
    words = ["", "idiot", "idiots", "1diot", "idoit", "idt", "vequeux", "vequ", "veq", "pathtic", "patheticc", "pthetc", "lowe", "pathet1cally", "pathxtiqally"]
    words += ["".join(r.choice("abidotmrnpheclowvqu") for _ in range(r.randint(1, 10))) for _ in range(1500)]
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                k, i = r.randrange(3), r.randrange(len(w) + 1)
                w[i : i + (k != 0)] = [r.choice("abiot")] if k != 2 else []
            words.append("".join(w))
    for w in words:
        begins = lambda t: len(t) >= 8 and any(distance(w[:i], t) <= 1 for i in range(len(w) + 1))  # noqa: B023, E731
        want = 2 if any(w.startswith(t) for t in terms) else int(any(distance(w, t) <= X.Lexicon.edits(t) or begins(t) for t in terms))
        assert lexicon.match(w) == want, w


def test_quotation_weighs_less():
    s = X.Scorer(["idiot"], None)
    abuse, quote, said = (s.features(t)[0] for t in ("you are an idiot and that is all", 'the word "idiot" is short', "he said idiot and left"))
    assert abuse > quote == said > 0
    assert s.features("you are an idi0t!!!")[1] > 0 and s.features("a fine day") == (0, 0, 0) == s.features(None)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = X.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    right, n, hit, toxic = got.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*"), F.count_if(F.expr("predicted = 1 and toxic = 1")), F.count_if(F.expr("toxic = 1"))).first()
    assert right / n > 0.97 and hit >= 0.85 * toxic


def test_copies_in_the_sample_mark_no_words():
    rows = [(1, 1, [10, 20]), (2, 1, [11, 20]), (3, 1, [11, 21]), (4, 0, [21, 5]), (5, 0, [6, 7]), (6, 0, []), (9, 0, [5])]
    assert X._apart(rows) == [1, 4, 5, 6]


def test_chance_words_of_toxic_copies_are_no_terms(spark):
    r = random.Random(11)
    fill = lambda n: [f"w{r.randrange(300)}x" for _ in range(n)]
    base = [*fill(40), "qqchance", "zzchance", *fill(40)]
    rows = []
    for i in range(300):
        w = fill(80)
        if i % 3 == 0:
            w.insert(r.randrange(80), "moronic")
        elif i % 3 == 1:
            w = list(base)
            w[r.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w), None, None))
    labels = spark.createDataFrame([(i, int(i % 3 < 2)) for i in range(300)], "doc_id long, toxic int")
    terms, _, _ = X.learn(spark.createDataFrame(rows, SCHEMA), labels)
    assert "moronic" in terms and not any("chance" in t for t in terms)


def test_misspelt_terms_alone_are_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = X.learn(docs, labels)
    scorer = X.Scorer(*model)
    texts = [r[0] for r in docs.join(labels, "doc_id").where("toxic = 0 and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("text").collect()]
    clean = [t for t in texts if not scorer.features(t)[0]]
    assert len(clean) > 0.9 * len(texts) and sum(scorer.score(t) >= 0.5 for t in texts) <= 0.01 * len(texts)
    short = [t for t in clean if len(t.split()) <= 200]
    bad = "1diot stup1d pathet1c"
    assert short and all(scorer.score(f"{t} {bad}") >= 0.5 for t in short)
    nine = bad + " w0rthless disgust1ng idi0t stvpid pathetlc worthles"
    assert all(scorer.score(f"{t} {nine}") >= 0.5 for t in clean)
    assert all(scorer.score(t) < scorer.score(f"{t} {bad}") <= scorer.score(f"{t} idiot stupid pathetic") for t in clean)


def test_odd_rows(spark):
    rows = [(i, f"plain words number {i} here " + ("you moronic fool" if i % 4 == 0 else "kind friend"), None, "x") for i in range(300)]
    rows += [(None, None, None, None), (900, "", None, None), (901, "so moronic", None, None), rows[0]]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(0, 1, 0), (None, None, 1), (7, 0, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.score_documents(spark.createDataFrame(rows, SCHEMA), labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[901]["predicted"] == 1 and by[900]["predicted"] == 0 and by[None]["predicted"] == 0
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    kept = X.without_toxic(spark.createDataFrame(rows, SCHEMA), labels)
    assert kept.columns == ["doc_id", "text", "toxic", "score"] and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}
    none = X.score_documents(spark.createDataFrame(rows, SCHEMA), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and X.score_documents(spark.createDataFrame([], SCHEMA), labels).collect() == []
