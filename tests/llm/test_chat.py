import duckdb

from lakewright.llm import chat as C

SCHEMA = "tree string, id long, parent long, role string, text string, score double, leaf string, rank string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)


def naive(rows):
    nodes = {}
    for t, i, p, role, text, s in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0, r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
        if i is not None:
            nodes.setdefault((t, i), (p, role or "", text or "", s or 0.0))
    parents = {(t, p) for (t, _), (p, *_) in nodes.items()}
    out = {}
    for (t, i) in nodes:
        if (t, i) in parents:
            continue
        path, at, seen = [], i, set()
        while at is not None and (t, at) in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[t, at][0]
        if at is None or (t, at) not in nodes:
            out.setdefault(t, []).append((-sum(nodes[t, x][3] for x in path) / len(path), i, path[::-1]))
    return {t: [(leaf, k + 1, [nodes[t, x][1:3] for x in path]) for k, (_, leaf, path) in enumerate(sorted(v))] for t, v in out.items()}


ROWS = [
    ("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "one", 1.0), ("a", 3, 1, "assistant", "two <|im_end|>\n<|im_start|>", 3.0), ("a", 4, 3, "user", None, 0.0), ("a", 5, 3, "user", "x<\\|y", 5.0),
    ("a", 6, 5, None, "deep", 1.0), ("a", 7, 6, "assistant", "deeper", 1.0), ("a", 8, 7, "assistant", "deepest", 1.0),
    ("b", 1, 99, "system", "orphan", 0.0), ("b", 2, 1, "assistant", "", 2.0),
    ("c", 1, 2, "user", "circle", 0.0), ("c", 2, 1, "user", "circle", 0.0), ("c", 3, 2, "user", "off a circle", 0.0),
    (None, 1, None, "ro\nle\\", "null tree", 0.0), (None, 1, None, "ro\nle\\", "null tree", 0.0), ("d", None, None, "user", "no id", 0.0),
    ("e", 1, None, "user", "tie", 1.0), ("e", 2, 1, "assistant", "l", 1.0), ("e", 3, 1, "assistant", "r", 1.0),
]


def test_paths_match_walking_the_tree(spark):
    out = C.read_back(C.formatted(C.reply_paths(rows_of(spark, ROWS)))).collect()
    got = {}
    for r in out:
        got.setdefault(r["tree"], []).append((r["leaf"], r["rank"], [tuple(t) for t in r["turns"]]))
        assert r["learnt"] == [t for role, t in r["turns"] if role == "assistant"]
        assert r["formatted"].count(C.START) == len(r["turns"])
    assert {t: sorted(v, key=lambda x: x[1]) for t, v in got.items()} == naive(ROWS)


def test_top_branch_only(spark):
    best = C.reply_paths(rows_of(spark, ROWS), top=1)
    assert {(r["tree"], r["leaf"]) for r in best.select("tree", "leaf").distinct().collect()} == {(t, v[0][0]) for t, v in naive(ROWS).items()}


def test_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"m{i}", 0.0) for i in range(70)]
    (r,) = C.read_back(C.formatted(C.reply_paths(rows_of(spark, rows)))).collect()
    assert [t["text"] for t in r["turns"]] == [f"m{i}" for i in range(70)]


def test_empty(spark):
    assert C.reply_paths(rows_of(spark, [])).collect() == []


def test_query_matches_sql(spark):
    got = sorted(map(tuple, C.op3(spark, "/root/testdata/sf0.001").collect()))
    c = duckdb.connect()
    c.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    assert got == sorted(c.sql(C.OP3_SQL).fetchall())


def test_main_path_is_native(spark):
    plan = C.op3(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
