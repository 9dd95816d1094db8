import corpus_pipeline
import public_tokenizers as P
import tiktoken

from lakewright.llm import byte_bpe, decontaminate, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {"documents": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    names = list(kept)
    for a, b in zip(names, names[1:], strict=False):
        assert set(kept[b]) <= set(kept[a]) and len(kept[b]) > 0.7 * len(kept[a])
    before, after = kept["ngram_jaccard_join"], kept["benchmark_decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, t in before.items() if any(i in t for i in items)}
    assert held and not held & set(after)
    for d in set(before) - set(after):
        assert any(decontaminate.locate(i, before[d], int(0.2 * len(i))) for i in items)
    assert all(not secrets.base_spans(t) for t in kept["secret_scans"].values())
    assert all(kept["secret_scans"][d] == secrets.redact(t) for d, t in after.items())
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r["token_ids"] == theirs.encode_ordinary(r["text"]) for r in docs.collect())


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-1] == "token_ids" and len(corpus_pipeline.STAGES) == 5 and out.count() > 0


def test_stages_keep_odd_rows_and_columns(spark):
    rows = [(1, None, 5, "a"), (None, None, None, None), (None, "", 0, "b"), (2, "", 0, None), (3, "plain words of a text that nobody would mind reading here", 1, "k"), (3, "plain words of a text that nobody would mind reading here", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `_row` string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == docs.columns + (["token_ids"] if k == 4 else [])
            got = sorted((tuple(r)[:2] for r in out.collect()), key=str)
            want = [] if df is not docs else [r[:2] for r in (rows[:-1] if k == 1 else rows)]
            assert got == sorted(want, key=str)
