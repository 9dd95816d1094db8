"""A corpus pipeline: five training-data operators, stage after stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.

Defined results of all stages: a null doc_id stays null; a null text stays null (the last
stage gives it no ids); columns beyond doc_id and text pass through, whatever their names;
rows that repeat are judged each, but for the second stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import byte_bpe, decontaminate, ngram_join, secrets, toxicity
from lakewright.llm._common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go.

    Null and empty texts get the score of a text without hits, which stays.  Without a
    labelled toxic text nothing goes.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, one
    without an id only if no other is there; of rows of one id the first by hash of the text,
    of repeated rows one.  Texts without a word are near-duplicates of nothing and stay.
    """
    return ngram_join.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take a fifth of its characters, go.

    Null and empty texts hold nothing; null and empty items are not looked for; without
    items all documents stay.
    """
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to placeholders; n_chars of changed texts is renewed.

    Of spans that overlap, the first gives the placeholder its kind; no row goes.
    """
    return secrets.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get their byte-level BPE ids as a last column, token_ids, in place of one of that name."""
    import public_tokenizers

    return byte_bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Similarity, learned scores and byte-pair ids have no SQL form; the tests use brute force.
ORACLE_SQL = None
