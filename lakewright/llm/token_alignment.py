"""Alignment of two tokenizers' tokens over the same texts, and corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file) over a space and the text, B a
``sentencepiece`` model, which adds that space itself.  Tokens become intervals of bytes, and DuckDB
works on them in every Arrow partition, a slice of documents at a time:

1. an ASOF join gives every token the last token of the other side that ends no later; where both
   end together a group closes, and where both also start together they are each other's only overlap;
2. a window sum of the closings before a token is the number of its group;
3. a range join finds the overlaps of the other tokens.  Intervals meet in blocks of ``BLOCK`` bytes
   first, so it compares a few neighbours and never a document's tokens with each other.

Links are the overlaps that end together.  A document's distinct linked pairs and their numbers go
to a written table in the shared folder; Spark merges their partial counts and joins the
corpus-wide ones back, broadcast if they are proven few, else by a shuffle on the pair.

Vocabularies are read on the driver and broadcast, as bytes of the two files.  ids of B are below
2**32.  Where the JSON file is a plain byte-level BPE whose ids are its merge ranks, texts of characters
up to U+024F take the same ranks through ``tiktoken``, several times as fast; all others and all other
files go through ``tokenizers``.

Defined results: texts that are null, empty, or whose joined A or B bytes differ from space and text have no
tokens (zeros, and '' for the digest); a null doc_id stays null; repeated rows are documents each, all
counted; very long texts are whole and make a slice of their own, so memory grows with the longest text;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import cut, map_arrow, sized, table, written
from lakewright.llm.byte_bpe import SPACED

SLICE_BYTES, BLOCK = 1 << 19, 16
_LATIN = re.compile("[\x00-ɏ]*")
_SHIFT = 1 << 32
_SEPARATORS = (",", ";", "|", "")


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabets show printable Latin-1 characters as themselves, other bytes from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: ids of texts, and the bytes of every id."""

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.full = Tokenizer.from_str(raw.decode())
        self.full.encode_special_tokens = True
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        byte, vocabulary = _byte_of_char(), spec["model"]["vocab"]
        of = {i: bytes(map(byte.__getitem__, t)) for t, i in vocabulary.items() if i not in special} | special
        self.bytes_of = [of.get(i, b"") for i in range(max(of) + 1)]
        model, cut_ = spec["model"], spec["pre_tokenizer"]
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        plain = model["type"] == "BPE" and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        plain &= cut_["type"] == "ByteLevel" and cut_["use_regex"] and not cut_["add_prefix_space"] and merged == list(range(256, 256 + len(merged)))
        self.fast = tiktoken.Encoding("a", pat_str=SPACED, mergeable_ranks={b: i for i, b in of.items() if i not in special}, special_tokens={}) if plain else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(t) if self.fast and _LATIN.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, got in zip(rest, self.full.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = got.ids
        return out


class Pieces:
    """Tokenizer B."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """texts come with their space, which the model adds by itself."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.array(one, dtype=np.int32) for one in ids]) if ids else np.zeros(0, dtype=np.int32)


def _intervals(ids: list[list[int]], size: np.ndarray) -> pa.Table:
    """doc, id, s, e of all tokens; documents follow one another, so ends rise throughout."""
    flat = _flat(ids)
    ends = np.cumsum(size[flat])
    kind = np.int32 if len(ends) == 0 or ends[-1] < 1 << 31 else np.int64
    return pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids]), "id": flat, "s": (ends - size[flat]).astype(kind), "e": ends.astype(kind)})


_GROUPED = """
create or replace temp table grouped as
with met as (
  select a.doc, a.id, a.s, a.e, coalesce(b.e = a.e, false) as closes, coalesce(b.e = a.e and b.s = a.s, false) as same, b.id as twin
  from a asof left join b on a.e >= b.e
)
select *, cast(coalesce(sum(cast(closes as int)) over (order by e rows between unbounded preceding and 1 preceding), 0) as int) as grp from met
"""
_OVERLAPS = f"""
create or replace temp table shared as
with rest_b as (select * from b anti join (select e from grouped where same) x on b.e = x.e),
     blocks_a as (select *, unnest(range(s // {BLOCK}, (e - 1) // {BLOCK} + 1)) as blk from grouped where not same),
     blocks_b as (select *, unnest(range(s // {BLOCK}, (e - 1) // {BLOCK} + 1)) as blk from rest_b)
select doc, id as a, twin as b, e as a_end, e as b_end from grouped where same
union all
select a.doc, a.id, b.id, a.e, b.e from blocks_a a join blocks_b b
on a.blk = b.blk and a.s < b.e and b.s < a.e and greatest(a.s, b.s) // {BLOCK} = a.blk
"""
_LINKS = f"select doc, cast(a as bigint) * {_SHIFT} + b as pair, cast(count(*) as int) as n from shared where a_end = b_end group by all order by doc, pair"
_COUNTS = "select doc, count(*) as n from shared group by doc"


class Aligner:
    """Both tokenizers and a DuckDB connection of one Python worker."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b)]
        #: All tokens' bytes end to end, and where each begins.
        self.spelt = [(np.frombuffer(b"".join(t.bytes_of), dtype=np.uint8), np.cumsum(n) - n) for t, n in zip((self.a, self.b), self.sizes, strict=True)]
        self.width = max(map(len, self.sizes))
        #: Every id behind each separator.
        self.shown = np.array([s + str(i) for s in _SEPARATORS for i in range(self.width)], dtype=object)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a side's bytes are not the text's."""
        both = self.a.encode(texts), self.b.encode(texts)
        raw = [t.encode() for t in texts]
        right = [self._bytes(k, both[k], raw) for k in range(2)]
        for i in np.flatnonzero(~(right[0] & right[1])):
            both[0][i], both[1][i] = [], []
        return both

    def _bytes(self, side: int, ids: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Whether a side's tokens, joined, are the bytes of each text."""
        size, (of, starts) = self.sizes[side], self.spelt[side]
        flat = _flat(ids)
        ends = np.cumsum(size[flat])
        joined = of[np.arange(ends[-1]) + np.repeat(starts[flat] - (ends - size[flat]), size[flat])]
        bounds = np.append(0, ends)[np.cumsum([0, *map(len, ids)])]
        return np.array([joined[i:j].tobytes() == r for i, j, r in zip(bounds[:-1], bounds[1:], raw, strict=True)])

    def _written(self, a: pa.Table, b: pa.Table, n: int) -> list[str]:
        """The groups of each of n documents: a1,a2|b1;a3|b2,b3."""
        of_a = self.db.sql("select grp, e, closes from grouped order by e").fetchnumpy()
        #: A token of B belongs to the group that closes next.
        groups = [of_a["grp"], np.searchsorted(of_a["e"][of_a["closes"]], b["e"].to_numpy())]
        docs = [t["doc"].to_numpy() for t in (a, b)]
        ids = [t["id"].to_numpy() for t in (a, b)]
        bounds = np.arange(int(groups[0][-1]) + 2 if len(groups[0]) else 1)
        before = [np.searchsorted(g, bounds) for g in groups]
        out = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        new = [np.concatenate([[True], x[1:] != x[:-1]])[: len(x)] for x in (*groups, docs[0])]
        out[np.arange(len(ids[0])) + before[1][groups[0]]] = ids[0] + self.width * np.where(new[2], 3, np.where(new[0], 1, 0))
        out[np.arange(len(ids[1])) + before[0][groups[1] + 1]] = ids[1] + self.width * np.where(new[1], 2, 0)
        cuts = np.searchsorted(docs[0], np.arange(n + 1)) + np.searchsorted(docs[1], np.arange(n + 1))
        shown = self.shown[out]
        return ["".join(shown[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def align(self, texts: list[str]) -> dict[str, list]:
        """Of each text (with its space): counts, groups, linked pairs and how often each."""
        ids = self._ids(texts)
        a, b = (_intervals(x, size) for x, size in zip(ids, self.sizes, strict=True))
        out = {"n_a": [len(x) for x in ids[0]], "n_b": [len(x) for x in ids[1]]}
        n = len(texts)
        self.db.register("a", a)
        self.db.register("b", b)
        for statement in (_GROUPED, _OVERLAPS):
            self.db.execute(statement)
        links = self.db.sql(_LINKS).fetchnumpy()
        cuts = np.searchsorted(links["doc"], np.arange(n + 1))
        counts, overlaps = self.db.sql(_COUNTS).fetchnumpy(), np.zeros(n, dtype=np.int64)
        overlaps[counts["doc"]] = counts["n"]
        closes = self.db.sql("select doc from grouped where closes order by doc").fetchnumpy()["doc"]
        total = np.concatenate([[0], np.cumsum(links["n"], dtype=np.int64)])
        out |= {"n_groups": np.bincount(closes, minlength=n), "n_links": total[cuts[1:]] - total[cuts[:-1]], "n_overlaps": overlaps}
        out["groups"] = self._written(a, b, n)
        out["pairs"] = [links["pair"][i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        out["times"] = [links["n"][i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out


_WORKER: dict = {}
_COLUMNS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_overlaps": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<int>"


def _align(a, b, keep: bool):
    def run(batches):
        if _WORKER.get("for") != (key := (hash(a.value), hash(b.value))):
            _WORKER.update({"for": key, "aligner": Aligner(a.value, b.value)})
        aligner = _WORKER["aligner"]
        names = [*_COLUMNS, "groups"] if keep else list(_COLUMNS)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                at = [i for i, t in enumerate(texts) if t]
                got = aligner.align([" " + texts[i] for i in at]) if at else {}
                empty = {"pairs": [], "times": [], "groups_sha256": "", "groups": ""}
                cols = {n: [empty.get(n, 0)] * len(texts) for n in names[1:]}
                if at:
                    got["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
                    for n in names[1:]:
                        for i, x in zip(at, got[n], strict=True):
                            cols[n][i] = x
                arrays = [batch.column(0).slice(lo, hi - lo), *(pa.array(cols[n], _COLUMNS.get(n, pa.string())) for n in names[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names)
                lo = hi

    return run


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def alignments(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """Of every row of docs: token, group, link and overlap counts, digest of the groups, and the linked pairs
    (A id * 2**32 + B id) with how often each; with groups=True also the written groups themselves."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _SCHEMA + (", groups string" if groups else "")
    return map_arrow(rows, _align(sc.broadcast(_read(a_path)), sc.broadcast(_read(b_path)), groups), schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n (how many links hold it) and best (1 if n is the highest of its B id) from rows of (pair, times)."""
    counts = cut(pairs.groupBy("pair").agg(F.sum("times").alias("n")))
    b = F.col("pair") % _SHIFT
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut(counts.join(most, b == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The counts of `alignments` for every row of docs, with the corpus-wide counts of its links."""
    stage = written(alignments(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "token-links")
    pairs = stage.select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "times")
    sums = pairs.join(sized(pair_counts(pairs)), "pair").groupBy("row")
    sums = sums.agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = stage.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_overlaps")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
