"""Order MinHash fingerprints, sensitive to edit distance.

The K-mers (over code points) of a text are numbered by occurrence, so repeats are
different elements.  A sketch selects the ``PICK`` elements that are least in its own order of
all elements and hashes them, in the order they have in the text, as a tuple to 16 bits.
The orders of the ``SKETCHES`` sketches are one random order begun at as many places of the hash
range, going round at its end, so every sketch has PICK elements whenever the text has and a
fingerprint costs two sorts of a text instead of one pass per sketch.  Likeness is the
share of sketches with equal tuples.

``fingerprints`` pairs each document with the next by id.  Rows are dealt once to ranges of
ids that quantiles of all ids bound; an id of many rows, and the null id, is a range of its own,
dealt to as many parts as its rows fill.  Every part also gets the first document after its
range, and each is streamed in descending order, so a row only needs the one document
before it in the stream.  Nothing but one text is held.

Defined results: a null text is empty; an empty text has an all-zero fingerprint, likeness
1 to another empty text and 0 to others; a text shorter than K is one k-mer, and a single
element is a tuple by itself.  A null id sorts before all others.  Rows of equal id share
the next document: that of the next greater id, the least text if that id repeats.  A lone
document is next to itself.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import map_arrow, table
from lakewright.llm._words import U, mix

K, SKETCHES, PICK = 8, 64, 2
_LOW, _LEAST = U((1 << 24) - 1), -(1 << 63)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(K)], dtype=U)
_BEGIN = (np.arange(SKETCHES, dtype=U) << U(58)) >> U(24)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _ordered(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, positions) by the upper 40 bits, then position."""
    if len(high) <= 1 << 24:
        s = np.sort((high & ~_LOW) | np.arange(len(high), dtype=U))
        return s >> U(24), (s & _LOW).astype(np.int64)
    at = np.argsort(high & ~_LOW, kind="stable")
    return high[at] >> U(24), at


def fingerprint(points: np.ndarray) -> np.ndarray:
    """SKETCHES numbers of 16 bits; all 0 for an empty text."""
    n = len(points)
    if n == 0:
        return np.zeros(SKETCHES, dtype=np.uint16)
    wide = points.astype(U) + U(1)
    k = min(n, K)
    h = np.zeros(n - k + 1, dtype=U)
    for i in range(k):
        h += wide[i : n - k + 1 + i] * _POWERS[i]
    grams, at = _ordered(mix(h + U(k)))
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    index = np.arange(len(grams))
    number = index - np.maximum.accumulate(np.where(new, index, 0))
    element = np.empty(len(grams), dtype=U)
    element[at] = mix((grams << U(24)) + number.astype(U) * U(0xD1B54A32D192ED03))
    values, at = _ordered(element)
    one = np.searchsorted(values, _BEGIN) % len(values)
    if len(values) == 1:
        tuples = mix(values[one] ^ U(0x5851F42D4C957F2D))
    else:
        two = (one + 1) % len(values)
        swap = at[two] < at[one]
        a, b = np.where(swap, values[two], values[one]), np.where(swap, values[one], values[two])
        tuples = mix(mix(a) + b)
    out = (tuples & U(0xFFFF)).astype(np.uint16)
    out[out == 0] = 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _stream(batches):
    """Rows come by range: first the guests (the next range's first document), then
    descending by id and text; the last text of an id is its least."""
    part = place = None
    here = after = None
    for batch in batches:
        rows = []
        for p, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            text = text.as_py() or ""
            if p != part:
                part, place, here, after = p, None, None, None
            if (guest, doc_id) != place:
                place, after = (guest, doc_id), here
            mine = fingerprint(points := _points(text))
            here = (text, points, mine)
            if guest:
                continue
            other, other_points, other_print = after
            n = len(text)
            q = n // 4
            edited = text[: n - q] + other[:q]
            new = fingerprint(np.concatenate([points[: n - q], other_points[:q]])) if q else mine
            rows.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(mine), as_text(new), likeness(mine, new), likeness(mine, other_print)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def _number(doc_id, starts: list[int]):
    """How many of starts (sorted) are at most doc_id, by binary search; 0 for null."""
    all_starts, steps = F.lit(starts).cast("array<long>"), [1 << i for i in range(len(starts).bit_length(), -1, -1)]
    # Past the end F.get is null, so the step is not taken.
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(all_starts, at + step - 1) <= doc_id, at + step).otherwise(at))


def next_documents(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text), dealt by part and in the order _stream wants."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(4 * n)], 40 * n)).first()[0] or []
    often = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    # Range 0 is the null id, range k the ids from starts[k - 1] on; an id found at two cuts has one of its own.
    starts = sorted({_LEAST, *cuts, *(x + 1 for x in often if x < -_LEAST - 1)})
    rows = rows.withColumn("number", _number(F.col("doc_id"), starts))
    told = sorted(rows.groupBy("number").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).collect())
    if not told:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    share = max(1, -(-sum(r.n for r in told) // (4 * n)))
    split, first_part, total = [1] * (len(starts) + 1), [0] * (len(starts) + 1), 0
    for r in told:
        split[r.number] = -(-r.n // share) if r.least == r.most else 1
        first_part[r.number] = total
        total += split[r.number]
    of = lambda values: F.get(F.lit(values), F.col("number"))
    part = of(first_part) + F.pmod(F.xxhash64("text"), of(split)).cast("int")
    # The first document of every range goes to all parts of the range before it, the very first to the last range.
    guests = [(after.least, first_part[r.number] + i) for r, after in zip(told, [*told[1:], told[0]], strict=True) for i in range(split[r.number])]
    least = F.col("doc_id").isin([r.least for r in told if r.least is not None])
    firsts = rows.where(least | F.col("doc_id").isNull() if told[0].least is None else least).groupBy("doc_id").agg(F.min("text").alias("text"))
    targets = spark.createDataFrame(guests, "least long, part int")
    guest = firsts.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("least"))).select("part", F.lit(1).alias("guest"), "doc_id", "text")
    dealt = rows.select(part.alias("part"), F.lit(0).alias("guest"), "doc_id", "text").unionByName(guest)
    return dealt.repartition(n, "part").sortWithinPartitions("part", F.desc("guest"), F.desc_nulls_last("doc_id"), F.desc("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row each."""
    return map_arrow(
        next_documents(docs), _stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
