"""Product-quantised vector codes by integer k-means with Exponion search.

Components become integers floor(256 * x).  Vectors are cut into ``parts`` equal consecutive parts, each
part position with a codebook of its own, which starts as the parts of the ``entries`` vectors of least
id.  A round gives every part its nearest entry and then replaces each entry by the floor of the
mean of its parts; after the last round parts are assigned once more.

Assignment is Exponion search.  A part starts at its previous entry p (in the first round at the entry next in
the order of first components), at squared distance U.  An entry as near as p lies within twice the
distance of p, so its squared distance to p is at most 4U: of p's neighbour entries, sorted by their
distance to it, only the head up to 4U is scanned.  All distances are integers, the bound holds for ties,
too, and of entries at equal distance the lowest index wins, so the result is that of a full scan.

On Spark: vectors and their current codes are a table in the shared folder, written anew each round by one
map pass.  Sums and numbers of parts per entry are partial in the tasks and merged by one small shuffle; only
codebooks (parts x entries, a bound set by parameters) pass the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, as
are vectors that cannot be cut into equal parts, that differ in length from that of least id, and those
with a component of magnitude 2**20 or more, for which 64-bit distances would not be exact.  A null
vec_id comes after all others and stays null; equal ids are ordered by their components; repeated rows
are vectors each.  With fewer vectors than entries the codebook has as many entries as vectors.
label_error is null where it passes 64 bits.  Long vectors are whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import map_arrow, sized, table, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integer components stay below this in magnitude.
LARGEST = 1 << 28


class Codebooks:
    """Entries of all part positions [parts, entries, width], with what Exponion search needs."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        parts, k, width = entries.shape
        self.flat = entries.reshape(parts * k, width)
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        order = np.argsort(apart, axis=2, kind="stable")
        #: Of every entry the others by distance, and these distances.
        self.near = (order + (np.arange(parts) * k)[:, None, None]).reshape(parts * k, k)
        self.apart = np.take_along_axis(apart, order, axis=2).reshape(parts * k, k)
        self.by_first = np.argsort(entries[:, :, 0], axis=1, kind="stable")

    def starts(self, x: np.ndarray) -> np.ndarray:
        """For vectors [n, parts, width] the entry next to each part by first component, [n, parts]."""
        out = np.empty(x.shape[:2], dtype=np.int64)
        for p, order in enumerate(self.by_first):
            at = np.searchsorted(self.entries[p, order, 0], x[:, p, 0])
            out[:, p] = order[np.minimum(at, len(order) - 1)]
        return out

    def nearest(self, x: np.ndarray, previous: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances [n, parts] of vectors [n, parts, width] that come from `previous` codes."""
        n, parts, width = x.shape
        k = self.entries.shape[1]
        points = x.reshape(n * parts, width)
        start = ((self.starts(x) if previous is None else previous) + np.arange(parts) * k).ravel()
        least = ((points - self.flat[start]) ** 2).sum(1)
        best, reach = start.copy(), self._reach(start, 4 * least)
        # Those that scan most come first, so every step works on a shrinking head.
        order = np.argsort(-reach, kind="stable")
        points, start, best, least = points[order], start[order], best[order], least[order]
        for step, live in enumerate(np.searchsorted(-reach[order], -np.arange(int(reach.max(initial=0))), side="left").tolist()):
            entry = self.near[start[:live], step]
            far = ((points[:live] - self.flat[entry]) ** 2).sum(1)
            better = (far < least[:live]) | ((far == least[:live]) & (entry < best[:live]))
            best[:live] = np.where(better, entry, best[:live])
            least[:live] = np.where(better, far, least[:live])
        out = np.empty_like(best), np.empty_like(least)
        out[0][order], out[1][order] = best, least
        return (out[0].reshape(n, parts) - np.arange(parts) * k), out[1].reshape(n, parts)

    def _reach(self, start: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many of the start entry's neighbours lie within the squared radius."""
        reach = np.empty(len(start), dtype=np.int64)
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(len(self.flat) + 1))
        for entry in np.flatnonzero(np.diff(bounds)):
            those = order[bounds[entry] : bounds[entry + 1]]
            reach[those] = np.searchsorted(self.apart[entry], radius[those], side="right")
        return reach

    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether kept, length, floor(256 * x) of all components end to end) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.abs(flat) * 256 < LARGEST
    wrong = np.concatenate([[0], np.cumsum(~good)])
    ends = np.cumsum(sizes)
    return (sizes > 0) & (wrong[ends] == wrong[ends - sizes]), sizes, np.floor(np.where(good, flat, 0) * 256).astype(np.int64)


def _kept(parts: int):
    """Vectors that can be coded, as the bytes of their 32-bit integers."""

    def run(batches):
        for batch in batches:
            good, sizes, flat = _integers(batch.column(2))
            good &= sizes % parts == 0
            ends = np.cumsum(sizes)
            vectors = [flat[e - n : e].astype("<i4").tobytes() if ok else None for ok, n, e in zip(good, sizes, ends, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vector"])
            yield out.filter(pa.array(good))

    return run


def _matrix(column, parts: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").astype(np.int64)
    return raw.reshape(len(column), parts, -1) if len(column) else raw.reshape(0, parts, 1)


def _assign(books, first: bool):
    """Codes and errors under the codebooks; the state carries the codes from round to round."""

    def run(batches):
        entries = books.value
        code = Codebooks(entries)
        for batch in batches:
            x = _matrix(batch.column(2), len(entries))
            previous = None if first else np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u2").reshape(x.shape[:2]).astype(np.int64)
            codes, errors = code.nearest(x, previous)
            packed = [c.tobytes() for c in codes.astype("<u2")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(errors.sum(1), pa.int64())], ["vec_id", "label", "vector", "code", "error"])

    return run


def _sums(parts: int, k: int, width: int):
    """Per task one row for each used entry: its number and sums of parts."""

    def run(batches):
        count, total = np.zeros(parts * k, dtype=np.int64), np.zeros((parts * k, width), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts).reshape(-1, width)
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, parts) + np.arange(parts) * k
            count += np.bincount(at.ravel(), minlength=parts * k)
            np.add.at(total, at.ravel(), x)
        used = np.flatnonzero(count)
        rows = pa.array([(i * width + j) for i in used for j in range(width)], pa.int64())
        yield pa.RecordBatch.from_arrays([rows, pa.array(np.repeat(count[used], width)), pa.array(total[used].ravel())], ["at", "n", "total"])

    return run


def _renewed(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries replaced by the floor of the mean of their parts; unused ones stay."""
    parts, k, width = entries.shape
    partial = map_arrow(state.select("vector", "code"), _sums(parts, k, width), "at long, n long, total long")
    new = entries.reshape(-1).copy()
    for r in partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # parts x entries x width rows at most
        new[r["at"]] = r["total"] // r["n"]
    return new.reshape(entries.shape)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, vector, code, error) of every kept row of (vec_id, embedding, label), and the final codebooks.

    vector holds 32-bit integers, code 16-bit indexes, both little-endian in part order.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    label = dict(rows.dtypes)["label"]
    kept = map_arrow(rows, _kept(parts), f"vec_id long, label {label}, vector binary")
    order = (F.col("vec_id").asc_nulls_last(), "vector")
    least = kept.orderBy(*order).limit(1).select(F.length("vector")).first()
    kept = kept.where(F.length("vector") == (least[0] if least else 0))
    start = [np.frombuffer(r["vector"], dtype="<i4") for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
    book = np.array(start, dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2) if start else np.zeros((parts, 0, 1), dtype=np.int64)
    schema = f"vec_id long, label {label}, vector binary, code binary, error long"
    state = map_arrow(kept, _assign(sc.broadcast(book), True), schema)
    if not start:
        return state, book
    for _ in range(rounds):
        state = written(state, "vector-codes")
        book = _renewed(state, book)
        state = map_arrow(state, _assign(sc.broadcast(book), False), schema)
    return written(state, "vector-codes"), book


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code in hex (two digits a part; at most 256 entries), error, label_error and codebooks_sha256."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    state, book = compressed(vectors, parts, entries, rounds)
    by_label = state.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    out = state.join(sized(by_label), F.col("label").eqNullSafe(F.col("of_label")), "left")
    # Of every 16-bit index "xx00" the first two digits.
    code = F.lower(F.regexp_replace(F.hex("code"), "(..)00", "$1"))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(Codebooks(book).sha256() if book.size else "").alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


_ASSIGNED = """
a{r} as (
  select vec_id, part, vec, arg_min(struct_pack(e := entry, d := d), struct_pack(d := d, e := entry)) as got
  from (select x.vec_id, x.part, x.vec, c.entry, list_sum(list_transform(range(1, {w} + 1), lambda i: (x.vec[i] - c.vec[i]) * (x.vec[i] - c.vec[i]))) as d
        from x join c{r} c on x.part = c.part)
  group by vec_id, part, vec
)"""
_RENEWED = """
s{r} as (
  select part, entry, i, (s - ((s % n) + n) % n) // n as v
  from (select part, got.e as entry, i, count(*) as n, cast(sum(vec[i]) as bigint) as s from a{r}, unnest(range(1, {w} + 1)) as t(i) group by all)
), c{q} as (
  select c.part, c.entry, coalesce(n.vec, c.vec) as vec
  from c{r} c left join (select part, entry, list(v order by i) as vec from s{r} group by part, entry) n on c.part = n.part and c.entry = n.entry
)"""
#: For vectors of 64 components, as those of the tables.
OP13_SQL = (
    """
with kept as (
  select vec_id, label, list_transform(embedding, lambda y: cast(floor(256 * cast(y as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), x as (
  select vec_id, p as part, q[p * 4 + 1 : p * 4 + 4] as vec from kept, unnest(range(0, 16)) as t(p)
), c0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, vec
  from x where vec_id in (select vec_id from kept order by vec_id limit 64)
)"""
    + "".join("," + _ASSIGNED.format(r=r, w=4) + ("," + _RENEWED.format(r=r, q=r + 1, w=4) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    + """
, codes as (
  select vec_id, string_agg(printf('%02x', cast(got.e as int)), '' order by part) as code, cast(sum(got.d) as bigint) as error from a2 group by vec_id
), books as (
  select sha256(string_agg(cast(vec[i] as varchar), ',' order by part, entry, i)) as h from c2, unnest(range(1, 5)) as t(i)
)
select c.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from codes c join kept k on c.vec_id = k.vec_id, books
"""
)
