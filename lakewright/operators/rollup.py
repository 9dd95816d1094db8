"""Stored states of distinct counts and percentiles, from which any union of cells is computed exactly.

A state is a small table: a row per cell and slot.  New batches only add rows; states of disjoint batches are
merged by summing (lags) or by or-ing (bitmaps), so months roll up to quarters, or partners to a
country, without going back to the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distinct_state(rows: DataFrame, cell: Sequence[str | Column], number: str | Column) -> DataFrame:
    """Which numbers occur in each cell: cell columns, _bucket (numbers by ranges of 32,768), _bits (4,096 bytes).

    Numbers are dense non-negative integers, such as serial numbers; of null no bit is set.  The bits
    are put together inside the tasks, so at most one row per cell, bucket and task is shuffled.
    """
    n = F.col(number) if isinstance(number, str) else number
    known = rows.withColumn("_n", n.cast("long")).where("_n is not null")
    return known.groupBy(*cell, F.bitmap_bucket_number("_n").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))


def merged_distinct(state: DataFrame, cell: Sequence[str | Column]) -> DataFrame:
    """A state over coarser cells, or the union of states of several batches."""
    return state.groupBy(*cell, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))


def distinct_counts(state: DataFrame, cell: Sequence[str | Column], into: str = "n_distinct") -> DataFrame:
    """The exact number of different numbers in each cell, of any cells coarser than the state's."""
    merged = merged_distinct(state, cell)
    names = [c for c in merged.columns if c not in ("_bucket", "_bits")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("_bits")).alias(into))


def span_state(rows: DataFrame, cell: Sequence[str | Column], number: str, month: str) -> DataFrame:
    """Which months of each year a number occurs in, in each cell: cell columns, number, _year, _months (bit 0: January).

    For cells that hold few of all numbers, where bitmaps of numbers would be nearly empty: a row per cell, number and
    year, however many months, cells or numbers there are.  Rows dealt by number are not shuffled.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.month(month) - 1)
    return rows.where(F.col(number).isNotNull() & F.col(month).isNotNull()).groupBy(*cell, number, F.year(month).alias("_year")).agg(F.bit_or(bit).alias("_months"))


def span_counts(state: DataFrame, cell: Sequence[str], number: str, months: int, span: str, into: str = "n_distinct") -> DataFrame:
    """The exact number of different numbers in each cell, of any cells coarser than the state's, and each span of so many
    months (a divisor of 12) that has any; `span` is its first day.  States of several batches are merged by or-ing."""
    merged = state.groupBy(*cell, number, "_year").agg(F.bit_or("_months").alias("_months"))
    spans = [F.when(F.col("_months").bitwiseAND(F.lit(((1 << months) - 1) << m)) != 0, F.lit(m + 1)) for m in range(0, 12, months)]
    held = merged.select(*cell, "_year", F.explode(F.array_compact(F.array(*spans))).alias("_month"))
    return held.groupBy(*cell, F.make_date("_year", "_month", F.lit(1)).alias(span)).agg(F.count("*").alias(into))


def value_state(rows: DataFrame, cell: Sequence[str | Column], value: str, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """How often each value occurs in each cell (_n), with further sums and maxima per cell and value; nulls of value are left out."""
    further = [F.sum(c).alias(k) for k, c in (sums or {}).items()] + [F.max(c).alias(k) for k, c in (most or {}).items()]
    return rows.where(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count("*").alias("_n"), *further)


def merged_values(state: DataFrame, cell: Sequence[str | Column], value: str, sums: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """A state over coarser cells, or the union of states of several batches."""
    return state.groupBy(*cell, value).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def percentiles(state: DataFrame, cell: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per cell the exact percentiles {name: share}: the least value with at least that share of rows at or below it.

    state has one row per cell and value (`merged_values`).  A cell's values are few (days of lag), so the running sum
    is over them, not over rows.
    """
    by = Window.partitionBy(*cell)
    ran = state.withColumns({"_upto": F.sum("_n").over(by.orderBy(value)), "_all": F.sum("_n").over(by)})
    return ran.groupBy(*cell).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p).cast("decimal(9,6)") * F.col("_all")), F.col(value))).alias(k) for k, p in shares.items()])
