"""Slowly changing history: versions with half-open windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _differs(columns: Sequence[str], left: str, right: str) -> Column:
    return reduce(Column.__or__, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def scd2_apply(history: DataFrame, source: DataFrame, keys: Sequence[str], check: Sequence[str], at: dt.datetime | dt.date, close_missing: bool = True) -> DataFrame:
    """history (with valid_from, valid_to) after a snapshot of source at a point in time.

    A key whose `check` columns changed closes and opens a version; a new key opens one; a
    key that vanished closes (if close_missing); all else stays.  One full join of the
    open versions with the source; closed versions only pass through.
    """
    data = [c for c in history.columns if c not in ("valid_from", "valid_to")]
    kind = history.schema["valid_from"].dataType
    now = F.lit(at).cast(kind)
    open_, closed = history.where("valid_to is null"), history.where("valid_to is not null")
    both = open_.alias("h").join(
        source.select(*data, F.lit(True).alias("_in")).alias("s"), reduce(Column.__and__, [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "full"
    )
    held, seen = F.col("h.valid_from").isNotNull(), F.col("s._in").isNotNull()
    changed = held & seen & _differs(check, "h", "s")
    gone = held & ~seen & F.lit(close_missing)
    version = lambda side, start, end: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in data], start.cast(kind).alias("valid_from"), end.cast(kind).alias("valid_to"))
    nothing = F.lit(None)
    rows = F.when(changed, F.array(version("h", F.col("h.valid_from"), now), version("s", now, nothing)))
    rows = rows.when(gone, F.array(version("h", F.col("h.valid_from"), now))).when(~held, F.array(version("s", now, nothing)))
    rows = rows.otherwise(F.array(version("h", F.col("h.valid_from"), nothing)))
    return closed.unionByName(both.select(F.inline(rows)))


def history_of_changes(events: DataFrame, keys: Sequence[str], state: Sequence[str], order: Sequence[str], start: str) -> DataFrame:
    """Versions from an event log: a row wherever the state differs from the key's event before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(by) == 1
    moved = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.lag(c).over(by)) for c in state])
    versions = events.withColumn("_new", first | moved).where("_new").drop("_new")
    return versions.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(by))


def as_of_view(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """history with dates for windows, is_current, version_number and total_versions."""
    by = Window.partitionBy(*keys)
    return history.withColumns(
        {
            "is_current": F.col("valid_to").isNull(),
            "version_number": F.row_number().over(by.orderBy("valid_from")),
            "total_versions": F.count("*").over(by),
            "valid_from": F.col("valid_from").cast("date"),
            "valid_to": F.col("valid_to").cast("date"),
        }
    )


def overlapping_windows(history: DataFrame, keys: Sequence[str], adjacent: bool = False) -> DataFrame:
    """Versions that begin before an earlier one of their key has ended, or that end before they start.

    One sweep in the order of starts keeps the greatest end so far (an open version never ends), so every
    version inside a longer one is told, however many stand between.  Of versions that start together the one that
    ends first comes first.  Windows are half-open; one without length overlaps nothing.  With adjacent=True
    only neighbours are compared, and the earlier of the two is told.
    """
    by = Window.partitionBy(*keys).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    inverted = F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False))
    if adjacent:
        marked = history.withColumn("_next", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))
        over = F.col("_next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_next")))
        return marked.withColumn("problem", F.when(inverted, "inverted").when(over, "overlap")).where("problem is not null").drop("_next")
    lasts = F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumns({"_end": F.max(F.when(lasts, F.col("valid_to"))).over(before), "_open": F.max(F.when(lasts, F.col("valid_to").isNull())).over(before)})
    over = lasts & (F.coalesce("_open", F.lit(False)) | F.coalesce(F.col("_end") > F.col("valid_from"), F.lit(False)))
    return marked.withColumn("problem", F.when(inverted, "inverted").when(over, "overlap")).where("problem is not null").drop("_end", "_open")
