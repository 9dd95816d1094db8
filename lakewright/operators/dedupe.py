"""Latest record per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def record_hash(columns: Sequence[str], null: str = "<null>", separator: str = "||") -> Column:
    """SHA-256 over the columns' string forms."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns]), 256)


def dedupe_latest(df: DataFrame, keys: Sequence[str], latest: Sequence[Column | str], ties: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: greatest by `latest` (nulls last), then least by `ties`.

    With `ties` that make the order total the result is deterministic.  Planned as a
    window with a group limit, so each task hands on one row per key before the shuffle.
    """
    order = [F.desc_nulls_last(c) for c in latest] + [F.asc_nulls_first(c) if isinstance(c, str) else c for c in ties]
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_row = 1").drop("_row")
