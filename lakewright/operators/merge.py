"""Keyed merge and the look-back that lets late records in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """target after updating matched and inserting new rows of source; rows of source for
    which `deleted` holds remove their key.  Nulls in keys are equal.  Raises if a key repeats in source."""
    twice = source.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"merge source repeats the key {twice[0].asDict()}")
    named = source.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    kept = target.join(named, reduce(Column.__and__, [target[k].eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]), "left_anti")
    new = source if deleted is None else source.where(~F.coalesce(deleted, F.lit(False)))
    return kept.unionByName(new.select(*[c for c in new.columns if c in target.columns]), allowMissingColumns=True)


def lookback(source: DataFrame, high: dt.date | None, days: int = 60, batch: str = "batch_date") -> DataFrame:
    """Rows of batches from `days` before the target's newest batch on; all if there is none.

    The bound is a literal, so a partitioned scan skips older folders.
    """
    return source if high is None else source.where(F.col(batch) >= F.lit(high - dt.timedelta(days=days)))
