"""Change feeds: current state and precedence of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.dedupe import dedupe_latest


def cdc_current(changes: DataFrame, keys: Sequence[str], latest: Sequence[Column | str], op: str = "op", ties: Sequence[Column | str] = (), keep_deleted: bool = False) -> DataFrame:
    """The newest event of each key; keys whose newest event is a delete ('D') go unless kept."""
    newest = dedupe_latest(changes, keys, latest, ties)
    return newest if keep_deleted else newest.where(~F.col(op).eqNullSafe(F.lit("D")))


def fill_from(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """primary and those rows of secondary whose key `known` (default: primary) lacks.

    Pass all keys ever seen, deleted ones too, as `known`, so that a deleted record does
    not come back from the secondary source.
    """
    seen = (known if known is not None else primary).select(*keys).distinct()
    return primary.unionByName(secondary.join(seen, list(keys), "left_anti"), allowMissingColumns=True)
