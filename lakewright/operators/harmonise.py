"""Several feeds of one thing, each with its own column names, as one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def harmonise(frames: Mapping[str, DataFrame], names: Mapping[str, Mapping[str, str]], extra: Sequence[str] = ()) -> DataFrame:
    """Union of the frames with columns renamed by names[feed] {target: source}; a target a feed
    lacks is null there; `extra` columns are carried as they are."""
    targets = list(dict.fromkeys(t for m in names.values() for t in m))

    def shaped(feed: str, df: DataFrame) -> DataFrame:
        have = {t: s for t, s in names[feed].items() if s in df.columns}
        return df.select(*[F.col(have[t]).cast("string").alias(t) if t in have else F.lit(None).cast("string").alias(t) for t in targets], *extra)

    return reduce(DataFrame.unionByName, [shaped(f, df) for f, df in frames.items()])
