"""Data-quality tests: each finds offending rows; none found is a pass.

A test is lazy; `summary` runs any number of them in one job.  Tests of single rows on one frame
are counted together in one pass over it; tests by key count by themselves.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import is_valid_thai_id
from lakewright.operators.scd2 import overlapping_windows


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    offending: DataFrame
    #: Of a test of single rows: the frame, and what makes a row of it offend.
    frame: DataFrame | None = None
    offends: Column | None = None

    def __post_init__(self) -> None:
        if self.severity not in ("error", "warn"):
            raise ValueError(f"severity {self.severity!r} is neither error nor warn")


@dataclass(frozen=True)
class Result:
    name: str
    severity: str
    failures: int

    @property
    def status(self) -> str:
        """pass, warn or fail: failures of a warning keep a run green."""
        return "pass" if not self.failures else "warn" if self.severity == "warn" else "fail"


def _by_row(name: str, severity: str, df: DataFrame, offends: Column) -> Check:
    return Check(name, severity, df.where(offends), df, offends)


def unique(df: DataFrame, keys: Sequence[str], severity: str = "error", name: str = "unique") -> Check:
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return Check(name, severity, df.where(present).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def not_null(df: DataFrame, column: str, severity: str = "error", name: str = "not_null") -> Check:
    return _by_row(name, severity, df, F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence, severity: str = "error", name: str = "accepted_values") -> Check:
    return _by_row(name, severity, df, F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str, severity: str = "error", name: str = "relationships") -> Check:
    known = parent.select(F.col(key).alias("_key")).distinct()
    return Check(name, severity, df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti"))


def accepted_range(df: DataFrame, column: str, low=None, high=None, severity: str = "error", name: str = "accepted_range") -> Check:
    """Both ends included; null passes."""
    out = F.lit(False)
    out = out if low is None else out | (F.col(column) < low)
    out = out if high is None else out | (F.col(column) > high)
    return _by_row(name, severity, df, out)


def expression(df: DataFrame, holds: str, where: str = "true", severity: str = "error", name: str = "expression") -> Check:
    return _by_row(name, severity, df, F.expr(where) & ~F.expr(holds))


def no_overlaps(history: DataFrame, keys: Sequence[str], severity: str = "error", name: str = "no_overlapping_windows") -> Check:
    return Check(name, severity, overlapping_windows(history, keys))


def valid_thai_id(df: DataFrame, column: str, severity: str = "warn", name: str = "valid_thai_id") -> Check:
    return _by_row(name, severity, df, ~is_valid_thai_id(F.col(column)))


def loss_within_coverage(facts: DataFrame, severity: str = "warn") -> Check:
    return _by_row("loss_within_coverage", severity, facts, F.col("is_outside_coverage"))


def earned_within_written(earned: DataFrame, severity: str = "error") -> Check:
    """No policy earns more than was written, give or take the larger of 1 and 0.1 %."""
    per = earned.groupBy("policy_id").agg(F.sum("earned_premium_thb").alias("earned"), F.max("written_premium_thb").alias("written"))
    return Check("earned_within_written", severity, per.where(F.col("earned") > F.col("written") + F.greatest(F.lit(1.0), F.abs("written") * 0.001)))


def premium_not_negative(payments: DataFrame, severity: str = "error") -> Check:
    return _by_row("premium_not_negative", severity, payments, F.expr("amount < 0 and not coalesce(is_refund, false)"))


def freshness(df: DataFrame, at: str, now: dt.datetime, warn_hours: float, error_hours: float, by: Sequence[str] = ()) -> DataFrame:
    """Newest row of each group against thresholds in whole hours: status pass, warn or error."""
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600)
    hours = F.coalesce(age.cast("double"), F.lit(float("inf")))
    found = df.groupBy(*by).agg(F.max(at).alias("newest"))
    return found.withColumn("age_hours", hours).withColumn("status", F.when(F.col("age_hours") > error_hours, "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def _counted(checks: Sequence[Check]) -> DataFrame:
    """place (in the order given), test, severity, failures."""
    by_frame: dict[int, list[tuple[int, Check]]] = {}
    out = []
    for k, c in enumerate(checks):
        if c.frame is None:
            out.append(c.offending.agg(F.count("*").alias("failures")).select(F.lit(k).alias("place"), F.lit(c.name).alias("test"), F.lit(c.severity).alias("severity"), "failures"))
        else:
            by_frame.setdefault(id(c.frame), []).append((k, c))
    for same in by_frame.values():
        counted = same[0][1].frame.agg(*[F.count(F.when(c.offends, 1)).alias(f"_{k}") for k, c in same])
        rows = [F.struct(F.lit(k).alias("place"), F.lit(c.name).alias("test"), F.lit(c.severity).alias("severity"), F.col(f"_{k}").alias("failures")) for k, c in same]
        out.append(counted.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, out)


def summary(checks: Sequence[Check]) -> DataFrame:
    """test, severity, failures: one row per check, in one job that scans a frame once for all its tests of rows."""
    return _counted(checks).drop("place")


def run(checks: Sequence[Check]) -> list[Result]:
    """The results in the order of the checks."""
    return [Result(r["test"], r["severity"], r["failures"]) for r in sorted(_counted(checks).collect(), key=lambda r: r["place"])]
