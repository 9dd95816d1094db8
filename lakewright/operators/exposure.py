"""Premium: written at inception, earned pro rata over days on risk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.functions.dates import date_key, year_month


def written_premium(policies: DataFrame) -> DataFrame:
    """One row per policy with an inception date: the whole premium in its month."""
    return policies.where("inception_date is not null").withColumns({"inception_date_key": date_key(F.col("inception_date")), "written_year_month": year_month(F.col("inception_date"))})


def at_risk(policies: DataFrame, payments: DataFrame, as_of: dt.date) -> DataFrame:
    """Policies with some exposure and its end, exposure_end_date.

    Exposure is [inception, end): end is the least of expiry, as_of and, for a cancelled
    policy, the first refund's effective date (expiry without one).
    """
    refunds = payments.where("is_refund").groupBy(F.col("policy_id").alias("_refunded")).agg(F.min("effective_date").alias("_refund"))
    end = F.least(F.col("expiry_date"), F.lit(as_of), F.when(F.col("policy_status") == "CANCELLED", F.coalesce("_refund", "expiry_date")))
    return (
        policies.where("inception_date is not null and expiry_date is not null and term_days > 0")
        .join(refunds, F.col("policy_id") == F.col("_refunded"), "left")
        .withColumn("exposure_end_date", end)
        .where("exposure_end_date > inception_date")
        .drop("_refunded", "_refund")
    )


def earned_cells(risk: DataFrame) -> DataFrame:
    """A row per row of `at_risk` and month of its exposure.

    A month earns its days' share of the written premium.  Months are made by a generator
    inside the stage; nothing is shuffled.
    """
    months = F.sequence(F.trunc("inception_date", "MM"), F.trunc("exposure_end_date", "MM"), F.expr("interval 1 month"))
    cells = risk.withColumn("month_start", F.explode(months))
    since = F.greatest("month_start", "inception_date")
    until = F.least(F.add_months("month_start", 1), F.col("exposure_end_date"))
    cells = cells.withColumn("days_on_risk", F.datediff(until, since)).where("days_on_risk > 0")
    return cells.withColumns(
        {
            "earned_year_month": year_month(F.col("month_start")),
            "earned_premium_thb": F.round(F.col("written_premium_thb") * F.col("days_on_risk") / F.col("term_days"), 2),
            "exposure_policy_years": F.round(F.col("days_on_risk") / F.lit(365.25), 6).cast("decimal(18,6)"),
        }
    )


def earned_premium(policies: DataFrame, payments: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per policy and month of exposure (`at_risk`, `earned_cells`).  The only shuffles are
    the refund aggregation (combined before it) and its join."""
    return earned_cells(at_risk(policies, payments, as_of))


def with_first_months(risk: DataFrame) -> DataFrame:
    """risk with `_counted`: the last day that earlier rows of the policy cover, null if there are none.

    Exposure has no gaps, so a row's month lies in an earlier row, too, if and only if it begins by that day (`is_first`):
    different policies of a month are counted without holding policies by month.
    """
    earlier = Window.partitionBy("policy_id").orderBy("inception_date", "exposure_end_date").rowsBetween(Window.unboundedPreceding, -1)
    return risk.withColumn("_counted", F.date_sub(F.max("exposure_end_date").over(earlier), 1))


def is_first() -> Column:
    """Whether a cell made of `with_first_months` is its policy's first in its month."""
    return F.col("policy_id").isNotNull() & (F.col("_counted").isNull() | (F.col("month_start") > F.col("_counted")))
