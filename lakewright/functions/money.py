"""Currency conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def convert(amount: Column, currency: Column, rate: Column, reporting: str = "THB") -> Column:
    """amount in the reporting currency, 2 decimals half up; null without a rate, never passed through."""
    factor = F.when(currency == reporting, F.lit(1).cast("decimal(18,8)")).otherwise(rate.cast("decimal(18,8)"))
    return F.round(amount.cast("decimal(20,4)") * factor, 2)
