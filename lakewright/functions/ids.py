"""National identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thai_id_check_digit(c: Column) -> Column:
    """Check digit of the first twelve digits: (11 - sum of digit * weight 13..2 mod 11) mod 10."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * (13 - i) for i in range(12)), F.lit(0))
    return ((F.lit(11) - total % 11) % 10).cast("int")


def is_valid_thai_id(c: Column) -> Column:
    """Whether the digits are thirteen and the last is the check digit; null for null."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce((F.length(digits) == 13) & (F.substring(digits, 13, 1).try_cast("int") == thai_id_check_digit(c)), F.lit(False))
    )
