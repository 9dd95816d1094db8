"""Masking of personal data by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "***"


def _tail(keep: int, least: int) -> Callable[[Column, str], Column]:
    return lambda t, _: F.when(F.length(t) < least, F.lit(HIDDEN)).otherwise(F.concat(F.lit(HIDDEN), F.right(t, F.lit(keep))))


def _phone(t: Column, _: str) -> Column:
    return F.when(F.length(t) < 6, F.lit(HIDDEN)).otherwise(F.concat(F.left(t, F.lit(3)), F.lit("****"), F.right(t, F.lit(2))))


def _email(t: Column, _: str) -> Column:
    return F.when(~F.contains(t, F.lit("@")), F.lit(HIDDEN)).otherwise(F.concat(F.left(t, F.lit(1)), F.lit("***@"), F.split_part(t, F.lit("@"), F.lit(2))))


def _gone(t: Column, _: str) -> Column:
    return F.lit(None).cast("string")


PII_TYPES: dict[str, Callable[[Column, str], Column]] = {
    "national_id": lambda t, salt: F.sha2(F.concat(F.lit(salt), t), 256),
    "phone": _phone,
    "plate": _tail(2, 4),
    "chassis": _tail(4, 4),
    "email": _email,
    "dob": lambda t, _: F.concat(F.left(t, F.lit(4)), F.lit("-01-01")),
    "name": lambda t, _: F.concat(F.left(t, F.lit(1)), F.lit(".")),
    "address": lambda t, _: F.lit("[redacted]"),
    "health": _gone,
    "health_condition": _gone,
    "bmi": _gone,
}


def mask_pii(c: Column, pii_type: str, salt: str = "") -> Column:
    """c masked as its type asks; null stays null; an unknown type raises ValueError."""
    if pii_type not in PII_TYPES:
        raise ValueError(f"unknown pii type {pii_type!r}; known: {', '.join(PII_TYPES)}")
    text = F.trim(c.cast("string"))
    return F.when(c.isNotNull(), PII_TYPES[pii_type](text, salt)).cast("string")
