"""Cleaning, normalising and banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Policy status words and what they stand for; anything else is UNKNOWN.
STATUS_WORDS = {
    "ACTIVE": "ACTIVE",
    "CANCELLED": "CANCELLED",
    "CANCELED": "CANCELLED",
    "EXPIRED": "EXPIRED",
    "มีผลบังคับ": "ACTIVE",
    "ยกเลิก": "CANCELLED",
    "หมดอายุ": "EXPIRED",
}


def clean_text(c: Column) -> Column:
    """Trimmed of spaces, runs of white space as one space, empty as null."""
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "), F.lit(""))


def clean_code(c: Column) -> Column:
    """clean_text in upper case."""
    return F.upper(clean_text(c))


def normalise_status(c: Column) -> Column:
    """One of ACTIVE, CANCELLED, EXPIRED, UNKNOWN (also for null)."""
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.coalesce(clean_code(c), F.lit(""))), F.lit("UNKNOWN"))


def partner_code(path: Column) -> Column:
    """Partner of a landing path ``.../partner_drops/<partner>/...``, upper case."""
    return F.upper(F.regexp_extract(path, r"partner_drops/([^/]+)/", 1))


def band(c: Column, edges: Sequence[float], labels: Sequence[str], inclusive: bool = False) -> Column:
    """labels[i] for the first edge that c is below (or at, if inclusive), else the last label.

    A null passes no test and so gets the last label.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = None
    for edge, label in zip(edges, labels, strict=False):
        test = c <= edge if inclusive else c < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(labels[-1]) if out is None else out.otherwise(labels[-1])
