"""Dates of two calendars and several surface forms; derived date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month abbreviations by number, English and Thai.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "ม.ค.": 1, "ก.พ.": 2, "มี.ค.": 3, "เม.ย.": 4, "พ.ค.": 5, "มิ.ย.": 6, "ก.ค.": 7, "ส.ค.": 8, "ก.ย.": 9, "ต.ค.": 10, "พ.ย.": 11, "ธ.ค.": 12,
}
#: Years above this are Buddhist Era, which runs 543 years ahead.
BUDDHIST_FROM, BUDDHIST_AHEAD = 2400, 543

_ANY = r"^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4})|(\d{1,2})\s+(\D+?)\s+(\d{4}))$"


def be_to_ce_date(c: Column) -> Column:
    """Date of ``Y-M-D``, ``D/M/Y`` or ``D month Y``, years in either calendar; null for anything
    else, including days that do not exist."""
    text = F.trim(c.cast("string"))
    part = [F.nullif(F.regexp_extract(text, _ANY, i), F.lit("")) for i in range(10)]
    year = F.coalesce(part[1], part[6], part[9]).try_cast("int")
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.coalesce(F.coalesce(part[2], part[5]).try_cast("int"), F.try_element_at(months, F.coalesce(F.lower(part[8]), F.lit(""))))
    day = F.coalesce(part[3], part[4], part[7]).try_cast("int")
    ce = F.when(year > BUDDHIST_FROM, year - BUDDHIST_AHEAD).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", ce, month, day), "yyyy-MM-dd")


def age_years(born: Column, as_of: Column) -> Column:
    """Whole years of 365.25 days."""
    return F.floor(F.datediff(as_of, born) / F.lit(365.25)).cast("int")


def reporting_lag(reported: Column, happened: Column) -> Column:
    return F.datediff(reported, happened)


def date_key(d: Column) -> Column:
    """yyyymmdd as an integer."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")
