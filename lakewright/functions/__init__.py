"""Column functions: every one returns a Column and stays inside code generation."""

from lakewright.functions.dates import age_years, be_to_ce_date, date_key, reporting_lag, year_month
from lakewright.functions.ids import is_valid_thai_id, thai_id_check_digit
from lakewright.functions.money import convert
from lakewright.functions.pii import PII_TYPES, mask_pii
from lakewright.functions.text import band, clean_code, clean_text, normalise_status, partner_code

__all__ = [
    "PII_TYPES", "age_years", "band", "be_to_ce_date", "clean_code", "clean_text", "convert", "date_key", "is_valid_thai_id", "mask_pii", "normalise_status", "partner_code",
    "reporting_lag", "thai_id_check_digit", "year_month",
]
