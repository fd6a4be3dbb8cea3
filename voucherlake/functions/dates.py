"""Date parsing: printed dates to ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printed date shapes.
DATE_PATTERN = r"(?U)\d{4}\s*[年/-]\s*\d{1,2}\s*[月/-]\s*\d{1,2}\s*日?"
DATE_PARTS = r"(?U)(\d{4})\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})\s*日?"
SPACED_DATE_PARTS = r"(?U)(\d{4})(?:\s*[年/-]\s*|\s+)(\d{1,2})(?:\s*[月/-]\s*|\s+)(\d{1,2})\s*(?:日)?"


def _iso(text: Column, parts: str) -> Column:
    year, month, day = (F.regexp_extract(text, parts, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return iso.try_cast("date").cast("string")


def iso_date(text: Column) -> Column:
    """First printed date as yyyy-MM-dd; an impossible date gives null."""
    return _iso(text, DATE_PARTS)


def spaced_iso_date(text: Column) -> Column:
    """Like iso_date, but the parts may also be separated by blanks only."""
    return _iso(text, SPACED_DATE_PARTS)


def has_date(text: Column) -> Column:
    # Few lines hold what stands between the parts of a date.
    return (text.contains("年") | text.contains("/") | text.contains("-")) & text.rlike(DATE_PATTERN)


def all_dates(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(DATE_PATTERN), 0)
    return F.filter(F.transform(found, iso_date), lambda d: d.isNotNull())
