"""Dates written by people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that are understood; each matches only strings of its own shape.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy-M", "yyyy/M", "yyyy年M月", "yyyy")


def parse_date(text: Column, iso_prefix: bool = False) -> Column:
    """Date of a string in one of DATE_FORMATS, missing parts as 1; null for anything else.

    With ``iso_prefix`` a string that no format matches is tried by its first ten characters, as a
    timestamp's text would need. The string itself is not trimmed."""
    tried = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    if iso_prefix:
        tried.append(F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-M-d"))))
    return F.coalesce(*tried)
