"""URLs in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import found

#: Fixed value: a URL ends at a comma, bar or quote.
URL = r"(?:http|https|ftp)://[^,|\"']+"


def urls(text: Column) -> Column:
    """All URLs as an array; null for null or empty text."""
    raw = text.cast("string")
    return F.when(raw != "", found(raw, URL))
