"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_count(text: Column) -> Column:
    """Pixels of a number written like ``16M`` or ``4K``; null if it isn't one."""
    form = r"^([0-9]+)([MmKk]?)$"
    unit = F.upper(F.regexp_extract(text, form, 2))
    digits = F.regexp_extract(text, form, 1)
    return F.when(digits != "", digits.cast("long") * F.when(unit == "M", 1_000_000).when(unit == "K", 1_000).otherwise(1))
