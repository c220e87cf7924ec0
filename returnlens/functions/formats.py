"""SF1: numbers as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(c: Column, digits: int = 2) -> Column:
    """0.1234 → '12.34%'."""
    return F.format_string(f"%.{digits}f%%", c * 100)


def money(c: Column, thousands: bool = False) -> Column:
    """1234.5 → '$1234.50', with ``thousands`` '$1,234.50'."""
    return F.format_string("$%,.2f" if thousands else "$%.2f", c)


def thousands(c: Column) -> Column:
    """1234567 → '1,234,567'."""
    return F.format_string("%,d", c.cast("bigint"))


def days(c: Column, digits: int = 1) -> Column:
    """3.25 → '3.3 days'."""
    return F.format_string(f"%.{digits}f days", c)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)
