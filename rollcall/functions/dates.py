"""UTC day helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(column: str) -> Column:
    return F.to_date(F.col(column), "yyyy-MM-dd")


def format_day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def day_end(column: str) -> Column:
    """First instant after the day."""
    return F.date_add(column, 1).cast("timestamp")


def month_start(column: str) -> Column:
    return F.trunc(column, "month")


def hours_before(now: Column, hours: int) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(hours))
