"""Display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(column: str | Column) -> Column:
    return F.format_number(F.col(column) if isinstance(column, str) else column, 0)


def two_digits(column: Column) -> Column:
    return F.lpad(column.cast("string"), 2, "0")


def padded_id(column: str, width: int = 10) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def play_time_text(column: str) -> Column:
    """``1y02m``, ``3h05m``, ``7s``: the two largest units of the time from the
    epoch to ``column`` seconds later, in calendar years and months."""
    seconds = F.col(column).cast("long")
    end = F.timestamp_seconds(seconds)
    units = [
        ("y", F.year(end) - 1970),
        ("m", F.month(end) - 1),
        ("d", F.dayofmonth(end) - 1),
        ("h", F.hour(end)),
        ("m", F.minute(end)),
        ("s", F.second(end)),
    ]
    text = None
    for (unit, amount), (next_unit, next_amount) in zip(units, units[1:]):
        pair = F.concat(thousands(amount), F.lit(unit), two_digits(next_amount), F.lit(next_unit))
        text = F.when(amount > 0, pair) if text is None else text.when(amount > 0, pair)
    return text.otherwise(F.concat(F.second(end).cast("string"), F.lit("s")))


def whole_months(start: str, end: Column) -> Column:
    """Full calendar months between two instants."""
    seen = F.col(start)
    apart = (F.year(end) - F.year(seen)) * 12 + F.month(end) - F.month(seen)
    reached = seen + F.make_ym_interval(F.lit(0), apart)
    return F.when(reached > end, apart - 1).otherwise(apart)


def _plural(amount: Column, unit: str) -> Column:
    return F.concat(thousands(amount), F.lit(f" {unit}"), F.when(amount == 1, "").otherwise("s"))


def short_duration(start: str, end: Column) -> Column:
    """``3 hours``: the largest unit only."""
    months = whole_months(start, end)
    years = F.floor(months / 12)
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)
    days, hours, minutes = (F.floor(seconds / n) for n in (86400, 3600, 60))
    return (
        F.when(years > 0, _plural(years, "year"))
        .when(months > 0, _plural(months, "month"))
        .when(days > 0, _plural(days, "day"))
        .when(hours > 0, _plural(hours, "hour"))
        .when(minutes > 0, _plural(minutes, "minute"))
        .otherwise(_plural(seconds, "second"))
    )


def presence_state(servers: str, last_seen: str, now: Column) -> Column:
    """``online`` when on any server, else how long ago: minutes, hours, days
    or months (years count as months)."""
    seconds = F.unix_micros(now) - F.unix_micros(last_seen)
    return (
        F.when(F.size(servers) > 0, "online")
        .when(whole_months(last_seen, now) > 0, "months")
        .when(seconds >= 86_400_000_000, "days")
        .when(seconds >= 3_600_000_000, "hours")
        .otherwise("minutes")
    )


def capitalized(column: str) -> Column:
    text = F.col(column)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2_147_483_647)))


def camel_case_words(column: str) -> Column:
    """A space before every capital letter, first letter raised."""
    spaced = F.regexp_replace(F.col(column), "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2_147_483_647))
