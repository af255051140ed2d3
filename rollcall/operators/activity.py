"""Activity calendars, dense series and their scales."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import play_time_text, thousands
from rollcall.operators.asof import positions

MAX_SPAN_DAYS = 5 * 366
PRESET_DAYS = {"30d": 30, "90d": 90, "1y": 365}
DEFAULT_RANGE = "90d"
QUARTERS = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Domain:
    """Closed range of days to show."""

    range: str
    start: date
    end: date


def parse_day(text: str | None) -> date | None:
    if text is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def resolve_domain(today: date, range_name: str | None = None, start: str | None = None,
                   end: str | None = None,
                   first_day: Callable[[], date | None] = lambda: None) -> Domain:
    """Days asked for: a custom range, everything, or a preset (90 days when
    unusable); never past yesterday and never longer than five years."""
    yesterday = today - timedelta(days=1)
    longest = timedelta(days=MAX_SPAN_DAYS - 1)
    custom_start, custom_end = parse_day(start), parse_day(end)
    if custom_start is not None and custom_end is not None and custom_start <= custom_end:
        last = min(custom_end, yesterday)
        return Domain("custom", max(custom_start, last - longest), last)
    if range_name == "all":
        first = first_day()
        if first is None or first > yesterday:
            first = yesterday
        return Domain("all", max(first, yesterday - longest), yesterday)
    name = range_name if range_name in PRESET_DAYS else DEFAULT_RANGE
    return Domain(name, yesterday - timedelta(days=PRESET_DAYS[name] - 1), yesterday)


def shift_domain(domain: Domain, direction: int, today: date) -> Domain:
    """The neighbouring window of the same length, stopped at yesterday."""
    span = domain.end - domain.start + timedelta(days=1)
    start, end = domain.start + direction * span, domain.end + direction * span
    yesterday = today - timedelta(days=1)
    if end > yesterday:
        start, end = yesterday - span + timedelta(days=1), yesterday
    return Domain("custom", start, end)


def first_day(table: DataFrame, where: Column | None = None) -> date | None:
    rows = table if where is None else table.where(where)
    return rows.agg(F.min("day")).first()[0]


def in_domain(table: DataFrame, domain: Domain) -> DataFrame:
    return table.where(F.col("day").between(F.lit(domain.start), F.lit(domain.end)))


def daily_players(player_days: DataFrame, since: date | None = None) -> DataFrame:
    """Players per day. The day table has one row per player and day, so this
    is a plain count; only a lower bound applies."""
    rows = player_days if since is None else player_days.where(F.col("day") >= F.lit(since))
    return rows.groupBy("day").agg(F.count("*").alias("players"))


def day_spine(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def dense_days(spark, domain: Domain) -> DataFrame:
    bounds = spark.range(1).select(
        F.lit(domain.start).alias("_start"), F.lit(domain.end).alias("_end")
    )
    return day_spine(bounds, "_start", "_end").select("day")


def fill_days(rows: DataFrame, domain: Domain) -> DataFrame:
    """One row for every day of the domain, gaps null."""
    spine = dense_days(rows.sparkSession, domain)
    return spine.join(in_domain(rows, domain), "day", "left")


def entity_domains(table: DataFrame, key: str, value: str, today: date) -> DataFrame:
    """Per entity: its whole range (from its first day, five years at most, to
    yesterday) and the three level thresholds over that range.

    The collected values are at most one per day of a five-year range.
    """
    end = F.date_sub(F.lit(today), 1)
    earliest = F.date_sub(F.lit(today), MAX_SPAN_DAYS)
    shown = F.col("day").between(earliest, end) & (F.col(value) > 0)
    per_key = table.groupBy(key).agg(
        F.min("day").alias("_first"),
        F.array_sort(F.collect_list(F.when(shown, F.col(value)))).alias("_values"),
    )
    n = F.size("_values")

    def threshold(q: float) -> Column:
        index = F.least(n, F.floor(n * F.lit(q)).cast("int") + 1)
        return F.when(n > 0, F.get("_values", index - 1))

    return per_key.select(
        key,
        F.when(F.col("_first") > end, end)
        .otherwise(F.greatest("_first", earliest)).alias("start"),
        end.alias("end"),
        F.array(*[threshold(q) for q in QUARTERS]).alias("thresholds"),
    )


def level(value: str, thresholds: str = "thresholds") -> Column:
    """0 for nothing, else 1 to 4 by the first threshold not exceeded."""
    v = F.col(value)
    steps = F.when(v.isNull() | (v <= 0), 0)
    for i in range(len(QUARTERS)):
        steps = steps.when(v <= F.get(thresholds, F.lit(i)), i + 1)
    return steps.otherwise(len(QUARTERS) + 1)


def calendar(table: DataFrame, key: str, value: str, today: date) -> DataFrame:
    """Dense calendar of every entity: value or null, level and grid cell."""
    spine = day_spine(entity_domains(table, key, value, today), "start", "end")
    sunday = F.date_sub("start", F.dayofweek("start") - 1)
    return (
        spine.join(table.select(key, "day", value), [key, "day"], "left")
        .withColumn("level", level(value))
        .withColumn("week", F.floor(F.datediff("day", sunday) / 7).cast("int"))
        .withColumn("weekday", F.dayofweek("day") - 1)
        .drop("thresholds", "end")
    )


def day_text(day: str) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def activity(table: DataFrame, key: str, domain: Domain, value: str = "play_time") -> DataFrame:
    """Value and tooltip text of every entity and active day of the domain."""
    shown = in_domain(table, domain)
    return shown.select(
        key, "day", F.col(value).alias("value"), tooltip(table.columns).alias("tooltip")
    )


def entity_activity(table: DataFrame, key: str, entity, domain: Domain,
                    value: str = "play_time") -> DataFrame:
    """One entity; the filter on its key reaches the scan of the day table."""
    return activity(table.where(F.col(key) == F.lit(entity)), key, domain, value).drop(key)


def tooltip(columns: list[str]) -> Column:
    """Text for a day, by what its table holds."""
    if "avg_clients" in columns:
        return F.concat(
            F.col("avg_clients").cast("string"), F.lit(" avg clients · peak "),
            F.col("max_clients").cast("string"), F.lit(" on "), day_text("day"),
        )
    text = play_time_text("play_time")
    if "player_count" in columns:
        text = F.concat(text, F.lit(" · "), thousands("player_count"), F.lit(" players"))
    return F.concat(text, F.lit(" on "), day_text("day"))


def server_timeline(headers: DataFrame, width: float = 1000.0, height: float = 36.0) -> DataFrame:
    """Population of each server over time, scaled to its own maximum (at
    least one): ``x`` by position, ``y`` by clients."""
    points = positions(
        headers.select("server", "snapshot_id", "ts", "num_clients")
        .withColumn("_day", F.to_date("ts")),
        ["server"], "_day", [F.col("ts").asc(), F.col("snapshot_id").asc()],
    ).drop("_day")
    peak = headers.groupBy("server").agg(
        F.greatest(F.lit(1), F.max("num_clients")).alias("peak")
    )
    along = F.when(F.col("total") == 1, F.lit(width)).otherwise(
        (F.col("position") - 1) / (F.col("total") - 1) * width
    )
    return (
        points.join(peak, "server")
        .withColumn("x", along)
        .withColumn("y", F.col("num_clients") / F.col("peak") * height)
        .drop("total")
    )


def nice_maximum(value: str) -> Column:
    """Smallest of 1, 2, 2.5, 5 or 10 times a power of ten that holds the value."""
    v = F.col(value).cast("double")
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    steps = F.when(v.isNull() | (v <= 0), F.lit(1.0))
    for factor in (1.0, 2.0, 2.5, 5.0):
        steps = steps.when(magnitude * factor >= v, magnitude * factor)
    return steps.otherwise(magnitude * 10.0)
