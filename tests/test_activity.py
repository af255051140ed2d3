from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates, text
from rollcall.operators import activity
from rollcall.operators.activity import Domain, resolve_domain, shift_domain
from tests.conftest import at, rows

TODAY = date(2024, 3, 1)


@pytest.mark.parametrize("args,want", [
    (dict(), ("90d", date(2023, 12, 2), date(2024, 2, 29))),
    (dict(range_name="30d"), ("30d", date(2024, 1, 31), date(2024, 2, 29))),
    (dict(range_name="nonsense"), ("90d", date(2023, 12, 2), date(2024, 2, 29))),
    (dict(start="2024-01-01", end="2024-12-31"), ("custom", date(2024, 1, 1), date(2024, 2, 29))),
    (dict(start="2000-01-01", end="2024-02-29"), ("custom", date(2019, 2, 26), date(2024, 2, 29))),
    (dict(start="2024-02-02", end="2024-02-01", range_name="1y"), ("1y", date(2023, 3, 2), date(2024, 2, 29))),
    (dict(start="2024-02-31", end="2024-02-01"), ("90d", date(2023, 12, 2), date(2024, 2, 29))),
    (dict(range_name="all"), ("all", date(2024, 2, 29), date(2024, 2, 29))),
    (dict(range_name="all", first_day=lambda: date(2024, 1, 5)), ("all", date(2024, 1, 5), date(2024, 2, 29))),
    (dict(range_name="all", first_day=lambda: date(2001, 1, 5)), ("all", date(2019, 2, 26), date(2024, 2, 29))),
])
def test_domains(args, want):
    got = resolve_domain(TODAY, **args)
    assert (got.range, got.start, got.end) == want


def test_windows_shift_by_their_span():
    d = Domain("30d", date(2024, 1, 31), date(2024, 2, 29))
    back = shift_domain(d, -1, TODAY)
    assert (back.start, back.end) == (date(2024, 1, 1), date(2024, 1, 30))
    stay = shift_domain(back, 1, date(2024, 2, 10))
    assert (stay.start, stay.end) == (date(2024, 1, 11), date(2024, 2, 9))


def table(spark, values, start=1):
    data = [(date(2024, 1, start + i), "e", v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "day date, player string, play_time int")


@pytest.mark.parametrize("values,thresholds", [
    ([1, 2, 3, 4], [2, 3, 4]), ([5], [5, 5, 5]), ([0, 0], [None] * 3),
    ([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4, 5, 6, 7, 8], [3, 5, 7]), ([0, 9, None, 9], [9, 9, 9])])
def test_thresholds_are_order_statistics(spark, values, thresholds):
    got = activity.entity_domains(table(spark, values), "player", "play_time", date(2024, 1, 20)).first()
    assert list(got.thresholds) == thresholds


def test_calendar_levels_and_grid(spark):
    days = activity.calendar(table(spark, [1, 2, None, 3, 4, 0], 3), "player", "play_time", date(2024, 1, 10))
    got = {r.day.day: (r.play_time, r.level, r.week, r.weekday) for r in days.collect()}
    # 3 January 2024 is a Wednesday.
    assert got == {3: (1, 1, 0, 3), 4: (2, 1, 0, 4), 5: (None, 0, 0, 5), 6: (3, 2, 0, 6), 7: (4, 3, 1, 0),
                   8: (0, 0, 1, 1), 9: (None, 0, 1, 2)}


def test_entity_seen_only_today_starts_yesterday(spark):
    got = activity.calendar(table(spark, [5], 10), "player", "play_time", date(2024, 1, 10)).collect()
    assert [(r.day, r.play_time, r.level) for r in got] == [(date(2024, 1, 9), None, 0)]


def test_dense_series(spark):
    d = Domain("custom", date(2024, 1, 1), date(2024, 1, 4))
    per_day = activity.daily_players(table(spark, [1, None, 2, None, 7]))
    assert rows(activity.fill_days(per_day, d)) == [
        (date(2024, 1, 1), 1), (date(2024, 1, 2), None), (date(2024, 1, 3), 1), (date(2024, 1, 4), None)]


def test_entity_tooltips(spark):
    d = Domain("custom", date(2024, 1, 1), date(2024, 1, 4))
    got = activity.entity_activity(table(spark, [7200 + 300]), "player", "e", d)
    assert rows(got) == [(date(2024, 1, 1), 7500, "2h05m on Jan 1, 2024")]
    scope = spark.createDataFrame([(date(2024, 1, 2), "x", 60, 1234)],
                                  "day date, clan string, play_time int, player_count int")
    assert activity.entity_activity(scope, "clan", "x", d).first().tooltip == "1m00s · 1,234 players on Jan 2, 2024"
    server = spark.createDataFrame([(date(2024, 1, 2), 1, 3, 9)], "day date, server int, avg_clients int, max_clients int")
    assert activity.entity_activity(server, "server", 1, d, "avg_clients").first().tooltip == (
        "3 avg clients · peak 9 on Jan 2, 2024")
    assert activity.first_day(scope) == date(2024, 1, 2)


@pytest.mark.parametrize("seconds,want", [
    (0, "0s"), (7, "7s"), (60, "1m00s"), (3 * 3600 + 5 * 60, "3h05m"), (86400, "1d00h"), (31 * 86400, "1m00d"),
    (365 * 86400 + 59 * 86400, "1y02m"), (12 * 3600 + 59, "12h00m")])
def test_play_time_text(spark, seconds, want):
    assert spark.range(1).select(F.lit(seconds).alias("s")).select(text.play_time_text("s")).first()[0] == want


@pytest.mark.parametrize("seen,want,state", [
    (datetime(2024, 2, 29, 23, 59, 30), "30 seconds", "minutes"),
    (datetime(2024, 2, 29, 23, 59, 0), "1 minute", "minutes"),
    (datetime(2024, 2, 29, 21, 0), "3 hours", "hours"),
    (datetime(2024, 2, 29), "1 day", "days"),
    (datetime(2024, 2, 1, 0, 0, 1), "28 days", "days"),
    (datetime(2024, 1, 31), "1 month", "months"),
    (datetime(2021, 3, 1, 0, 0, 1), "2 years", "months"),
])
def test_ages(spark, seen, want, state):
    now = F.lit(datetime(2024, 3, 1))
    df = spark.createDataFrame([(seen, [])], "seen timestamp, servers array<string>")
    assert df.select(text.short_duration("seen", now), text.presence_state("servers", "seen", now)).first() == (want, state)


def test_other_text_and_dates(spark):
    df = spark.createDataFrame([("camelCaseText", "fOO", 42, 1234567, "2024-02-15")],
                               "c string, w string, i int, n int, d string")
    day = dates.parse_day("d")
    got = df.select(
        text.camel_case_words("c"), text.capitalized("w"), text.padded_id("i"), text.thousands("n"),
        dates.month_start(day), dates.day_end("d"), dates.format_day(day)).first()
    assert tuple(got) == ("Camel Case Text", "Foo", "0000000042", "1,234,567", date(2024, 2, 1),
                          datetime(2024, 2, 16), "2024-02-15")


@pytest.mark.parametrize("value,want", [
    (0, 1.0), (-3, 1.0), (None, 1.0), (1, 1.0), (1.1, 2.0), (2.2, 2.5), (3, 5.0), (7, 10.0), (1000, 1000.0), (0.3, 0.5)])
def test_axis_maximum(spark, value, want):
    df = spark.createDataFrame([(None if value is None else float(value),)], "v double")
    assert abs(df.select(activity.nice_maximum("v")).first()[0] - want) < 1e-12


def test_timeline(spark, headers):
    h = headers((1, at(0), 1, 7, "CTF", 0), (2, at(5), 1, 7, "CTF", 4), (3, at(0, 2), 1, 7, "CTF", 2), (4, at(0), 2, 7, "CTF", 0))
    got = rows(activity.server_timeline(h), "server", "snapshot_id", "position", "peak", "x", "y")
    assert got == [(1, 1, 1, 4, 0.0, 0.0), (1, 2, 2, 4, 500.0, 36.0), (1, 3, 3, 4, 1000.0, 18.0), (2, 4, 1, 1, 1000.0, 0.0)]
