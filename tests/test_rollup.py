from datetime import date

from pyspark.sql import functions as F
import pytest

from rollcall.jobs import roll_up_days, roll_up_yesterday
from rollcall.operators import prepare, rollup
from rollcall.sources import day_tables
from tests.conftest import at, rows

DAY = date(2024, 1, 1)


def tables(headers, clients):
    return rollup.day_tables(headers, prepare.observe(headers, clients))


def test_in_game_player_counts_five_minutes(headers, clients):
    t = tables(headers((1, at(0), 1, 7, "CTF", 1)), clients((1, 0, "player0", "clan0", 0, True)))
    assert rows(t["player_day"]) == [(DAY, "player0", 300)]
    assert rows(t["server_day"]) == [(DAY, 1, 1, 1)]
    assert rows(t["map_day"]) == [(DAY, 7, 300, 1)]
    assert rows(t["game_type_day"]) == [(DAY, "CTF", 300, 1)]
    assert rows(t["clan_day"]) == [(DAY, "clan0", 300, 1)]


def test_spectator_is_present_without_time(headers, clients):
    t = tables(headers((1, at(0), 1, 7, "CTF", 1)), clients((1, 0, "player0", "clan0", 0, False)))
    assert rows(t["player_day"]) == [(DAY, "player0", 0)]
    assert rows(t["map_day"]) == [(DAY, 7, 0, 1)]
    assert rows(t["clan_day"]) == [(DAY, "clan0", 0, 1)]
    assert rows(t["server_day"]) == [(DAY, 1, 1, 1)]


def test_duplicate_name_counts_once_and_first_wins(headers, clients):
    t = tables(
        headers((1, at(0), 1, 7, "CTF", 2)),
        clients((1, 1, "player0", "second", 0, False), (1, 0, "player0", "first", 0, True)),
    )
    assert rows(t["player_day"]) == [(DAY, "player0", 300)]
    assert rows(t["clan_day"]) == [(DAY, "first", 300, 1)]


def test_empty_server_has_no_day(headers):
    h = headers((1, at(0), 1, 7, "CTF", 0), (2, at(0), 2, 7, "CTF", 1))
    assert rows(rollup.server_day(h), "server") == [(2,)]


def test_empty_hours_do_not_dilute(headers):
    h = headers((1, at(0), 1, 7, "CTF", 2), (2, at(5), 1, 7, "CTF", 2),
                (3, at(60), 1, 7, "CTF", 0), (4, at(120), 1, 7, "CTF", 4))
    assert rows(rollup.server_day(h)) == [(DAY, 1, 3, 4)]


def test_empty_snapshot_dilutes_its_own_hour(headers):
    h = headers((1, at(0), 1, 7, "CTF", 4), (2, at(5), 1, 7, "CTF", 1))
    assert rows(rollup.server_day(h)) == [(DAY, 1, 3, 4)]  # 2.5 rounds up
    h = headers((1, at(0), 1, 7, "CTF", 4), (2, at(5), 1, 7, "CTF", 0))
    assert rows(rollup.server_day(h)) == [(DAY, 1, 2, 4)]


def test_distinct_players_across_game_types(headers, clients):
    t = tables(
        headers((1, at(0), 1, 7, "CTF", 1), (2, at(5), 1, 8, "DM", 2)),
        clients((1, 0, "player0", "clan0", 0, True), (2, 0, "player0", "clan0", 0, True),
                (2, 1, "player1", None, 0, True)),
    )
    assert rows(t["player_day"]) == [(DAY, "player0", 600), (DAY, "player1", 300)]
    assert rows(t["game_type_day"]) == [(DAY, "CTF", 300, 1), (DAY, "DM", 600, 2)]
    assert rows(t["clan_day"]) == [(DAY, "clan0", 600, 1)]


def test_flat_rows_give_the_same_presence(spark, headers, clients):
    h = headers((1, at(0), 1, 7, "CTF", 1), (2, at(5), 1, 7, "CTF", 0))
    c = clients((1, 0, "a", None, 0, True), (1, 1, "a", "x", 0, True))
    flat = h.join(c, "snapshot_id", "left")
    assert rows(rollup.day_presence(flat)) == rows(rollup.day_presence(prepare.observe(h, c)))


def test_open_and_done_days_are_skipped(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "day date")
    done = spark.createDataFrame([(date(2024, 1, 1),)], "day date")
    assert rows(rollup.days_to_roll_up(days, done, date(2024, 1, 3))) == [(date(2024, 1, 2),)]


def names(spark, *pairs):
    return spark.createDataFrame(list(pairs), "name string, id int")


def test_unresolved_names_drop_out_and_are_counted(spark):
    days = spark.createDataFrame([(DAY, "a", 300), (DAY, "b", 0)], "day date, player string, play_time long")
    known = names(spark, ("a", 11))
    assert rows(rollup.resolve_ids(days, known, "player", "player_id")) == [(DAY, 300, 11)]
    assert rows(rollup.resolve_counts(days, known, "player")) == [(DAY, 1, 1)]


def flat(headers, clients, *more):
    return headers.join(clients, "snapshot_id", "left")


def test_day_write_is_idempotent_and_drops_emptied_days(spark, headers, clients, tmp_path):
    root = str(tmp_path / "days")
    h = headers((1, at(0, 1), 1, 7, "CTF", 1), (2, at(0, 2), 1, 7, "CTF", 1))
    c = clients((1, 0, "a", "x", 0, True), (2, 0, "b", None, 0, True))
    ids = (names(spark, ("a", 1), ("b", 2)), names(spark, ("x", 5)), names(spark, ("CTF", 9)))
    both = [date(2024, 1, 1), date(2024, 1, 2)]
    for _ in range(2):
        roll_up_days(flat(h, c), root, both, *ids)
        assert rows(day_tables.read_day_table(spark, root, "player_day"), "day", "player_id", "play_time") == [
            (both[0], 1, 300), (both[1], 2, 300)]
    # The first day is recomputed from nothing: its directory goes, the other stays.
    roll_up_days(flat(h, c).where("snapshot_id = 2"), root, both, *ids)
    for name in ("player_day", "server_day", "map_day", "game_type_day"):
        assert rows(day_tables.read_day_table(spark, root, name), "day") == [(both[1],)]
    assert rows(day_tables.read_day_table(spark, root, "clan_day"), "day") == []


def test_one_day_run_skips_open_and_done_days(spark, headers, clients, tmp_path):
    root = str(tmp_path / "days")
    f = flat(headers((1, at(0), 1, 7, "CTF", 1)), clients((1, 0, "a", None, 0, True)))
    ids = (names(spark, ("a", 1)), names(spark, ("x", 5)), names(spark, ("CTF", 9)))
    assert not roll_up_yesterday(f, root, DAY, DAY, *ids)
    assert roll_up_yesterday(f, root, date(2024, 1, 2), DAY, *ids)
    assert not roll_up_yesterday(f, root, date(2024, 1, 2), DAY, *ids)


def test_small_count_overflow_fails(spark):
    clan = spark.createDataFrame(
        [(DAY, "x", 1, 40000)], "day date, clan string, play_time long, player_count long")
    empty = {n: spark.createDataFrame([], s) for n, s in {
        "player_day": "day date, player string, play_time long",
        "server_day": "day date, server int, avg_clients int, max_clients int",
        "map_day": "day date, map int, play_time long, player_count long",
        "game_type_day": "day date, game_type string, play_time long, player_count long",
    }.items()}
    ids = names(spark, ("x", 1))
    out = day_tables.with_ids({**empty, "clan_day": clan}, ids, ids, ids)
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        out["clan_day"].collect()


def test_a_hot_key_of_copies_is_reduced_before_the_shuffle(spark):
    """One (snapshot, player) holds nearly all rows; every input partition sends
    at most one row for it."""
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") < n - 2, 1).otherwise(F.col("id")).cast("long").alias("snapshot_id"),
        F.lit("p").alias("player"), F.col("id").alias("ordinal"), F.col("id").alias("v"))
    out = prepare.first_occurrence(df)
    assert rows(out) == [(1, "p", 0, 0), (n - 2, "p", n - 2, n - 2), (n - 1, "p", n - 1, n - 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[plan.rindex("WindowGroupLimit"):]


def test_unknown_names_are_counted(spark, headers, clients, tmp_path):
    h = headers((1, at(0, 1), 1, 7, "CTF", 2))
    c = clients((1, 0, "a", "x", 0, True), (1, 1, "stranger", None, 0, True))
    ids = (names(spark, ("a", 1)), names(spark, ("y", 5)), names(spark, ("CTF", 9)))
    got = roll_up_days(flat(h, c), str(tmp_path / "days"), [date(2024, 1, 1)], *ids)
    first = date(2024, 1, 1)
    assert got == {"player_day": [(first, 1, 1)], "game_type_day": [(first, 1, 0)], "clan_day": [(first, 0, 1)]}
