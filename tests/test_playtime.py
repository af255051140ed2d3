from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rollcall.operators import asof, playtime
from tests.conftest import at, rows


def test_no_previous_snapshot_gives_nothing(headers, clients):
    c = playtime.credited(headers((1, at(0), 1, 7, "CTF", 1)), clients((1, 0, "a", "x", 0, True)))
    assert rows(c) == []


def two(headers, seconds):
    return headers((1, at(0), 1, 7, "CTF", 1), (2, at(seconds / 60), 1, 7, "CTF", 1))


@pytest.mark.parametrize("seconds,credit", [
    (300, 300), (600, 600), (601, 300), (3600, 300), (1, 1), (0, None)])
def test_gap_rule(headers, seconds, credit):
    got = {r.snapshot_id: r.credit for r in asof.elapsed(two(headers, seconds)).collect()}
    assert got == {1: None, 2: credit}


def test_fraction_of_a_second_is_cut(spark):
    h = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 1), (2, datetime(2024, 1, 1, 0, 0, 1, 999_000), 1)],
        "snapshot_id long, ts timestamp, server int")
    assert [r.elapsed for r in asof.elapsed(h).orderBy("snapshot_id").collect()] == [None, 1]


def test_totals_of_two_players_in_one_clan(headers, clients):
    c = playtime.credited(
        two(headers, 300),
        clients((2, 0, "a", "x", 0, True), (2, 1, "b", "x", 0, False), (2, 2, "a", "x", 0, True)))
    expected = {
        "player": [("a", 300), ("b", 300)], "clan": [("x", 600)],
        "clan_player": [("x", "a", 300), ("x", "b", 300)],
        "map": [(7, 600)], "game_type": [("CTF", 600)], "server": [(1, 600)],
        "player_map": [("a", 7, 300), ("b", 7, 300)], "clan_map": [("x", 7, 600)],
        "player_game_type": [("a", "CTF", 300), ("b", "CTF", 300)],
        "clan_game_type": [("x", "CTF", 600)],
    }
    for name, keys in playtime.TOTALS.items():
        assert rows(playtime.play_time(c, keys)) == expected[name], name
    tagged = playtime.all_totals(c)
    for name, keys in playtime.TOTALS.items():
        want = sorted((tuple(map(str, r[:-1])) + (r[-1],) for r in expected[name]), key=str)
        assert rows(tagged.where(F.col("total") == name), *keys, "play_time") == want


def test_no_clan_gives_no_clan_total(headers, clients):
    c = playtime.credited(two(headers, 300), clients((2, 0, "a", None, 0, True)))
    assert rows(playtime.play_time(c, ("clan",))) == []
    assert rows(playtime.play_time(c, ("player",))) == [("a", 300)]


def test_ties_are_never_their_own_previous(headers):
    h = headers((1, at(0), 1, 7, "CTF", 0), (2, at(5), 1, 8, "CTF", 0), (3, at(5), 1, 9, "CTF", 0),
                (4, at(10), 1, 7, "CTF", 0), (5, at(10), 2, 7, "CTF", 0))
    got = rows(asof.previous_snapshot(h), "snapshot_id", "prev_snapshot_id", "prev_map")
    assert got == [(1, None, None), (2, 1, 7), (3, 1, 7), (4, 3, 9), (5, None, None)]


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_previous_crosses_buckets(headers, bucket):
    stamps = [(i, at(m, d), 1, i, "CTF", 0) for i, (d, m) in enumerate(
        [(1, 0), (1, 59), (1, 60), (1, 1439), (2, 0), (9, 5), (9, 5), (9, 6)])]
    got = rows(asof.previous_snapshot(headers(*stamps), bucket=bucket), "snapshot_id", "prev_snapshot_id")
    assert got == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 6)]


def test_last_known_state_seeds_the_first_bucket(spark, headers):
    known = spark.createDataFrame([(1, at(0), 90, 7), (3, at(0), 91, 7)],
                                  "server int, ts timestamp, snapshot_id long, map int")
    h = headers((1, at(5), 1, 7, "CTF", 0), (2, at(5), 2, 7, "CTF", 0), (3, at(1, 2), 1, 7, "CTF", 0))
    got = rows(asof.previous_snapshot(h, last_known=known), "snapshot_id", "prev_snapshot_id")
    assert got == [(1, 90), (2, None), (3, 1)]


def test_a_server_with_all_rows_is_split_by_bucket(spark):
    """Brute force over one server: the window never spans more than an hour."""
    h = spark.range(5000).select(
        F.col("id").alias("snapshot_id"), F.lit(1).alias("server"), F.lit(7).alias("map"),
        F.timestamp_seconds(1_704_067_200 + (F.col("id") * 7919) % 500_000).alias("ts"))
    pdf = h.toPandas().sort_values(["ts", "snapshot_id"])
    at_ts = pdf.groupby("ts").snapshot_id.max()
    want = dict(zip(at_ts.index, at_ts.shift(1)))
    got = asof.previous_snapshot(h, bucket="hour").toPandas()
    assert all((r.prev_snapshot_id == want[r.ts]) or (want[r.ts] != want[r.ts]) for r in got.itertuples())
    assert len(got) == 5000


def test_stored_totals_and_deltas(spark):
    stored = spark.createDataFrame([("a", 10), ("b", None)], "player string, play_time long")
    deltas = spark.createDataFrame([("a", 5), ("c", 7)], "player string, play_time long")
    got = rows(playtime.add_deltas(stored, deltas, ["player"], "play_time"))
    assert got == [("a", 15), ("b", 0), ("c", 7)]


def test_positions_over_buckets(spark):
    df = spark.createDataFrame([("s", i // 3, i) for i in range(10)], "k string, b int, v int")
    got = rows(asof.positions(df, ["k"], "b", [F.col("v")]), "v", "position", "total")
    assert sorted(got) == [(i, i + 1, 10) for i in range(10)]


def test_play_sessions(spark):
    data = [("a", at(0)), ("a", at(5)), ("a", at(15)), ("a", at(25.5)), ("b", at(0)), ("b", at(0)), ("b", at(0, day=2))]
    df = spark.createDataFrame(data, "player string, ts timestamp")
    got = rows(playtime.play_sessions(df), "player", "started", "last_seen", "snapshots")
    assert got == sorted([("a", at(0), at(15), 3), ("a", at(25.5), at(25.5), 1), ("b", at(0), at(0), 2), ("b", at(0, day=2), at(0, day=2), 1)], key=str)
    assert playtime.play_sessions(df.limit(0)).count() == 0


def test_play_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    data = [(p, at(7 * i + 40 * (i // 3))) for i in range(9) for p in ("a", "b")]
    df = spark.createDataFrame(data, "player string, ts timestamp")
    for n, part in enumerate((df, spark.createDataFrame([("z", at(0, day=9))], df.schema))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = (playtime.play_sessions(stream.withWatermark("ts", "1 hour")).writeStream.format("parquet").outputMode("append")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(playtime.play_sessions(df))
