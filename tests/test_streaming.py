from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollcall import jobs
from rollcall.operators import playtime, rating, rollup, state
from rollcall.schema import FLAT
from rollcall.sources.archive import to_archive
from rollcall.streaming import closed_days
from rollcall.streaming import feed as feeds
from rollcall.streaming import live

START = datetime(2024, 1, 1)


def polls(spark):
    """Two servers, two hours, changing crowds; the second server is timed."""
    out, i = [], 0
    for tick in range(24):
        for server in (1, 2):
            i += 1
            ts = START + timedelta(minutes=5 * tick + server)
            crowd = [(f"p{(tick // 6 + k) % 7}", "x" if k % 2 else None, (tick * (k + 3)) % 11 + tick) for k in range((tick + server) % 5)]
            game = "CTF" if server == 1 else "Race"
            head = (i, ts, server, f"s{server}", "0.6", server * 10, "m", game, 1, 8, len(crowd), 16)
            if not crowd:
                out.append((*head, None, None, None, None, None, None))
            out += [(*head, n, c, s, -1, True, k) for k, (n, c, s) in enumerate(crowd)]
    return spark.createDataFrame(out, FLAT)


@pytest.fixture(scope="module")
def drops(spark, tmp_path_factory):
    """The same rows delivered as files of one hour, each file twice."""
    folder = tmp_path_factory.mktemp("drop")
    df = polls(spark)
    for hour in (0, 1):
        part = df.where(F.hour("ts") == hour)
        for copy in ("a", "b"):
            to_archive(part).coalesce(1).write.mode("overwrite").parquet(str(folder / f"{hour}{copy}"))
    return str(folder)


def read(spark, drops, per_trigger):
    return feeds.read_feed(spark, f"{drops}/*", per_trigger)


def run(df, spark, name, mode, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def same(a, b, columns, digits=None):
    def norm(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in df.select(*columns).collect()), key=str)
    assert norm(a) == norm(b)


def test_rows_and_headers_count_once(spark, drops, tmp_path):
    got = run(feeds.unique_rows(read(spark, drops, 2)), spark, "uniq", "append", tmp_path)
    want = polls(spark)
    assert got.count() == want.count()
    heads = run(feeds.unique_headers(read(spark, drops, 2)), spark, "heads", "append", tmp_path)
    assert heads.count() == want.select("snapshot_id").distinct().count()


def test_closed_hours_and_days_equal_the_batch(spark, drops, tmp_path):
    # A later poll moves the watermark past the windows.
    stream = feeds.unique_headers(read(spark, drops, 1), "0 minutes")
    hours = run(feeds.server_hours(stream), spark, "hours", "append", tmp_path)
    want = rollup.server_hour(jobs.headers_of(polls(spark))).where("hour < TIMESTAMP'2024-01-01 01:00:00'")
    same(hours.withColumn("hour", F.col("hour.start")), want, ["server", "hour", "snapshot_count", "client_sum", "max_clients"])


def test_closed_days(spark, tmp_path):
    df = polls(spark)
    moved = df.withColumn("ts", F.col("ts") + F.expr("interval 3 days")).withColumn("snapshot_id", F.col("snapshot_id") + 1000)
    for i, part in enumerate((df, moved, moved.withColumn("ts", F.col("ts") + F.expr("interval 9 days")))):
        to_archive(part).coalesce(1).write.parquet(str(tmp_path / "drop" / str(i)))
    stream = feeds.unique_headers(feeds.read_feed(spark, f"{tmp_path}/drop/*", 1), "1 hour")
    got = run(feeds.server_days(stream), spark, "days", "append", tmp_path)
    want = rollup.server_day(jobs.headers_of(df))
    first = got.where("day = DATE'2024-01-01'")
    same(first, want, ["day", "server", "avg_clients", "max_clients"])


def test_closed_days_are_written_once_and_reopened(spark, tmp_path):
    """Day folders from a stream; a batch that runs again and a late row change what they should."""
    df = polls(spark)
    later = [df.withColumn("ts", F.col("ts") + F.expr(f"interval {n} days")).withColumn("snapshot_id", F.col("snapshot_id") + 1000 * n) for n in (0, 1, 4)]
    for i, part in enumerate(later):
        to_archive(part).coalesce(1).write.parquet(str(tmp_path / "drop" / str(i)))
    table = closed_days.ClosedDays(spark, str(tmp_path / "days"))
    run_all = lambda: closed_days.start_closed_days(feeds.read_feed(spark, f"{tmp_path}/drop/*", 1), table, str(tmp_path / "ck"), "1 hour").awaitTermination()
    run_all()
    run_all()
    columns = ["day", "server", "avg_clients", "max_clients"]
    got = lambda: table.read().withColumnRenamed("server_id", "server")
    want = rollup.server_day(jobs.headers_of(later[0].unionByName(later[1])))
    same(got(), want, columns)
    entries = table.ledger().collect()
    assert sorted(str(e.day) for e in entries) == ["2024-01-01", "2024-01-02"] and all(e.query and e.rows == 2 for e in entries)
    # A late snapshot of the first day, behind the watermark: the day is written again.
    late = df.where("snapshot_id = 47").withColumn("snapshot_id", F.lit(999).cast("long")).withColumn("num_clients", F.lit(90)).withColumn("ts", F.col("ts") + F.expr("interval 8 hours"))
    whole = later[0].unionByName(later[1]).unionByName(late)
    table.reopen(whole, [START.date()])
    same(got(), rollup.server_day(jobs.headers_of(whole)), columns)
    assert table.ledger().where(f"batch = {closed_days.REOPENED}").count() == 1
    table.reopen(whole.limit(0), [START.date()])
    assert [str(r.day) for r in got().select("day").distinct().collect()] == ["2024-01-02"]


def test_latest_state_and_counts(spark, drops, tmp_path):
    stream = read(spark, drops, 2).select("server", "ts", "snapshot_id", "map", "num_clients")
    got = run(feeds.latest_states(stream), spark, "latest", "complete", tmp_path)
    want = state.latest_state(jobs.headers_of(polls(spark)).select("server", "ts", "snapshot_id", "map", "num_clients"))
    same(got, want, ["server", "snapshot_id", "map", "num_clients"])
    ids = feeds.unique_headers(read(spark, drops, 2)).select(F.lit("snapshots").alias("entity"), F.col("snapshot_id").alias("id"))
    got = run(feeds.entity_counts(ids), spark, "counts", "complete", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("snapshots", 48, 48)]


def methods(spark):
    return spark.createDataFrame([("CTF", "ELO"), ("Race", "TIME")], "game_type string, rank_method string")


@pytest.fixture(scope="module")
def lived(spark, drops, tmp_path_factory):
    root = tmp_path_factory.mktemp("live")
    tables = live.LiveTables(spark, str(root / "tables"), compact_every=2)
    rows = live.with_rank_method(feeds.unique_rows(read(spark, drops, 2)), methods(spark))
    live.start_live(rows, tables, str(root / "ck")).awaitTermination()
    return tables


def test_play_time_equals_the_batch(spark, lived):
    df = polls(spark)
    want = playtime.all_totals(playtime.credited(jobs.headers_of(df), jobs.clients_of(df)))
    same(lived.play_time(), want, ["total", "server", "map", "game_type", "clan", "player", "play_time"])


def test_ratings_equal_hourly_rounds(spark, lived):
    df = polls(spark)
    elo = df.where("game_type = 'CTF'")
    matches = rating.ranked_matches(rating.score_deltas(jobs.headers_of(elo), jobs.clients_of(elo)))
    for scope in live.SCOPES:
        want = rating.elo_rounds(matches, scope, F.date_trunc("hour", "ts"))
        got = lived.ratings().where(F.col("scope") == scope).select(F.col("place").alias(scope), "player", "rating")
        same(got, want.withColumn(scope, F.col(scope).cast("string")), [scope, "player", "rating"])


def test_best_times_equal_the_batch(spark, lived):
    df = polls(spark).where("game_type = 'Race'")
    want = rating.best_times(jobs.headers_of(df), jobs.clients_of(df))
    same(lived.best_times(), want.withColumn("map", F.col("map").cast("string")), ["map", "player", "rating"])


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    tables = live.LiveTables(spark, str(tmp_path / "t"))
    df = polls(spark).join(methods(spark), "game_type")
    first, second = df.where("hour(ts) = 0"), df.where("hour(ts) = 1")
    tables.process(first, 0)
    tables.process(second, 1)
    once = sorted(map(str, tables.play_time().collect())), sorted(map(str, tables.ratings().collect()))
    tables.process(second, 1)
    assert once == (sorted(map(str, tables.play_time().collect())), sorted(map(str, tables.ratings().collect())))
    # Rows older than the state reached go to the side table and change no total.
    tables.process(first, 2)
    assert once[0] == sorted(map(str, tables.play_time().collect()))
    late = spark.read.parquet(f"{tables.root}/late").where("batch = 2")
    assert late.count() == first.count()


def test_compaction_keeps_every_total(spark, tmp_path):
    df = polls(spark).join(methods(spark), "game_type")
    parts = [df.where(f"floor((unix_timestamp(ts) - {int(START.timestamp())}) / 1800) = {n}") for n in range(3)]
    plain = live.LiveTables(spark, str(tmp_path / "plain"))
    small = live.LiveTables(spark, str(tmp_path / "small"), compact_every=1)
    for batch, part in enumerate(parts):
        plain.process(part, batch)
        small.process(part, batch)
    small.process(parts[2], 2)
    assert small._batches("playtime") == [2] and small._batches("playtime_base") == [1, 2]
    assert small._batches("state") == [1, 2]
    for table in ("play_time", "ratings", "best_times"):
        a, b = getattr(plain, table)(), getattr(small, table)()
        assert a.count() > 0
        same(a, b, a.columns)


def test_late_rows_are_brought_in(spark, tmp_path):
    """Hours delivered out of order: best times at once, play time after a reconcile."""
    df = polls(spark).join(methods(spark), "game_type")
    part = f"floor((unix_timestamp(ts) - {int(START.timestamp())}) / 1800)"
    df = df.where(f"{part} < 3")
    hours = [df.where(f"{part} = {n}") for n in range(3)]
    tables = live.LiveTables(spark, str(tmp_path / "t"))
    for batch, part in enumerate((hours[0], hours[2], hours[1])):
        tables.process(part, batch)
    assert tables.late_batches() == [2]
    headers, clients = jobs.headers_of(df), jobs.clients_of(df)
    race = df.where("game_type = 'Race'")
    want = rating.best_times(jobs.headers_of(race), jobs.clients_of(race))
    same(tables.best_times(), want.withColumn("map", F.col("map").cast("string")), ["map", "player", "rating"])
    keys = ["total", "server", "map", "game_type", "clan", "player", "play_time"]
    want = playtime.all_totals(playtime.credited(headers, clients))
    for taken in (1, 0):  # a second run finds nothing left
        assert tables.reconcile(df) == taken and tables.late_batches() == []
        got = tables.play_time().where("play_time <> 0")
        same(got, want.where("play_time <> 0"), keys)


def test_new_checkpoint_cannot_replace_batches(spark, drops, tmp_path):
    tables = live.LiveTables(spark, str(tmp_path / "t"))
    feed = lambda: live.with_rank_method(feeds.unique_rows(read(spark, drops, 2)), methods(spark))
    first = live.start_live(feed(), tables, str(tmp_path / "ck"))
    first.awaitTermination()
    assert feeds.rows_behind(first) == 0
    with pytest.raises(ValueError, match="another checkpoint"):
        live.start_live(feed(), tables, str(tmp_path / "other"))
    live.start_live(feed(), tables, str(tmp_path / "ck")).awaitTermination()
    assert feeds.trigger_of("poll") == {"processingTime": "5 minutes"}
