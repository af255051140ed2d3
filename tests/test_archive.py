from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollcall import jobs
from rollcall.operators import asof, history, prepare, rollup
from rollcall.schema import FLAT
from rollcall.sources import archive, day_tables
from tests.conftest import rows


def poll(i, ts, clients=(), server=1):
    head = (i, ts, server, "srv", "0.6", 7, "ctf5", "CTF", 1, 8, len(clients), 16)
    if not clients:
        return [(*head, None, None, None, None, None, None)]
    return [(*head, n, clan, score, -1, True, k) for k, (n, clan, score) in enumerate(clients)]


def flat(spark, *polls):
    return spark.createDataFrame([r for p in polls for r in p], FLAT)


START = datetime(2024, 1, 1)


def month(spark, days=6, per_day=4):
    out, i = [], 0
    for d in range(days):
        for k in range(per_day):
            i += 1
            who = [(f"p{j}", "x" if j % 2 else None, j) for j in range(k)]
            out.append(poll(i, START + timedelta(days=d, minutes=5 * k), who, server=k % 2))
    return flat(spark, *out)


def test_types_and_nulls_survive(spark, tmp_path):
    root = str(tmp_path / "a")
    df = flat(spark, poll(1, START + timedelta(milliseconds=123), [("a", "", -9999), ("b", None, 1)]), poll(2, START))
    archive.write_archive(df, root)
    back = archive.read_archive(spark, root)
    assert rows(back.select(*df.columns)) == rows(df)
    assert dict(back.drop("dt").dtypes) == dict(df.dtypes)
    files = [str(p) for p in (tmp_path / "a").rglob("*.parquet")]
    assert files and all("dt=2024-01-01" in f and ".zstd." in f for f in files)


def test_one_day_is_a_partition_filter(spark, tmp_path):
    root = str(tmp_path / "a")
    archive.write_archive(month(spark), root)
    one = archive.read_archive(spark, root, date(2024, 1, 2), date(2024, 1, 2))
    assert rows(one.select("snapshot_id").distinct()) == [(5,), (6,), (7,), (8,)]
    assert {f.split("dt=")[1][:10] for f in one.inputFiles()} == {"2024-01-02"}
    since = archive.read_archive(spark, root, date(2024, 1, 5))
    assert "PartitionFilters: [isnotnull(dt" in since._jdf.queryExecution().executedPlan().toString()
    assert since.select("dt").distinct().count() == 2
    assert archive.read_archive(spark, root, date(2030, 1, 1), date(2030, 1, 2)).count() == 0
    assert rows(archive.archived_days(spark, root)) == [(date(2024, 1, d),) for d in range(1, 7)]


def test_rows_are_sorted_by_server_and_time(spark, tmp_path):
    root = str(tmp_path / "a")
    archive.write_archive(month(spark).repartition(5), root)
    for f in (tmp_path / "a").rglob("*.parquet"):
        got = [(r.gameServerId, r.createdAt, r.snapshotId) for r in spark.read.parquet(str(f)).collect()]
        assert got == sorted(got)


def test_archive_batch_moves_and_repeats_safely(spark, tmp_path):
    root, hot = str(tmp_path / "a"), month(spark)
    now = F.lit(datetime(2024, 1, 6, 0, 5, 0))
    for _ in range(2):  # the second run finds everything there
        stays = archive.archive_batch(hot, root, now, 48)
        assert rows(stays.select("snapshot_id").distinct()) == [(i,) for i in range(14, 25)]
        assert archive.read_archive(spark, root).count() == hot.where("snapshot_id < 14").count()
    tiles = history.tiling(archive.archive_objects(spark, root).drop("dt"))
    assert {r.state for r in tiles.collect()} <= {"first", "tile", "gap", "overlap"}
    nothing = archive.archive_batch(stays, root, F.lit(START), 48)
    assert nothing.count() == stays.count()


def test_archive_batch_with_a_moving_clock(spark, tmp_path):
    """Snapshots pass retention while the batch runs: those stay hot."""
    base = month(spark).where("snapshot_id = 1").drop("snapshot_id", "ts")
    many = spark.range(200).select(
        F.col("id").alias("snapshot_id"),
        (F.current_timestamp() - F.expr("INTERVAL 48 HOURS") + F.make_dt_interval(secs=F.col("id") / 20 - 4)).alias("ts"))
    hot = many.crossJoin(base).select(*month(spark).columns)
    hot.write.parquet(str(tmp_path / "hot"))
    hot, root = spark.read.parquet(str(tmp_path / "hot")), str(tmp_path / "a")
    stays = archive.archive_batch(hot, root, F.current_timestamp(), 48)
    kept = archive.read_archive(spark, root)
    assert kept.count() + stays.count() == hot.count() and kept.count() > 0
    assert kept.agg(F.max("snapshot_id")).first()[0] < (stays.agg(F.min("snapshot_id")).first()[0] or 10**9)


def test_a_list_of_days_reads_no_other(spark, tmp_path):
    root = str(tmp_path / "a")
    archive.write_archive(month(spark), root)
    days = [date(2024, 1, 1), date(2024, 1, 5)]
    got = archive.read_archive(spark, root, days=days)
    assert {r.d for r in got.select(F.to_date("ts").alias("d")).distinct().collect()} == set(days)
    assert len({f.split("dt=")[1][:10] for f in got.inputFiles()}) == 2


def test_a_short_archive_retires_nothing(spark, tmp_path, monkeypatch):
    hot, root = month(spark), str(tmp_path / "a")
    write = archive.write_archive
    monkeypatch.setattr(archive, "write_archive", lambda df, r: write(df.where("snapshot_id <> 3"), r))
    with pytest.raises(RuntimeError, match="nothing retired"):
        archive.archive_batch(hot, root, F.lit(datetime(2024, 2, 1)), 48)


def test_watermark_is_an_id_bound(spark, headers):
    h = headers((5, datetime(2024, 1, 1), 1, 7, "CTF", 0), (4, datetime(2024, 1, 9), 1, 7, "CTF", 0),
                (6, datetime(2024, 1, 9), 1, 7, "CTF", 0))
    now = F.lit(datetime(2024, 1, 9))
    assert rows(history.archivable(h, now), "snapshot_id") == [(4,), (5,)]
    assert rows(history.retention_split(h, now), "snapshot_id", "archivable") == [(4, True), (5, True), (6, False)]
    fresh = h.where("snapshot_id = 6")
    assert rows(history.archivable(fresh, now)) == []
    assert rows(history.archive_backlog(h, now), "oldest", "behind_seconds") == [(datetime(2024, 1, 9), None)]
    assert rows(history.archive_backlog(h.where("snapshot_id > 4"), now), "behind_seconds") == [(6 * 86400,)]


def test_backfill_rolls_up_missing_days_only(spark, tmp_path):
    archive_root, root = str(tmp_path / "a"), str(tmp_path / "d")
    df = month(spark)
    archive.write_archive(df, archive_root)
    archive.write_archive(df.where("snapshot_id < 7"), archive_root)  # a crash wrote some twice
    ids = spark.createDataFrame([(f"p{i}", i) for i in range(4)] + [("x", 50), ("CTF", 60)], "name string, id int")
    now = F.lit(datetime(2024, 1, 8))
    first = jobs.backfill(spark, archive_root, root, now, ids, ids, ids, limit=2)
    assert first == [date(2024, 1, 1), date(2024, 1, 2)]
    # The newest archived day never counts; the others have passed retention.
    rest = jobs.backfill(spark, archive_root, root, now, ids, ids, ids)
    assert rest == [date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 5)]
    assert jobs.backfill(spark, archive_root, root, now, ids, ids, ids) == []
    live = rollup.day_tables(jobs.headers_of(df), df)
    for name, key in (("player_day", "player"), ("server_day", "server"), ("clan_day", "clan")):
        want = live[name].where("day < DATE'2024-01-06'")
        got = day_tables.read_day_table(spark, root, name)
        value = "avg_clients" if name == "server_day" else "play_time"
        assert rows(got, "day", value) == rows(want, "day", value), name


def test_clustered_ids_are_spread(spark):
    """Two thousand close ids and a far one: many ranges, none with most rows."""
    objects = spark.range(2000).union(spark.createDataFrame([(10**12,)], "id long")).select(
        F.col("id").alias("first_id"), (F.col("id") + 0).alias("last_id"), F.col("id").cast("string").alias("object"))
    got = asof.ordered_neighbours(objects, "first_id", "last_id", ["object"], 50)
    want = [(0, None), *((i, i - 1) for i in range(1, 2000)), (10**12, 1999)]
    assert sorted((r.first_id, r.prev_last_id) for r in got.collect()) == want
    cuts = objects.approxQuantile("first_id", [i / 50 for i in range(1, 50)], 0.004)
    assert len(set(cuts)) > 30


def test_tiling_states(spark):
    objects = spark.createDataFrame(
        [("a", 1, 10), ("b", 11, 20), ("c", 25, 30), ("d", 28, 40), ("e", 41, 41)],
        "object string, first_id long, last_id long")
    for buckets in (1, 2, 1024):
        got = asof.ordered_neighbours(objects, "first_id", "last_id", ["object"], buckets)
        assert rows(got, "first_id", "prev_last_id") == [(1, None), (11, 10), (25, 20), (28, 30), (41, 40)]
    assert [r.state for r in history.tiling(objects).orderBy("first_id").collect()] == [
        "first", "tile", "gap", "overlap", "tile"]


def test_a_long_object_leaves_no_gap_behind(spark):
    objects = spark.createDataFrame(
        [("a", 1, 100), ("b", 10, 20), ("c", 50, 60), ("d", 101, 101), ("e", 103, 104)], "object string, first_id long, last_id long")
    for buckets in (1, 2, 1024):
        got = asof.highest_before(objects, "first_id", "last_id", ["object"], buckets)
        assert rows(got, "first_id", "highest_last_id") == sorted([(1, None), (10, 100), (50, 100), (101, 100), (103, 101)], key=str)
    assert [r.state for r in history.tiling(objects).orderBy("first_id").collect()] == ["first", "overlap", "overlap", "tile", "gap"]


def test_intervals_of_ids(spark):
    ids = [1, 2, 3, 3, 7, 65535, 65536, 65537, 200_000, -1]
    df = spark.createDataFrame([(i,) for i in ids], "snapshot_id long")
    got = history.id_intervals(df)
    assert rows(got) == sorted([(1, 3, 3), (7, 7, 1), (65535, 65535, 1), (65536, 65537, 2), (200_000, 200_000, 1), (-1, -1, 1)], key=str)
    asked = spark.createDataFrame([(i,) for i in (-2, -1, 0, 1, 3, 4, 7, 8, 65534, 65537, 65538, 65538, 300_000)], "snapshot_id long")
    wider = got.unionByName(spark.createDataFrame([(2, 4, 3), (2, 2, 1)], got.schema))
    assert rows(history.outside(asked, wider)) == sorted([(-2,), (0,), (8,), (65534,), (65538,), (300_000,)], key=str)


def test_a_run_reads_what_it_wrote_and_no_more(spark, tmp_path, monkeypatch):
    """The second run goes by the manifest; one that died is found by its mark."""
    root, hot = str(tmp_path / "a"), month(spark)
    read = []
    whole = archive.read_archive
    monkeypatch.setattr(archive, "files_of", lambda s, r, d: set(whole(s, r, days=d).inputFiles()))
    monkeypatch.setattr(archive, "read_archive", lambda *a, **k: read.append(k) or whole(*a, **k))
    archive.archive_batch(hot, root, F.lit(datetime(2024, 1, 6, 0, 5)), 48)
    assert read == [] and archive.manifest(spark, root).agg(F.sum("snapshots")).first()[0] == 13
    files = set(whole(spark, root).inputFiles())
    late = hot.where("snapshot_id = 3").withColumn("snapshot_id", F.lit(0).cast("long"))
    archive.archive_batch(hot.unionByName(late), root, F.lit(datetime(2024, 1, 6, 0, 5)), 48)
    added = set(whole(spark, root).inputFiles()) - files
    assert read == [] and len(added) == 1 and whole(spark, root).where("snapshot_id = 0").count() == late.count()
    # Files without an entry: the run after it reads the days and writes nothing twice.
    spark.range(1).write.parquet(f"{root}/_manifest/open")
    archive.write_archive(hot.where("snapshot_id = 14"), root)
    archive.archive_batch(hot, root, F.lit(datetime(2024, 2, 6)), 48)
    assert len(read) == 1 and whole(spark, root).drop("dt").where("snapshot_id > 0").count() == hot.count()


def test_one_history_from_hot_rows_and_archive(spark):
    df = month(spark)
    both = history.merged_history(df.where("snapshot_id > 5"), df.where("snapshot_id < 12"))
    assert rows(both.select(*df.columns)) == rows(df)
    old = df.withColumn("ordinal", F.lit(None).cast("int"))
    copies = old.withColumn("source", F.lit("f1")).unionByName(
        old.where("snapshot_id = 4").withColumn("source", F.lit("f2")))
    assert rows(history.one_copy_per_snapshot(copies, "source").select(*df.columns)) == rows(old)


def test_coverage(spark):
    days = spark.createDataFrame([(date(2024, 1, d), p) for d in (1, 2, 5) for p in "ab"], "day date, player string")
    assert rows(history.coverage(days)) == [(date(2024, 1, 1), date(2024, 1, 5), 3, 2)]
    assert rows(history.coverage(days.limit(0))) == [(None, None, 0, 0)]


def test_rough_minutes(spark):
    df = prepare.with_day(month(spark, days=1))
    assert rows(history.archive_minutes(df)) == [
        (date(2024, 1, 1), "p0", 15), (date(2024, 1, 1), "p1", 10), (date(2024, 1, 1), "p2", 5)]
