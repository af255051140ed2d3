"""Play time as keyed state: order doesn't matter, nothing is lost, keys are touched alone."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rollcall import jobs
from rollcall.operators import playtime
from rollcall.plans import stored
from rollcall.plans.fixtures import Tables
from rollcall.schema import FLAT
from rollcall.sources.archive import to_archive
from rollcall.streaming import feed as feeds
from rollcall.streaming import keyed

START = datetime(2024, 1, 1)
KEYS = ["total", "server", "map", "game_type", "clan", "player"]


def polls(spark, servers=(1, 2, 3), ticks=40, minutes=7):
    """Servers polled in turns; ties, empty snapshots, a player twice, moving crowds."""
    out, i = [], 0
    for tick in range(ticks):
        for server in servers:
            i += 1
            ts = START + timedelta(minutes=minutes * tick + (0 if server == 3 and tick % 5 == 0 else server), microseconds=tick)
            crowd = [(f"p{(tick // 4 + k * server) % 9}", "x" if k % 2 else None) for k in range((tick + server) % 4)]
            head = (i, ts, server, f"s{server}", "0.6", server * 10 + tick // 20, "m", "CTF", 1, 8, len(crowd), 16)
            if not crowd:
                out.append((*head, None, None, None, None, None, None))
            out += [(*head, n, c, 1, -1, True, k) for k, (n, c) in enumerate(crowd)]
    return spark.createDataFrame(out, FLAT)


def drop(df, folder, parts):
    """``parts``: conditions on the rows, a file each, in the order of delivery."""
    for i, part in enumerate(parts):
        to_archive(df.where(part)).coalesce(1).write.parquet(f"{folder}/{i:02d}")


def run(spark, folder, tables, checkpoint, lateness="90 days"):
    rows = feeds.read_feed(spark, f"{folder}/*", 1)
    keyed.start_keyed(rows, tables, checkpoint, lateness, splits=3).awaitTermination()


def totals(df):
    return sorted((tuple(r) for r in df.where("play_time <> 0").select(*KEYS, "play_time").collect()), key=str)


def batch(df):
    return totals(playtime.all_totals(playtime.credited(jobs.headers_of(df), jobs.clients_of(df))))


HALF_HOUR = f"floor((unix_timestamp(ts) - {int(START.timestamp())}) / 1800)"


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 0, 1, 2, 2]])
def test_out_of_order_equals_the_batch(spark, tmp_path, order):
    df = polls(spark)
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"), compact_every=2)
    drop(df, tmp_path / "drop", [f"{HALF_HOUR} % 3 = {n}" for n in order])
    run(spark, tmp_path / "drop", tables, str(tmp_path / "ck"))
    assert totals(tables.play_time()) == batch(df)
    assert tables.behind().count() == 0


def held(spark, checkpoint, batch_id):
    state = spark.read.format("statestore").option("stateVarName", "hours").option("batchId", batch_id).load(checkpoint)
    return {(r.key.server, r.key.split, r.user_map_key.hour): str(r.user_map_value) for r in state.collect()}


def test_a_batch_touches_its_own_keys_only(spark, tmp_path):
    df, ck = polls(spark), str(tmp_path / "ck")
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"))
    drop(df, tmp_path / "drop", [f"{HALF_HOUR} < 6", f"server = 2 and {HALF_HOUR} >= 6 and {HALF_HOUR} < 8"])
    run(spark, tmp_path / "drop", tables, ck)
    before, after = held(spark, ck, 0), held(spark, ck, 1)
    assert {k[0] for k in before} == {"1", "2", "3"} and {k[1] for k in before} == {0, 1, 2}
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert changed and {k[0] for k in changed} == {"2"}
    assert min(k[2] for k in changed) > min(k[2] for k in before)  # old hours of that server neither
    seen = {r.server for r in spark.read.parquet(f"{tables.root}/playtime/batch=1").where("total = 'server'").collect()}
    assert seen == {"2"}


def test_rows_behind_the_watermark_are_told(spark, tmp_path):
    """Live rows and rows behind add up to all rows, and hours behind it go from the state."""
    df, ck = polls(spark, ticks=60), str(tmp_path / "ck")
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"), compact_every=3)
    late = "server = 1 and hour(ts) = 1"
    parts = [f"not ({late}) and hour(ts) = {h}" for h in range(7)] + [late]
    drop(df, tmp_path / "drop", parts)
    run(spark, tmp_path / "drop", tables, ck, lateness="1 hour")
    behind, rows = tables.behind(), df.where(late)
    assert behind.count() == rows.count() > 0
    assert {(r.batch, r.rows) for r in tables.rows_behind().collect()} == {(len(parts) - 1, rows.count())}
    assert [str(r.day) for r in tables.days_to_rebuild().collect()] == ["2024-01-01"]
    assert totals(tables.play_time()) == batch(df.where(f"not ({late})"))
    hour = lambda k: k[2] - int(START.timestamp()) // 3600
    assert {hour(k) for k in held(spark, ck, 1)} == {0, 1}
    assert min(hour(k) for k in held(spark, ck, len(parts) - 1)) >= 4


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"))
    out = spark.createDataFrame([("credit", "1", "m", "g", "p", None, 7, 1, 5), ("behind", "1", "m", "g", "p", None, 0, 2, 5)], keyed.OUT)
    for _ in range(2):
        tables.take(out, 3)
    assert tables.play_time().where("total = 'player'").first().play_time == 7 and tables.behind().count() == 1
    tables.take(out.where("kind = 'credit'"), 3)
    assert tables.behind().count() == 0
    with pytest.raises(ValueError, match="another checkpoint"):
        tables.check_checkpoint(str(tmp_path / "none"))


def test_splits_hold_every_row_once(spark):
    df = polls(spark)
    rows = keyed.split_rows(df, 4)
    assert rows.where("own").count() == df.count()
    heads = rows.groupBy("snapshot_id").agg(F.countDistinct("split").alias("n")).where("n <> 4")
    assert heads.count() == 0


def test_a_stream_runs_in_a_session_of_any_state_store(spark, tmp_path):
    """Sessions that others build keep state in memory, a store that takes no keyed state."""
    df, conf = polls(spark, ticks=4), "spark.sql.streaming.stateStore.providerClass"
    own, other = spark.conf.get(conf), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    drop(df, tmp_path / "drop", ["true"])
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"))
    spark.conf.set(conf, other)
    try:
        run(spark, tmp_path / "drop", tables, str(tmp_path / "ck"))
        assert spark.conf.get(conf) == other
    finally:
        spark.conf.set(conf, own)
    assert totals(tables.play_time()) == batch(df)


def test_the_operator_needs_no_module_of_the_session(tmp_path):
    """The worker on the driver has only Spark's own path."""
    (tmp_path / "operator").write_bytes(cloudpickle.dumps(keyed.Credits()))
    code = "import pickle, sys; print(type(pickle.load(open(sys.argv[1], 'rb'))).__name__, 'rollcall' in sys.modules)"
    path = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code, tmp_path / "operator"], cwd=tmp_path, env=path, capture_output=True, text=True, check=True)
    assert found.stdout.split()[-2:] == ["Credits", "False"]


def test_state_has_few_partitions(spark, tmp_path):
    """Each batch opens and commits all of them, with rows or without."""
    df, conf, most = polls(spark, ticks=4), "spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism
    own = spark.conf.get(conf)
    drop(df, tmp_path / "drop", ["true"])
    tables = keyed.KeyedTables(spark, str(tmp_path / "t"))
    spark.conf.set(conf, most + 5)
    try:
        run(spark, tmp_path / "drop", tables, str(tmp_path / "ck"))
        assert spark.conf.get(conf) == str(most + 5)
    finally:
        spark.conf.set(conf, own)
    assert len([p for p in (tmp_path / "ck" / "state" / "0").iterdir() if p.name.isdigit()]) == most
    assert totals(tables.play_time()) == batch(df)


def test_dropped_files_hold_ranges_of_time(spark, tmp_path, monkeypatch):
    """A file of hours from all over the month would touch the whole state."""
    rows = [(i, START + timedelta(hours=i * 37 % 700), i % 9, "view", 1.5, f'{{"k": {i % 50}}}') for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stored, "FILE_ROWS", 60)
    stored.drop_youngest_first(Tables(spark, str(tmp_path)), str(tmp_path / "drop"))
    spans = spark.read.parquet(f"{tmp_path}/drop/*").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("createdAt").alias("first"), F.max("createdAt").alias("last"), F.count(F.lit(1)).alias("rows")).orderBy("first").collect()
    assert len(spans) > 5 and sum(r.rows for r in spans) == 400
    assert all(a.last < b.first for a, b in zip(spans, spans[1:]))


def test_one_value_holds_an_hour(spark, tmp_path):
    """An hour crosses to Python as one value, not snapshot by snapshot."""
    df, ck = polls(spark, ticks=4), str(tmp_path / "ck")
    drop(df, tmp_path / "drop", ["true"])
    run(spark, tmp_path / "drop", keyed.KeyedTables(spark, str(tmp_path / "t")), ck)
    state = spark.read.format("statestore").option("stateVarName", "hours").load(ck)
    assert state.select("user_map_value.*").dtypes == [("polls", "binary")]
    found = [pa.ipc.open_stream(bytes(r.user_map_value.polls)).read_all() for r in state.where("key.split = 0").collect()]
    assert sorted(i for h in found for i in h["id"].to_pylist()) == sorted(r.snapshot_id for r in df.select("snapshot_id").distinct().collect())
