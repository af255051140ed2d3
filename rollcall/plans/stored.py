"""Named queries that write the archive, move hot rows into it and run the live
tables, under the shared folder, and then read back what is there."""

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall import jobs
from rollcall.operators import prepare
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.playtimes import tagged_sql, total_sql
from rollcall.plans.registry import query, sql_day, sql_int
from rollcall.session import shared_folder
from rollcall.sources import archive, day_tables
from rollcall.streaming import closed_days, feed, keyed, live

DAYS = [date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 17)]
MOVED_AT = "2024-01-20 00:00:00"
SUMMARY = """CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT event_id) AS BIGINT) AS snapshots,
       min(event_id) AS first_id, max(event_id) AS last_id"""


def flat_events(t: Tables):
    """Event rows in the archive's form; servers and maps by a number of their name."""
    number = lambda c: (F.crc32(F.col(c).cast("binary")) % (1 << 31)).cast("int")
    text, zero = F.lit("-"), F.lit(0)
    return prepare.observe(t.event_headers, t.event_clients).select(
        "snapshot_id", "ts", number("server").alias("server"), F.col("server").alias("server_name"),
        text.alias("version"), number("map").alias("map"), F.col("map").alias("map_name"),
        "game_type", zero.alias("num_players"), zero.alias("max_players"), "num_clients",
        zero.alias("max_clients"), "player", "clan", "score", zero.alias("country"), "in_game",
        "ordinal",
    )


def new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def written_archive(t: Tables) -> str:
    root = new_folder(t, "archive")
    archive.write_archive(flat_events(t), root)
    return root


@query("archive_day_list", with_cte("events", f"""
SELECT DISTINCT {sql_day('ts')} AS day FROM ev"""))
def archive_day_list(t: Tables):
    """Days of a written archive, from its folders."""
    return archive.archived_days(t.spark, written_archive(t))


@query("archive_read_days", with_cte("events", f"""
SELECT {sql_day('ts')} AS day, {SUMMARY} FROM ev
WHERE CAST(ts AS DATE) IN ({', '.join(f"DATE '{d}'" for d in DAYS)}) GROUP BY 1"""))
def archive_read_days(t: Tables):
    """Some days of a written archive; no other folder is listed."""
    return archive.day_summary(archive.read_archive(t.spark, written_archive(t), days=DAYS))


@query("archive_move", with_cte("events", f"""
, bound AS (SELECT max(event_id) AS id FROM ev
            WHERE ts < TIMESTAMP '{MOVED_AT}' - INTERVAL 48 HOUR)
SELECT CASE WHEN event_id <= id THEN 'archive' ELSE 'hot' END AS place, {sql_day('ts')} AS day,
       {SUMMARY}
FROM ev, bound GROUP BY 1, 2"""))
def archive_move(t: Tables):
    """Rows per day that a retention run moved to the archive, and that stayed."""
    root = new_folder(t, "archive")
    stays = archive.archive_batch(flat_events(t), root, F.lit(MOVED_AT).cast("timestamp"), 48)
    moved = archive.read_archive(t.spark, root)
    return (
        archive.day_summary(moved).select(F.lit("archive").alias("place"), "*")
        .unionByName(archive.day_summary(stays).select(F.lit("hot").alias("place"), "*"))
    )


@query("live_play_time", with_cte("events", total_sql(["player", "game_type"])))
def live_play_time(t: Tables):
    """Play time that a stream over dropped files keeps, in several batches and in
    whatever order the files come; late rows are brought in at the end."""
    flat, folder = flat_events(t), new_folder(t, "feed")
    archive.to_archive(flat).repartitionByRange(4, "createdAt").write.parquet(f"{folder}/drop")
    rows = feed.read_feed(t.spark, f"{folder}/drop", files_per_trigger=2)
    unknown = t.spark.createDataFrame([], "game_type string, rank_method string")
    tables = live.LiveTables(t.spark, f"{folder}/tables")
    live.start_live(live.with_rank_method(rows, unknown), tables, f"{folder}/checkpoint").awaitTermination()
    tables.reconcile(flat.withColumn("rank_method", F.lit(None).cast("string")))
    totals = tables.play_time().where("total = 'player_game_type' and play_time <> 0")
    return totals.select("player", "game_type", "play_time")


FILE_ROWS = 2_000_000
KEYED = {"player_game_type": ("player", "game_type"), "clan_player": ("clan", "player"), "game_type": ("game_type",)}


@query("keyed_play_time", with_cte("events", "\nUNION ALL\n".join(
    f"SELECT total, game_type, clan, player, play_time FROM ({tagged_sql(n, k)})" for n, k in KEYED.items())))
def keyed_play_time(t: Tables):
    """Totals from keyed streaming state; the youngest files come first."""
    folder = new_folder(t, "feed")
    drop_youngest_first(t, f"{folder}/drop")
    dropped = feed.read_feed(t.spark, f"{folder}/drop/*", files_per_trigger=1)
    tables = keyed.KeyedTables(t.spark, f"{folder}/tables")
    keyed.start_keyed(dropped, tables, f"{folder}/checkpoint", "60 days", splits=2).awaitTermination()
    totals = tables.play_time().where(F.col("total").isin(list(KEYED)) & (F.col("play_time") != 0))
    return totals.select("total", "game_type", "clan", "player", "play_time")


def drop_youngest_first(t: Tables, folder: str) -> None:
    """All events as files of a feed, the later half of the month first. A file, which is
    a batch, holds a range of time, so that a batch is about hours of its own."""
    rows = archive.to_archive(flat_events(t))
    for part, test in enumerate((F.dayofmonth("createdAt") > 15, F.dayofmonth("createdAt") <= 15)):
        files = -(-t.events.withColumnRenamed("ts", "createdAt").where(test).count() // FILE_ROWS)
        rows.where(test).repartitionByRange(max(files, 1), "createdAt").write.parquet(f"{folder}/{part}")


def all_days(rows) -> list[date]:
    return [r.day for r in rows.select(F.to_date("ts").alias("day")).distinct().collect()]


def event_names(t: Tables, column: str, number):
    """(name, id) of the players or clans of the events."""
    return t.events.select(F.col(column).cast("string").alias("name"), number.cast("int").alias("id")).dropna().distinct()


@query("stored_player_days", with_cte("events", f"""
SELECT {sql_day('day')} AS day, CAST(player AS BIGINT) AS player_id, CAST(play_time AS BIGINT) AS play_time FROM epday"""))
def stored_player_days(t: Tables):
    """Day tables of all days, written to their folders, some twice, and read back."""
    rows, root = flat_events(t), new_folder(t, "days")
    players, clans = event_names(t, "user_id", F.col("user_id")), event_names(t, "clan", F.substring("clan", 6, 9))
    games = t.events.select(F.col("event_type").alias("name"), (F.crc32(F.col("event_type").cast("binary")) % (1 << 31)).cast("int").alias("id")).distinct()
    for days in (all_days(rows), DAYS):
        jobs.roll_up_days(rows, root, days, players, clans, games)
    return day_tables.read_day_table(t.spark, root, "player_day")


def streamed(t: Tables, name: str, stream):
    """Running results of a stream over dropped files after its last batch."""
    folder = new_folder(t, name)
    archive.to_archive(flat_events(t)).write.parquet(f"{folder}/drop")
    rows = stream(feed.read_feed(t.spark, f"{folder}/drop"))
    writer = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("closed_server_days", with_cte("events", f"""
SELECT {sql_day('hour')} AS day, CAST(server AS BIGINT) AS server,
       {sql_int('round(round(avg(client_sum / snapshot_count), 9))')} AS avg_clients,
       {sql_int('max(max_clients)')} AS max_clients
FROM (SELECT crc AS server, date_trunc('hour', ts) AS hour, count(*) AS snapshot_count,
             sum(num_clients) AS client_sum, max(num_clients) AS max_clients
      FROM eh JOIN (SELECT DISTINCT server, dense_rank() OVER (ORDER BY server) AS crc FROM eh) USING (server) GROUP BY 1, 2)
WHERE client_sum > 0 AND CAST(hour AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM eh) GROUP BY 1, 2"""))
def closed_server_days(t: Tables):
    """Days that the watermark has closed, from a stream into day folders; one is written
    again from history. Servers by rank of their name."""
    folder, rows = new_folder(t, "days"), flat_events(t)
    archive.to_archive(rows).write.parquet(f"{folder}/drop")
    table = closed_days.ClosedDays(t.spark, f"{folder}/days")
    closed_days.start_closed_days(feed.read_feed(t.spark, f"{folder}/drop"), table, f"{folder}/checkpoint", "1 hour").awaitTermination()
    table.reopen(rows, DAYS[:1])
    closed = table.read().withColumnRenamed("server_id", "server")
    names = t.events.select("event_type").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("event_type")))
    numbers = names.select((F.crc32(F.col("event_type").cast("binary")) % (1 << 31)).cast("int").alias("server"), "n")
    return closed.join(numbers, "server").select("day", F.col("n").alias("server"), "avg_clients", "max_clients")


@query("streamed_states", with_cte("events", """
SELECT server AS name, arg_max(snapshot_id, (ts, snapshot_id)) AS snapshot_id, arg_max(num_clients, (ts, snapshot_id)) AS num_clients
FROM eh GROUP BY server"""))
def streamed_states(t: Tables):
    """Last header of every server, from a stream."""
    columns = ["server", "ts", "snapshot_id", "server_name", "num_clients"]
    last = streamed(t, "states", lambda rows: feed.latest_states(rows.select(*columns)))
    return last.select(F.col("server_name").alias("name"), "snapshot_id", "num_clients")


@query("streamed_counts", with_cte("events", """
SELECT 'snapshots' AS entity, count(DISTINCT event_id) AS added, max(event_id) AS cursor FROM ev"""))
def streamed_counts(t: Tables):
    """Snapshots counted by a stream as they come."""
    def ids(rows):
        return feed.unique_headers(rows).select(F.lit("snapshots").alias("entity"), F.col("snapshot_id").alias("id"))
    return streamed(t, "counts", lambda rows: feed.entity_counts(ids(rows)))
