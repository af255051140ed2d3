"""Named queries: retention, archive coverage and backfill."""

from pyspark.sql import functions as F

from rollcall.operators import history, prepare
from rollcall.plans.fixtures import EVENTS_TODAY, Tables, with_cte
from rollcall.plans.registry import query, sql_day, sql_int, sql_ts
from rollcall.plans.rollups import player_day

NOW = f"TIMESTAMP '{EVENTS_TODAY}'"


def now():
    return F.lit(EVENTS_TODAY).cast("timestamp")


@query("retention_split", with_cte("events", f"""
SELECT snapshot_id, coalesce(snapshot_id <= (
  SELECT max(snapshot_id) FROM eh WHERE ts < {NOW} - INTERVAL 48 HOUR), false) AS archivable
FROM eh"""))
def retention_split(t: Tables):
    return history.retention_split(t.event_headers, now()).select("snapshot_id", "archivable")


@query("chunk_days", with_cte("events", f"""
SELECT {sql_day('ts')} AS day, count(*) AS snapshots, min(snapshot_id) AS first_id,
       max(snapshot_id) AS last_id
FROM eh WHERE snapshot_id <= (
  SELECT max(snapshot_id) FROM eh WHERE ts < {NOW} - INTERVAL 48 HOUR)
GROUP BY 1"""))
def chunk_days(t: Tables):
    return history.day_chunks(history.archivable(t.event_headers, now()))


@query("archive_backlog", with_cte("events", f"""
SELECT {sql_ts('oldest')} AS oldest,
       CASE WHEN oldest < cutoff THEN date_diff('microsecond', oldest, cutoff) // 1000000 END
         AS behind_seconds
FROM (SELECT arg_min(ts, snapshot_id) AS oldest, {NOW} - INTERVAL 48 HOUR AS cutoff FROM eh)"""))
def archive_backlog(t: Tables):
    return history.archive_backlog(t.event_headers, now())


def archived_days(t: Tables):
    return prepare.with_day(t.order_headers).select("day")


def rolled_up_days(t: Tables):
    finished = t.read("orders").where("o_orderstatus = 'F' AND o_totalprice > 250000")
    return finished.select(F.to_date("o_orderdate").alias("day"))


MISSING = """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders)
  AND o_orderdate + INTERVAL 1 DAY + INTERVAL 48 HOUR <= TIMESTAMP '2001-07-31'
  AND o_orderdate NOT IN (SELECT o_orderdate FROM orders
                          WHERE o_orderstatus = 'F' AND o_totalprice > 250000)"""


@query("backfill_days", f"""
SELECT {sql_day('day')} AS day FROM ({MISSING}) ORDER BY day LIMIT 4""")
def backfill_days(t: Tables):
    today = F.lit("2001-07-31").cast("timestamp")
    return history.backfill_days(archived_days(t), rolled_up_days(t), today)


@query("missing_days", f"SELECT {sql_day('day')} AS day FROM ({MISSING})")
def missing_days(t: Tables):
    today = F.lit("2001-07-31").cast("timestamp")
    return history.backfill_days(archived_days(t), rolled_up_days(t), today, limit=None)


@query("days_present", f"""
SELECT DISTINCT {sql_day('l_shipdate')} AS day FROM lineitem
WHERE l_shipdate NOT IN (SELECT o_orderdate FROM orders)""")
def days_present(t: Tables):
    shipped = t.read("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return shipped.join(archived_days(t).distinct(), "day", "left_anti")


@query("rollup_coverage", with_cte("orders", f"""
SELECT {sql_day('min(day)')} AS first_day, {sql_day('max(day)')} AS last_day, count(*) AS days,
       date_diff('day', min(day), max(day)) + 1 - count(*) AS missing
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM oseen)"""))
def rollup_coverage(t: Tables):
    return history.coverage(player_day(t))


@query("archive_tiling", with_cte("events", """
, objects AS (
  SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H') AS object, min(event_id) AS first_id,
         max(event_id) AS last_id
  FROM ev GROUP BY 1
  UNION ALL
  SELECT event_type || strftime(ts, '%Y%m%d'), min(event_id), max(event_id)
  FROM ev GROUP BY 1)
SELECT object, first_id, last_id,
       CASE WHEN reached IS NULL THEN 'first' WHEN first_id > reached + 1 THEN 'gap'
            WHEN first_id <= reached THEN 'overlap' ELSE 'tile' END AS state
FROM (SELECT *, max(last_id) OVER (ORDER BY first_id, last_id, object
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
      FROM objects)"""))
def archive_tiling(t: Tables):
    ids = [F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")]
    hourly = t.events.groupBy(
        F.date_format("ts", "yyyyMMddHH").alias("object")).agg(*ids)
    daily = t.events.groupBy(
        F.concat("event_type", F.date_format("ts", "yyyyMMdd")).alias("object")).agg(*ids)
    tiles = history.tiling(hourly.unionByName(daily))
    return tiles.select("object", "first_id", "last_id", "state")


@query("merged_history", with_cte("events", f"""
SELECT snapshot_id, {sql_ts('ts')} AS ts, server, player, clan FROM eseen"""))
def merged_history(t: Tables):
    """Hot rows from the 10th on, archive rows before the 20th."""
    rows = prepare.observe(t.event_headers, t.event_clients).select(
        "snapshot_id", "ordinal", "ts", "server", "player", "clan")
    hot = rows.where("ts >= TIMESTAMP '2024-01-10'")
    archive = rows.where("ts < TIMESTAMP '2024-01-20'")
    return history.merged_history(hot, archive).drop("ordinal")


@query("one_copy", with_cte("orders", f"""
SELECT snapshot_id, player, {sql_int('score')} AS score, l_linestatus AS source FROM oc
WHERE l_linestatus = (SELECT min(l.l_linestatus) FROM lineitem l WHERE l.l_orderkey = oc.l_orderkey)"""))
def one_copy(t: Tables):
    rows = t.order_clients.withColumn("source", F.col("ordinal.l_linestatus"))
    return history.one_copy_per_snapshot(rows, "source").select(
        "snapshot_id", "player", "score", "source")


@query("archive_minutes", with_cte("orders", f"""
SELECT {sql_day('ts')} AS day, player, count(*) * 5 AS approx_minutes
FROM oh JOIN oc USING (snapshot_id) WHERE in_game GROUP BY 1, 2"""))
def archive_minutes(t: Tables):
    flat = prepare.with_day(prepare.observe(t.order_headers, t.order_clients))
    return history.archive_minutes(flat)
