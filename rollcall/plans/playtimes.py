"""Named queries: previous snapshots and elapsed play time."""

from pyspark.sql import functions as F

from rollcall.operators import asof, playtime, prepare
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.registry import query, sql_int, sql_ts


@query("prev_snapshot", with_cte("orders", f"""
, seen_at AS (
  SELECT server, ts, max(snapshot_id) AS id, arg_max(map, snapshot_id) AS map
  FROM oh GROUP BY server, ts),
before AS (
  SELECT server, ts, lag(ts) OVER w AS prev_ts, lag(id) OVER w AS prev_snapshot_id,
         lag(map) OVER w AS prev_map
  FROM seen_at WINDOW w AS (PARTITION BY server ORDER BY ts))
SELECT oh.snapshot_id, oh.server, {sql_ts('prev_ts')} AS prev_ts, prev_snapshot_id, prev_map
FROM oh JOIN before USING (server, ts)"""))
def prev_snapshot(t: Tables):
    return asof.previous_snapshot(t.order_headers, bucket="month").select(
        "snapshot_id", "server", "prev_ts", "prev_snapshot_id", "prev_map"
    )


@query("elapsed", with_cte("events", f"""
SELECT snapshot_id, server, {sql_int('seconds')} AS elapsed,
       {sql_int("CASE WHEN seconds > 600 THEN 300 WHEN seconds > 0 THEN seconds END")} AS credit
FROM elapsed"""))
def elapsed(t: Tables):
    return asof.elapsed(t.event_headers).select("snapshot_id", "server", "elapsed", "credit")


def credits(t: Tables):
    return playtime.credited(t.event_headers, t.event_clients)


def total_sql(keys, where="") -> str:
    cols = ", ".join(keys)
    some_clan = "WHERE clan IS NOT NULL" if "clan" in keys else ""
    return f"SELECT {cols}, CAST(sum(credit) AS BIGINT) AS play_time FROM credits {some_clan} GROUP BY {cols}"


# Query names say "team" and "group" for clan and game type.
def query_name(total: str) -> str:
    return "playtime_" + {"clan_player": "team_player"}.get(total, total).replace(
        "game_type", "group").replace("clan", "team")


for _total, _keys in playtime.TOTALS.items():
    query(query_name(_total), with_cte("events", total_sql(_keys)))(
        lambda t, keys=_keys: playtime.play_time(credits(t), keys)
    )


def tagged_sql(total, keys) -> str:
    dims = ["server", "map", "game_type", "clan", "player"]
    cols = ", ".join(d if d in keys else f"CAST(NULL AS VARCHAR) AS {d}" for d in dims)
    return f"SELECT '{total}' AS total, {cols}, play_time FROM ({total_sql(keys)})"


@query("playtime_totals", with_cte("events", "\nUNION ALL\n".join(
    tagged_sql(n, k) for n, k in playtime.TOTALS.items())))
def playtime_totals(t: Tables):
    """Totals stored up to the middle of the month plus the deltas after it."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    halves = playtime.all_totals(credits(t).withColumn("late", late), ["late"])
    keys = ["total", "server", "map", "game_type", "clan", "player"]
    return playtime.summed(halves, keys, "play_time")


@query("play_sessions", with_cte("events", f"""
, marked AS (
  SELECT player, server, ts,
         CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM eseen WINDOW w AS (PARTITION BY player, server ORDER BY ts)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY player, server ORDER BY ts) AS session FROM marked)
SELECT player, server, {sql_ts('min(ts)')} AS started, {sql_ts('max(ts)')} AS last_seen, count(*) AS snapshots
FROM numbered GROUP BY player, server, session"""))
def play_sessions(t: Tables):
    """Sessions per player and server; the twin finds them by gaps and islands."""
    seen = prepare.observe(t.event_headers, t.event_clients)
    return playtime.play_sessions(seen, ("player", "server"), "6 hours")
