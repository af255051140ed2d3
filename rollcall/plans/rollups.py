"""Named queries: observations and daily rollups."""

from pyspark.sql import functions as F

from rollcall.functions import dates
from rollcall.operators import prepare, rollup
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.registry import query, sql_day, sql_int

DAY = sql_day("ts")
SECONDS = sql_int("sum(CASE WHEN in_game THEN 300 ELSE 0 END)")


def order_presence(t: Tables):
    return rollup.day_presence(prepare.observe(t.order_headers, t.order_clients))


def event_presence(t: Tables):
    return rollup.day_presence(prepare.observe(t.event_headers, t.event_clients))


def rank_methods_of(maps):
    """Rank method per game type: long names are timed."""
    method = F.when(F.length("game_type") > 6, "TIME").otherwise("ELO")
    return maps.select("game_type", method.alias("rank_method")).distinct()


@query("observations", with_cte("orders", f"""
SELECT snapshot_id, {DAY} AS day, server, map, game_type, player, clan, in_game,
       CASE WHEN length(game_type) > 6 THEN 'TIME' ELSE 'ELO' END AS rank_method
FROM oseen WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-01-01'"""))
def observations(t: Tables):
    maps = t.order_headers.select("map", "game_type").distinct()
    headers = prepare.in_range(t.order_headers, "1996-01-01", "2001-01-01")
    ranked = prepare.with_rank_method(headers, maps, rank_methods_of(maps))
    seen = prepare.observe(ranked, t.order_clients.drop("score"))
    return prepare.with_day(prepare.first_occurrence(seen)).select(
        "snapshot_id", "day", "server", "map", "game_type", "player", "clan", "in_game",
        "rank_method",
    )


@query("player_day", with_cte("orders", f"""
SELECT {DAY} AS day, player, {SECONDS} AS play_time FROM oseen GROUP BY 1, 2"""))
def player_day(t: Tables):
    return rollup.player_day(order_presence(t))


@query("server_day", with_cte("events", f"""
SELECT {sql_day('hour')} AS day, server,
       {sql_int('round(round(avg(client_sum / snapshot_count), 9))')} AS avg_clients,
       {sql_int('max(max_clients)')} AS max_clients
FROM (SELECT server, date_trunc('hour', ts) AS hour, count(*) AS snapshot_count,
             sum(num_clients) AS client_sum, max(num_clients) AS max_clients
      FROM eh GROUP BY 1, 2)
WHERE client_sum > 0 GROUP BY 1, 2"""))
def server_day(t: Tables):
    return rollup.server_day(t.event_headers)


def scope_sql(scope: str) -> str:
    return with_cte("orders", f"""
SELECT {DAY} AS day, {scope}, {SECONDS} AS play_time, count(DISTINCT player) AS player_count
FROM oseen WHERE {scope} IS NOT NULL GROUP BY 1, 2""")


@query("map_day", scope_sql("map"))
def map_day(t: Tables):
    return rollup.scope_day(order_presence(t), "map")


@query("group_day", scope_sql("game_type"))
def group_day(t: Tables):
    return rollup.scope_day(order_presence(t), "game_type")


@query("team_day", scope_sql("clan"))
def team_day(t: Tables):
    return rollup.scope_day(order_presence(t), "clan")


def known_players(t: Tables):
    """Name to id; suppliers in debt are not known."""
    return t.suppliers.where(F.col("s_acctbal") >= 0).select(
        F.col("player").alias("name"), F.col("s_suppkey").alias("id")
    )


@query("resolve_ids", with_cte("orders", f"""
SELECT {DAY} AS day, s_suppkey AS player_id, {SECONDS} AS play_time
FROM oseen JOIN (SELECT player, s_suppkey FROM sup WHERE s_acctbal >= 0) USING (player)
GROUP BY 1, 2"""))
def resolve_ids(t: Tables):
    return rollup.resolve_ids(player_day(t), known_players(t), "player", "player_id")


@query("resolve_ids_rejects", with_cte("orders", f"""
SELECT day, count(*) FILTER (WHERE s_acctbal >= 0) AS resolved,
       count(*) FILTER (WHERE s_acctbal < 0) AS rejected
FROM (SELECT DISTINCT {DAY} AS day, player FROM oseen) JOIN sup USING (player)
GROUP BY day"""))
def resolve_ids_rejects(t: Tables):
    return rollup.resolve_counts(player_day(t), known_players(t), "player")


@query("open_days", with_cte("orders", """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM oh
WHERE ts < TIMESTAMP '2000-01-01'
  AND CAST(ts AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem
                               WHERE l_returnflag = 'R' AND l_quantity >= 40)"""))
def open_days(t: Tables):
    done = t.read("lineitem").where("l_returnflag = 'R' AND l_quantity >= 40").select(
        F.to_date("l_shipdate").alias("day")
    )
    days = prepare.with_day(t.order_headers).select("day").distinct()
    return rollup.days_to_roll_up(days, done, "2000-01-01")


@query("hour_windows", with_cte("events", """
SELECT server, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour,
       count(*) AS snapshot_count, CAST(sum(num_clients) AS BIGINT) AS client_sum,
       CAST(max(num_clients) AS BIGINT) AS max_clients
FROM eh GROUP BY server, date_trunc('hour', ts)"""))
def hour_windows(t: Tables):
    return rollup.server_hour(t.event_headers)


@query("flatten", with_cte("orders", """
SELECT oh.snapshot_id, strftime(ts, '%Y-%m-%d') AS day, server, CAST(place AS BIGINT) AS ordinal,
       player, clan, CAST(score AS BIGINT) AS score, in_game
FROM oh LEFT JOIN oc USING (snapshot_id)"""))
def flatten(t: Tables):
    return prepare.flatten(nested_orders(t))


@query("regroup", with_cte("orders", """
SELECT oh.snapshot_id, strftime(any_value(ts), '%Y-%m-%d') AS day, any_value(server) AS server,
       count(player) AS clients,
       coalesce(string_agg(player || ':' || CAST(score AS VARCHAR), '|' ORDER BY place), '') AS list
FROM oh LEFT JOIN oc USING (snapshot_id) GROUP BY oh.snapshot_id"""))
def regroup(t: Tables):
    entry = lambda c: F.concat_ws(":", c.player, c.score.cast("string"))
    return nested_orders(t).select(
        "snapshot_id", "day", "server", F.size("clients").alias("clients"),
        F.array_join(F.transform("clients", entry), "|").alias("list"),
    )


def nested_orders(t: Tables):
    flat = prepare.with_day(t.order_headers.select("snapshot_id", "ts", "server")).drop("ts")
    flat = flat.join(t.order_clients, "snapshot_id", "left")
    return prepare.regroup(flat, ["player", "clan", "score", "in_game"])


@query("valid_times", with_cte("orders", """
SELECT snapshot_id, player, CAST(score AS BIGINT) AS score FROM oc
WHERE in_game AND abs(score) <> 9999 AND player <> '(connecting)'"""))
def valid_times(t: Tables):
    return prepare.valid_times(t.order_clients).select("snapshot_id", "player", "score")


@query("team_names", with_cte("events", """
SELECT DISTINCT clan FROM ev WHERE coalesce(clan, '') <> ''"""))
def team_names(t: Tables):
    worn = t.event_clients.withColumn("clan", F.coalesce("clan", F.lit("")))
    return prepare.clan_names(worn)


SOURCE = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


@query("survivorship", with_cte("orders", f"""
SELECT snapshot_id, player, CAST({SOURCE} AS BIGINT) AS source, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, player
        ORDER BY {SOURCE} DESC, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount,
                 l_tax, l_shipdate, l_returnflag, l_linestatus) AS best FROM oc)
WHERE best = 1"""))
def survivorship(t: Tables):
    responses = t.order_clients.select(
        "snapshot_id", "player", F.col("ordinal").alias("arrival"), "score",
        F.expr(SOURCE.replace("l_returnflag", "ordinal.l_returnflag")).alias("source"),
    )
    merged = prepare.survivors(responses, ["snapshot_id", "player"], "source", "arrival")
    return merged.select("snapshot_id", "player", "source", "score")


@query("poll_headers", with_cte("orders", """
SELECT snapshot_id, player, l_linestatus AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY l_linenumber DESC, l_partkey DESC,
      l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_shipdate DESC) AS latest
  FROM oc WHERE in_game) WHERE latest = 1"""))
def poll_headers(t: Tables):
    responses = t.order_clients.select(
        "snapshot_id", F.col("ordinal").alias("arrival"), "player",
        F.col("ordinal.l_linestatus").alias("status"), F.col("in_game").alias("has_header"),
    )
    return prepare.last_header(responses, ["snapshot_id"], ["player", "status"], "arrival")


@query("month_play_time", with_cte("orders", f"""
SELECT {sql_day("date_trunc('month', ts)")} AS month, player, {SECONDS} AS play_time
FROM oseen JOIN (SELECT DISTINCT s_name AS player FROM supplier WHERE s_acctbal > 0) USING (player)
GROUP BY 1, 2"""))
def month_play_time(t: Tables):
    """Play time by month, of the players on a list of any size."""
    listed = t.suppliers.where("s_acctbal > 0").select("player").distinct()
    days = prepare.keep_listed(rollup.player_day(order_presence(t)), listed, ["player"])
    return days.groupBy(dates.month_start("day").alias("month"), "player").agg(F.sum("play_time").alias("play_time"))
