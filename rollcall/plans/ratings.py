"""Named queries: matches, Elo and best times."""

import uuid

from pyspark.sql import functions as F

from rollcall.operators import boards, prepare, rating
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.registry import query, sql_int, sql_num
from rollcall.session import cut_lineage, shared_folder
from rollcall.streaming.live import LiveTables

DAY_MINUTES = 1440
WEEKS = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")


def matches(t: Tables, unit: str, max_gap_minutes: int):
    deltas = rating.score_deltas(t.bucket_headers(unit), t.bucket_clients(unit), max_gap_minutes)
    return rating.ranked_matches(cut_lineage(deltas))


def day_matches(t: Tables):
    return matches(t, "day", DAY_MINUTES)


def week_matches(t: Tables):
    return matches(t, "week", 7 * DAY_MINUTES)


@query("match_deltas", with_cte("day", f"""
SELECT snapshot_id, map, player, {sql_int('score_delta')} AS score_delta, players,
       {sql_num('mean_delta')} AS mean_delta
FROM day_matches"""))
def match_deltas(t: Tables):
    return day_matches(t).select(
        "snapshot_id", "map", "player", "score_delta", "players", "mean_delta"
    )


CHANCE = """1.0 / (1.0 + pow(10.0, -greatest(-400.0, least(400.0, a.rating - b.rating)) / 400.0))"""
RESULT = """CASE WHEN a.score_delta > b.score_delta THEN 1.0
                 WHEN a.score_delta = b.score_delta THEN 0.5 ELSE 0.0 END"""


def field_sql(rated: str) -> str:
    return f"""
SELECT a.snapshot_id, a.game_type, a.player, any_value(a.players) AS players,
       sum({RESULT}) AS wins, sum({CHANCE}) AS expected
FROM {rated} a JOIN {rated} b ON a.snapshot_id = b.snapshot_id AND a.player <> b.player
GROUP BY a.snapshot_id, a.game_type, a.player"""


RATED = """, rated AS (
  SELECT m.*, coalesce(r.rating, 0.0) AS rating
  FROM day_matches m LEFT JOIN ratings r USING (game_type, player))"""


@query("pair_outcomes", with_cte("day", f"""
{RATED}
SELECT snapshot_id, player, players, {sql_num('CAST(wins AS DOUBLE)')} AS wins,
       {sql_num('expected')} AS expected
FROM ({field_sql('rated')})"""))
def pair_outcomes(t: Tables):
    rated = rating.with_ratings(day_matches(t), t.stored_ratings, "game_type")
    return rating.field_results(rated).select(
        "snapshot_id", "player", "players", "wins", "expected"
    )


@query("elo_round", with_cte("day", f"""
{RATED}
SELECT snapshot_id, player, {sql_num('25.0 * (wins - expected) / (players - 1)')} AS elo_delta
FROM ({field_sql('rated')})"""))
def elo_round(t: Tables):
    changes = rating.elo_round(day_matches(t), t.stored_ratings, "game_type")
    return changes.select("snapshot_id", "player", "elo_delta")


@query("elo_round_large", with_cte("day", f"""
{RATED}
SELECT snapshot_id, player, {sql_num('25.0 * (wins - expected) / (players - 1)')} AS elo_delta
FROM ({field_sql('rated')})"""))
def elo_round_large(t: Tables):
    """The same round; matches of more than a hundred players by sorting and distinct ratings."""
    changes = rating.elo_round(day_matches(t), t.stored_ratings, "game_type", large_players=100)
    return changes.select("snapshot_id", "player", "elo_delta")


@query("rating_totals", with_cte("day", f"""
{RATED}
, changes AS (
  SELECT game_type, player, sum(delta) FILTER (WHERE delta <> 0) AS delta FROM (
    SELECT game_type, player, 25.0 * (wins - expected) / (players - 1) AS delta
    FROM ({field_sql('rated')}))
  GROUP BY game_type, player)
SELECT game_type, player, {sql_num("""CASE
    WHEN delta IS NOT NULL THEN coalesce(r.rating, 0.0) + delta
    WHEN r.player IS NOT NULL THEN r.rating ELSE 0.0 END""")} AS rating
FROM ratings r FULL JOIN changes USING (game_type, player)"""))
def rating_totals(t: Tables):
    changes = rating.elo_round(day_matches(t), t.stored_ratings, "game_type")
    return rating.add_ratings(t.stored_ratings, changes, "game_type")


WEEKLY = [f"date_trunc('week', m.ts) = DATE '{week}'" for week in WEEKS]


def rounds_sql(matches: str, cte: str, result: str = "", periods: list[str] = WEEKLY) -> str:
    """One pair of CTEs per period: the field of that period, then the new sums."""
    parts = [", start0 AS (SELECT '' AS game_type, '' AS player, 0.0 AS rating WHERE false)"]
    for i, test in enumerate(periods):
        parts.append(f"""
rated{i} AS (
  SELECT m.*, coalesce(r.rating, 0.0) AS rating
  FROM {matches} m LEFT JOIN start{i} r USING (game_type, player)
  WHERE {test}),
start{i + 1} AS (
  SELECT game_type, player, sum(rating) AS rating FROM (
    SELECT game_type, player, rating FROM start{i}
    UNION ALL
    SELECT game_type, player, 25.0 * (wins - expected) / (players - 1)
    FROM ({field_sql(f'rated{i}')}))
  GROUP BY game_type, player)""")
    body = ",".join(parts)
    last = f"SELECT game_type, player, {sql_num('rating')} AS rating FROM start{len(periods)}"
    return with_cte(cte, f"{body}\n{result.format(last=last) or last}")


@query("elo_rounds", rounds_sql("day_matches", "day"))
def elo_rounds(t: Tables):
    return rating.elo_rounds(day_matches(t), "game_type", F.date_trunc("week", "ts"))


@query("elo_board", rounds_sql("day_matches", "day", """, rated_all AS ({last}),
listed AS (
  SELECT * FROM rated_all UNION ALL
  SELECT DISTINCT h.game_type, c.player, 0.0 AS rating
  FROM day_headers h JOIN day_clients c USING (snapshot_id)
  WHERE h.snapshot_id IN (SELECT snapshot_id FROM day_matches) AND NOT EXISTS (
    SELECT 1 FROM rated_all r WHERE r.game_type = h.game_type AND r.player = c.player))
SELECT * FROM (
  SELECT game_type, player, rating,
         row_number() OVER (PARTITION BY game_type ORDER BY rating DESC, player) AS rank
  FROM listed)
WHERE rank <= 100"""))
def elo_board(t: Tables):
    """First page of every game type by rating; clients without a match are listed."""
    found = day_matches(t)
    ratings = rating.elo_rounds(found, "game_type", F.date_trunc("week", "ts"))
    rows = rating.with_info_rows(
        ratings, found, t.bucket_headers("day"), t.bucket_clients("day"), "game_type", "ELO")
    rows = rows.withColumn("rating", F.round("rating", 6) + F.lit(0.0)).withColumn("play_time", F.lit(0))
    return boards.page_per_scope(rows, "game_type", boards.by_rating("player")).drop("play_time")


@query("elo_replay", rounds_sql("week_matches", "week"))
def elo_replay(t: Tables):
    """One match per event type and week, so the exact order is the weeks."""
    return rating.elo_replay(week_matches(t), "game_type", F.date_trunc("month", "ts"))


@query("missing_info_rows", with_cte("day", """
SELECT DISTINCT h.game_type, c.player, CAST(0 AS DOUBLE) AS rating
FROM day_headers h JOIN day_clients c USING (snapshot_id)
WHERE h.snapshot_id IN (SELECT snapshot_id FROM day_matches)
  AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.game_type = h.game_type
                  AND r.player = c.player AND r.rating IS NOT NULL)"""))
def missing_info_rows(t: Tables):
    info = t.stored_ratings.where(F.col("rating").isNotNull())
    return rating.missing_info(
        day_matches(t), t.bucket_headers("day"), t.bucket_clients("day"), info, "game_type", "ELO"
    )


@query("best_time", with_cte("orders", f"""
SELECT map, player, {sql_num('CAST(max(-abs(score)) AS DOUBLE)')} AS rating
FROM oh JOIN oc USING (snapshot_id)
WHERE in_game AND abs(score) <> 9999 AND player <> '(connecting)'
GROUP BY map, player"""))
def best_time(t: Tables):
    return rating.best_times(t.order_headers, t.order_clients)


@query("best_time_kept", with_cte("orders", f"""
SELECT map, player, {sql_num('CAST(max(r) AS DOUBLE)')} AS rating FROM (
  SELECT map, player, -abs(score) AS r FROM oh JOIN oc USING (snapshot_id) WHERE in_game
  UNION ALL SELECT map, player, CAST(-20 AS INTEGER) FROM oh JOIN oc USING (snapshot_id) WHERE NOT in_game)
GROUP BY map, player"""))
def best_time_kept(t: Tables):
    """Stored times are only improved."""
    stored = prepare.observe(t.order_headers, t.order_clients.where("NOT in_game")).select(
        "map", "player", F.lit(-20.0).alias("rating")
    ).distinct()
    return rating.best_times(t.order_headers, t.order_clients, stored)


HALVES = ["day(ts) <= 15", "day(ts) > 15"]


@query("live_ratings", rounds_sql("day_matches", "day", """, rated_all AS ({last}),
ranked AS (SELECT DISTINCT snapshot_id FROM day_matches WHERE game_type >= 'm')
SELECT 'ELO' AS rank_method, game_type AS place, player, rating FROM rated_all
UNION ALL
SELECT DISTINCT 'ELO', h.game_type, c.player, 0.0
FROM day_headers h JOIN day_clients c USING (snapshot_id) JOIN ranked USING (snapshot_id)
WHERE NOT EXISTS (SELECT 1 FROM rated_all r WHERE r.game_type = h.game_type AND r.player = c.player)
UNION ALL
SELECT 'TIME', h.map, c.player, round(CAST(max(CASE WHEN in_game AND abs(score) <> 9999 THEN -abs(score) END) AS DOUBLE), 6)
FROM day_headers h JOIN day_clients c USING (snapshot_id) WHERE h.game_type < 'm' GROUP BY h.map, c.player""",
    [f"m.game_type >= 'm' AND {half.replace('ts', 'm.ts')}" for half in HALVES]))
def live_ratings(t: Tables):
    """Ratings by both methods as the live tables keep them, in two batches; clients
    without a match or a time are listed."""
    method = F.when(F.col("game_type") >= "m", "ELO").otherwise("TIME")
    text, zero = F.lit("-"), F.lit(0)
    heads = t.bucket_headers("day").withColumnsRenamed({"snapshot_id": "label"}).select(
        "label", F.xxhash64("label").alias("snapshot_id"), "ts", "server", text.alias("server_name"), text.alias("version"),
        "map", F.col("map").alias("map_name"), "game_type", zero.alias("num_players"), zero.alias("max_players"), "num_clients",
        zero.alias("max_clients"), method.alias("rank_method"))
    clients = prepare.first_occurrence(t.bucket_clients("day")).withColumnRenamed("snapshot_id", "label")
    rows = cut_lineage(heads.join(clients.withColumn("country", zero), "label").drop("label").withColumn("ordinal", zero))
    root = f"{shared_folder(t.spark)}/live-{uuid.uuid4().hex}"
    tables = LiveTables(t.spark, root, DAY_MINUTES)
    for batch, half in enumerate(HALVES):
        tables.process(rows.where(half), batch)
    listed = tables.info_rows().where("rank_method = 'TIME' or scope = 'game_type'")
    return listed.select("rank_method", "place", "player", "rating")
