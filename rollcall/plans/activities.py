"""Named queries: calendars, series and display text."""

from datetime import date

from pyspark.sql import functions as F

from rollcall.functions import text
from rollcall.operators import activity, rollup
from rollcall.plans.fixtures import EVENTS_TODAY, Tables, with_cte
from rollcall.plans.registry import query, sql_day, sql_int, sql_num
from rollcall.plans.rollups import event_presence

TODAY = date.fromisoformat(EVENTS_TODAY)

PRESENCE = "sum(CASE WHEN in_game THEN 300 ELSE 0 END)"
DAY_SQL = {
    "player": "SELECT day, player, play_time FROM epday",
    **{
        scope: f"SELECT CAST(ts AS DATE) AS day, {scope}, {PRESENCE} AS play_time, "
               f"count(DISTINCT player) AS player_count FROM eseen "
               f"WHERE {scope} IS NOT NULL GROUP BY 1, 2"
        for scope in ("map", "game_type", "clan")
    },
    "server": """SELECT CAST(hour AS DATE) AS day, server,
      CAST(round(round(avg(client_sum / n), 9)) AS INTEGER) AS avg_clients,
      max(max_clients) AS max_clients
    FROM (SELECT server, date_trunc('hour', ts) AS hour, count(*) AS n,
                 sum(num_clients) AS client_sum, max(num_clients) AS max_clients
          FROM eh GROUP BY 1, 2) WHERE client_sum > 0 GROUP BY 1, 2""",
}


def day_table(t: Tables, entity: str):
    if entity == "server":
        return rollup.server_day(t.event_headers)
    if entity == "player":
        return rollup.player_day(event_presence(t))
    return rollup.scope_day(event_presence(t), entity)


def play_time_sql(seconds: str) -> str:
    """Two largest calendar units since the epoch."""
    end = f"(TIMESTAMP '1970-01-01' + to_seconds({seconds}))"
    units = [("y", f"year({end}) - 1970"), ("m", f"month({end}) - 1"), ("d", f"day({end}) - 1"),
             ("h", f"hour({end})"), ("m", f"minute({end})"), ("s", f"second({end})")]
    cases = " ".join(
        f"WHEN {a} > 0 THEN CAST({a} AS VARCHAR) || '{u}' || lpad(CAST({b} AS VARCHAR), 2, '0') || '{v}'"
        for (u, a), (v, b) in zip(units, units[1:])
    )
    return f"CASE {cases} ELSE CAST(second({end}) AS VARCHAR) || 's' END"


ON_DAY = "' on ' || strftime(day, '%b %-d, %Y')"
TOOLTIPS = {
    "player": f"{play_time_sql('CAST(play_time AS BIGINT)')} || {ON_DAY}",
    "server": "CAST(avg_clients AS VARCHAR) || ' avg clients · peak ' || "
              f"CAST(max_clients AS VARCHAR) || {ON_DAY}",
}
NAMES = {"player": "player", "map": "map", "game_type": "group", "clan": "team", "server": "server"}


def activity_sql(entity: str) -> str:
    value = "avg_clients" if entity == "server" else "play_time"
    tooltip = TOOLTIPS.get(entity) or (
        f"{play_time_sql('CAST(play_time AS BIGINT)')} || ' · ' || format('{{:,}}', player_count) "
        f"|| ' players' || {ON_DAY}"
    )
    return with_cte("events", f"""
SELECT {entity}, {sql_day('day')} AS day, {sql_int(value)} AS value, {tooltip} AS tooltip
FROM ({DAY_SQL[entity]})
WHERE day BETWEEN DATE '2023-11-02' AND DATE '2024-01-30'""")


def entity_activity(t: Tables, entity: str):
    """Every entity's activity over the last ninety days."""
    value = "avg_clients" if entity == "server" else "play_time"
    domain = activity.resolve_domain(TODAY, "90d")
    return activity.activity(day_table(t, entity), entity, domain, value)


for _entity, _name in NAMES.items():
    query(f"activity_{_name}", activity_sql(_entity))(
        lambda t, entity=_entity: entity_activity(t, entity))


def calendar_sql(entity: str, value: str, cols: str) -> str:
    return with_cte("events", f"""
, days AS ({DAY_SQL[entity]}),
ordered AS (
  SELECT {entity}, {value} AS v, row_number() OVER (PARTITION BY {entity} ORDER BY {value}) AS i,
         count(*) OVER (PARTITION BY {entity}) AS n
  FROM days WHERE {value} > 0 AND day BETWEEN DATE '2019-01-28' AND DATE '2024-01-30'),
thresholds AS (
  SELECT {entity}, max(CASE WHEN i = least(n, n * 1 // 4 + 1) THEN v END) AS t1,
         max(CASE WHEN i = least(n, n * 2 // 4 + 1) THEN v END) AS t2,
         max(CASE WHEN i = least(n, n * 3 // 4 + 1) THEN v END) AS t3
  FROM ordered GROUP BY {entity}),
domains AS (
  SELECT {entity}, least(greatest(min(day), DATE '2019-01-28'), DATE '2024-01-30') AS start
  FROM days GROUP BY {entity}),
spine AS (
  SELECT {entity}, start, CAST(unnest(generate_series(start, DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day
  FROM domains),
grid AS (
  SELECT s.{entity}, s.day, d.{value} AS value,
         CASE WHEN {value} IS NULL OR {value} <= 0 THEN 0 WHEN {value} <= t1 THEN 1
              WHEN {value} <= t2 THEN 2 WHEN {value} <= t3 THEN 3 ELSE 4 END AS level,
         (date_diff('day', start, s.day) + dayofweek(start)) // 7 AS week,
         dayofweek(s.day) AS weekday
  FROM spine s LEFT JOIN days d USING ({entity}, day) LEFT JOIN thresholds USING ({entity}))
SELECT {entity}, {sql_day('day')} AS day, {cols} FROM grid""")


@query("activity_levels", calendar_sql(
    "player", "play_time", f"{sql_int('value')} AS play_time, {sql_int('level')} AS level"))
def activity_levels(t: Tables):
    days = activity.calendar(day_table(t, "player"), "player", "play_time", TODAY)
    return days.select("player", "day", "play_time", "level")


@query("calendar_grid", calendar_sql(
    "clan", "play_time", f"{sql_int('level')} AS level, {sql_int('week')} AS week, "
    f"{sql_int('weekday')} AS weekday"))
def calendar_grid(t: Tables):
    days = activity.calendar(day_table(t, "clan"), "clan", "play_time", TODAY)
    return days.select("clan", "day", "level", "week", "weekday")


def players_sql(first: str, last: str) -> str:
    return with_cte("events", f"""
SELECT {sql_day('d.day')} AS day, players
FROM (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT day, count(*) AS players FROM epday GROUP BY day) p ON p.day = d.day""")


@query("daily_players", players_sql("2023-11-02", "2024-01-30"))
def daily_players(t: Tables):
    domain = activity.resolve_domain(TODAY, "90d")
    return activity.fill_days(
        activity.daily_players(day_table(t, "player"), domain.start), domain)


@query("shifted_window", players_sql("2024-01-01", "2024-01-30"))
def shifted_window(t: Tables):
    """The thirty days before the thirty days up to 29 February."""
    today = date(2024, 3, 1)
    domain = activity.shift_domain(activity.resolve_domain(today, "30d"), -1, today)
    return activity.fill_days(
        activity.daily_players(day_table(t, "player"), domain.start), domain)


@query("first_days", with_cte("events", f"""
SELECT player, {sql_day('min(day)')} AS day, {sql_day("greatest(min(day), DATE '2019-01-28')")} AS start
FROM epday GROUP BY player"""))
def first_days(t: Tables):
    table = day_table(t, "player")
    start = activity.entity_domains(table, "player", "play_time", TODAY).select("player", "start")
    return table.groupBy("player").agg(F.min("day").alias("day")).join(start, "player")


@query("server_timeline", with_cte("events", f"""
SELECT server, snapshot_id, position, {sql_int('peak')} AS peak,
       {sql_num('CASE WHEN n = 1 THEN 1000.0 ELSE CAST(position - 1 AS DOUBLE) / (n - 1) * 1000 END')} AS x,
       {sql_num('CAST(num_clients AS DOUBLE) / peak * 36')} AS y
FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY ts, snapshot_id) AS position,
             count(*) OVER (PARTITION BY server) AS n,
             greatest(1, max(num_clients) OVER (PARTITION BY server)) AS peak FROM eh)"""))
def server_timeline(t: Tables):
    return activity.server_timeline(t.event_headers).drop("ts", "num_clients")


@query("axis_max", with_cte("events", f"""
, peaks AS (SELECT map, CAST(max(play_time) AS DOUBLE) AS peak FROM ({DAY_SQL['map']}) GROUP BY map),
scaled AS (SELECT *, pow(10.0, floor(log10(peak))) AS m FROM peaks WHERE peak > 0
           UNION ALL SELECT *, NULL FROM peaks WHERE peak <= 0)
SELECT map, {sql_num('peak')} AS peak, {sql_num('''CASE WHEN peak <= 0 THEN 1.0 WHEN m >= peak THEN m
  WHEN 2 * m >= peak THEN 2 * m WHEN 2.5 * m >= peak THEN 2.5 * m WHEN 5 * m >= peak THEN 5 * m
  ELSE 10 * m END''')} AS axis FROM scaled"""))
def axis_max(t: Tables):
    peaks = day_table(t, "map").groupBy("map").agg(F.max("play_time").cast("double").alias("peak"))
    return peaks.withColumn("axis", activity.nice_maximum("peak"))


NOW = "2001-09-15 12:00:00"
MONTHS = f"""(CASE WHEN o_orderdate + to_months(apart) > TIMESTAMP '{NOW}' THEN apart - 1 ELSE apart END)"""


def plural(n: str, unit: str) -> str:
    return f"format('{{:,}}', {n}) || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


@query("formatted_times", f"""
SELECT o_orderkey, {play_time_sql('seconds')} AS play_time, format('{{:,}}', seconds) AS grouped,
       lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS padded,
       CASE WHEN months // 12 > 0 THEN {plural('(months // 12)', 'year')}
            WHEN months > 0 THEN {plural('months', 'month')}
            WHEN days > 0 THEN {plural('days', 'day')} ELSE 'none' END AS age,
       CASE WHEN months > 0 THEN 'months' WHEN days > 0 THEN 'days' ELSE 'none' END AS presence,
       upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS priority
FROM (SELECT *, {MONTHS} AS months, date_diff('second', o_orderdate, TIMESTAMP '{NOW}') // 86400 AS days
      FROM (SELECT *, CAST(floor(o_totalprice * 100) AS BIGINT) AS seconds,
              (2001 - year(o_orderdate)) * 12 + 9 - month(o_orderdate) AS apart FROM orders))""")
def formatted_times(t: Tables):
    now = F.lit(NOW).cast("timestamp")
    orders = t.read("orders").withColumn("seconds", F.floor(F.col("o_totalprice") * 100))
    return orders.withColumn("servers", F.array().cast("array<string>")).select(
        "o_orderkey",
        text.play_time_text("seconds").alias("play_time"),
        text.thousands("seconds").alias("grouped"),
        text.padded_id("o_orderkey").alias("padded"),
        text.short_duration("o_orderdate", now).alias("age"),
        text.presence_state("servers", "o_orderdate", now).alias("presence"),
        text.capitalized("o_orderpriority").alias("priority"),
    )
