"""Named queries: counts, change sets, current state and keyed upserts."""

from pyspark.sql import functions as F

from rollcall.operators import counts, prepare, state
from rollcall.plans.boards import RUNS, live_states, polls, states
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.registry import query, sql_day, sql_int, sql_ts
from rollcall.sources.game_types import default_rank_methods

ALL_MAPS = """maps AS (
  SELECT DISTINCT map, game_type FROM oh
  UNION SELECT DISTINCT l_linestatus || '/' || l_returnflag, '0-NONE' FROM lineitem)"""

PLAYERS = "SELECT DISTINCT map, player FROM oseen"
CLANS = "SELECT DISTINCT map, clan FROM oseen WHERE clan IS NOT NULL"


def all_maps(t: Tables):
    """Maps of the orders, and maps nobody has played."""
    unplayed = t.read("lineitem").select(
        F.concat_ws("/", "l_linestatus", "l_returnflag").alias("map"),
        F.lit("0-NONE").alias("game_type"),
    )
    return t.order_headers.select("map", "game_type").unionByName(unplayed).distinct()


def info(t: Tables, *keys: str):
    """Distinct known pairs. All of them start from the same distinct rows, whose
    exchange Spark computes once per query."""
    base = prepare.observe(t.order_headers, t.order_clients).select(
        "game_type", "map", "player", "clan").distinct()
    return base.select(*keys).dropna().distinct()


def count_sql(scope: str, dims: str, tables: dict[str, str]) -> str:
    joins = "\n".join(
        f"LEFT JOIN (SELECT {scope}, count(*) AS {n} FROM ({sql}) GROUP BY {scope}) USING ({scope})"
        for n, sql in tables.items()
    )
    cols = ", ".join(f"coalesce({n}, 0) AS {n}" for n in tables)
    return f"SELECT {scope}, {cols} FROM ({dims})\n{joins}"


@query("group_counts", with_cte("orders", f", {RUNS}, {ALL_MAPS}\n" + count_sql(
    "game_type", "SELECT DISTINCT game_type FROM maps", {
        "player_count": "SELECT DISTINCT game_type, player FROM oseen",
        "clan_count": "SELECT DISTINCT game_type, clan FROM oseen WHERE clan IS NOT NULL",
        "map_count": "SELECT game_type FROM maps",
        "server_count": "SELECT game_type FROM live",
    })))
def group_counts(t: Tables):
    maps = all_maps(t)
    return counts.game_type_counts(
        maps.select("game_type").distinct(), info(t, "game_type", "player"),
        info(t, "game_type", "clan"), maps, live_states(t, counted=False))


MAP_COUNTS = count_sql("map", "SELECT map FROM maps", {
    "player_count": PLAYERS, "clan_count": CLANS, "server_count": "SELECT map FROM live"})


def map_counts_of(t: Tables):
    return counts.map_counts(
        all_maps(t), info(t, "map", "player"), info(t, "map", "clan"), live_states(t, counted=False))


@query("map_counts", with_cte("orders", f", {RUNS}, {ALL_MAPS}\n{MAP_COUNTS}"))
def map_counts(t: Tables):
    return map_counts_of(t)


@query("map_server_counts", with_cte("orders", f", {RUNS}, {ALL_MAPS}\n" + count_sql(
    "map", "SELECT map FROM maps", {"server_count": "SELECT map FROM live"})))
def map_server_counts(t: Tables):
    return counts.map_server_counts(all_maps(t), live_states(t, counted=False))


@query("map_count_changes", with_cte("orders", f"""
, {RUNS}, {ALL_MAPS}, fresh AS ({MAP_COUNTS}),
stored AS (
  SELECT map, count(DISTINCT player) AS player_count, count(DISTINCT clan) AS clan_count,
         CAST(NULL AS BIGINT) AS server_count
  FROM maps LEFT JOIN oseen USING (map) GROUP BY map)
SELECT f.* FROM fresh f JOIN stored s USING (map)
WHERE f.player_count IS DISTINCT FROM s.player_count OR f.clan_count IS DISTINCT FROM s.clan_count
   OR f.server_count IS DISTINCT FROM s.server_count"""))
def map_count_changes(t: Tables):
    """Server counts were never stored; null differs from any count."""
    columns = ["player_count", "clan_count", "server_count"]
    stored = counts.with_counts(
        all_maps(t).select("map"), "map",
        player_count=info(t, "map", "player"), clan_count=info(t, "map", "clan"),
    ).withColumn("server_count", F.lit(None).cast("long"))
    return counts.changes(stored, map_counts_of(t), "map", columns)


@query("team_active_counts", """
WITH old AS (
  SELECT n_name AS clan, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'
  WHERE r_name <> 'ASIA' GROUP BY 1),
new AS (
  SELECT n_name AS clan, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey WHERE r_name <> 'AFRICA' GROUP BY 1)
SELECT clan, coalesce(o.n, 0) AS old_count, coalesce(w.n, 0) AS active_player_count
FROM old o FULL JOIN new w USING (clan) WHERE coalesce(o.n, 0) <> coalesce(w.n, 0)""")
def team_active_counts(t: Tables):
    """Stored counts cover one segment and lack Asia; Africa has lost everybody."""
    nations = t.read("nation").join(
        t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t.read("customer")
    building = customers.where("c_mktsegment = 'BUILDING'").select("c_nationkey", "c_custkey")
    stored = (
        nations.where("r_name <> 'ASIA'")
        .join(building, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.col("n_name").alias("clan"))
        .agg(F.count("c_custkey").alias("active_player_count"))
    )
    clan = F.when(F.col("r_name") != "AFRICA", F.col("n_name"))
    players = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("player"), clan.alias("clan"))
    return counts.active_clan_changes(stored, players)


ENTITIES = {
    "players": ("supplier", "s_suppkey"), "clans": ("nation", "n_nationkey"),
    "game_types": ("region", "r_regionkey"), "servers": ("customer", "c_custkey"),
    "maps": ("part", "p_partkey"), "snapshots": ("orders", "o_orderkey"),
}


@query("entity_counts", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS entity, count(*) AS added, CAST(max({key}) AS BIGINT) AS cursor "
    f"FROM {table}" for name, (table, key) in ENTITIES.items()))
def entity_counts(t: Tables):
    return counts.entity_counts(None, **{
        name: t.read(table).select(F.col(key).alias("id"))
        for name, (table, key) in ENTITIES.items()
    })


@query("new_entities", with_cte("events", """
SELECT event_id AS snapshot_id, event_type AS server FROM ev
WHERE event_id > (SELECT max(event_id) FROM ev WHERE ts < TIMESTAMP '2024-01-20')"""))
def new_entities(t: Tables):
    """Rows above the id reached before the 20th."""
    cursor = t.event_headers.where("ts < TIMESTAMP '2024-01-20'").agg(F.max("snapshot_id"))
    return counts.since(t.event_headers, cursor.scalar(), "snapshot_id").select("snapshot_id", "server")


@query("latest_state", with_cte("orders", f"""
, {RUNS}
SELECT server, snapshot_id, {sql_day('ts')} AS day, map, {sql_int('max_clients')} AS max_clients,
       num_clients FROM states"""))
def latest_state(t: Tables):
    return prepare.with_day(states(t)).select(
        "server", "snapshot_id", "day", "map", "max_clients", "num_clients")


@query("failure_runs", with_cte("orders", f"""
, {RUNS}
SELECT server, {sql_ts('last_seen')} AS last_seen, failure_count,
       last_seen IS NOT NULL AND failure_count = 0 AS online FROM runs"""))
def failure_runs(t: Tables):
    return state.failure_runs(polls(t))


HALF = "TIMESTAMP '2024-01-16'"


def worn_sql(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT player, max(ts) AS last_seen, max(clan) FILTER (WHERE ts = worn_at) AS clan FROM (
    SELECT *, max(CASE WHEN clan IS NOT NULL THEN ts END) OVER (PARTITION BY player) AS worn_at
    FROM eseen WHERE {where}) GROUP BY player)"""


@query("player_upsert", with_cte("events", f"""
, {worn_sql('old', f'ts < {HALF}')}, {worn_sql('new', f'ts >= {HALF}')},
both_sides AS (
  SELECT player, o.last_seen AS old_seen, o.clan AS old_clan, n.last_seen AS new_seen,
         n.clan AS new_clan, o.player IS NOT NULL AS known, n.player IS NOT NULL AS fresh
  FROM old o FULL JOIN new n USING (player)),
marked AS (
  SELECT *, fresh AND (NOT known OR new_seen - old_seen > INTERVAL 10 MINUTE
            OR (new_clan IS NOT NULL AND new_clan IS DISTINCT FROM old_clan)) AS written
  FROM both_sides)
SELECT player, {sql_ts('CASE WHEN written THEN new_seen ELSE old_seen END')} AS last_seen,
       CASE WHEN written THEN coalesce(new_clan, old_clan) ELSE old_clan END AS clan, written
FROM marked"""))
def player_upsert(t: Tables):
    """Players stored in the first half of the month, seen again in the second."""
    seen = prepare.observe(t.event_headers, t.event_clients).select("player", "ts", "clan")
    stored = state.seen_players(seen.where(f"ts < {HALF}"))
    fresh = state.seen_players(seen.where(f"ts >= {HALF}"))
    return state.upsert_players(stored, fresh)


@query("new_ids", """
WITH known AS (SELECT max(p_partkey) AS id, p_name AS name, p_brand AS brand FROM part
               WHERE p_type = 'PROMO' GROUP BY p_name, p_brand),
fresh AS (SELECT DISTINCT p_name AS name, p_brand AS brand FROM part
          WHERE (p_name, p_brand) NOT IN (SELECT (name, brand) FROM known))
SELECT (SELECT max(id) FROM known) + row_number() OVER (
         ORDER BY substr(md5(name || chr(31) || brand), 1, 3), name, brand) AS id, name, brand
FROM fresh""")
def new_ids(t: Tables):
    """Names of promoted parts have ids; the others get theirs."""
    names = t.read("part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "p_partkey", "p_type")
    known = names.where("p_type = 'PROMO'").groupBy("name", "brand").agg(
        F.max("p_partkey").alias("id"))
    return state.new_ids(known, names, ["name", "brand"])


@query("insert_absent", """
SELECT c_name AS name, 'customer' AS kind FROM customer
UNION ALL
SELECT DISTINCT p_name, 'part' FROM part WHERE p_name NOT IN (SELECT c_name FROM customer)""")
def insert_absent(t: Tables):
    dim = t.read("customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    rows = t.read("part").select(F.col("p_name").alias("name"), F.lit("part").alias("kind"))
    return state.insert_absent(dim, rows, ["name"])


@query("master_reassign", """
WITH servers AS (
  SELECT c_name AS ip, CAST(c_nationkey + 8300 AS BIGINT) AS port,
         CASE WHEN c_acctbal >= 0 THEN CAST(n_regionkey AS BIGINT) END AS master
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
listed AS (
  SELECT DISTINCT c_name AS ip, CAST(c_nationkey + 8300 AS BIGINT) AS port
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'
  UNION SELECT s_name, 8303 FROM supplier)
SELECT ip, port, CASE WHEN l.ip IS NOT NULL THEN 3 WHEN master <> 3 THEN master END AS master
FROM servers s FULL JOIN listed l USING (ip, port)""")
def master_reassign(t: Tables):
    """Master 3 lists customers with orders in 2001 and the suppliers."""
    customers = t.read("customer").join(
        t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    address = [F.col("c_name").alias("ip"), (F.col("c_nationkey") + 8300).alias("port")]
    servers = customers.select(
        *address, F.when(F.col("c_acctbal") >= 0, F.col("n_regionkey")).alias("master"))
    recent = t.read("orders").where("o_orderdate >= TIMESTAMP '2001-01-01'")
    listed = customers.join(
        recent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(*address)
    listed = listed.unionByName(
        t.read("supplier").select(F.col("s_name").alias("ip"), F.lit(8303).alias("port")))
    return state.reassign_master(servers, listed, 3)


@query("orphans", f"""
SELECT l_orderkey AS snapshot_id, {sql_int('l_linenumber')} AS line FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def orphans(t: Tables):
    """Clients that go with the pending orders."""
    lines = t.read("lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("line"))
    kept = t.read("orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("snapshot_id"))
    return state.orphans(lines, kept, "snapshot_id")


# Game types with a rank method of their own.
DEFAULTS_SQL = """(VALUES ('DM','ELO'),('CTF','ELO'),('TDM','ELO'),('DM*','ELO'),('DM+','ELO'),
('DM++','ELO'),('fng2','ELO'),('fng2+','ELO'),('iCTF*','ELO'),('iCTF+','ELO'),('iCTFX','ELO'),
('iDM*','ELO'),('iDM+','ELO'),('zCatch','ELO'),('zCatch/TeeVi','ELO'),('DDraceNetwork','TIME'),
('Gores','TIME'),('TestDDraceNetwor','TIME'),('TestGores','TIME'),('Race','TIME'),
('iDDRace','TIME'),('XXLDDRace','TIME'),('PPRace','TIME'),('TestDDNet++','TIME'))
AS d(game_type, rank_method)"""


@query("rank_methods", f"""
SELECT DISTINCT o_orderpriority AS game_type, CAST(NULL AS VARCHAR) AS rank_method FROM orders
UNION ALL SELECT DISTINCT event_type, NULL FROM events
UNION ALL SELECT game_type, rank_method FROM {DEFAULTS_SQL}""")
def rank_methods(t: Tables):
    """Game types found in the tables, with the defaults upserted."""
    found = t.read("orders").select(F.col("o_orderpriority").alias("game_type")).unionByName(
        t.read("events").select(F.col("event_type").alias("game_type"))).distinct()
    stored = found.withColumn("rank_method", F.lit(None).cast("string"))
    return state.set_rank_methods(stored, default_rank_methods(t.spark))


@query("map_counts_moved", with_cte("orders", f", {RUNS}, {ALL_MAPS}\n" + count_sql(
    "map", "SELECT map FROM maps", {"player_count": PLAYERS, "clan_count": CLANS})))
def map_counts_moved(t: Tables):
    """Counts of the rows up to 1998, moved by the pairs first seen after it."""
    rows = prepare.observe(t.order_headers, t.order_clients).select("ts", "map", "player", "clan")
    cut = F.lit("1998-01-01").cast("timestamp")
    pairs = {"player_count": ["map", "player"], "clan_count": ["map", "clan"]}
    none = t.spark.createDataFrame([], "map string, player string, clan string")
    before = {c: counts.first_seen(none, rows.where(F.col("ts") < cut), keys) for c, keys in pairs.items()}
    stored = counts.with_counts(all_maps(t).select("map"), "map", **before)
    fresh = {c: counts.first_seen(before[c], rows.where(F.col("ts") >= cut), keys) for c, keys in pairs.items()}
    return counts.moved_counts(stored, all_maps(t), "map", **fresh)
