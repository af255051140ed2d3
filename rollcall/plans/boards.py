"""Named queries: leaderboards, search and presence."""

from pyspark.sql import functions as F

from rollcall.operators import boards, playtime, prepare, rating, search, state
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.playtimes import credits, total_sql
from rollcall.plans.registry import query, sql_int, sql_num


def total(t: Tables, name: str):
    return playtime.play_time(credits(t), playtime.TOTALS[name])


def page_sql(rows: str, order: str, cols: str, first: int = 1, last: int = 100) -> str:
    return f"""
SELECT {cols}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({rows}))
WHERE rank BETWEEN {first} AND {last}"""


def scoped_sql(rows: str, scope: str, order: str, cols: str, last: int = 100) -> str:
    return f"""
SELECT {cols}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) AS rank FROM ({rows}))
WHERE rank <= {last}"""


@query("top_players", with_cte("events", page_sql(
    total_sql(["player"]), "play_time DESC, player", "player, play_time", 1, 3)))
def top_players(t: Tables):
    return boards.top(total(t, "player"), boards.by_play_time("player"), 3)


@query("top_teams", with_cte("events", page_sql(
    total_sql(["clan"]), "play_time DESC, clan", "clan, play_time")))
def top_teams(t: Tables):
    return boards.page(total(t, "clan"), boards.by_play_time("clan"))


GROUPS = """SELECT game_type, count(DISTINCT player) AS player_count,
  count(DISTINCT map) AS map_count FROM eseen GROUP BY game_type"""


@query("top_groups", with_cte("events", page_sql(
    GROUPS, "player_count DESC, map_count DESC, game_type",
    "game_type, player_count, map_count", 1, 3)))
def top_groups(t: Tables):
    seen = prepare.observe(t.event_headers, t.event_clients)
    counts = (
        seen.select("game_type", "player").distinct()
        .groupBy("game_type").agg(F.count("*").alias("player_count"))
        .join(
            t.event_headers.select("game_type", "map").distinct()
            .groupBy("game_type").agg(F.count("*").alias("map_count")), "game_type")
    )
    return boards.top(counts, boards.by_counts("game_type"), 3)


@query("ranked_page", with_cte("events", page_sql(
    total_sql(["player"]), "play_time DESC, player", "player, play_time", 101, 200)))
def ranked_page(t: Tables):
    """Second page of the list of all players."""
    return boards.page(total(t, "player"), boards.by_play_time("player"), 2)


# Orders as polls of their customer: a finished order is a failed poll.
RUNS = """
runs AS (
  SELECT server, max(ts) FILTER (WHERE ok) AS last_seen, count(*) FILTER (
      WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok)) AS failure_count
  FROM (SELECT o_custkey AS server, o_orderdate AS ts, o_orderstatus <> 'F' AS ok,
          max(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END)
            OVER (PARTITION BY o_custkey) AS last_ok FROM orders)
  GROUP BY server),
states AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY server ORDER BY ts DESC, snapshot_id DESC) AS nth FROM ohc) WHERE nth = 1),
live AS (
  SELECT * FROM states WHERE server IN (
    SELECT server FROM runs WHERE last_seen IS NOT NULL AND failure_count = 0))"""


def polls(t: Tables):
    return t.read("orders").select(
        F.col("o_custkey").alias("server"), F.col("o_orderdate").alias("ts"),
        (F.col("o_orderstatus") != "F").alias("ok"),
    )


def states(t: Tables, counted: bool = True):
    return state.latest_state(t.counted_order_headers if counted else t.order_headers)


def live_states(t: Tables, counted: bool = True):
    """Live servers; client counts cost a pass over all clients."""
    return state.online_states(states(t, counted), state.failure_runs(polls(t)))


SERVERS = """SELECT c_custkey AS server, coalesce(failure_count, 0) AS failure_count,
  num_clients, max_clients, CAST(floor(c_acctbal) AS BIGINT) AS play_time
  FROM customer LEFT JOIN runs ON runs.server = c_custkey LEFT JOIN live ON live.server = c_custkey"""


@query("servers_board", with_cte("orders", f", {RUNS} " + page_sql(
    SERVERS, "failure_count, max_clients DESC NULLS FIRST, num_clients DESC NULLS FIRST, "
    "play_time DESC, server",
    "server, CAST(failure_count AS BIGINT) AS failure_count, num_clients, "
    "CAST(max_clients AS BIGINT) AS max_clients, play_time")))
def servers_board(t: Tables):
    runs = state.failure_runs(polls(t)).select("server", "failure_count")
    servers = t.read("customer").select(
        F.col("c_custkey").alias("server"), F.floor("c_acctbal").alias("play_time")
    )
    rows = (
        servers.join(runs, "server", "left")
        .join(live_states(t).select("server", "num_clients", "max_clients"), "server", "left")
        .withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))
    )
    return boards.page(rows, boards.server_order("server"))


RATED_TIMES = f"({total_sql(['player', 'game_type'])}) LEFT JOIN ratings USING (game_type, player)"


@query("group_players", with_cte("events", scoped_sql(
    f"SELECT * FROM {RATED_TIMES}", "game_type",
    "rating DESC NULLS LAST, play_time DESC, player",
    f"game_type, player, play_time, {sql_num('rating')} AS rating")))
def group_players(t: Tables):
    rows = total(t, "player_game_type").join(t.stored_ratings, ["game_type", "player"], "left")
    return boards.page_per_scope(rows, "game_type", boards.by_rating("player"))


MAP_TIMES = f"""SELECT * FROM ({total_sql(['player', 'map'])}) LEFT JOIN (
  SELECT map, player, max(-abs(score)) AS rating FROM eseen
  WHERE in_game AND abs(score) <> 9999 GROUP BY map, player) USING (map, player)"""


@query("map_players", with_cte("events", scoped_sql(
    MAP_TIMES, "map", "rating DESC NULLS LAST, play_time DESC, player",
    f"map, player, play_time, {sql_num('CAST(rating AS DOUBLE)')} AS rating")))
def map_players(t: Tables):
    times = rating.best_times(t.event_headers, t.event_clients)
    rows = total(t, "player_map").join(times, ["map", "player"], "left")
    return boards.page_per_scope(rows, "map", boards.by_rating("player"))


def stacked(parts):
    """Lists of several kinds as one, with ``kind`` and ``scope``."""
    out = None
    for kind, df, scope, item in parts:
        df = df.select(
            F.lit(kind).alias("kind"), F.col(scope).cast("string").alias("scope"),
            F.col(item).cast("string").alias("item"), "play_time",
        )
        out = df if out is None else out.unionByName(df)
    return boards.page_per_scope(out, ["kind", "scope"], boards.by_play_time("item"))


def stacked_sql(parts) -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT '{kind}' AS kind, {scope} AS scope, {item} AS item, play_time "
        f"FROM ({total_sql([scope, item])})"
        for kind, scope, item in parts
    )
    return with_cte("events", scoped_sql(
        rows, "kind, scope", "play_time DESC, item", "kind, scope, item, play_time"))


@query("scope_teams", stacked_sql([("group", "game_type", "clan"), ("map", "map", "clan")]))
def scope_teams(t: Tables):
    return stacked([
        ("group", total(t, "clan_game_type"), "game_type", "clan"),
        ("map", total(t, "clan_map"), "map", "clan"),
    ])


@query("team_members", stacked_sql([("members", "clan", "player")]))
def team_members(t: Tables):
    return stacked([("members", total(t, "clan_player"), "clan", "player")])


@query("team_members_page", with_cte("events", f"""
SELECT clan, player, play_time, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY clan ORDER BY play_time DESC, player) AS rank,
         least(3, (count(*) OVER (PARTITION BY clan) + 99) // 100) AS page
  FROM ({total_sql(['clan', 'player'])}))
WHERE rank > (page - 1) * 100 AND rank <= page * 100"""))
def team_members_page(t: Tables):
    """The third page of every clan's members, or the last one it has."""
    return boards.clamped_page(total(t, "clan_player"), "clan", boards.by_play_time("player"), 3)


@query("team_scopes", stacked_sql([("group", "clan", "game_type"), ("map", "clan", "map")]))
def team_scopes(t: Tables):
    return stacked([
        ("group", total(t, "clan_game_type"), "clan", "game_type"),
        ("map", total(t, "clan_map"), "clan", "map"),
    ])


@query("player_scopes", stacked_sql([
    ("group", "player", "game_type"), ("map", "player", "map"), ("team", "player", "clan")]))
def player_scopes(t: Tables):
    return stacked([
        ("group", total(t, "player_game_type"), "player", "game_type"),
        ("map", total(t, "player_map"), "player", "map"),
        ("team", total(t, "clan_player"), "player", "clan"),
    ])


@query("scope_servers", with_cte("orders", f", {RUNS} " + scoped_sql(
    "SELECT 'group' AS kind, game_type AS scope, * FROM live UNION ALL "
    "SELECT 'map' AS kind, map AS scope, * FROM live",
    "kind, scope", "num_clients DESC, max_clients DESC, server",
    "kind, scope, server, num_clients, CAST(max_clients AS BIGINT) AS max_clients")))
def scope_servers(t: Tables):
    maps = t.order_headers.select("map", "game_type").distinct()
    live = boards.servers_in_scope(live_states(t).drop("game_type"), maps)
    columns = ["server", "num_clients", "max_clients"]
    both = live.select(F.lit("group").alias("kind"), F.col("game_type").alias("scope"), *columns)
    both = both.unionByName(
        live.select(F.lit("map").alias("kind"), F.col("map").alias("scope"), *columns))
    return boards.page_per_scope(both, ["kind", "scope"], boards.by_clients("server"))


@query("group_maps", with_cte("events", scoped_sql(
    "SELECT game_type, map, count(DISTINCT player) AS player_count FROM eseen GROUP BY 1, 2",
    "game_type", "player_count DESC, map", "game_type, map, player_count")))
def group_maps(t: Tables):
    seen = prepare.observe(t.event_headers, t.event_clients)
    counts = (
        seen.select("game_type", "map", "player").distinct()
        .groupBy("game_type", "map").agg(F.count("*").alias("player_count"))
    )
    return boards.page_per_scope(counts, "game_type", boards.by_players("map"))


LINE_KEY = ("player, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, "
            "l_shipdate, l_returnflag, l_linestatus")


@query("snapshot_clients", with_cte("orders", f"""
SELECT snapshot_id, player, CAST(score AS BIGINT) AS score,
       row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, {LINE_KEY}) AS rank
FROM oc"""))
def snapshot_clients(t: Tables):
    """Every client of every snapshot."""
    ranked = boards.ranked_per_scope(
        t.order_clients, "snapshot_id", boards.by_score("player", "ordinal"))
    return ranked.select("snapshot_id", "player", "score", "rank")


@query("live_clients", with_cte("orders", f""", {RUNS}
SELECT * FROM (
  SELECT live.server, player, CAST(score AS BIGINT) AS score, in_game, row_number() OVER (
    PARTITION BY live.server ORDER BY score DESC, {LINE_KEY}) AS rank
  FROM live JOIN oc USING (snapshot_id))
WHERE rank <= 100"""))
def live_clients(t: Tables):
    """First page of every live server's clients by score."""
    clients = t.order_clients.select("snapshot_id", "player", "score", "in_game", "ordinal")
    page = boards.page_per_scope(
        state.live_clients(live_states(t, counted=False), clients), "server", boards.by_score("player", "ordinal"))
    return page.drop("snapshot_id", "ordinal")


def customer_servers(t: Tables):
    return t.read("customer").select(
        F.col("c_custkey").alias("server"), F.col("c_name").alias("ip"),
        (F.col("c_nationkey") + 8300).cast("int").alias("port"),
    )


def shown(servers: str = "servers"):
    entry = lambda s: F.concat_ws(":", s.ip, s.port.cast("string"))
    return F.array_join(F.transform(servers, entry), ",").alias("servers")


ONLINE = """
online AS (
  SELECT player, string_agg(DISTINCT spot, ',' ORDER BY spot) AS servers FROM (
    SELECT player, c_name || ':' || CAST(c_nationkey + 8300 AS VARCHAR) AS spot
    FROM live JOIN oc USING (snapshot_id) JOIN customer ON c_custkey = live.server)
  GROUP BY player)"""


@query("presence", with_cte("orders", f", {RUNS}, {ONLINE} " + page_sql(
    "SELECT sup.player, CAST(floor(s_acctbal) AS BIGINT) AS play_time, coalesce(servers, '') AS servers, "
    "CASE WHEN servers IS NULL THEN 'offline' ELSE 'online' END AS presence "
    "FROM sup LEFT JOIN online USING (player)",
    "play_time DESC, player", "player, play_time, servers, presence")))
def presence(t: Tables):
    players = t.suppliers.select("player", F.floor("s_acctbal").alias("play_time"))
    page = boards.page(players, boards.by_play_time("player"))
    on = state.live_clients(
        live_states(t, counted=False), t.order_clients.select("snapshot_id", "player"))
    rows = boards.online_on(page, on, customer_servers(t))
    state_now = F.when(F.size("servers") > 0, "online").otherwise("offline")
    return rows.select("player", "play_time", "rank", shown(), state_now.alias("presence"))


@query("page_counts", with_cte("events", """
SELECT map, count(*) AS rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages
FROM (SELECT DISTINCT map, player FROM eseen) GROUP BY map"""))
def page_counts(t: Tables):
    seen = prepare.observe(t.event_headers, t.event_clients).select("map", "player").distinct()
    return boards.last_page_per_scope(seen, "map")


@query("current_members", with_cte("events", f"""
, worn AS (
  SELECT player, clan FROM (SELECT *, row_number() OVER (
    PARTITION BY player ORDER BY ts DESC, clan DESC) AS nth FROM eseen WHERE clan IS NOT NULL)
  WHERE nth = 1)
SELECT clan, player, play_time
FROM ({total_sql(['clan', 'player'])}) JOIN worn USING (clan, player)"""))
def current_members(t: Tables):
    seen = prepare.observe(t.event_headers, t.event_clients)
    return boards.current_members(total(t, "clan_player"), state.seen_players(seen))


@query("masters", """
SELECT n_name AS address, CAST(n_nationkey + 8283 AS BIGINT) AS port, count(c_custkey) AS servers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 9000
GROUP BY 1, 2""")
def masters(t: Tables):
    master = t.read("nation").select(
        F.col("n_nationkey").alias("master"), F.col("n_name").alias("address"),
        (F.col("n_nationkey") + 8283).alias("port"),
    )
    return boards.masters(master, mastered(t)).drop("master")


def mastered(t: Tables):
    owner = F.when(F.col("c_acctbal") >= 9000, F.col("c_nationkey"))
    return t.read("customer").select(F.col("c_custkey").alias("server"), owner.alias("master"))


@query("masterless", """
SELECT count(*) AS servers FROM customer WHERE NOT c_acctbal >= 9000""")
def masterless(t: Tables):
    return boards.without_master(mastered(t))


@query("search_players", with_cte("orders", f""", {RUNS},
spots AS (
  SELECT l_partkey AS part, string_agg(DISTINCT spot, ',' ORDER BY spot) AS servers FROM (
    SELECT l_partkey, c_name || ':' || CAST(c_nationkey + 8300 AS VARCHAR) AS spot
    FROM live JOIN oc USING (snapshot_id) JOIN customer ON c_custkey = live.server)
  GROUP BY l_partkey)
""" + page_sql(
    "SELECT p_partkey AS player, p_name AS name, CAST(floor(p_retailprice) AS BIGINT) AS play_time, "
    "coalesce(servers, '') AS servers FROM part LEFT JOIN spots ON part = p_partkey "
    "WHERE p_name ILIKE '%RING%'",
    "length(name), play_time DESC, player", "player, name, play_time, servers", 1, 30)))
def search_players(t: Tables):
    players = t.read("part").select(
        F.col("p_partkey").alias("player"), F.col("p_name").alias("name"),
        F.floor("p_retailprice").alias("play_time"),
    )
    clients = t.order_clients.select("snapshot_id", F.col("ordinal.l_partkey").alias("player"))
    on = state.live_clients(live_states(t, counted=False), clients)
    hits = search.search_players(players, on, customer_servers(t), "RING")
    return hits.select("player", "name", "play_time", "rank", shown())


@query("search_teams", page_sql(
    "SELECT n_nationkey AS clan, n_name AS name, count(c_custkey) AS play_time "
    "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey "
    "WHERE n_name ILIKE '%nation\\_1%' ESCAPE '\\' GROUP BY 1, 2",
    "length(name), play_time DESC, clan", "CAST(clan AS BIGINT) AS clan, name, play_time", 1, 30))
def search_teams(t: Tables):
    members = t.read("customer").groupBy(F.col("c_nationkey").alias("clan")).agg(
        F.count("*").alias("_n"))
    clans = (
        t.read("nation").select(F.col("n_nationkey").alias("clan"), F.col("n_name").alias("name"))
        .join(members, "clan", "left")
        .select("clan", "name", F.coalesce("_n", F.lit(0)).alias("play_time"))
    )
    return search.search_clans(clans, "nation_1")


@query("search_servers", with_cte("orders", f""", {RUNS} """ + page_sql(
    "SELECT server, c_name AS name, c_name AS ip, c_nationkey + 8300 AS port, num_clients, "
    "map, game_type FROM live JOIN customer ON c_custkey = server WHERE c_name ILIKE '%#00000010%'",
    "length(name), num_clients DESC, server",
    "server, name, ip, CAST(port AS BIGINT) AS port, num_clients, map, game_type", 1, 30)))
def search_servers(t: Tables):
    names = t.read("customer").select(
        F.col("c_custkey").alias("server"), F.col("c_name").alias("name"))
    live = live_states(t).select("server", "num_clients", "map").join(names, "server")
    maps = t.order_headers.select("map", "game_type").distinct().withColumn(
        "map_name", F.col("map"))
    hits = search.search_servers(live, customer_servers(t), maps, "#00000010")
    return hits.drop("max_clients", "map_name")
