from pyspark.sql import functions as F

from rollcall.operators import boards, search
from tests.conftest import rows


def test_page_numbers():
    assert [boards.page_number(p) for p in (None, "x", "0", "-3", "2", 5)] == [1, 1, 1, 1, 2, 5]


def players(spark, n=250):
    return spark.range(n).select(
        F.format_string("p%03d", "id").alias("player"), (F.col("id") % 10).alias("play_time"))


def test_pages_tile_the_list(spark):
    df, order = players(spark), boards.by_play_time("player")
    pages = [boards.page(df, order, n).orderBy("rank").collect() for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [100, 100, 50, 0]
    assert [r["rank"] for p in pages for r in p] == list(range(1, 251))
    want = sorted(df.collect(), key=lambda r: (-r.play_time, r.player))
    assert [r.player for p in pages for r in p] == [r.player for r in want]
    plan = boards.page(df, order, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scope_pages_keep_best_rows_before_the_shuffle(spark):
    df = players(spark).withColumn("scope", F.when(F.col("player") < "p240", "big").otherwise("small"))
    got = boards.page_per_scope(df, "scope", boards.by_play_time("player"), 2)
    assert rows(got.groupBy("scope").agg(F.min("rank"), F.max("rank"), F.count("*"))) == [("big", 101, 200, 100)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert rows(boards.last_page_per_scope(df, "scope")) == [("big", 240, 3), ("small", 10, 1)]


def test_unrated_players_come_last(spark):
    df = spark.createDataFrame([("a", None, 9), ("b", 0.0, 1), ("c", -5.0, 2), ("d", 0.0, 4)],
                               "player string, rating double, play_time int")
    got = boards.page(df, boards.by_rating("player")).orderBy("rank").collect()
    assert [r.player for r in got] == ["d", "b", "c", "a"]


def test_servers_without_state_lead_among_equals(spark):
    df = spark.createDataFrame(
        [(1, 0, 16, 4, 10), (2, 0, None, None, 1), (3, 1, 64, 60, 99), (4, 0, 16, 5, 1)],
        "server int, failure_count int, max_clients int, num_clients int, play_time int")
    got = boards.page(df, boards.server_order()).orderBy("rank").collect()
    assert [r.server for r in got] == [2, 4, 1, 3]


def live(spark):
    on = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 9)], "player string, server int")
    states = spark.createDataFrame([(1, "alpha_1", 3), (2, "beta", 1)], "server int, name string, num_clients int")
    servers = spark.createDataFrame([(1, "1.1.1.1", 1), (2, "2.2.2.2", 2), (9, "9.9.9.9", 9)],
                                    "server int, ip string, port int")
    return on, states, servers


def test_online_servers_are_distinct_and_live(spark):
    on, states, servers = live(spark)
    on = on.join(states.select("server"), "server", "left_semi")
    got = boards.online_on(spark.createDataFrame([("a",), ("b",), ("c",)], "player string"), on, servers)
    assert {r.player: [(s.ip, s.port) for s in r.servers] for r in got.collect()} == {
        "a": [("1.1.1.1", 1), ("2.2.2.2", 2)], "b": [], "c": []}


def names(spark, *values):
    return spark.createDataFrame([(v, v, 1) for v in values], "player string, name string, play_time int")


def test_wildcards_are_plain_text(spark):
    df = names(spark, "a_b", "aXb", "100%", "100x", "A_B c")
    assert rows(search.search(df, "a_b", "name", "play_time", "player"), "name") == [("A_B c",), ("a_b",)]
    assert rows(search.search(df, "0%", "name", "play_time", "player"), "name") == [("100%",)]


def test_backslash_is_the_escape_character(spark):
    df = names(spark, "ab", "a\\b", "a%", "a\\x", "a")
    find = lambda text: rows(search.search(df, text, "name", "play_time", "player"), "name")
    assert find("a\\b") == [("ab",)]  # an escaped plain character is itself
    assert find("a\\\\") == [("a\\b",), ("a\\x",)]  # two backslashes are one
    assert find("a\\") == [("a%",)]  # at the end it escapes the closing wildcard
    assert find("a\\_") == [("a\\b",), ("a\\x",)]  # then the underscore is a wildcard again


def test_short_queries_find_nothing(spark):
    assert search.search(names(spark, "a"), "a", "name", "play_time", "player").count() == 0


def test_shortest_names_first_and_thirty_at_most(spark):
    df = names(spark, *["x" * n + "ab" for n in range(40)])
    got = search.search(df, "AB", "name", "play_time", "player").orderBy("rank").collect()
    assert [len(r.name) for r in got] == list(range(2, 32))


def test_search_joins(spark):
    on, states, servers = live(spark)
    hits = search.search_players(names(spark, "a", "aa", "baa"), on.replace("a", "aa"), servers, "aa")
    assert {r.name: len(r.servers) for r in hits.collect()} == {"aa": 2, "baa": 0}
    maps = spark.createDataFrame([(5, "ctf5", "CTF")], "map int, map_name string, game_type string")
    hits = search.search_servers(states.withColumn("map", F.lit(5)), servers, maps, "ALPHA_")
    assert rows(hits, "name", "ip", "map_name") == [("alpha_1", "1.1.1.1", "ctf5")]


def test_masters_include_empty_ones(spark):
    masters = spark.createDataFrame([(1, "m1", 1), (2, "m2", 2)], "master int, address string, port int")
    servers = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "server int, master int")
    assert rows(boards.masters(masters, servers), "address", "servers") == [("m1", 2), ("m2", 0)]
    assert boards.without_master(servers).first().servers == 1
