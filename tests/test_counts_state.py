import random
from datetime import datetime

from pyspark.sql import functions as F

from rollcall.operators import counts, prepare, state
from rollcall.sources.game_types import default_rank_methods
from rollcall.sources.tables import sample_players
from tests.conftest import at, rows


def test_clan_counts_change_set(spark):
    clans = spark.createDataFrame([("clan1", 1), ("clan3", 2)], "clan string, active_player_count long")
    players = spark.createDataFrame(
        [("a", "clan2"), ("b", None), ("c", "clan3"), ("d", "clan3")], "player string, clan string")
    got = rows(counts.active_clan_changes(clans, players), "clan", "active_player_count")
    assert got == [("clan1", 0), ("clan2", 1)]


def test_entity_counts_and_cursor(spark):
    some, none = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "id long")
    assert rows(counts.entity_counts(players=some, clans=none)) == [("clans", 0, None), ("players", 1, 1)]
    assert rows(counts.entity_counts(players=spark.range(3))) == [("players", 3, 2)]


def test_counting_in_batches_reaches_everything(spark):
    ids = spark.range(1, 26)
    total = cursor = 0
    while True:
        added, cursor = counts.count_since(ids, cursor, 10).first()
        if not added:
            break
        total += added
    assert (total, cursor) == (25, 25)


def test_counts_are_zero_without_rows_and_changes_are_null_safe(spark):
    maps = spark.createDataFrame([(1,), (2,)], "map int")
    info = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "map int, player string")
    none = spark.createDataFrame([], "map int")
    fresh = counts.map_counts(maps, info, none, none)
    assert rows(fresh) == [(1, 2, 0, 0), (2, 0, 0, 0)]
    stored = spark.createDataFrame(
        [(1, 2, 0, 0), (2, None, 0, 0)], "map int, player_count long, clan_count long, server_count long")
    got = counts.changes(stored, fresh, "map", ["player_count", "clan_count", "server_count"])
    assert rows(got) == [(2, 0, 0, 0)]


def test_player_upsert_rules(spark):
    stored = spark.createDataFrame(
        [("keeps", at(0), "old"), ("soon", at(0), "old"), ("moves", at(0), "old"), ("gone", at(0), None)],
        "player string, last_seen timestamp, clan string")
    seen = spark.createDataFrame(
        [("keeps", at(30), None), ("soon", at(10), None), ("moves", at(1), "new"), ("fresh", at(1), None)],
        "player string, last_seen timestamp, clan string")
    got = rows(state.upsert_players(stored, seen), "player", "last_seen", "clan", "written")
    assert got == [
        ("fresh", at(1), None, True), ("gone", at(0), None, False), ("keeps", at(30), "old", True),
        ("moves", at(1), "new", True), ("soon", at(0), "old", False)]


def test_last_clan_is_kept_over_blank(spark):
    seen = spark.createDataFrame(
        [("a", at(0), "x"), ("a", at(5), ""), ("b", at(0), None)], "player string, ts timestamp, clan string")
    assert rows(state.seen_players(seen), "player", "last_seen", "clan") == [("a", at(5), "x"), ("b", at(0), None)]


def test_poll_gives_clans_and_players(clients):
    c = clients((1, 0, "name1", "clan1", 0, True), (1, 1, "name2", "clan2", 0, True), (1, 2, "name3", "", 0, True))
    assert rows(prepare.clan_names(c)) == [("clan1",), ("clan2",)]
    assert rows(c.select(prepare.blank_to_null("clan"))) == [("clan1",), ("clan2",), (None,)]


def test_failures_since_last_success(spark):
    polls = spark.createDataFrame([
        (1, at(0), False), (1, at(5), True), (1, at(10), False), (1, at(5, 3), False),
        (2, at(0), True), (3, at(0), False), (3, at(1), False)],
        "server int, ts timestamp, ok boolean")
    got = rows(state.failure_runs(polls), "server", "failure_count", "online", "last_seen")
    assert got == [(1, 2, False, at(5)), (2, 0, True, at(0)), (3, 2, False, None)]
    states = spark.createDataFrame([(1,), (2,), (3,)], "server int")
    assert rows(state.online_states(states, state.failure_runs(polls))) == [(2,)]


def test_latest_state_and_its_clients(headers, clients):
    h = headers((1, at(0), 1, 7, "CTF", 1), (3, at(5), 1, 8, "CTF", 2), (2, at(5), 1, 9, "CTF", 3))
    latest = state.latest_state(h)
    assert rows(latest, "server", "snapshot_id", "map") == [(1, 3, 8)]
    c = clients((1, 0, "old", None, 0, True), (3, 0, "new", None, 0, True))
    assert rows(state.live_clients(latest, c), "player") == [("new",)]


def test_new_ids_are_dense_and_stable(spark):
    dim = spark.createDataFrame([(5, "a"), (9, "b")], "id int, name string")
    names = spark.createDataFrame([("b",), ("c",), ("c",), ("d",), ("e",)], "name string")
    first, again = state.new_ids(dim, names, ["name"]), state.new_ids(dim, names, ["name"])
    assert sorted(r.id for r in first.collect()) == [10, 11, 12]
    assert rows(first) == rows(again)
    empty = state.new_ids(dim.limit(0), names, ["name"])
    assert sorted(r.id for r in empty.collect()) == [1, 2, 3, 4]


def test_master_list_replaces_the_set(spark):
    servers = spark.createDataFrame(
        [("a", 1, 3), ("b", 1, 3), ("c", 1, 4), ("d", 1, None)], "ip string, port int, master int")
    listed = spark.createDataFrame([("a", 1), ("d", 1), ("e", 1), ("e", 1)], "ip string, port int")
    got = rows(state.reassign_master(servers, listed, 3), "ip", "master")
    assert got == [("a", 3), ("b", None), ("c", 4), ("d", 3), ("e", 3)]


def test_cascade_and_updates(spark):
    children = spark.createDataFrame([(1, "x"), (2, "y")], "snapshot_id long, v string")
    parents = spark.createDataFrame([(1,)], "snapshot_id long")
    assert rows(state.without_orphans(children, parents, "snapshot_id"), "v") == [("x",)]
    assert rows(state.orphans(children, parents, "snapshot_id"), "v") == [("y",)]
    delta = spark.createDataFrame([(2, "z")], "snapshot_id long, v string")
    assert rows(state.apply_changes(children, delta, ["snapshot_id"], ["v"])) == [(1, "x"), (2, "z")]


def test_insert_if_absent(spark):
    dim = spark.createDataFrame([("a", 1)], "name string, id int")
    got = state.insert_absent(dim, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), ["name"])
    assert rows(got) == [("a", 1), ("b", None)]


def test_default_rank_methods(spark):
    methods = default_rank_methods(spark)
    assert {r[0]: r[1] for r in methods.groupBy("rank_method").count().collect()} == {"ELO": 15, "TIME": 9}
    known = spark.createDataFrame([("DM", "TIME"), ("mine", None)], "game_type string, rank_method string")
    got = dict(state.set_rank_methods(known, methods).collect())
    assert got["DM"] == "ELO" and got["mine"] is None and got["Race"] == "TIME"


def test_sample_players_skip_existing(spark):
    there = sample_players(spark, 3).select("player")
    assert sample_players(spark, 10, there).count() == 7


def test_richest_source_survives_and_ties_keep_the_first(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 1, "x"), (1, "a", 2, 2, "y"), (1, "a", 2, 3, "z"), (1, "b", 0, 2, "w")],
        "poll int, player string, source int, arrival int, clan string")
    got = prepare.survivors(df, ["poll", "player"], "source", "arrival")
    assert rows(got) == [(1, "a", 2, 2, "y"), (1, "b", 0, 2, "w")]


def test_flatten_keeps_empty_snapshots_and_regroup_restores(spark):
    nested = spark.createDataFrame(
        [(1, at(0), [("a", "x", 1), ("b", None, 2)]), (2, at(5), [])],
        "snapshot_id long, ts timestamp, clients array<struct<player:string,clan:string,score:int>>")
    flat = prepare.flatten(nested)
    assert rows(flat, "snapshot_id", "ordinal", "player", "clan") == [
        (1, 0, "a", "x"), (1, 1, "b", None), (2, None, None, None)]
    back = prepare.regroup(flat, ["player", "clan", "score"])
    assert rows(back.select("snapshot_id", "ts", "clients")) == rows(nested)


def test_regroup_sorts_without_a_lambda(spark):
    """The default comparator of ``array_sort`` is one, run for every pair that a sort compares."""
    flat = spark.createDataFrame([(1, n % 3, f"p{n}", "", n) for n in (4, 2, 0, 5)], "snapshot_id long, ordinal int, player string, clan string, score int")
    back = prepare.regroup(flat, ["player", "clan", "score"])
    assert "array_sort" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert [c.player for c in back.first().clients] == ["p0", "p4", "p2", "p5"]


def test_half_open_range(headers):
    h = headers((1, at(0), 1, 7, "CTF", 0), (2, at(0, 2), 1, 7, "CTF", 0))
    assert rows(prepare.in_range(h, datetime(2024, 1, 1), datetime(2024, 1, 2)), "snapshot_id") == [(1,)]


def test_ids_above_a_cursor(spark):
    assert counts.count_since(spark.range(5), 2).first() == (2, 4)
    assert counts.count_since(spark.range(5).where(F.col("id") > 9), 2).first() == (0, 2)


def test_counts_moved_by_new_keys_equal_a_recount(spark):
    """Three deltas; later ones read the stored counts and the known keys, not the rows."""
    rnd = random.Random(3)
    data = [(rnd.choice(["m1", "m2", None]), rnd.choice([None, *"abcdefg"]), rnd.choice([None, "x", "y"])) for _ in range(60)]
    df = [spark.createDataFrame(data[i:i + 20], "map string, player string, clan string") for i in (0, 20, 40)]
    maps = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "map string")
    pairs = {"player_count": ["map", "player"], "clan_count": ["map", "clan"]}
    known = {c: df[0].select(*keys).limit(0) for c, keys in pairs.items()}
    stored = counts.with_counts(maps.limit(0), "map", **{c: known[c] for c in pairs})
    for n in range(3):
        fresh = {c: counts.first_seen(known[c], df[n], keys) for c, keys in pairs.items()}
        stored = counts.moved_counts(stored, maps, "map", **fresh)
        known = {c: known[c].unionByName(fresh[c]) for c in pairs}
        seen = data[:20 * n + 20]
        want = [(m, len({p for a, p, _ in seen if a == m and p}), len({c for a, _, c in seen if a == m and c})) for m in ("m1", "m2", "m3")]
        assert rows(stored, "map", "player_count", "clan_count") == want
