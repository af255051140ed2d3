import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import rating
from tests.conftest import at, rows


def pair(headers, clients, minutes=5, second_map=7, before=(100, 100), after=(99, 101), in_game=(True, True)):
    h = headers((1, at(0), 1, 7, "CTF", 2), (2, at(minutes), 1, second_map, "CTF", 2))
    c = clients(
        (1, 0, "a", None, before[0], True), (1, 1, "b", None, before[1], True),
        (2, 0, "a", None, after[0], in_game[0]), (2, 1, "b", None, after[1], in_game[1]))
    return h, c


def changes(spark, h, c, scope):
    matches = rating.ranked_matches(rating.score_deltas(h, c))
    return rating.elo_round(matches, rating.no_ratings(matches, scope), scope)


@pytest.mark.parametrize("scope", ["map", "game_type"])
def test_two_players(spark, headers, clients, scope):
    h, c = pair(headers, clients)
    assert rows(changes(spark, h, c, scope), "player", "elo_delta") == [("a", -12.5), ("b", 12.5)]


@pytest.mark.parametrize("case", [
    dict(second_map=8), dict(minutes=60), dict(minutes=31), dict(in_game=(True, False)),
    dict(after=(98, 99)),  # mean -1.5: a new game
])
def test_not_a_match(spark, headers, clients, case):
    h, c = pair(headers, clients, **case)
    assert rows(changes(spark, h, c, "map")) == []


@pytest.mark.parametrize("case", [dict(minutes=30 + 59 / 60), dict(after=(99, 99)), dict(after=(98, 100))])
def test_still_a_match(spark, headers, clients, case):
    h, c = pair(headers, clients, **case)
    assert len(rows(changes(spark, h, c, "map"))) == 2


def test_no_previous_snapshot(spark, headers, clients):
    h, c = pair(headers, clients)
    assert rows(changes(spark, h.where("snapshot_id = 2"), c, "map")) == []


def brute(players):
    """players: {name: (rating, score_delta)} -> elo change."""
    out = {}
    for a, (ra, sa) in players.items():
        total = 0.0
        for b, (rb, sb) in players.items():
            if a != b:
                w = 1.0 if sa > sb else 0.5 if sa == sb else 0.0
                d = max(-400.0, min(400.0, ra - rb))
                total += 25 * (w - 1 / (1 + 10 ** (-d / 400)))
        out[a] = total / (len(players) - 1)
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_give_the_pairwise_result(spark, block):
    rng = random.Random(5)
    small = {f"p{i}": (rng.choice([0.0, 50.0, 900.0, -300.0]), rng.randint(-2, 4)) for i in range(40)}
    other = {f"q{i}": (rng.uniform(-500, 500), rng.randint(-2, 4)) for i in range(7)}
    data = [(m, n, "g", s, len(p), r) for m, p in ((1, small), (2, other)) for n, (r, s) in p.items()]
    df = spark.createDataFrame(
        data, "snapshot_id long, player string, game_type string, score_delta int, players long, rating double")
    matches, ratings = df.drop("rating"), df.select("game_type", "player", "rating")
    got = {r.player: r.elo_delta for r in
           rating.elo_round(matches, ratings, "game_type", block).collect()}
    want = {**brute(small), **brute(other)}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_plan_has_no_pair_rows(spark, headers, clients):
    h, c = pair(headers, clients)
    plan = changes(spark, h, c, "map")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def history(spark):
    """A few dozen matches on two servers and one map."""
    rng = random.Random(3)
    data, ids = [], 0
    for tick in range(12):
        seats = rng.sample([f"p{i}" for i in range(8)], 8)
        for server in range(2):
            ids += 1
            group = seats[server * 4:server * 4 + rng.randint(2, 4)]
            data += [(ids, at(5 * tick), server, 7, "CTF", p, rng.randint(0, 5), len(group)) for p in group]
    return data, spark.createDataFrame(
        data, "snapshot_id long, ts timestamp, server int, map int, game_type string, player string, "
              "score_delta int, players long")


def sequential(data):
    ratings = {}
    for match in sorted({(d[1], d[0]) for d in data}):
        now = [d for d in data if (d[1], d[0]) == match]
        for p, delta in brute({d[5]: (ratings.get(d[5], 0.0), d[6]) for d in now}).items():
            ratings[p] = ratings.get(p, 0.0) + delta
    return ratings


def test_rounds_of_one_tick_equal_the_sequential_result(spark):
    data, df = history(spark)
    got = {r.player: r.rating for r in rating.elo_rounds(df, "map", F.col("ts")).collect()}
    want = sequential(data)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_replay_is_exact_even_inside_a_tick(spark):
    data, df = history(spark)
    # Same players twice within one instant: order falls back to the id.
    data = data + [(100 + i, d[1], d[2], d[3], d[4], d[5], 5 - d[6], d[7]) for i in (0,) for d in data if d[0] == 3]
    df = spark.createDataFrame(data, df.schema)
    got = {r.player: r.rating for r in rating.elo_replay(df, "map", F.date_trunc("hour", "ts")).collect()}
    want = sequential(data)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_best_time(headers, clients):
    h = headers((1, at(0), 1, 7, "Race", 2), (2, at(5), 1, 7, "Race", 2))
    c = clients((1, 0, "a", None, 10, True), (1, 1, "b", None, -10, True), (2, 0, "a", None, 12, True))
    assert rows(rating.best_times(h, c)) == [(7, "a", -10.0), (7, "b", -10.0)]


def test_invalid_times(headers, clients):
    h = headers((1, at(0), 1, 7, "Race", 2))
    c = clients((1, 0, "a", None, 9999, True), (1, 1, "b", None, -9999, True),
                (1, 2, "(connecting)", None, 5, True), (1, 3, "d", None, 5, False))
    assert rows(rating.best_times(h, c)) == []


def test_stored_time_is_only_improved(spark, headers, clients):
    h, c = headers((1, at(0), 1, 7, "Race", 1)), clients((1, 0, "a", None, 10, True), (1, 1, "b", None, 10, True))
    stored = spark.createDataFrame([(7, "a", -5.0), (7, "b", None)], "map int, player string, rating double")
    assert rows(rating.best_times(h, c, stored)) == [(7, "a", -5.0), (7, "b", -10.0)]


def test_missing_info_rows(spark, headers, clients):
    h, c = pair(headers, clients)
    extra = clients((2, 2, "joiner", None, 0, True), (2, 3, "viewer", None, 0, False))
    c = c.unionByName(extra)
    info = spark.createDataFrame([(7, "a", None)], "map int, player string, rating double")
    matches = rating.ranked_matches(rating.score_deltas(h, c))
    got = rows(rating.missing_info(matches, h, c, info, "map", "ELO"), "player", "rating")
    assert got == [("b", 0.0), ("joiner", 0.0), ("viewer", 0.0)]
    got = rows(rating.missing_info(matches, h, c, info, "map", "TIME"), "player", "rating")
    assert got == [("b", None), ("joiner", None), ("viewer", None)]


def test_rating_updates(spark):
    info = spark.createDataFrame([(7, "a", None), (7, "b", 3.0)], "map int, player string, rating double")
    new = spark.createDataFrame([(7, "a", -4.0)], "map int, player string, rating double")
    assert rows(rating.set_ratings(info, new, ["map", "player"])) == [(7, "a", -4.0), (7, "b", 3.0)]
    moved = spark.createDataFrame([(7, "a", 2.0), (7, "c", 1.0)], "map int, player string, elo_delta double")
    assert rows(rating.add_ratings(info, moved, "map")) == [(7, "a", 2.0), (7, "b", 3.0), (7, "c", 1.0)]


def test_null_ratings_stay_until_a_change(spark):
    stored = spark.createDataFrame(
        [(7, "idle", None), (7, "tied", None), (7, "low", -3.0), (7, "up", None)], "map int, player string, rating double")
    moved = spark.createDataFrame(
        [(7, "tied", 0.0), (7, "up", 1.5), (7, "new", 0.0), (7, "low", 0.0)], "map int, player string, elo_delta double")
    assert rows(rating.add_ratings(stored, moved, "map"), "player", "rating") == [
        ("idle", None), ("low", -3.0), ("new", 0.0), ("tied", None), ("up", 1.5)]


def history_of(spark, seed, places=3, matches=30, crowd=12):
    rnd = random.Random(seed)
    out = []
    for i in range(matches):
        place, n, ts = rnd.randrange(places), rnd.randint(2, 5), at(rnd.randrange(9))
        who = rnd.sample(range(crowd), n)
        out += [(f"m{i:03d}", ts, place, f"p{w}", rnd.randint(-2, 6), n, 0.0) for w in who]
    return spark.createDataFrame(out, "snapshot_id string, ts timestamp, map int, player string, score_delta int, players long, mean_delta double")


def plain_replay(df, start):
    now, matches = dict(start), {}
    for r in df.collect():
        matches.setdefault((r.ts, r.snapshot_id), []).append(r)
    for _, field in sorted(matches.items()):
        old = {r.player: now.get((r.map, r.player)) or 0.0 for r in field}
        for r in field:
            moved = 0.0
            for o in field:
                if o.player != r.player:
                    result = 0.5 + 0.5 * ((r.score_delta > o.score_delta) - (r.score_delta < o.score_delta))
                    gap = max(-400.0, min(400.0, old[r.player] - old[o.player]))
                    moved += result - 1 / (1 + 10 ** (-gap / 400))
            now[r.map, r.player] = old[r.player] + 25 * moved / (len(field) - 1)
    return {k: None if v is None else round(v, 9) + 0.0 for k, v in now.items()}


@pytest.mark.parametrize("rows_at_once,crowd", [(10_000, 12), (20, 40), (0, 12), (12, 60)])
def test_replay_is_exact_whatever_way_a_match_goes(spark, rows_at_once, crowd):
    """Places in one task, places cut into connected groups, and groups in waves."""
    df = history_of(spark, rows_at_once, crowd=crowd)
    start = {(0, "p1"): 300.0, (1, "p2"): None, (2, "zz"): None, (2, "p3"): -50.0}
    ratings = spark.createDataFrame([(*k, v) for k, v in start.items()], "map int, player string, rating double")
    got = rating.elo_replay(df, "map", F.expr("minute(ts) div 5"), ratings, rows_at_once)
    assert {(r.map, r.player): None if r.rating is None else round(r.rating, 9) + 0.0 for r in got.collect()} == plain_replay(df, start)


def test_connected_matches_share_a_group(spark):
    sides = [("a", 1, "p"), ("b", 1, "p"), ("b", 1, "q"), ("c", 1, "q"), ("d", 2, "p"), ("e", 1, "r"), *[(f"x{i:02d}", 3, f"s{i + k}") for i in range(20) for k in (0, 1)]]
    got = dict(map(tuple, rating.conflict_groups(spark.createDataFrame(sides, "snapshot_id string, map int, player string"), "map").collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", **{f"x{i:02d}": "x00" for i in range(20)}}


def test_a_large_field_by_sorting():
    rnd = np.random.default_rng(1)
    r, s = np.where(rnd.random(700) < 0.8, 0.0, rnd.normal(0, 300, 700)), rnd.integers(-3, 9, 700)
    wins, expected = rating.whole_field(r, s)
    result = 0.5 + 0.5 * np.sign(s[:, None] - s[None])
    chance = 1 / (1 + 10 ** (-np.clip(r[:, None] - r[None], -400, 400) / 400))
    assert np.allclose(wins, result.sum(axis=1) - 0.5) and np.allclose(expected, chance.sum(axis=1) - 0.5)
    wins, _ = rating.whole_field(np.zeros(50_000), np.arange(50_000.0))
    assert (wins == np.arange(50_000)).all()


def field(spark, data):
    return spark.createDataFrame(data, "snapshot_id long, map int, player string, rating double, score_delta int, players long")


@pytest.mark.parametrize("block", [3, 512])
def test_large_fields_equal_the_blocks(spark, block):
    rnd = random.Random(block)
    data = [(m, 1, f"p{i}", rnd.choice([0.0, 0.0, 900.0, -5.0, rnd.random() * 300]), rnd.randint(-2, 3), n) for m, n in enumerate([2, 3, 40, 75]) for i in range(n)]
    df = field(spark, data)
    norm = lambda d: sorted((r.snapshot_id, r.player, r.wins, round(r.expected, 9)) for r in d.collect())
    want = norm(rating.field_results(df))
    assert norm(rating.large_field_results(df, block)) == want and len(want) == 120
    ratings = df.select("map", F.concat("snapshot_id", F.lit("/"), "player").alias("player"), "rating")
    matches = df.withColumn("player", F.concat("snapshot_id", F.lit("/"), "player")).drop("rating")
    norm = lambda d: sorted((r.player, round(r.elo_delta, 9)) for r in d.collect())
    assert norm(rating.elo_round(matches, ratings, "map", block, 39)) == norm(rating.elo_round(matches, ratings, "map"))


def test_a_match_of_fifty_thousand(spark):
    n = 50_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("snapshot_id"), F.lit(1).alias("map"), F.concat(F.lit("p"), "id").alias("player"),
        F.when(F.col("id") % 10 < 8, 0.0).otherwise((F.col("id") % 997).cast("double")).alias("rating"),
        (F.col("id") % 41 - 3).cast("int").alias("score_delta"), F.lit(n).cast("long").alias("players"))
    got = rating.large_field_results(df).toPandas().sort_values("player")
    pdf = df.toPandas().sort_values("player")
    wins, expected = rating.whole_field(pdf["rating"].to_numpy(), pdf["score_delta"].to_numpy())
    assert len(got) == n and (got["wins"].to_numpy() == wins).all() and np.allclose(got["expected"], expected)
    assert abs(got["wins"].sum() - n * (n - 1) / 2) < 1 and abs(got["expected"].sum() - n * (n - 1) / 2) < 1


@pytest.mark.parametrize("spread", [5, 300, 3000])
def test_chances_without_pairs(spark, spread):
    """Ratings near each other, around the span and far beyond it; those on the edges of cells."""
    rnd = np.random.default_rng(spread)
    r = np.round(np.concatenate([rnd.normal(0, spread, 600), 50.0 * rnd.integers(-20, 20, 100)]), 3)
    distinct, players = np.unique(r, return_counts=True)
    chance = 1 / (1 + 10 ** (-np.clip(distinct[:, None] - distinct[None], -400, 400) / 400))
    assert np.allclose(rating.summed_chances(distinct, players), chance @ players, rtol=1e-12)
    df = field(spark, [(1, 1, f"p{i}", float(x), 0, len(r)) for i, x in enumerate(r)])
    got = {x.rating: x.expected for x in rating.field_results(df).collect()}
    assert np.allclose([got[x] for x in distinct], chance @ players - 0.5, rtol=1e-12)


def test_a_match_costs_its_players_not_their_pairs(spark):
    """Distinct ratings: 400,000 players would be 160 billion pairs."""
    n = 400_000
    wins, expected = rating.whole_field(np.arange(n) / 1000, np.arange(n))
    _, odd = rating.whole_field(np.array([0.0, 0.0, np.inf, -np.inf]), np.arange(4))
    assert np.allclose(odd[:2], 0.5 + 1 / 11 + 10 / 11) and np.isnan(odd[2:]).all()
    assert (wins == np.arange(n)).all() and abs(expected.sum() - n * (n - 1) / 2) < 1
    data = [(1, 1, f"p{i}", i / 100, i, 1200) for i in range(1200)]
    plan = rating.field_results(field(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert "meet_blocks" in plan and "chances_from" in plan  # blocks for the small ones only
