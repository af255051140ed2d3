"""Ratings from consecutive snapshots: Elo by score change, and best time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.asof import previous_snapshot, whole_units
from rollcall.operators.prepare import first_occurrence, observe, valid_times
from rollcall.session import cut_lineage, folder_values, remove, shared_folder, stage_by
from rollcall.sources.rating_store import RatingStore, log_rows, settled

K_FACTOR = 25.0
RATING_SPAN = 400.0
MIN_MEAN_DELTA = -1.0
MAX_GAP_MINUTES = 30

# Opponents are compared block against block; a block stays around this size.
BLOCK_PLAYERS = 512
PAIRS_AT_ONCE = 1 << 18  # pairs held at a time, or one row's
# Ratings lie in cells. Chances between two cells are a polynomial of either rating, exact
# to the last digits of a double; eight cells are the span, where chances stop to change.
CELL = RATING_SPAN / 8
DEGREES = 14
REPLAY_ROWS = 200_000  # rows of connected matches that one task replays


def basis(ratings: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Chebyshev polynomials, a column each, of ratings within their cells."""
    place = np.clip(2 * (ratings / CELL - cells) - 1, -1.0, 1.0)
    return np.cos(np.arccos(place)[:, None] * np.arange(DEGREES))


def chance(gap: np.ndarray) -> np.ndarray:
    """Win chance of a player rated ``gap`` above another, without the span."""
    return 1.0 / (1.0 + 10.0 ** (-gap / RATING_SPAN))


# Chebyshev coefficients, in both ratings, of the chances between cells that are so far apart.
_NODES = np.cos((np.arange(DEGREES) + 0.5) * np.pi / DEGREES)
_FIT = np.cos(np.arccos(_NODES)[:, None] * np.arange(DEGREES)).T * np.where(np.arange(DEGREES) == 0, 1, 2)[:, None] / DEGREES
BETWEEN = {
    apart: _FIT @ chance(CELL * (apart + (_NODES[:, None] - _NODES[None]) / 2)) @ _FIT.T for apart in range(-8, 9)
}


def score_deltas(headers: DataFrame, clients: DataFrame, max_gap_minutes: int = MAX_GAP_MINUTES,
                 last_known: DataFrame | None = None,
                 earlier_clients: DataFrame | None = None, bucket: str = "day") -> DataFrame:
    """Score change of every player in game in both of two consecutive
    snapshots of one server on one map, at most ``max_gap_minutes`` whole
    minutes apart. ``earlier_clients`` holds the client rows of ``last_known``.
    """
    pairs = (
        previous_snapshot(headers, ("map",), bucket, last_known)
        .where(F.col("prev_map") == F.col("map"))
        .where(whole_units("prev_ts", "ts", 60) <= max_gap_minutes)
        .select("snapshot_id", "prev_snapshot_id", "ts", "server", "map", "game_type")
    )
    columns = ["snapshot_id", "player", "score", "in_game", "ordinal"]
    current = clients.select(*columns)
    before = current if earlier_clients is None else current.unionByName(
        earlier_clients.select(*columns)
    )
    # Both sides dedupe the same rows, so Spark shuffles and sorts them once.
    now = first_occurrence(current).where("in_game").drop("in_game", "ordinal")
    then = first_occurrence(before).where("in_game").select(
        F.col("snapshot_id").alias("prev_snapshot_id"), "player", F.col("score").alias("_before")
    )
    return observe(pairs, now).join(then, ["prev_snapshot_id", "player"]).select(
        "snapshot_id", "ts", "server", "map", "game_type", "player",
        (F.col("score") - F.col("_before")).alias("score_delta"),
    )


def match_stats(deltas: DataFrame) -> DataFrame:
    """Participants and mean score change per match."""
    return deltas.groupBy("snapshot_id").agg(
        F.count("*").alias("players"), F.avg("score_delta").alias("mean_delta")
    )


def ranked_matches(deltas: DataFrame) -> DataFrame:
    """Participants of matches that count: two players or more, and a mean
    change that does not look like a restarted game.

    ``deltas`` is read twice here and again by a round: pass it materialised
    (:func:`cut_lineage`), it is far smaller than the client rows behind it.
    """
    counted = match_stats(deltas).where(
        (F.col("players") >= 2) & (F.col("mean_delta") >= MIN_MEAN_DELTA)
    )
    return deltas.join(counted, "snapshot_id")


def with_ratings(matches: DataFrame, ratings: DataFrame, scope: str) -> DataFrame:
    """Stored rating of each participant; missing or null is zero."""
    return (
        matches.join(ratings.select(scope, "player", "rating"), [scope, "player"], "left")
        .withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    )


SUMS = T.StructType([
    T.StructField("wins", T.ArrayType(T.DoubleType())),
    T.StructField("expected", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(SUMS)
def meet_blocks(mine: pd.Series, my_delta: pd.Series, theirs: pd.Series,
                their_delta: pd.Series) -> pd.DataFrame:
    """Per row two blocks of players; summed results and win chances of each
    player of the first against the second. Rows are met many at a time: their
    players lie end to end, and every player is repeated once per opponent."""
    lengths, others = mine.map(len).to_numpy(), theirs.map(len).to_numpy()
    wins, expected = [], []
    met = np.cumsum(lengths * others) // PAIRS_AT_ONCE
    for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(met)) + 1):
        if not len(part):
            continue
        n, m = lengths[part], others[part]
        r, s = np.concatenate(mine.iloc[part].to_list()), np.concatenate(my_delta.iloc[part].to_list())
        other_r = np.concatenate(theirs.iloc[part].to_list())
        other_s = np.concatenate(their_delta.iloc[part].to_list())
        times, first = np.repeat(m, n), np.repeat(np.cumsum(m) - m, n)
        start = np.cumsum(times) - times
        a = np.repeat(np.arange(len(r)), times)
        b = np.arange(len(a)) + np.repeat(first - start, times)
        gap = np.clip(r[a] - other_r[b], -RATING_SPAN, RATING_SPAN)
        cuts = np.cumsum(n)[:-1]
        wins += np.split(np.add.reduceat(np.sign(s[a] - other_s[b]) * 0.5 + 0.5, start), cuts)
        expected += np.split(np.add.reduceat(1.0 / (1.0 + 10.0 ** (-gap / RATING_SPAN)), start), cuts)
    return pd.DataFrame({"wins": wins, "expected": expected})


def field_results(rated: DataFrame, block_players: int = BLOCK_PLAYERS, large_players: int | None = None) -> DataFrame:
    """Each participant against everyone else in the match, without pair rows.

    Adds ``wins`` (ties count half) and ``expected`` (summed win chances). Matches of
    more than ``large_players`` players, by default those of more than one block, go by
    :func:`large_field_results`, all others by :func:`block_results`.
    """
    large = F.col("players") > (block_players if large_players is None else large_players)
    rated = cut_lineage(rated)  # read several times
    if rated.where(large).isEmpty():
        return block_results(rated, block_players)
    return block_results(rated.where(~large), block_players).unionByName(large_field_results(rated.where(large), block_players))


def block_results(rated: DataFrame, block_players: int = BLOCK_PLAYERS) -> DataFrame:
    """:func:`field_results` by comparing players.

    Players are spread over blocks by hash, and every block meets every block
    of its match inside one row, so neither a row nor a key grows with the size
    of a match; a match of ordinary size is one block.
    """
    others = [c for c in rated.columns if c != "snapshot_id"]
    blocks_needed = F.ceil(F.col("players") / F.lit(block_players))
    blocks = (
        rated.withColumn("block", F.pmod(F.xxhash64("player"), blocks_needed))
        .groupBy("snapshot_id", "block")
        .agg(F.max(blocks_needed).alias("blocks"), F.collect_list(F.struct(*others)).alias("mine"))
    )
    every_block = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    mine = blocks.select("snapshot_id", "mine", F.explode(every_block).alias("block"))
    theirs = blocks.select(
        "snapshot_id", "block",
        F.col("mine.rating").alias("their_rating"), F.col("mine.score_delta").alias("their_delta"),
    )
    met = mine.join(theirs, ["snapshot_id", "block"]).withColumn(
        "_m", meet_blocks("mine.rating", "mine.score_delta", "their_rating", "their_delta"))
    sums = F.arrays_zip("mine", "_m.wins", "_m.expected")
    # Everybody also met themselves: half a win and half a chance.
    return (
        met.select("snapshot_id", F.inline(sums))
        .select("snapshot_id", "mine.*", "wins", "expected")
        .groupBy(*rated.columns)
        .agg((F.sum("wins") - 0.5).alias("wins"), (F.sum("expected") - 0.5).alias("expected"))
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def chances_between(mine: pd.Series, theirs: pd.Series, their_players: pd.Series) -> pd.Series:
    """Per row a block of ratings: the win chances of each against the ratings of
    another block, each counted for its players."""
    out = []
    for r, other, players in zip(mine, theirs, their_players):
        gap = np.clip(np.subtract.outer(r, other), -RATING_SPAN, RATING_SPAN)
        out.append((1.0 / (1.0 + 10.0 ** (-gap / RATING_SPAN))) @ players)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def chances_from(apart: pd.Series, sums: pd.Series) -> pd.Series:
    """Per row the sums of a cell's polynomials: the coefficients of the chances that
    ratings ``apart`` cells above have against it."""
    return pd.Series([BETWEEN[int(n)] @ s for n, s in zip(apart, sums)])


def large_field_results(rated: DataFrame, block_ratings: int = BLOCK_PLAYERS) -> DataFrame:
    """The columns of :func:`field_results`, without comparing players.

    Results follow from how many players of the match have a smaller or the same score
    change: a count per change and a running sum over the changes of the match. Chances
    follow from the distinct ratings and the players that have each: most players start
    at the same one. As in :func:`summed_chances`, sums of polynomials stand for the
    ratings of a cell. Only cells eight apart, between which some chances are beyond the
    span and some aren't, meet in blocks of ratings. So a match costs a sort, and no row
    or key grows with it.
    """
    match = "snapshot_id"
    below = Window.partitionBy(match).orderBy("score_delta").rowsBetween(Window.unboundedPreceding, -1)
    results = (
        rated.groupBy(match, "score_delta").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("wins", F.coalesce(F.sum("_n").over(below), F.lit(0)) + 0.5 * (F.col("_n") - 1)).drop("_n")
    )
    cell = F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col("rating") / CELL)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (F.col("rating") / CELL - F.col("cell")) - 1)))
    ratings = (
        rated.groupBy(match, "rating").agg(F.count(F.lit(1)).alias("_n"), F.max("players").alias("_players"))
        .withColumn("cell", cell).withColumn("_angle", angle)
    )
    waves = [F.cos(F.col("_angle") * i) for i in range(DEGREES)]
    cells = ratings.groupBy(match, "cell").agg(
        F.array(*[F.sum(F.col("_n") * w) for w in waves]).alias("sums"), F.sum("_n").alias("here"))
    ordered, (least, most) = Window.partitionBy(match).orderBy("cell"), chance(np.array([-RATING_SPAN, RATING_SPAN])).tolist()
    beyond = [
        F.coalesce(F.sum("here").over(ordered.rangeBetween(*r)), F.lit(0))
        for r in ((Window.unboundedPreceding, -9), (9, Window.unboundedFollowing))
    ]
    far = cells.select(match, "cell", (most * beyond[0] + least * beyond[1]).alias("_far"))
    near = (
        cells.withColumn("apart", F.explode(F.sequence(F.lit(-7), F.lit(7))))
        .select(match, (F.col("cell") + F.col("apart")).alias("cell"), chances_from("apart", "sums").alias("_c"))
        .groupBy(match, "cell").agg(*[F.sum(F.col("_c")[i]).alias(f"_c{i}") for i in range(DEGREES)])
    )
    expected = sum((F.col(f"_c{i}") * w for i, w in enumerate(waves)), F.col("_far"))
    within = ratings.join(far, [match, "cell"]).join(near, [match, "cell"]).select(match, "rating", expected.alias("expected"))

    edges = cells.select(match, "cell", F.explode(F.array(F.col("cell") - 8, F.col("cell") + 8)).alias("other"))
    edges = edges.join(cells.select(match, F.col("cell").alias("other")), [match, "other"])
    blocks = (
        ratings.join(edges.select(match, "cell").distinct(), [match, "cell"])
        .withColumn("block", F.pmod(F.xxhash64("rating"), F.ceil(F.col("_players") / F.lit(block_ratings))))
        .groupBy(match, "cell", "block").agg(F.collect_list("rating").alias("mine"), F.collect_list("_n").alias("n"))
    )
    theirs = blocks.select(match, F.col("cell").alias("other"), F.col("mine").alias("theirs"), F.col("n").alias("their_players"))
    across = (
        blocks.join(edges, [match, "cell"]).join(theirs, [match, "other"])
        .withColumn("expected", chances_between("mine", "theirs", "their_players"))
        .select(match, F.inline(F.arrays_zip(F.col("mine").alias("rating"), "expected")))
    )
    chances = (
        within.unionByName(across)
        .groupBy(match, "rating").agg((F.sum("expected") - 0.5).alias("expected"))  # less the one against oneself
    )
    return rated.join(results, [match, "score_delta"]).join(chances, [match, "rating"]).select(*rated.columns, "wins", "expected")


def elo_round(matches: DataFrame, ratings: DataFrame, scope: str,
              block_players: int = BLOCK_PLAYERS, large_players: int | None = None) -> DataFrame:
    """Rating change of every participant, all ratings read before the round.

    ``matches`` comes from :func:`ranked_matches`; the change is the mean over
    opponents of K * (result - win chance). Matches of more than ``large_players``
    players, by default more than a block, go by :func:`large_field_results`.
    """
    gain = K_FACTOR * (F.col("wins") - F.col("expected")) / (F.col("players") - 1)
    rated = with_ratings(matches, ratings, scope)
    return field_results(rated, block_players, large_players).withColumn("elo_delta", gain)


def no_ratings(matches: DataFrame, scope: str) -> DataFrame:
    return matches.select(scope, "player", F.lit(0.0).alias("rating")).limit(0)


def add_ratings(ratings: DataFrame, changes: DataFrame, scope: str) -> DataFrame:
    """Stored ratings plus changes. Only a change other than zero touches a stored
    row, and then reads a null rating as zero; other rows stay as they are, null
    ones too. New participants start from zero."""
    keys, none = [scope, "player"], F.lit(None).cast("double")
    return settled(
        log_rows(ratings, keys, F.col("rating"), none, True)
        .unionByName(log_rows(changes, keys, none, F.col("elo_delta"), False)), keys)


def elo_rounds(matches: DataFrame, scope: str, period: Column,
               ratings: DataFrame | None = None, fold_every: int = 16) -> DataFrame:
    """Ratings after all matches, one rating period after the other.

    Within a period every match reads the ratings the period started with and
    the changes add up; the next period starts from the sums. With a period of
    one poll interval this is the sequential result as long as a player is on
    one server at a time. ``period`` must sort as text (a date or timestamp).
    The loop runs once per period. It scans that period's directory and, of the
    ratings, the buckets of its players (:class:`RatingStore`).
    """
    spark = matches.sparkSession
    matches, path = stage_by(matches.withColumn("_period", period.cast("string")), "_period", "snapshot_id")
    store = rating_store(matches, scope, fold_every)
    try:
        if ratings is not None:
            store.start(ratings)
        for n, value in enumerate(staged_values(matches, path, "_period")):
            now = matches.where(F.col("_period") == value)
            store.add(elo_round(now, store.lookup(now, n), scope), n)
        return cut_lineage(store.read())
    finally:
        remove(spark, path)
        remove(spark, store.root)


def rating_store(matches: DataFrame, scope: str, fold_every: int = 16) -> RatingStore:
    """An empty store for the ratings of ``matches``."""
    spark = matches.sparkSession
    root = f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    return RatingStore(spark, root, matches.select(scope, "player").schema, fold_every)


def staged_values(staged: DataFrame, path: str, column: str) -> list[str]:
    """Values of the directories of a staged table, sorted; no data is read."""
    return [unquote(v) for v in folder_values(staged.sparkSession, path, column)]


def summed_chances(distinct: np.ndarray, players: np.ndarray) -> np.ndarray:
    """Summed win chances of each of the sorted ``distinct`` ratings against all of them,
    each counted for its players. Sums of the polynomials over the ratings so far stand
    for the opponents, so it costs the ratings, not their pairs: opponents within the
    span by cell, all beyond it at once."""
    cells = np.floor(distinct / CELL)
    count = np.concatenate([[0.0], np.cumsum(players, dtype=float)])
    low = np.searchsorted(distinct, distinct - RATING_SPAN, side="left")
    high = np.searchsorted(distinct, distinct + RATING_SPAN, side="right")
    least, most = chance(np.array([-RATING_SPAN, RATING_SPAN]))
    expected = most * count[low] + least * (count[-1] - count[high])
    own = basis(distinct, cells)
    known, first = np.unique(cells, return_index=True)
    last = np.append(first[1:], len(distinct))
    # Sums start anew in each cell, so that no large number takes digits of a small one.
    sums = [np.vstack([np.zeros(DEGREES), np.cumsum(own[i:j] * players[i:j, None], axis=0)]) for i, j in zip(first, last)]
    for at, (cell, i, j) in enumerate(zip(known, first, last)):
        for other in range(*np.searchsorted(known, [cell - 8, cell + 9])):
            start, stop = first[other], last[other]
            a, b = np.clip(low[i:j], start, stop) - start, np.clip(high[i:j], start, stop) - start
            met = sums[other][b] - sums[other][a]
            expected[i:j] += ((own[i:j] @ BETWEEN[int(cell - known[other])]) * met).sum(axis=1)
    return expected


def whole_field(ratings: np.ndarray, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Results and summed win chances of every player of a match against all others:
    results by sorting, chances from the distinct ratings, each with its players."""
    order = np.sort(deltas)
    below = np.searchsorted(order, deltas, side="left")
    wins = below + 0.5 * (np.searchsorted(order, deltas, side="right") - below - 1)
    distinct, which, players = np.unique(ratings, return_inverse=True, return_counts=True)
    finite, expected = np.isfinite(distinct), np.full(len(distinct), np.nan)  # others have no chance against themselves
    if not np.isnan(distinct).any():
        over, under = players[distinct == np.inf].sum(), players[distinct == -np.inf].sum()
        beyond = chance(np.array([-RATING_SPAN, RATING_SPAN])) @ [over, under]
        expected[finite] = summed_chances(distinct[finite], players[finite]) + beyond
    return wins, expected[which] - 0.5


def replayed(pdf: pd.DataFrame, scope: str) -> pd.DataFrame:
    """Rating change per place and player after the matches of ``pdf`` in event order."""
    places, players = (pd.factorize(pdf[c]) for c in (scope, "player"))
    code = places[0].astype(np.int64) * max(len(players[1]), 1) + players[0]
    _, first, who = np.unique(code, return_index=True, return_inverse=True)
    now = pdf["rating"].to_numpy(dtype=float)[first]
    change, score = np.zeros(len(first)), pdf["score_delta"].to_numpy(dtype=float)
    turn = pd.MultiIndex.from_arrays([pdf["ts"], pdf["snapshot_id"]])
    match, turns = pd.factorize(turn, sort=True)
    order = np.argsort(match, kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(match, minlength=len(turns)))[:-1]):
        wins, expected = whole_field(now[who[rows]], score[rows])
        moved = K_FACTOR * (wins - expected) / (len(rows) - 1)
        now[who[rows]] += moved
        change[who[rows]] += moved
    return pd.DataFrame({scope: pdf[scope].to_numpy()[first], "player": pdf["player"].to_numpy()[first], "elo_delta": change})


def conflict_groups(matches: DataFrame, scope: str) -> DataFrame:
    """(snapshot_id, group): matches of a scope that are connected by players, in one
    or several steps, share a group, the smallest of their ids. Labels go from matches
    to their players and back until none changes, a few rounds of grouped minimums."""
    sides = matches.select(scope, "player", "snapshot_id")
    groups = cut_lineage(sides.select("snapshot_id", F.col("snapshot_id").alias("group")).distinct())
    while True:
        of_player = sides.join(groups, "snapshot_id").groupBy(scope, "player").agg(F.min("group").alias("least"))
        now = sides.join(of_player, [scope, "player"]).groupBy("snapshot_id").agg(F.min("least").alias("least"))
        # A label is the id of a match: it goes on to that match's own label at once.
        ahead = now.select(F.col("snapshot_id").alias("least"), F.col("least").alias("group"))
        moved = cut_lineage(now.join(ahead, "least").select("snapshot_id", "group"))
        if moved.join(groups, ["snapshot_id", "group"], "left_anti").isEmpty():
            return moved
        groups = moved


def wave_changes(left: DataFrame, ratings: DataFrame, scope: str) -> DataFrame:
    """Rating changes after waves of matches: each takes every match that is the
    earliest one left for all its players. For connected matches too many for one task."""
    start, ratings = ratings, cut_lineage(ratings)
    left = cut_lineage(left)
    while not left.isEmpty():
        turn = F.struct("ts", "snapshot_id")
        heads = left.groupBy(scope, "player").agg(F.min(turn).alias("_head"))
        ready = (
            left.join(heads, [scope, "player"])
            .groupBy("snapshot_id")
            .agg(F.bool_and(F.col("_head.snapshot_id") == F.col("snapshot_id")).alias("_ready"))
            .where("_ready")
            .select("snapshot_id")
        )
        ready = cut_lineage(ready)
        now = left.join(ready, "snapshot_id", "left_semi")
        ratings = cut_lineage(add_ratings(ratings, elo_round(now, ratings, scope), scope))
        left = cut_lineage(left.join(ready, "snapshot_id", "left_anti"))
    before = start.select(scope, "player", F.col("rating").alias("_before"))
    moved = F.coalesce("rating", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0))
    return ratings.join(before, [scope, "player"], "left").select(scope, "player", moved.alias("elo_delta"))


def replay_changes(matches: DataFrame, ratings: DataFrame, scope: str,
                   rows_at_once: int = REPLAY_ROWS) -> DataFrame:
    """Rating changes after all ``matches`` in exact (ts, snapshot_id) order.

    Matches without a common player can't affect each other. Places with up to
    ``rows_at_once`` rows are replayed by a task each; a larger place is cut into
    groups of connected matches, which are a task each, and only a group that is
    itself larger goes in waves. Whatever way a match goes, the changes are the same.
    """
    columns = [scope, "player", "snapshot_id", "ts", "score_delta"]
    kind = T.StructType([*matches.select(scope, "player").schema.fields, T.StructField("elo_delta", T.DoubleType())])
    run = lambda pdf: replayed(pdf, scope)

    def in_groups(rows: DataFrame, *keys: str) -> DataFrame:
        return with_ratings(rows.select(*columns, *[k for k in keys if k != scope]), ratings, scope).groupBy(*keys).applyInPandas(run, kind)

    def above(rows: DataFrame, key: str) -> DataFrame:
        return cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_at_once).select(key))

    crowded = above(matches, scope)
    if crowded.isEmpty():
        return in_groups(matches, scope)
    large = matches.join(crowded, scope, "left_semi")
    grouped = large.join(conflict_groups(large, scope), "snapshot_id")
    tangled = above(grouped, "group")
    out = in_groups(matches.join(crowded, scope, "left_anti"), scope).unionByName(
        in_groups(grouped.join(tangled, "group", "left_anti"), scope, "group"))
    if tangled.isEmpty():
        return out
    rows = grouped.join(tangled, "group", "left_semi").drop("group")
    return out.unionByName(wave_changes(rows, ratings.join(rows.select(scope, "player").distinct(), [scope, "player"], "left_semi"), scope))


def elo_replay(matches: DataFrame, scope: str, slice_by: Column,
               ratings: DataFrame | None = None, rows_at_once: int = REPLAY_ROWS) -> DataFrame:
    """Ratings after replaying all matches in exact (ts, snapshot_id) order.

    The loop runs once per time slice (``slice_by`` must sort as text): it reads that
    slice, looks up the ratings of its players (:class:`RatingStore`) and replays
    place by place (:func:`replay_changes`), in a number of jobs that doesn't depend
    on the matches in a slice as long as no place has more than ``rows_at_once`` rows
    there that are connected by players.
    """
    spark = matches.sparkSession
    matches, path = stage_by(matches.withColumn("_slice", slice_by.cast("string")), "_slice", "snapshot_id")
    store = rating_store(matches, scope)
    try:
        if ratings is not None:
            store.start(ratings)
        for n, value in enumerate(staged_values(matches, path, "_slice")):
            now = matches.where(F.col("_slice") == value)
            store.add(replay_changes(now, store.lookup(now, n), scope, rows_at_once), n)
        return cut_lineage(store.read())
    finally:
        remove(spark, path)
        remove(spark, store.root)


def missing_info(matches: DataFrame, headers: DataFrame, clients: DataFrame, info: DataFrame,
                 scope: str, rank_method: str) -> DataFrame:
    """Info rows to create: every client of a ranked snapshot that has none,
    spectators and joiners too. Elo rows start at 0, time rows at null."""
    start = F.lit(0.0) if rank_method == "ELO" else F.lit(None).cast("double")
    snapshots = headers.select("snapshot_id", scope)
    if rank_method == "ELO":
        snapshots = snapshots.join(matches.select("snapshot_id"), "snapshot_id", "left_semi")
    return (
        observe(snapshots, clients.select("snapshot_id", "player"))
        .select(scope, "player").distinct()
        .join(info.select(scope, "player"), [scope, "player"], "left_anti")
        .withColumn("rating", start)
    )


def with_info_rows(ratings: DataFrame, matches: DataFrame, headers: DataFrame,
                   clients: DataFrame, scope: str, rank_method: str) -> DataFrame:
    """Ratings and the info rows that every other client of a ranked snapshot gets,
    spectators and joiners too, so that boards list them."""
    rated = ratings.select(scope, "player", "rating")
    return rated.unionByName(missing_info(matches, headers, clients, rated, scope, rank_method))


def best_times(headers: DataFrame, clients: DataFrame,
               stored: DataFrame | None = None) -> DataFrame:
    """Best time per map and player as a rating: minus the absolute score, so
    bigger is better. A stored rating is only ever improved."""
    seen = observe(
        headers.select("snapshot_id", "map"),
        valid_times(clients.select("snapshot_id", "player", "score", "in_game")),
    )
    best = seen.groupBy("map", "player").agg(
        F.max(-F.abs("score")).cast("double").alias("rating")
    )
    if stored is None:
        return best
    return (
        stored.select("map", "player", "rating").unionByName(best)
        .groupBy("map", "player").agg(F.max("rating").alias("rating"))
    )


def set_ratings(info: DataFrame, ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite the rating of existing info rows that appear in ``ratings``."""
    fresh = ratings.select(*keys, F.col("rating").alias("_new"))
    return (
        info.join(fresh, list(keys), "left")
        .withColumn("rating", F.coalesce("_new", "rating"))
        .drop("_new")
    )
