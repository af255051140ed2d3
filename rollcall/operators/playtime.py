"""Elapsed-time accounting: every client present is credited, spectators too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.asof import elapsed
from rollcall.operators.prepare import first_occurrence, observe

# One play-time total per entry.
TOTALS: dict[str, tuple[str, ...]] = {
    "player_map": ("player", "map"),
    "player_game_type": ("player", "game_type"),
    "player": ("player",),
    "clan_map": ("clan", "map"),
    "clan_game_type": ("clan", "game_type"),
    "clan": ("clan",),
    "clan_player": ("clan", "player"),
    "game_type": ("game_type",),
    "map": ("map",),
    "server": ("server",),
}


def credited(headers: DataFrame, clients: DataFrame,
             last_known: DataFrame | None = None, bucket: str = "day") -> DataFrame:
    """One row per player and snapshot with the seconds it is worth. The join
    comes before the dedupe, which reuses its partitioning by snapshot."""
    worth = (
        elapsed(headers, last_known, bucket)
        .where(F.col("credit").isNotNull())
        .select("snapshot_id", "ts", "server", "map", "game_type", "credit")
    )
    present = clients.select("snapshot_id", "player", "clan", "ordinal")
    return first_occurrence(observe(worth, present)).drop("ordinal")


def credited_again(headers: DataFrame, clients: DataFrame, late: DataFrame) -> DataFrame:
    """What the credits of all snapshots have beyond those without the ``late`` ones
    (``snapshot_id``), as rows of :func:`credited`; credits may be negative. Headers
    are measured twice; client rows are read for the snapshots that differ only: the
    late ones and the next ones of their servers."""
    zero = F.lit(0).cast("long")
    on_time = elapsed(headers.join(late, "snapshot_id", "left_anti")).select("snapshot_id", F.col("credit").alias("_known"))
    differ = (
        elapsed(headers).join(on_time, "snapshot_id", "left")
        .withColumn("credit", F.coalesce("credit", zero) - F.coalesce("_known", zero))
        .where("credit <> 0").select("snapshot_id", "ts", "server", "map", "game_type", "credit")
    )
    present = clients.select("snapshot_id", "player", "clan", "ordinal")
    return first_occurrence(observe(differ, present)).drop("ordinal")


def play_time(credits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total seconds per key; a missing clan is no clan."""
    if "clan" in keys:
        credits = credits.where(F.col("clan").isNotNull())
    return credits.groupBy(*keys).agg(F.sum("credit").alias("play_time"))


def all_totals(credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All ten totals in one pass, tagged by ``total``; per value of ``by``, if given.

    Credits shrink to one row per distinct key combination first; only those
    rows are repeated for the ten key sets.
    """
    dims = ["server", "map", "game_type", "clan", "player"]
    base = credits.groupBy(*dims, *by).agg(F.sum("credit").alias("play_time"))
    key_sets = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("total"),
            *[
                (F.col(d) if d in keys else F.lit(None)).cast("string").alias(d)
                for d in dims
            ],
        )
        for name, keys in TOTALS.items()
    ]))
    clan_totals = [name for name, keys in TOTALS.items() if "clan" in keys]
    return (
        base.select(key_sets.alias("k"), "play_time", *by)
        .select("k.*", "play_time", *by)
        .where(~F.col("total").isin(clan_totals) | F.col("clan").isNotNull())
        .groupBy("total", *dims, *by)
        .agg(F.sum("play_time").alias("play_time"))
    )


def add_deltas(stored: DataFrame, deltas: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stored totals plus new deltas; a null stored value counts as zero and a
    new key starts from its delta."""
    return summed(stored.select(*keys, value).unionByName(deltas.select(*keys, value)), keys, value)


def summed(both: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stored and new rows, already in one table, as one row per key."""
    return both.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def play_sessions(observations: DataFrame, keys: Sequence[str] = ("player",), gap: str = "10 minutes") -> DataFrame:
    """Play sessions, an addition of this library: runs of a player's observations that
    are at most ``gap`` apart. (keys, started, last_seen, snapshots). The same on a batch
    and, behind a watermark on ``ts`` and in append mode, on a stream."""
    window = F.session_window("ts", gap)
    return observations.groupBy(*keys, window.alias("session")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("snapshots")
    ).drop("session")
