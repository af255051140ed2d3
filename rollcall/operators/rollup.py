"""Daily rollups: fixed credit per in-game observation, distinct players."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.prepare import first_occurrence

OBSERVATION_SECONDS = 300


def day_presence(seen: DataFrame) -> DataFrame:
    """Play time per (day, map, game type, clan, player).

    ``seen`` is client rows with their header columns: flat archive rows as they
    are, or :func:`observe` output, whose partitioning by snapshot the dedupe
    reuses. Detail rows are shuffled once either way. What leaves here is at most
    one row per player, place and day; the day tables all start from it.
    """
    rows = seen.where(F.col("player").isNotNull()).select(
        "snapshot_id", "player", "ordinal", F.to_date("ts").alias("day"), "map", "game_type",
        "clan", "in_game",
    )
    active = F.when(F.col("in_game"), F.lit(OBSERVATION_SECONDS)).otherwise(F.lit(0))
    return (
        first_occurrence(rows)
        .groupBy("day", "map", "game_type", "clan", "player")
        .agg(F.sum(active).alias("play_time"))
    )


def player_day(presence: DataFrame) -> DataFrame:
    """Spectators stay, with zero seconds."""
    return presence.groupBy("day", "player").agg(F.sum("play_time").alias("play_time"))


def scope_day(presence: DataFrame, scope: str) -> DataFrame:
    """Play time and distinct players per day and map, game type or clan.

    Grouping by player first spreads a busy scope over many tasks and makes the
    distinct count a plain count.
    """
    return (
        presence.where(F.col(scope).isNotNull())
        .groupBy("day", scope, "player")
        .agg(F.sum("play_time").alias("play_time"))
        .groupBy("day", scope)
        .agg(F.sum("play_time").alias("play_time"), F.count("*").alias("player_count"))
    )


def server_hour(headers: DataFrame) -> DataFrame:
    """Declared client counts per server and UTC hour, empty snapshots included."""
    return headers.groupBy("server", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("snapshot_count"),
        F.sum("num_clients").alias("client_sum"),
        F.max("num_clients").alias("max_clients"),
    )


def server_day(headers: DataFrame) -> DataFrame:
    """Mean of the hourly means over hours that saw anybody, rounded half up."""
    hourly_mean = F.col("client_sum") / F.col("snapshot_count")
    # The inner rounding drops the last bits, which depend on summation order.
    mean = F.round(F.round(F.avg(hourly_mean), 9)).cast("int")
    return (
        server_hour(headers)
        .where(F.col("client_sum") > 0)
        .groupBy(F.to_date("hour").alias("day"), "server")
        .agg(mean.alias("avg_clients"), F.max("max_clients").alias("max_clients"))
    )


def day_tables(headers: DataFrame, seen: DataFrame) -> dict[str, DataFrame]:
    """All five day tables. The presence rows are kept for the four that share
    them; release with ``tables["presence"].unpersist()``."""
    presence = day_presence(seen).persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "presence": presence,
        "player_day": player_day(presence),
        "server_day": server_day(headers),
        "map_day": scope_day(presence, "map"),
        "game_type_day": scope_day(presence, "game_type"),
        "clan_day": scope_day(presence, "clan"),
    }


def resolve_ids(rows: DataFrame, names: DataFrame, name: str, id_name: str) -> DataFrame:
    """Replace a name by its id; rows with an unknown name drop out."""
    lookup = names.select(F.col("name").alias(name), F.col("id").alias(id_name))
    return rows.join(lookup, name).drop(name)


def resolve_counts(rows: DataFrame, names: DataFrame, name: str,
                   by: Sequence[str] = ("day",)) -> DataFrame:
    """How many rows per group resolved and how many were rejected."""
    lookup = names.select(F.col("name").alias(name), F.col("id").alias("_id"))
    return rows.join(lookup, name, "left").groupBy(*by).agg(
        F.count("_id").alias("resolved"),
        (F.count("*") - F.count("_id")).alias("rejected"),
    )


def days_to_roll_up(days: DataFrame, rolled_up: DataFrame, today) -> DataFrame:
    """Days that are over and have no player rows yet."""
    return days.where(F.col("day") < F.lit(today).cast("date")).join(
        rolled_up.select("day").distinct(), "day", "left_anti"
    )
