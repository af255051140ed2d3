"""Whole runs a scheduler would start."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import history, rollup
from rollcall.schema import HEADER_COLUMNS
from rollcall.sources import archive, day_tables


def headers_of(flat: DataFrame) -> DataFrame:
    """One header per snapshot, however many copies of it the archive holds."""
    return flat.select(*[c for c in HEADER_COLUMNS if c in flat.columns]).dropDuplicates(
        ["snapshot_id"])


def clients_of(flat: DataFrame) -> DataFrame:
    """Client rows; empty snapshots have none."""
    return flat.where(F.col("player").isNotNull()).select(
        "snapshot_id", "ordinal", "player", "clan", "score", "in_game")


def roll_up_days(flat: DataFrame, root: str, days: list[date], players: DataFrame,
                 clans: DataFrame, game_types: DataFrame) -> dict[str, list[tuple]]:
    """Compute and replace ``days`` in all five tables, many days per job. Returns,
    per table that has names, (day, rows resolved, rows rejected for an unknown name)."""
    flat = flat.where(F.to_date("ts").isin(days))
    tables = rollup.day_tables(headers_of(flat), flat)
    try:
        day_tables.write_day_tables(
            day_tables.with_ids(tables, players, clans, game_types), root, days)
        named = {
            "player_day": (players, "player"), "game_type_day": (game_types, "game_type"),
            "clan_day": (clans, "clan"),
        }
        return {
            table: sorted(tuple(r) for r in rollup.resolve_counts(tables[table], names, name).collect())
            for table, (names, name) in named.items()
        }
    finally:
        tables["presence"].unpersist()


def backfill(spark: SparkSession, archive_root: str, root: str, now: Column, players: DataFrame,
             clans: DataFrame, game_types: DataFrame, hours: int = history.RETENTION_HOURS,
             limit: int | None = history.BACKFILL_DAYS) -> list[date]:
    """Roll up archived days that are missing, oldest first; returns them."""
    due = history.backfill_days(
        archive.archived_days(spark, archive_root), day_tables.rolled_up_days(spark, root),
        now, hours, limit,
    )
    days = [r.day for r in due.collect()]
    if days:
        flat = archive.read_archive(spark, archive_root, days=days)
        roll_up_days(flat, root, days, players, clans, game_types)
    return days


def roll_up_yesterday(flat: DataFrame, root: str, today: date, day: date, players: DataFrame,
                      clans: DataFrame, game_types: DataFrame) -> bool:
    """Roll up one day of the hot rows unless it is not over or already done."""
    spark = flat.sparkSession
    wanted = spark.range(1).select(F.lit(day).alias("day"))
    open_days = rollup.days_to_roll_up(wanted, day_tables.rolled_up_days(spark, root), today)
    if open_days.isEmpty():
        return False
    roll_up_days(flat, root, [day], players, clans, game_types)
    return True
