"""Entity counts and the change sets that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, key: str, alias: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(alias))


def with_counts(dim: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Every row of ``dim`` with the row count of each table; zero when none.

    Each table is reduced to one row per key before it is joined.
    """
    for alias, rows in tables.items():
        dim = dim.join(counted(rows, key, alias), key, "left")
    return dim.select(
        *[c for c in dim.columns if c not in tables],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in tables],
    )


def game_type_counts(game_types: DataFrame, player_info: DataFrame, clan_info: DataFrame,
                     maps: DataFrame, live: DataFrame) -> DataFrame:
    """Players, clans, maps and live servers of every game type."""
    return with_counts(
        game_types.select("game_type"), "game_type",
        player_count=player_info, clan_count=clan_info, map_count=maps, server_count=live,
    )


def map_counts(maps: DataFrame, player_info: DataFrame, clan_info: DataFrame,
               live: DataFrame) -> DataFrame:
    """Players, clans and live servers of every map."""
    return with_counts(
        maps.select("map"), "map",
        player_count=player_info, clan_count=clan_info, server_count=live,
    )


def map_server_counts(maps: DataFrame, live: DataFrame) -> DataFrame:
    return with_counts(maps.select("map"), "map", server_count=live)


def first_seen(known: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of new rows that are not known yet, once each; keys with a null are none.
    ``known`` and these together are what is known next."""
    return rows.select(*keys).dropna().distinct().join(known.select(*keys), list(keys), "left_anti")


def moved_counts(stored: DataFrame, dim: DataFrame, key: str, **fresh: DataFrame) -> DataFrame:
    """Counts kept up by new keys alone: the ``stored`` ones and what :func:`first_seen`
    found since, table by table. A row of ``dim`` that isn't stored starts from zero; the
    rows that were counted before are not read again."""
    names = list(fresh)
    now = with_counts(dim.select(key), key, **fresh)
    before = stored.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return now.join(before, key, "left").select(
        key, *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long"))).alias(c) for c in names])


def differs(columns: Sequence[str], old: str, new: str) -> Column:
    """Null-safe: true when any column changed."""
    before = F.struct(*[F.col(f"{old}.{c}") for c in columns])
    after = F.struct(*[F.col(f"{new}.{c}") for c in columns])
    return ~before.eqNullSafe(after)


def changes(stored: DataFrame, fresh: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` that would change a stored row. Keys unknown to
    ``stored`` are not updates and stay out."""
    return (
        stored.alias("old").join(fresh.alias("new"), key)
        .where(differs(columns, "old", "new"))
        .select(key, *[F.col(f"new.{c}").alias(c) for c in columns])
    )


def active_clan_counts(players: DataFrame) -> DataFrame:
    """Players whose current clan it is, per clan."""
    return counted(players, "clan", "active_player_count")


def active_clan_changes(clans: DataFrame, players: DataFrame) -> DataFrame:
    """Counts to write: changed clans, clans that lost everybody set to zero."""
    old = clans.select("clan", F.col("active_player_count").alias("old_count"))
    new = active_clan_counts(players)
    zero = F.lit(0).cast("long")
    return (
        old.join(new, "clan", "full")
        .select(
            "clan",
            F.coalesce("old_count", zero).alias("old_count"),
            F.coalesce("active_player_count", zero).alias("active_player_count"),
        )
        .where(F.col("old_count") != F.col("active_player_count"))
    )


def since(entities: DataFrame, cursor: Column | int | None, key: str = "id") -> DataFrame:
    """Rows with an id above the cursor; all of them before there is one."""
    if cursor is None:
        return entities
    cursor = cursor if isinstance(cursor, Column) else F.lit(cursor)
    return entities.where(cursor.isNull() | (F.col(key) > cursor))


def count_since(entities: DataFrame, cursor: int | None = None, batch: int | None = None) -> DataFrame:
    """Entities with an id above the cursor and the cursor to store next. A
    ``batch`` counts at most that many, lowest ids first."""
    fresh = since(entities, cursor).select("id")
    if batch is not None:
        fresh = fresh.orderBy("id").limit(batch)
    return fresh.agg(
        F.count("*").alias("added"),
        F.coalesce(F.max("id"), F.lit(cursor)).cast("long").alias("cursor"),
    )


def entity_counts(cursor: int | None = None, **tables: DataFrame) -> DataFrame:
    """One row per entity table: how many, and the highest id counted."""
    rows = [
        count_since(df, cursor).select(F.lit(name).alias("entity"), "added", "cursor")
        for name, df in tables.items()
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
