"""Leaderboards: paged lists, and the same lists for every scope at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import cut_lineage

PAGE_SIZE = 100


def page_number(text: str | int | None) -> int:
    """Page asked for by a user; anything unusable is page one."""
    try:
        number = int(text)
    except (TypeError, ValueError):
        return 1
    return number if number > 0 else 1


def page(df: DataFrame, order: Sequence[Column], number: int = 1,
         size: int = PAGE_SIZE) -> DataFrame:
    """One page with its rank numbers.

    Sort and limit first, so every task keeps at most ``number * size`` rows;
    only the rows of the page itself are numbered. ``order`` must end in a key.
    """
    skip = (number - 1) * size
    rows = df.orderBy(*order).offset(skip).limit(size)
    numbered = F.row_number().over(Window.orderBy(*order)) + F.lit(skip)
    return rows.withColumn("rank", numbered)


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return page(df, order, 1, n)


def page_per_scope(df: DataFrame, scope: Sequence[str] | str, order: Sequence[Column],
                   number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The same page of every scope's list.

    The rank bound lets Spark keep only the best rows of each scope on the map
    side, so a huge scope does not reach one task whole.
    """
    scope = [scope] if isinstance(scope, str) else list(scope)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return df.withColumn("rank", rank).where(
        (F.col("rank") <= number * size) & (F.col("rank") > (number - 1) * size)
    )


def ranked_per_scope(df: DataFrame, scope: str, order: Sequence[Column]) -> DataFrame:
    """Every scope's whole list with its rank numbers; for scopes that are small
    by nature, such as the clients of one snapshot."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))


def clamped_page(df: DataFrame, scope: str, order: Sequence[Column], number: int,
                 size: int = PAGE_SIZE) -> DataFrame:
    """A page of every scope's list; a scope with fewer pages gives its last one.

    Counts the scopes first. Only rows up to the page asked for are ranked; of
    shorter lists these are all.
    """
    last = last_page_per_scope(df, scope, size).select(
        F.col(scope).alias("_of"), F.least(F.col("pages"), F.lit(number)).alias("_page"))
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    ranked = df.withColumn("rank", rank).where(F.col("rank") <= number * size)
    first = (F.col("_page") - 1) * size
    return (
        ranked.join(last, F.col(scope) == F.col("_of"))
        .where((F.col("rank") > first) & (F.col("rank") <= first + size)).drop("_of", "_page")
    )


def last_page_per_scope(df: DataFrame, scope: str, size: int = PAGE_SIZE) -> DataFrame:
    """Row and page counts of each scope's list."""
    return df.groupBy(scope).agg(F.count("*").alias("rows")).withColumn(
        "pages", F.ceil(F.col("rows") / F.lit(size))
    )


def by_play_time(*keys: str) -> list[Column]:
    return [F.col("play_time").desc(), *[F.col(k).asc() for k in keys]]


def by_rating(*keys: str) -> list[Column]:
    """Unrated last."""
    return [F.col("rating").desc_nulls_last(), *by_play_time(*keys)]


def by_counts(key: str) -> list[Column]:
    return [F.col("player_count").desc(), F.col("map_count").desc(), F.col(key).asc()]


def by_players(key: str) -> list[Column]:
    return [F.col("player_count").desc(), F.col(key).asc()]


def by_clients(key: str) -> list[Column]:
    return [F.col("num_clients").desc(), F.col("max_clients").desc(), F.col(key).asc()]


def by_score(*keys: str) -> list[Column]:
    return [F.col("score").desc(), *[F.col(k).asc() for k in keys]]


def server_order(key: str = "server") -> list[Column]:
    """All servers: fewest failures first, and servers without a live state
    ahead of the others among equals (a descending order with nulls first)."""
    return [
        F.col("failure_count").asc(),
        F.col("max_clients").desc_nulls_first(),
        F.col("num_clients").desc_nulls_first(),
        F.col("play_time").desc(),
        F.col(key).asc(),
    ]


def current_members(members: DataFrame, players: DataFrame) -> DataFrame:
    """Clan members whose current clan still is this one."""
    return members.join(players.select("player", "clan"), ["player", "clan"], "left_semi")


def servers_in_scope(states: DataFrame, maps: DataFrame) -> DataFrame:
    """Live servers with the game type of their map."""
    return states.join(maps.select("map", "game_type"), "map")


def online_on(rows: DataFrame, state_clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Distinct live servers of each listed player; an empty array when offline.

    ``rows`` is a page of a list: it is made once, and the clients of live servers
    (:func:`rollcall.operators.state.live_clients`) are cut to its players before
    the other joins.
    """
    rows = cut_lineage(rows)
    seen = (
        state_clients.select("player", "server")
        .join(rows.select("player"), "player", "left_semi")
        .join(servers.select("server", "ip", "port"), "server")
        .groupBy("player")
        .agg(F.array_sort(F.collect_set(F.struct("ip", "port"))).alias("servers"))
    )
    empty = F.array().cast("array<struct<ip:string,port:int>>")
    joined = rows.join(seen, "player", "left")
    return joined.withColumn("servers", F.coalesce("servers", empty))


def masters(master_servers: DataFrame, servers: DataFrame) -> DataFrame:
    """Servers per master server, zero included, by address and port."""
    owned = servers.groupBy("master").agg(F.count("*").alias("servers"))
    return (
        master_servers.join(owned, "master", "left")
        .withColumn("servers", F.coalesce("servers", F.lit(0).cast("long")))
        .orderBy("address", "port")
    )


def without_master(servers: DataFrame) -> DataFrame:
    return servers.where(F.col("master").isNull()).agg(F.count("*").alias("servers"))
