"""Row shaping shared by all operators: joins to headers, flattening, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.schema import HEADER_COLUMNS

# Scores and names that never count as a finishing time.
NO_TIME_SCORE = 9999
CONNECTING_NAME = "(connecting)"


def in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open time range ``[start, end)``; reaches the scan as a filter."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def with_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """UTC day of each row (the session time zone is UTC)."""
    return df.withColumn("day", F.to_date(ts))


def observe(headers: DataFrame, clients: DataFrame) -> DataFrame:
    """One row per client with its snapshot's header columns.

    Joined on the snapshot alone, so the result is already partitioned for any
    grouping that contains ``snapshot_id``.
    """
    return clients.join(headers, "snapshot_id")


def first_occurrence(
    df: DataFrame,
    keys: Sequence[str] = ("snapshot_id", "player"),
    order: str = "ordinal",
) -> DataFrame:
    """Keep the first row of each key by ``order``.

    The bound on the row number is what makes Spark keep one row per key on the
    map side already, so a key with very many copies never reaches one task
    whole. The remaining columns break ties, which keeps retries deterministic;
    a snapshot's header columns are the same in all its rows and stay out.
    """
    fixed = HEADER_COLUMNS if "snapshot_id" in keys else []
    rest = [c for c in df.columns if c not in keys and c != order and c not in fixed]
    earliest = Window.partitionBy(*keys).orderBy(order, *rest)
    return df.withColumn("_nth", F.row_number().over(earliest)).where("_nth = 1").drop("_nth")


def flatten(nested: DataFrame) -> DataFrame:
    """One row per client; an empty snapshot stays as one row of null clients."""
    header = [c for c in nested.columns if c != "clients"]
    return (
        nested.select(*header, F.posexplode_outer("clients").alias("ordinal", "_client"))
        .select(*header, "ordinal", "_client.*")
    )


def regroup(flat: DataFrame, client_columns: Sequence[str]) -> DataFrame:
    """Flat rows back to one row per snapshot with an ordered ``clients`` array.

    The array is the client list of one poll, so its length is bounded by the
    slots of a server. Operators here work on flat rows and never need this.
    """
    header = [c for c in flat.columns if c not in (*client_columns, "ordinal", "snapshot_id")]
    place = [F.col("ordinal")]
    if isinstance(flat.schema["ordinal"].dataType, T.StructType):
        # Its fields one by one: Spark makes a new ordering for each comparison of a struct in a struct.
        place = [F.col("ordinal").isNotNull().alias("_placed"), *[F.col("ordinal")[n].alias(f"_place_{n}") for n in flat.schema["ordinal"].dataType.names]]
    client = F.struct(*place, *client_columns)
    collected = F.sort_array(F.collect_list(F.when(F.col("player").isNotNull(), client)))
    return (
        flat.groupBy("snapshot_id")
        .agg(*[F.first(c).alias(c) for c in header], collected.alias("_clients"))
        .withColumn(
            "clients",
            F.transform("_clients", lambda c: F.struct(*[c[n].alias(n) for n in client_columns])),
        )
        .drop("_clients")
    )


def blank_to_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def clan_names(clients: DataFrame, column: str = "clan") -> DataFrame:
    """Distinct non-empty clan names."""
    return clients.where(F.col(column) != "").select(F.col(column)).distinct()


def valid_times(observations: DataFrame) -> DataFrame:
    """Rows that may carry a finishing time."""
    return observations.where(
        F.col("in_game")
        & (F.abs("score") != NO_TIME_SCORE)
        & (F.col("player") != CONNECTING_NAME)
    )


def with_rank_method(headers: DataFrame, maps: DataFrame, game_types: DataFrame) -> DataFrame:
    """snapshot -> map -> game type -> rank method. Catalyst picks broadcast
    or shuffle from the size of the dimensions."""
    return (
        headers.drop("game_type")
        .join(maps.select("map", "game_type"), "map")
        .join(game_types.select("game_type", "rank_method"), "game_type")
    )


def survivors(responses: DataFrame, keys: Sequence[str], source: str, arrival: str) -> DataFrame:
    """Merge client rows of several responses to one poll.

    The richest source wins, the earliest arrival among equals. Copies are
    reduced on the map side by the partial aggregate.
    """
    rest = [c for c in responses.columns if c not in (*keys, source, arrival)]
    winner = F.min(F.struct((-F.col(source)).alias("_rank"), F.col(arrival), *rest))
    return (
        responses.groupBy(*keys)
        .agg(winner.alias("_w"))
        .select(
            *keys,
            (-F.col("_w._rank")).alias(source),
            F.col(f"_w.{arrival}").alias(arrival),
            *[F.col(f"_w.{c}").alias(c) for c in rest],
        )
        .select(*responses.columns)
    )


def last_header(responses: DataFrame, keys: Sequence[str], fields: Sequence[str],
                arrival: str) -> DataFrame:
    """Header of a poll: the last response that carries one."""
    latest = F.max(F.struct(arrival, *fields)).alias("_h")
    return (
        responses.where(F.col("has_header")).groupBy(*keys).agg(latest)
        .select(*keys, *[F.col(f"_h.{f}").alias(f) for f in fields])
    )


def keep_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """``name IN (list)`` for a list of any size."""
    return df.join(listed, list(on), "left_semi")
