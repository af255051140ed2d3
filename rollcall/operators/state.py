"""Current state and keyed upserts as joins; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.asof import positions

SEEN_THROTTLE_MINUTES = 10


def latest_state(headers: DataFrame) -> DataFrame:
    """Last header of every server; one partial aggregate, no window."""
    rest = [c for c in headers.columns if c not in ("server", "ts", "snapshot_id")]
    return (
        headers.groupBy("server")
        .agg(F.max(F.struct("ts", "snapshot_id", *rest)).alias("_s"))
        .select("server", "_s.*")
    )


def live_clients(states: DataFrame, clients: DataFrame) -> DataFrame:
    """Client lists of the latest snapshots only."""
    return clients.join(states.select("server", "snapshot_id"), "snapshot_id")


def failure_runs(polls: DataFrame) -> DataFrame:
    """Per server: failures since its last successful poll, last success, and
    whether the latest poll succeeded. ``polls`` has server, ts, ok.

    The last success comes from per-day extremes; polls are then matched to it
    by (server, day), so one very busy server is spread over its days.
    """
    by_day = polls.withColumn("_day", F.to_date("ts"))
    days = by_day.groupBy("server", "_day").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("_ok"))
    last = days.groupBy("server").agg(F.max("_ok").alias("last_seen"))
    bounds = days.select("server", "_day").join(last, "server")
    since = F.col("last_seen").isNull() | (F.col("ts") > F.col("last_seen"))
    return (
        by_day.join(bounds, ["server", "_day"])
        .groupBy("server")
        .agg(
            F.max("last_seen").alias("last_seen"),
            F.sum(F.when(~F.col("ok") & since, 1).otherwise(0)).alias("failure_count"),
        )
        .withColumn("online", F.col("last_seen").isNotNull() & (F.col("failure_count") == 0))
    )


def online_states(states: DataFrame, runs: DataFrame) -> DataFrame:
    """A failed poll drops the server's state."""
    return states.join(runs.where(~F.col("online")).select("server"), "server", "left_anti")


def seen_players(clients: DataFrame) -> DataFrame:
    """Per player: last time seen, and the clan last worn (an empty clan is no
    clan and hides nothing)."""
    clan = F.nullif(F.col("clan"), F.lit(""))
    worn = F.max(F.when(clan.isNotNull(), F.struct(F.col("ts"), clan.alias("clan"))))
    return clients.groupBy("player").agg(
        F.max("ts").alias("last_seen"), worn.getField("clan").alias("clan")
    )


def upsert_players(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored players after ``seen``, with ``written``: a known player is only
    rewritten when it moved on by more than ten minutes or changed clan."""
    old = stored.select("player", F.col("last_seen").alias("_seen"), F.col("clan").alias("_clan"),
                        F.lit(True).alias("_known"))
    new = seen.select("player", "last_seen", "clan", F.lit(True).alias("_fresh"))
    minutes = F.expr(f"interval {SEEN_THROTTLE_MINUTES} minutes")
    moved = F.col("last_seen") - F.col("_seen") > minutes
    changed = F.col("clan").isNotNull() & ~F.col("clan").eqNullSafe(F.col("_clan"))
    written = F.col("_fresh").isNotNull() & (F.col("_known").isNull() | moved | changed)
    return (
        old.join(new, "player", "full")
        .withColumn("written", F.coalesce(written, F.lit(False)))
        .select(
            "player",
            F.when(F.col("written"), F.col("last_seen")).otherwise(F.col("_seen")).alias("last_seen"),
            F.when(F.col("written"), F.coalesce("clan", "_clan")).otherwise(F.col("_clan")).alias("clan"),
            "written",
        )
    )


def insert_absent(dim: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dim`` plus the rows whose key it does not hold."""
    fresh = rows.dropDuplicates(list(keys)).join(dim.select(*keys), list(keys), "left_anti")
    return dim.unionByName(fresh, allowMissingColumns=True)


def new_ids(dim: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids for names ``dim`` (id, keys) does not hold: max id plus position.

    Position follows (hash prefix, key), numbered per prefix and shifted, so
    no single task numbers them all; it is the same on every retry.
    """
    fresh = names.select(*keys).distinct().join(dim.select(*keys), list(keys), "left_anti")
    digest = F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))
    placed = positions(
        fresh.withColumn("_prefix", F.substring(digest, 1, 3)),
        [], "_prefix", [F.col(k).asc() for k in keys],
    )
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return placed.select((top + F.col("position")).alias("id"), *keys)


def set_rank_methods(game_types: DataFrame, methods: DataFrame) -> DataFrame:
    """Upsert of rank methods by game type name; other game types keep theirs."""
    return game_types.select("game_type", F.col("rank_method").alias("_old")).join(
        methods.select("game_type", "rank_method"), "game_type", "full"
    ).select("game_type", F.coalesce("rank_method", "_old").alias("rank_method"))


def reassign_master(servers: DataFrame, listed: DataFrame, master) -> DataFrame:
    """Servers after one master's list arrived: listed ones belong to it, its
    others lose their master, unknown ones are added."""
    keys = ["ip", "port"]
    marks = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    mine = F.lit(master)
    owner = F.when(F.col("_listed"), mine).when(F.col("master") != mine, F.col("master"))
    return servers.join(marks, keys, "full").withColumn("master", owner).drop("_listed")


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children a deleted parent takes along."""
    return children.join(parents.select(key), key, "left_anti")


def apply_changes(target: DataFrame, delta: DataFrame, keys: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Keyed update: rows of ``target`` named in ``delta`` take its values."""
    fresh = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(fresh, list(keys), "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined
