"""Streams of flat archive rows and the aggregates that run on them natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.schema import ARCHIVE, HEADER_COLUMNS
from rollcall.sources.archive import from_archive

LATENESS = "48 hours"
# How often the jobs are due, as trigger intervals.
TRIGGERS = {
    "poll": "5 minutes", "archive": "10 minutes", "rollup": "1 hour", "backfill": "15 minutes",
    "global_counts": "1 minute", "clan_counts": "5 minutes", "game_type_counts": "1 hour",
    "map_server_counts": "1 hour", "map_counts": "24 hours",
}


def trigger_of(job: str) -> dict[str, str]:
    """Trigger arguments of a job, for ``DataStreamWriter.trigger``."""
    return {"processingTime": TRIGGERS[job]}


def rows_behind(query) -> int:
    """Rows that a query's operators left out so far because they were behind the
    watermark. They stay in the drop folder, for the archive and a day rebuild."""
    return sum(
        int(state.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress for state in progress.get("stateOperators", [])
    )


def read_feed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Rows as they land in a drop folder; the file bound is the back-pressure."""
    rows = (
        spark.readStream.schema(ARCHIVE).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return from_archive(rows)


def unique_rows(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each client row once, however often its poll was delivered."""
    return feed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(
        ["snapshot_id", "ordinal"])


def unique_headers(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each snapshot once."""
    headers = feed.select(*[c for c in HEADER_COLUMNS if c in feed.columns])
    return headers.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["snapshot_id"])


def server_hours(headers: DataFrame) -> DataFrame:
    """Closed UTC hours per server (append mode)."""
    return headers.groupBy(F.window("ts", "1 hour").alias("hour"), "server").agg(
        F.count("*").alias("snapshot_count"),
        F.sum("num_clients").alias("client_sum"),
        F.max("num_clients").alias("max_clients"),
    )


def server_days(headers: DataFrame) -> DataFrame:
    """Closed UTC days per server from the closed hours (append mode)."""
    hourly_mean = F.col("client_sum") / F.col("snapshot_count")
    mean = F.round(F.round(F.avg(hourly_mean), 9)).cast("int")
    live = server_hours(headers).where(F.col("client_sum") > 0)
    return (
        live.groupBy(F.window(F.window_time("hour"), "1 day").alias("day"), "server")
        .agg(mean.alias("avg_clients"), F.max("max_clients").alias("max_clients"))
        .select(F.to_date("day.start").alias("day"), "server", "avg_clients", "max_clients")
    )


def latest_states(headers: DataFrame) -> DataFrame:
    """Last header of every server (update mode). One row of state per server."""
    rest = [c for c in headers.columns if c not in ("server", "ts", "snapshot_id")]
    return (
        headers.groupBy("server").agg(F.max(F.struct("ts", "snapshot_id", *rest)).alias("_s"))
        .select("server", "_s.*")
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    """Running count and highest id per entity kind (complete or update mode);
    the checkpoint takes the place of a stored cursor."""
    return entities.groupBy("entity").agg(
        F.count("*").alias("added"), F.max("id").alias("cursor"))
