"""Hot window, archive and rollup coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.dates import day_end, hours_before
from rollcall.operators.asof import highest_before

RETENTION_HOURS = 48
BACKFILL_DAYS = 4
MINUTES_PER_OBSERVATION = 5


def watermark(headers: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """One row: the highest id among snapshots older than the retention."""
    return headers.where(F.col("ts") < hours_before(now, hours)).agg(
        F.max("snapshot_id").alias("watermark")
    )


def archivable(headers: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Snapshots up to the watermark id. It is an id bound: a younger snapshot
    with a smaller id goes too. The bound is a scalar subquery, so it reaches
    the scan as a filter."""
    return headers.where(F.col("snapshot_id") <= watermark(headers, now, hours).scalar())


def retention_split(headers: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Every snapshot, flagged by whether it may be archived."""
    bound = watermark(headers, now, hours).scalar()
    return headers.withColumn("archivable", F.coalesce(F.col("snapshot_id") <= bound, F.lit(False)))


def day_chunks(headers: DataFrame) -> DataFrame:
    """Archive objects to write: snapshots, first and last id per UTC day."""
    return headers.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("snapshots"),
        F.min("snapshot_id").alias("first_id"),
        F.max("snapshot_id").alias("last_id"),
    )


def backfill_days(archived: DataFrame, rolled_up: DataFrame, now: Column,
                  hours: int = RETENTION_HOURS, limit: int | None = BACKFILL_DAYS) -> DataFrame:
    """Archived days still to roll up, oldest first: never the newest archived
    day, only days whose retention has passed."""
    newest = archived.agg(F.max("day")).scalar()
    settled = day_end("day") + F.make_dt_interval(F.lit(0), F.lit(hours)) <= now
    days = (
        archived.select("day").distinct()
        .where((F.col("day") < newest) & settled)
        .join(rolled_up.select("day").distinct(), "day", "left_anti")
        .orderBy("day")
    )
    return days if limit is None else days.limit(limit)


def coverage(player_days: DataFrame) -> DataFrame:
    """First and last rolled-up day and how many in between are missing."""
    span = F.datediff("last_day", "first_day") + 1
    return player_days.groupBy("day").agg(F.count("*").alias("_n")).agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("days"),
    ).withColumn("missing", F.coalesce(span - F.col("days"), F.lit(0)))


def archive_backlog(headers: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Oldest live snapshot (lowest id) and how far it is past retention."""
    oldest = headers.agg(F.min_by("ts", "snapshot_id").alias("oldest"))
    cutoff = hours_before(now, hours)
    behind = F.unix_micros(cutoff) - F.unix_micros("oldest")
    return oldest.withColumn(
        "behind_seconds",
        F.when(F.col("oldest") < cutoff, F.floor(behind / 1_000_000)),
    )


def tiling(objects: DataFrame) -> DataFrame:
    """How each archive object's id range follows all those before, which begin at
    smaller ids: ``tile``, ``gap`` or ``overlap`` (``first`` for the first). A long
    object covers what stands behind a short one inside it."""
    reached = F.col("highest_last_id")
    state = (
        F.when(reached.isNull(), "first")
        .when(F.col("first_id") > reached + 1, "gap")
        .when(F.col("first_id") <= reached, "overlap")
        .otherwise("tile")
    )
    return highest_before(objects, "first_id", "last_id", ["object"]).withColumn("state", state)


def merged_history(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Hot rows and archive rows as one history; a row in both, or in two
    archive objects, counts once."""
    return hot.unionByName(archive).dropDuplicates(["snapshot_id", "ordinal"])


def one_copy_per_snapshot(rows: DataFrame, source: str) -> DataFrame:
    """For archives written without client ordinals: keep all rows of each
    snapshot from a single source object."""
    kept = rows.groupBy("snapshot_id").agg(F.min(source).alias(source))
    return rows.join(kept, ["snapshot_id", source], "left_semi")


def archive_minutes(flat: DataFrame) -> DataFrame:
    """Rough minutes per day and player, straight from archive rows."""
    return flat.where("in_game").groupBy("day", "player").agg(
        (F.count("*") * MINUTES_PER_OBSERVATION).alias("approx_minutes")
    )


ID_RANGE = 1 << 16  # ids of one window; intervals end at its multiples


def id_intervals(ids: DataFrame) -> DataFrame:
    """(first_id, last_id, snapshots): runs of ids without a gap, of ``ids(snapshot_id)``.
    Runs are found inside ranges of ``ID_RANGE`` ids, so no window holds the table."""
    runs = Window.partitionBy("_range").orderBy("snapshot_id")
    return (
        ids.select("snapshot_id").distinct().withColumn("_range", F.floor(F.col("snapshot_id") / ID_RANGE))
        .withColumn("_run", F.col("snapshot_id") - F.row_number().over(runs))
        .groupBy("_range", "_run")
        .agg(F.min("snapshot_id").alias("first_id"), F.max("snapshot_id").alias("last_id"), F.count(F.lit(1)).alias("snapshots"))
        .drop("_range", "_run")
    )


def outside(ids: DataFrame, intervals: DataFrame) -> DataFrame:
    """The distinct ``ids(snapshot_id)`` that lie in none of :func:`id_intervals`: an
    anti-join by range. Inside a range of ids the last interval that begins at or
    before an id reaches the furthest, however often intervals overlap."""
    place = F.floor(F.col("snapshot_id") / ID_RANGE).alias("_range")
    wanted = ids.select("snapshot_id").distinct().select(place, "snapshot_id", F.lit(None).cast("long").alias("_upto"))
    begin = intervals.select(F.col("first_id").alias("snapshot_id"), F.col("last_id").alias("_upto")).select(place, "snapshot_id", "_upto")
    before = Window.partitionBy("_range").orderBy("snapshot_id", F.col("_upto").desc_nulls_last())
    reached = F.coalesce(F.max("_upto").over(before.rowsBetween(Window.unboundedPreceding, 0)), F.col("snapshot_id") - 1)
    both = wanted.unionByName(begin).withColumn("_reached", reached)
    return both.where("_upto is null and _reached < snapshot_id").select("snapshot_id")
