"""Strict as-of: the latest earlier row of the same source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAY_GAP_SECONDS = 600
PLAY_GAP_CREDIT = 300


def previous_snapshot(
    headers: DataFrame,
    carry: Sequence[str] = ("map",),
    bucket: str = "day",
    last_known: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev_ts``, ``prev_snapshot_id`` and ``prev_<carry>``: the latest
    snapshot of the same server with a strictly smaller ``ts`` (among equal
    times the largest id; a tied row is never its own predecessor).

    One server may hold a large share of all rows, so the window runs per
    (server, time bucket). The last row of every bucket, reduced before its
    shuffle, seeds the next bucket of that server; the only per-server window
    is over those seeds, one row per bucket. ``last_known`` (server, ts,
    snapshot_id, carry) seeds the first bucket: state left by earlier batches.
    """
    seen = F.struct(
        F.unix_micros("ts").alias("t"),
        F.col("snapshot_id").alias("id"),
        *[F.col(c).alias(c) for c in carry],
    )
    keyed = headers.withColumn("_bucket", F.date_trunc(bucket, "ts")).withColumn("_seen", seen)

    lasts = keyed.groupBy("server", "_bucket").agg(F.max("_seen").alias("_seen"))
    if last_known is not None:
        before = last_known.select(
            "server", F.lit(None).cast("timestamp").alias("_bucket"), seen.alias("_seen")
        )
        lasts = lasts.unionByName(before)
    by_bucket = Window.partitionBy("server").orderBy(F.col("_bucket").asc_nulls_first())
    seeds = (
        lasts.withColumn("_seen", F.lag("_seen").over(by_bucket))
        .where(F.col("_bucket").isNotNull() & F.col("_seen").isNotNull())
    )

    rows = keyed.withColumn("_own", F.lit(True)).unionByName(seeds, allowMissingColumns=True)
    strictly_before = (
        Window.partitionBy("server", "_bucket")
        .orderBy(F.col("_seen.t"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_prev", F.max("_seen").over(strictly_before))
        .where(F.col("_own"))
        .select(
            *headers.columns,
            F.timestamp_micros("_prev.t").alias("prev_ts"),
            F.col("_prev.id").alias("prev_snapshot_id"),
            *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in carry],
        )
    )


def whole_units(start: str, end: str, seconds: int) -> Column:
    """Whole units between two instants, truncated."""
    micros = f"(unix_micros({end}) - unix_micros({start}))"
    return F.expr(f"{micros} div {seconds * 1_000_000}")


def elapsed(headers: DataFrame, last_known: DataFrame | None = None,
            bucket: str = "day") -> DataFrame:
    """Seconds since the previous snapshot and the play time they are worth.

    A gap over ten minutes is worth five; no previous snapshot or a gap under
    one second is worth nothing (null credit).
    """
    seconds = F.col("elapsed")
    credit = F.when(seconds > PLAY_GAP_SECONDS, F.lit(PLAY_GAP_CREDIT).cast("long")).when(
        seconds > 0, seconds
    )
    return (
        previous_snapshot(headers, (), bucket, last_known)
        .withColumn("elapsed", whole_units("prev_ts", "ts", 1))
        .withColumn("credit", credit)
    )


def ranged(df: DataFrame, order: str, value: str, ties: Sequence[str], buckets: int) -> DataFrame:
    """``df`` cut at approximate quantiles of the numeric ``order`` into at most
    ``buckets`` ranges (``_bucket``) of about equal size, however the values cluster;
    ``_at`` sorts by ``order``, ``value`` and ``ties``."""
    steps = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(order, steps, 0.2 / buckets))) if steps else []
    bucket = F.size(F.filter(
        F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < F.col(order)))
    return df.withColumn("_bucket", bucket).withColumn(
        "_at", F.struct(F.col(order).alias("o"), F.col(value).alias("v"), *ties)
    )


def ordered_neighbours(df: DataFrame, order: str, value: str, ties: Sequence[str] = (),
                       buckets: int = 256) -> DataFrame:
    """``prev_<value>``: ``value`` of the row before, ordered by ``order``,
    ``value`` and ``ties`` over the whole table, without a single-task window.

    Each range (:func:`ranged`) is a window partition, and the last row of each range
    (at most ``buckets`` rows) seeds the next non-empty one.
    """
    keyed = ranged(df, order, value, ties, buckets)
    lasts = keyed.groupBy("_bucket").agg(F.max("_at").alias("_at"))
    seeds = lasts.withColumn("_at", F.lag("_at").over(Window.orderBy("_bucket"))).where(
        F.col("_at").isNotNull()
    )
    rows = keyed.withColumn("_own", F.lit(True)).unionByName(seeds, allowMissingColumns=True)
    inside = Window.partitionBy("_bucket").orderBy("_at")
    return (
        rows.withColumn(f"prev_{value}", F.lag("_at.v").over(inside))
        .where(F.col("_own"))
        .drop("_bucket", "_at", "_own")
    )


def highest_before(df: DataFrame, order: str, value: str, ties: Sequence[str] = (),
                   buckets: int = 256) -> DataFrame:
    """``highest_<value>``: the largest ``value`` of all rows before, in the order of
    :func:`ordered_neighbours`: a running maximum, as a prefix scan over the ranges.
    The maximum of each range (at most ``buckets`` rows) goes on to all later ones."""
    keyed = ranged(df, order, value, ties, buckets)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        keyed.groupBy("_bucket").agg(F.max(value).alias("_high"))
        .withColumn("_high", F.max("_high").over(before)).where(F.col("_high").isNotNull())
    )
    rows = keyed.withColumn("_own", F.lit(True)).withColumn("_high", F.col(value)).unionByName(
        seeds, allowMissingColumns=True)
    inside = Window.partitionBy("_bucket").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.withColumn(f"highest_{value}", F.max("_high").over(inside))
        .where(F.col("_own"))
        .drop("_bucket", "_at", "_own", "_high")
    )


def positions(df: DataFrame, scope: Sequence[str], bucket: str,
              order: Sequence[Column]) -> DataFrame:
    """``position`` (from 1) and ``total`` of each row in its scope's order.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside
    (scope, bucket) and shifted by the size of the earlier buckets, so a long
    scope is spread over tasks and only bucket sizes meet in one place.
    """
    sizes = df.groupBy(*scope, bucket).agg(F.count("*").alias("_n"))
    scoped = Window.partitionBy(*scope)
    earlier = scoped.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *scope, bucket,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(scoped).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy(*scope, bucket).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, [*scope, bucket])
        .withColumn("position", F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before")
    )
