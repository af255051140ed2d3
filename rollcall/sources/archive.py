"""The snapshot archive: flat client rows as ZSTD Parquet under ``dt=DAY``."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.history import id_intervals, outside, watermark
from rollcall.schema import ARCHIVE, ARCHIVE_NAMES
from rollcall.session import cut_lineage, day_folders, has_files, remove

SORT = ["dt", "gameServerId", "createdAt", "snapshotId"]
READ_SCHEMA = T.StructType([*ARCHIVE.fields, T.StructField("dt", T.DateType())])


def to_archive(flat: DataFrame) -> DataFrame:
    """Working names to file names, in file column order."""
    return flat.select(*[
        F.col(ARCHIVE_NAMES[f.name]).cast(f.dataType).alias(f.name) for f in ARCHIVE
    ])


def from_archive(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed(ARCHIVE_NAMES)


def write_archive(flat: DataFrame, root: str, mode: str = "append") -> None:
    """Files hold contiguous ranges of (day, server, time), so row groups have
    tight bounds on server and time. Range partitioning splits a busy day or a
    busy server over many tasks and keeps a snapshot's rows together."""
    rows = to_archive(flat).withColumn("dt", F.to_date("createdAt"))
    (
        rows.repartitionByRange(*SORT)
        .sortWithinPartitions(*SORT, "clientOrdinal")
        .write.mode(mode).partitionBy("dt").option("compression", "zstd").parquet(root)
    )


def read_archive(spark: SparkSession, root: str, first: date | None = None,
                 last: date | None = None, days: list[date] | None = None) -> DataFrame:
    """Flat rows of a closed range or a list of days. With a list or both ends
    given only those day directories are listed, else the partition filter prunes
    them. A row filed under the wrong day is left out: the day filter is on its time."""
    reader = spark.read.schema(READ_SCHEMA)
    if days is None and first is not None and last is not None:
        days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    if days is not None:
        folders = ",".join(f"dt={d.isoformat()}" for d in days)
        try:
            rows = reader.option("basePath", root).parquet(f"{root}/{{{folders}}}")
        except Exception as error:  # none of the days was ever written
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = spark.createDataFrame([], READ_SCHEMA)
    else:
        rows = reader.parquet(root)
        if first is not None:
            rows = rows.where(F.col("dt") >= F.lit(first))
        if last is not None:
            rows = rows.where(F.col("dt") <= F.lit(last))
    return from_archive(rows).where(F.to_date("ts") == F.col("dt"))


def archived_days(spark: SparkSession, root: str) -> DataFrame:
    """Days present, from the directory layout; no file is opened."""
    return day_folders(spark, root, "dt")


def archive_objects(spark: SparkSession, root: str) -> DataFrame:
    """First and last snapshot id of every file, for the tiling check."""
    rows = spark.read.schema(READ_SCHEMA).parquet(root)
    return rows.groupBy(F.col("_metadata.file_path").alias("object"), "dt").agg(
        F.min("snapshotId").alias("first_id"), F.max("snapshotId").alias("last_id")
    )


def day_summary(flat: DataFrame) -> DataFrame:
    return flat.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("rows"),
        F.countDistinct("snapshot_id").alias("snapshots"),
        F.min("snapshot_id").alias("first_id"),
        F.max("snapshot_id").alias("last_id"),
    )


MANIFEST = "first_id long, last_id long, snapshots long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of archived ids, a few rows per archive run."""
    if not has_files(spark, f"{root}/_manifest/done"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/done")


def files_of(spark: SparkSession, root: str, days: list[date]) -> set[str]:
    """Data files of some days; their folders are listed, nothing is opened."""
    return set(read_archive(spark, root, days=days).inputFiles()) if days else set()


def not_archived(due: DataFrame, root: str, days: list[date]) -> DataFrame:
    """Ids of ``due`` that the archive doesn't hold. The manifest tells, unless there is
    none yet or a run died between its files and its entry: then the days are read."""
    spark, ids = due.sparkSession, due.select("snapshot_id").distinct()
    sure = has_files(spark, f"{root}/_manifest/done") and not has_files(spark, f"{root}/_manifest/open")
    if not sure and not files_of(spark, root, days):
        return ids
    if not sure:
        held = read_archive(spark, root, days=days).select("snapshot_id").distinct()
        return ids.join(held, "snapshot_id", "left_anti")
    return outside(ids, manifest(spark, root))


def archive_batch(hot: DataFrame, root: str, now: Column, hours: int) -> DataFrame:
    """Move what is past retention from the hot rows to the archive.

    The clock is read once: all steps go by the watermark id found then.

    Writes the snapshots the archive does not hold yet, by the manifest's intervals of
    ids, then reads back the files it has written, and no others, and compares them with
    the source before they are entered and anything may be dropped. A run that died half
    way leaves an open mark, and the next one looks into the days themselves.
    Returns the hot rows that stay.
    """
    spark = hot.sparkSession
    bound = watermark(hot, now, hours).first()[0]
    if bound is None:
        return hot
    due = hot.where(F.col("snapshot_id") <= bound)
    days = [r.day for r in due.select(F.to_date("ts").alias("day")).distinct().collect()]
    # Kept before the archive changes: the mark and the files below would change what it says.
    fresh = cut_lineage(not_archived(due, root, days))
    before = files_of(spark, root, days)
    mark = f"{root}/_manifest/open"
    spark.range(1).write.mode("overwrite").parquet(mark)
    rows = due.join(fresh, "snapshot_id", "left_semi")
    write_archive(rows, root)

    written = sorted(files_of(spark, root, days) - before)
    found = spark.createDataFrame([], rows.schema)
    if written:
        back = spark.read.schema(READ_SCHEMA).option("basePath", root).parquet(*written)
        found = from_archive(back).where(F.to_date("ts") == F.col("dt"))
    if not day_summary(rows).exceptAll(day_summary(found)).isEmpty():
        raise RuntimeError(f"archive under {root} does not hold all rows; nothing retired")
    id_intervals(due).write.mode("append").parquet(f"{root}/_manifest/done")
    remove(spark, mark)
    return hot.where(F.col("snapshot_id") > bound)
