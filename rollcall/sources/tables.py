"""Relational source and synthetic load data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, id_column: str, low: int, high: int,
              partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel id ranges. The database's own driver jar
    has to be on the class path."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=id_column, lowerBound=str(low),
                 upperBound=str(high), numPartitions=str(partitions), **options)
        .load()
    )


def sample_players(spark: SparkSession, n: int, existing: DataFrame | None = None) -> DataFrame:
    """``n`` synthetic players for load tests; names already there are skipped."""
    names = spark.range(n).select(
        F.concat(F.lit("player "), F.lpad(F.col("id").cast("string"), 9, "0")).alias("player"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.xxhash64("id"), F.lit(31_536_000)))
        .alias("created_at"),
    )
    return names if existing is None else names.join(existing, "player", "left_anti")
