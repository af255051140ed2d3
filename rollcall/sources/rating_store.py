"""Ratings as a log: a base and the changes after it, by bucket of the key.

A rating period reads the buckets that its own players are in, and writes a directory
of changes. Every ``fold_every`` periods base and changes become a new base, with as many
buckets as its rows want, so a bucket stays about as large however many ratings there are:
what a period costs follows its own players, not the ratings that are stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import folder_values, remove

FIRST_BUCKETS = 16
ROWS_PER_BUCKET = 1 << 16


def log_rows(rows: DataFrame, keys: list[str], rating: Column, change: Column, stored: bool) -> DataFrame:
    """A stored row has a rating (that may be null), a change has none. Only a change
    other than zero counts, but the key of any change is rated from then on."""
    nonzero = F.when(change != 0, change)
    return rows.select(*keys, rating.cast("double").alias("rating"), nonzero.cast("double").alias("delta"), F.lit(stored).alias("stored"))


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of a log per key. Its order doesn't matter."""
    return rows.groupBy(*keys).agg(F.sum("rating").alias("rating"), F.sum("delta").alias("delta"), F.bool_or("stored").alias("stored"))


def settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rating per key: a stored null stays null until a change reads it as zero; a key
    without a stored row starts from zero."""
    kept = F.when(F.col("stored"), F.col("rating")).otherwise(0.0)
    moved = F.coalesce("rating", F.lit(0.0)) + F.col("delta")
    return summed(rows, keys).select(*keys, F.when(F.col("delta").isNull(), kept).otherwise(moved).alias("rating"))


@dataclass(frozen=True)
class RatingStore:
    """``keys`` are the columns of a key with their types, as in ``"map int, player string"``."""

    spark: SparkSession
    root: str
    keys: T.StructType
    fold_every: int = 16
    rows_per_bucket: int = ROWS_PER_BUCKET

    @property
    def names(self) -> list[str]:
        return self.keys.fieldNames()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.keys.fields, *T.StructType.fromDDL("rating double, delta double, stored boolean, bucket int").fields])

    def _bases(self) -> dict[int, int]:
        """Buckets of each base by the period it goes up to."""
        found = (v.split("x") for v in folder_values(self.spark, f"{self.root}/base", "upto"))
        return {int(period): int(buckets) for period, buckets in found}

    def _periods(self) -> list[int]:
        return sorted(int(v) for v in folder_values(self.spark, f"{self.root}/changes", "period"))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str, buckets: int) -> None:
        rows = rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket")
        rows.sortWithinPartitions("bucket", *self.names).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)

    def _log(self, before: int | None = None) -> tuple[int, list[DataFrame]]:
        """Number of buckets, and the newest base older than ``before`` with the changes after it."""
        bases = {p: n for p, n in self._bases().items() if before is None or p < before}
        newest = max(bases, default=None)
        buckets = FIRST_BUCKETS if newest is None else bases[newest]
        paths = [] if newest is None else [f"{self.root}/base/upto={newest}x{buckets}"]
        paths += [
            f"{self.root}/changes/period={p}" for p in self._periods()
            if (newest is None or p > newest) and (before is None or p < before)
        ]
        return buckets, [self.spark.read.schema(self.schema).parquet(p) for p in paths]

    def start(self, ratings: DataFrame) -> None:
        """Ratings that are there before the first period (number 0)."""
        rows = log_rows(ratings, self.names, F.col("rating"), F.lit(None).cast("double"), True)
        self._write_base(rows, -1)

    def _write_base(self, rows: DataFrame, upto: int) -> None:
        buckets = max(FIRST_BUCKETS, 1 << max(0, (rows.count() // self.rows_per_bucket).bit_length()))
        self._write(rows, f"{self.root}/base/upto={upto}x{buckets}", buckets)

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """Ratings of the keys in ``wanted``, as period ``before`` finds them. The buckets
        of these keys are listed first, and no other directory is read; a store that is
        still small is read as it is."""
        buckets, parts = self._log(before)
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*self.keys.fields, T.StructField("rating", T.DoubleType())]))
        wanted = wanted.select(*self.names).distinct()
        if buckets > FIRST_BUCKETS:
            hit = sorted(r[0] for r in wanted.select(self._bucket(buckets)).distinct().collect())
            parts = [p.where(F.col("bucket").isin(hit)) for p in parts]
        rows = reduce(DataFrame.unionByName, parts).drop("bucket")
        return settled(rows.join(wanted, self.names, "left_semi"), self.names)

    def add(self, changes: DataFrame, period: int) -> None:
        """Write the changes (keys, ``elo_delta``) of a period; one that runs again
        replaces what it wrote. Now and then this folds what is there."""
        buckets, _ = self._log(period)
        rows = log_rows(changes, self.names, F.lit(None).cast("double"), F.col("elo_delta"), False)
        self._write(summed(rows, self.names), f"{self.root}/changes/period={period}", buckets)
        if period % self.fold_every == self.fold_every - 1:
            self.fold(period)

    def fold(self, upto: int) -> None:
        """A new base. The one before and the changes after it stay, in case the period
        runs again; what they cover goes."""
        for period, n in self._bases().items():
            if period == upto:
                remove(self.spark, f"{self.root}/base/upto={period}x{n}")
        older = sorted(p for p in self._bases() if p < upto)
        rows = reduce(DataFrame.unionByName, self._log(upto + 1)[1]).drop("bucket")
        ratings = settled(rows, self.names)
        self._write_base(log_rows(ratings, self.names, F.col("rating"), F.lit(None).cast("double"), True), upto)
        for period, n in self._bases().items():
            if older and period < older[-1]:
                remove(self.spark, f"{self.root}/base/upto={period}x{n}")
        for period in self._periods():
            if older and period <= older[-1]:
                remove(self.spark, f"{self.root}/changes/period={period}")

    def read(self) -> DataFrame:
        """All ratings."""
        _, parts = self._log()
        if not parts:
            return self.lookup(self.spark.createDataFrame([], self.keys))
        return settled(reduce(DataFrame.unionByName, parts).drop("bucket"), self.names)
