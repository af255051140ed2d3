"""Day tables from a stream: a day is written when the watermark has closed it, and
written again when rows behind the watermark turn up."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.jobs import headers_of
from rollcall.operators import rollup
from rollcall.session import has_files
from rollcall.sources.day_tables import read_day_table, write_day_tables
from rollcall.streaming import feed as feeds

LEDGER = "query string, day date, rows long, batch long"
REOPENED = -1  # stands for the batch of a day that was written again from history


@dataclass(frozen=True)
class ClosedDays:
    """Server days under ``root``. A closed day is in one batch whole, since one
    watermark closes it for all servers, and a batch replaces whole day folders: one
    that runs again writes the same. The ledger holds which query and batch wrote a day."""

    spark: SparkSession
    root: str

    def _enter(self, rows: DataFrame, query: str | None, batch: int) -> None:
        counted = rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(query).cast("string").alias("query"), "day", "rows")
        mode = "append" if batch == REOPENED else "overwrite"
        counted.write.mode(mode).parquet(f"{self.root}/_ledger/batch={batch}")

    def _replace(self, rows: DataFrame, days: Iterable[date]) -> None:
        rows = rows.withColumn("server_id", F.col("server").cast("int")).drop("server")
        write_day_tables({"server_day": rows.withColumns({c: F.col(c).cast("smallint") for c in ("avg_clients", "max_clients")})}, self.root, days)

    def take(self, rows: DataFrame, batch: int) -> None:
        """``foreachBatch`` body: rows of :func:`feed.server_days`."""
        rows = rows.persist()
        try:
            days = [r.day for r in rows.select("day").distinct().collect()]
            if days:
                self._replace(rows, days)
                self._enter(rows, self.spark.sparkContext.getLocalProperty("sql.streaming.queryId"), batch)
        finally:
            rows.unpersist()

    def reopen(self, flat: DataFrame, days: list[date]) -> None:
        """Write ``days`` again from ``flat`` history (the archive and the hot rows),
        late rows included; a day without rows goes."""
        rows = rollup.server_day(headers_of(flat.where(F.to_date("ts").isin(days)))).persist()
        try:
            self._replace(rows, days)
            self._enter(rows, None, REOPENED)
        finally:
            rows.unpersist()

    def read(self) -> DataFrame:
        return read_day_table(self.spark, self.root, "server_day")

    def ledger(self) -> DataFrame:
        if not has_files(self.spark, f"{self.root}/_ledger"):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/_ledger")


def start_closed_days(feed: DataFrame, table: ClosedDays, checkpoint: str,
                      lateness: str = feeds.LATENESS, trigger: dict | None = None):
    """Run a stream of flat rows into day folders, each snapshot once."""
    days = feeds.server_days(feeds.unique_headers(feed, lateness))
    return (
        days.writeStream.foreachBatch(table.take).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
