"""The five day tables on disk: one directory per day, rewritten whole."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.operators import rollup
from rollcall.schema import DAY_TABLES
from rollcall.session import day_folders, remove

# id column of each table; rows of a day are sorted by it.
KEYS = {
    "player_day": "player_id", "server_day": "server_id", "map_day": "map_id",
    "game_type_day": "game_type_id", "clan_day": "clan_id",
}


def with_ids(tables: dict[str, DataFrame], players: DataFrame, clans: DataFrame,
             game_types: DataFrame) -> dict[str, DataFrame]:
    """Names to ids (unknown names drop out) and the declared column types.
    A count too big for its type fails the write instead of wrapping."""
    resolved = {
        "player_day": rollup.resolve_ids(tables["player_day"], players, "player", "player_id"),
        "server_day": tables["server_day"].withColumnRenamed("server", "server_id"),
        "map_day": tables["map_day"].withColumnRenamed("map", "map_id"),
        "game_type_day": rollup.resolve_ids(
            tables["game_type_day"], game_types, "game_type", "game_type_id"),
        "clan_day": rollup.resolve_ids(tables["clan_day"], clans, "clan", "clan_id"),
    }
    out = {}
    for name, df in resolved.items():
        schema = StructType.fromDDL(DAY_TABLES[name])
        out[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return out


def write_day_tables(tables: dict[str, DataFrame], root: str, days: Iterable[date]) -> None:
    """Replace ``days`` in every table. Days are whole directories, so running
    again gives the same files; a day that has no rows any more is removed.

    Rows are ranged over (day, key) and sorted: a busy day is several files. The
    days that have rows are noted while they are written.
    """
    days = sorted(days)
    for name, df in tables.items():
        path = f"{root}/{name}"
        seen = Observation()
        rows = df.where(F.col("day").isin(days)).repartitionByRange("day", KEYS[name])
        (
            rows.sortWithinPartitions("day", KEYS[name])
            .observe(seen, F.collect_set(F.col("day").cast("string")).alias("days"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day").parquet(path)
        )
        filled = set(seen.get["days"])
        for day in days:
            if day.isoformat() not in filled:
                remove(df.sparkSession, f"{path}/day={day.isoformat()}")


def read_day_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(DAY_TABLES[name]).parquet(f"{root}/{name}")


def rolled_up_days(spark: SparkSession, root: str) -> DataFrame:
    """Days with any player row, from the directory layout."""
    return day_folders(spark, f"{root}/player_day", "day")
