"""Named queries over the given tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.plans.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def portable(df: DataFrame) -> DataFrame:
    """Column types two engines print alike: whole numbers as bigint, doubles
    rounded, days and instants as text."""
    out = []
    for field in df.schema:
        col, kind = F.col(field.name), field.dataType
        if isinstance(kind, WHOLE):
            col = col.cast("long")
        elif isinstance(kind, T.DoubleType):
            col = F.round(col, 6) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is the statement that must give the same rows."""

    def add(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return add


# SQL twins of the portable forms.
def sql_day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_num(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def sql_int(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
