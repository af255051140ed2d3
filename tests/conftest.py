from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rollcall import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minute: float = 0, day: int = 1) -> datetime:
    """An instant in January 2024, minutes after midnight."""
    seconds = round(minute * 60)
    return datetime(2024, 1, day, seconds // 3600, seconds % 3600 // 60, seconds % 60)


HEADER = "snapshot_id long, ts timestamp, server int, map int, game_type string, num_clients int"
CLIENT = "snapshot_id long, ordinal int, player string, clan string, score int, in_game boolean"


@pytest.fixture()
def headers(spark):
    """headers((id, ts, server, map, game_type, num_clients), ...)"""
    return lambda *rows: spark.createDataFrame(list(rows), HEADER)


@pytest.fixture()
def clients(spark):
    """clients((id, ordinal, player, clan, score, in_game), ...)"""
    return lambda *rows: spark.createDataFrame(list(rows), CLIENT)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
