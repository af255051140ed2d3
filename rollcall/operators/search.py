"""Substring search over player, clan and server names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.boards import online_on, page

RESULTS = 30
MIN_QUERY = 2


def like_pattern(text: str) -> str:
    """User text as an ILIKE pattern: ``_`` and ``%`` are plain characters,
    a backslash keeps its meaning as the escape character. Before any other
    character it only makes that character plain, so it is left out there."""
    pattern = "%" + text.replace("_", r"\_").replace("%", r"\%") + "%"
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "_%\\" else m[1], pattern, flags=re.S)


def searchable(text: str) -> bool:
    return len(text) >= MIN_QUERY


def matches(column: str, text: str) -> Column:
    return F.col(column).ilike(like_pattern(text))


def search(df: DataFrame, text: str, name: str, weight: str, key: str,
           results: int = RESULTS) -> DataFrame:
    """Shortest names first, then the heaviest. One scan, top-k per task."""
    if not searchable(text):
        return df.limit(0).withColumn("rank", F.lit(0))
    order = [F.length(name).asc(), F.col(weight).desc(), F.col(key).asc()]
    return page(df.where(matches(name, text)), order, 1, results)


def search_players(players: DataFrame, state_clients: DataFrame, servers: DataFrame,
                   text: str, key: str = "player") -> DataFrame:
    """Matching players and the servers they are on. The result is cut to its
    thirty rows before the live tables are joined."""
    hits = search(players, text, "name", "play_time", key)
    return online_on(hits, state_clients, servers)


def search_clans(clans: DataFrame, text: str, key: str = "clan") -> DataFrame:
    return search(clans, text, "name", "play_time", key)


def search_servers(states: DataFrame, servers: DataFrame, maps: DataFrame, text: str) -> DataFrame:
    known = states.join(servers.select("server", "ip", "port"), "server")
    hits = search(known, text, "name", "num_clients", "server")
    return hits.join(maps.select("map", "map_name", "game_type"), "map", "left")
