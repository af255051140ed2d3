"""Declared schemas. Nothing is inferred at read time.

Working column names used by every operator:

  header row   snapshot_id, ts, server, map, game_type, num_clients
               (+ server_name, version, num_players, max_players, max_clients)
  client row   snapshot_id, ordinal, player, clan, score, country, in_game

``ordinal`` is any orderable column that gives a client's position in the
snapshot's client list.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the archive files.
ARCHIVE = T.StructType([
    T.StructField("snapshotId", T.LongType(), False),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("gameServerId", T.IntegerType(), False),
    T.StructField("serverName", T.StringType(), False),
    T.StructField("version", T.StringType(), False),
    T.StructField("mapId", T.IntegerType(), False),
    T.StructField("mapName", T.StringType(), False),
    T.StructField("gameTypeName", T.StringType(), False),
    T.StructField("numPlayers", T.IntegerType(), False),
    T.StructField("maxPlayers", T.IntegerType(), False),
    T.StructField("numClients", T.IntegerType(), False),
    T.StructField("maxClients", T.IntegerType(), False),
    T.StructField("playerName", T.StringType(), True),
    T.StructField("clanName", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("country", T.IntegerType(), True),
    T.StructField("inGame", T.BooleanType(), True),
    T.StructField("clientOrdinal", T.IntegerType(), True),
])

# archive column -> working column
ARCHIVE_NAMES = {
    "snapshotId": "snapshot_id",
    "createdAt": "ts",
    "gameServerId": "server",
    "serverName": "server_name",
    "version": "version",
    "mapId": "map",
    "mapName": "map_name",
    "gameTypeName": "game_type",
    "numPlayers": "num_players",
    "maxPlayers": "max_players",
    "numClients": "num_clients",
    "maxClients": "max_clients",
    "playerName": "player",
    "clanName": "clan",
    "score": "score",
    "country": "country",
    "inGame": "in_game",
    "clientOrdinal": "ordinal",
}

HEADER_COLUMNS = [
    "snapshot_id", "ts", "server", "server_name", "version", "map", "map_name",
    "game_type", "num_players", "max_players", "num_clients", "max_clients",
]
CLIENT_COLUMNS = ["player", "clan", "score", "country", "in_game", "ordinal"]

CLIENT_STRUCT = T.StructType([
    T.StructField("player", T.StringType(), False),
    T.StructField("clan", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("country", T.IntegerType(), True),
    T.StructField("in_game", T.BooleanType(), True),
])

# Working form of a flat archive row.
FLAT = T.StructType([
    T.StructField(ARCHIVE_NAMES[f.name], f.dataType, f.nullable) for f in ARCHIVE
])

# Day tables. Small counts are stored as smallint, as the day tables declare.
PLAYER_DAY = "day date, player_id int, play_time int"
SERVER_DAY = "day date, server_id int, avg_clients smallint, max_clients smallint"
MAP_DAY = "day date, map_id int, play_time int, player_count int"
GAME_TYPE_DAY = "day date, game_type_id int, play_time int, player_count int"
CLAN_DAY = "day date, clan_id int, play_time int, player_count smallint"

DAY_TABLES = {
    "player_day": PLAYER_DAY,
    "server_day": SERVER_DAY,
    "map_day": MAP_DAY,
    "game_type_day": GAME_TYPE_DAY,
    "clan_day": CLAN_DAY,
}

RANK_METHODS = ("ELO", "TIME")
