"""Named queries: server answers and master lists, encoded from the tables and
decoded again."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.operators import prepare
from rollcall.plans.fixtures import Tables, with_cte
from rollcall.plans.registry import query, sql_int
from rollcall.plans.rollups import nested_orders
from rollcall.sources import packets


def datagram(name: str, *fields: Column) -> Column:
    """Marker bytes, format name and NUL-terminated fields."""
    head = F.lit(bytearray(b"\xff" * 10 + name.encode()))
    body = F.concat(F.array_join(F.concat(*fields), "\x00"), F.lit("\x00"))
    return F.concat(head, F.encode(body, "UTF-8"))


def client_fields(clients: Column, raised: int, *more: Column) -> Column:
    return F.flatten(F.transform(clients, lambda c: F.array(
        c.player, F.coalesce(c.clan, F.lit("")), F.lit("-1"),
        (c.score + raised).cast("string"), F.when(c.in_game, "1").otherwise("0"), *more)))


def order_answers(t: Tables):
    """Two answers per order: everybody, then in-game clients scored 100 up."""
    orders = nested_orders(t).join(
        t.counted_order_headers.select("snapshot_id", "map", "game_type", "num_clients", "max_clients"),
        "snapshot_id")
    text = [F.lit("tok"), F.lit("0.6"), F.concat(F.lit("server "), F.col("server").cast("string")),
            F.col("map"), F.col("game_type"), F.lit("0"), F.lit("0"), F.lit("0"),
            F.col("num_clients").cast("string"), F.col("max_clients").cast("string")]
    playing = F.filter("clients", lambda c: c.in_game)
    first = datagram("inf3", F.array(*text), client_fields(F.col("clients"), 0))
    second = datagram("iex+", F.array(F.lit("tok"), F.lit("1")), client_fields(playing, 100, F.lit("")))
    both = F.array(
        F.struct(F.lit(0).alias("arrival"), first.alias("payload")),
        F.struct(F.lit(1).alias("arrival"), second.alias("payload")),
    )
    return orders.select(F.col("snapshot_id").alias("poll"), F.inline(both))


@query("decode_clients", with_cte("orders", f"""
, best AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id, player ORDER BY in_game DESC, place) AS pick
  FROM oc)
SELECT snapshot_id AS poll, player, clan, {sql_int('CASE WHEN in_game THEN score + 100 ELSE score END')} AS score,
       in_game
FROM best WHERE pick = 1"""))
def decode_clients(t: Tables):
    _, clients = packets.merge_polls(packets.decode_server_info(order_answers(t)))
    return clients.select("poll", "player", "clan", "score", "in_game")


@query("decode_headers", with_cte("orders", f"""
SELECT snapshot_id AS poll, 'server ' || CAST(server AS VARCHAR) AS server_name, map AS map_name,
       game_type, num_clients, {sql_int('max_clients')} AS max_clients FROM ohc"""))
def decode_headers(t: Tables):
    headers, _ = packets.merge_polls(packets.decode_server_info(order_answers(t)))
    return headers.select("poll", "server_name", "map_name", "game_type", "num_clients", "max_clients")


def packed(n: Column) -> Column:
    """Hex digits of a whole number in the packed form of version 0.7: all five bytes as
    one number, of which those that hold anything are written."""
    value = F.when(n < 0, F.bitwise_not(n)).otherwise(n).cast("long")
    five = F.when(n < 0, 0x40 << 32).otherwise(0).cast("long")
    digits, more = F.lit(10), F.lit(0x8080808000)
    for at, (start, bits) in enumerate(((0, 6), (6, 7), (13, 7), (20, 7), (27, 7))):
        five = five.bitwiseOR(F.shiftleft(F.shiftright(value, start).bitwiseAND((1 << bits) - 1), 32 - 8 * at))
    for at, most in ((3, 1 << 27), (2, 1 << 20), (1, 1 << 13), (0, 1 << 6)):
        digits = F.when(value < most, 2 * at + 2).otherwise(digits)
        more = F.when(value < most, (0x8080808000 >> (40 - 8 * at)) << (40 - 8 * at)).otherwise(more)
    return F.lpad(F.hex(five.bitwiseOR(more)), 10, "0").substr(F.lit(1), digits)


def packed_answers(t: Tables):
    """An answer of version 0.7 per order; scores have one to five bytes."""

    def text(c: Column) -> Column:
        return F.concat(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), F.lit("00"))

    at = F.col("ordinal")
    part, line = at.l_partkey.cast("int"), at.l_linenumber.cast("int")
    sized = F.call_function("shiftright", part % 100003 * 7919, line % 5 * 6)
    flat = t.order_clients.select(
        "snapshot_id", "ordinal", "player", "clan", (line - 4).alias("country"),
        F.when(line % 2 == 0, -sized).otherwise(sized).alias("score"),
        F.when(F.col("in_game"), 0).otherwise(1).alias("kind"))
    headers = prepare.with_day(t.order_headers.select("snapshot_id", "ts", "server")).drop("ts")
    # Encoded before rows meet: Java compiles no method as long as one for a whole answer
    # would be, and Spark none of a lambda over the list.
    rows = headers.join(flat, "snapshot_id", "left").select("snapshot_id", "day", "server", "ordinal", "player", F.concat(
        text(F.col("player")), text(F.col("clan")), *[packed(F.col(n)) for n in ("country", "score", "kind")]).alias("encoded"))
    zero = packed(F.lit(0))
    counted = t.counted_order_headers.select("snapshot_id", F.concat(
        text(F.col("map")), text(F.col("game_type")), zero, zero, zero, zero,
        packed(F.col("num_clients")), packed(F.col("max_clients"))).alias("rest"))
    orders = prepare.regroup(rows, ["player", "encoded"]).join(counted, "snapshot_id")
    server = text(F.concat(F.lit("server "), F.col("server").cast("string")))
    start = F.lit((b"\x21" + bytes(8) + b"\xff" * 4 + b"inf3").hex())
    head = [start, zero, text(F.lit("0.7")), server, text(F.lit("host")), F.col("rest")]
    return orders.select(
        F.col("snapshot_id").alias("poll"), F.lit(0).alias("arrival"),
        F.unhex(F.concat(*head, F.array_join("clients.encoded", ""))).alias("payload"))


@query("decode_packed", with_cte("orders", f"""
, sized AS (
  SELECT snapshot_id, player, clan, in_game, l_linenumber AS line, nth,
         ((l_partkey % 100003) * 7919) >> CAST((l_linenumber % 5) * 6 AS INTEGER) AS size
  FROM oc)
SELECT snapshot_id AS poll, 'server ' || CAST(server AS VARCHAR) AS server_name, map AS map_name,
       {sql_int('max_clients')} AS max_clients, player, clan, {sql_int('line - 4')} AS country,
       {sql_int('CASE WHEN line % 2 = 0 THEN -size ELSE size END')} AS score, in_game
FROM ohc LEFT JOIN (SELECT * FROM sized WHERE nth = 1) USING (snapshot_id)"""))
def decode_packed(t: Tables):
    """Headers and clients of the packed answers; a poll without clients has one row."""
    headers, clients = packets.merge_polls(packets.decode_server_info(packed_answers(t)))
    return headers.join(clients, "poll", "left").select(
        "poll", "server_name", "map_name", "max_clients", "player", "clan", "country", "score", "in_game")


@query("decode_master_list", """
SELECT CAST(c_nationkey AS BIGINT) AS poll,
       CAST((c_custkey >> 24) & 255 AS VARCHAR) || '.' || CAST((c_custkey >> 16) & 255 AS VARCHAR) || '.' ||
       CAST((c_custkey >> 8) & 255 AS VARCHAR) || '.' || CAST(c_custkey & 255 AS VARCHAR) AS ip,
       CAST(c_nationkey + 8300 AS BIGINT) AS port
FROM customer""")
def decode_master_list(t: Tables):
    """Datagrams of at most 64 customers, listed by their nation."""
    record = F.concat(
        F.lit(packets.IPV4_PREFIX), F.lpad(F.hex("c_custkey"), 8, "0"),
        F.lpad(F.hex(F.col("c_nationkey") + 8300), 4, "0"))
    head = F.lit(bytearray(b"\xff" * 10 + packets.MASTER_LIST.encode()))
    lists = t.read("customer").groupBy(
        F.col("c_nationkey").alias("poll"), F.expr("c_custkey div 64").alias("arrival")
    ).agg(F.concat(head, F.unhex(F.array_join(F.collect_list(record), ""))).alias("payload"))
    return packets.decode_master_list(lists).select("poll", "ip", "port")
