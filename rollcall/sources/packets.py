"""Captured server answers decoded in bulk with column expressions.

Input is a table of datagrams: ``poll``, ``arrival`` (order within the poll)
and ``payload`` (binary). Nothing here opens a socket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the wire format. Padding bytes (six, or nine in version 0.7),
# four 0xff bytes and a four-letter name come first, then NUL-terminated fields.
PAYLOAD_MARK = "FF"
PAYLOAD_MARKS_7 = ("20", "21", "22", "23")
MAGIC = "FFFFFFFF"

# name -> (rank among sources, header field positions, first client field,
# fields per client). Positions count from the token at 0.
HEADER = ("version", "server_name", "map_name", "game_type", "num_players", "max_players",
          "num_clients", "max_clients")
FORMATS = {
    "inf3": (0, (1, 2, 3, 4, 6, 7, 8, 9), 10, 5),
    "dtsf": (1, (1, 2, 3, 4, 6, 7, 8, 9), 11, 5),
    "iext": (2, (1, 2, 3, 6, 8, 9, 10, 11), 13, 6),
    "iex+": (3, None, 2, 6),
    "inf3/7": (4, (1, 2, 4, 5, 8, 9, 10, 11), 12, 5),
}
# Version 0.7 packs whole numbers into one to five bytes: an extend bit, a sign bit
# and six bits, then extend bits and seven bits each, lowest first. The bytes are
# read as ISO 8859-1, so a character is a byte. Numbers cut off at the end are 0.
TEXT_7 = r"([^\x00]*+)\x00"
NUMBER_7 = r"([\x80-\xff]{4}(?:[\x00-\xff]|\z)|[\x80-\xff]{0,3}(?:[\x00-\x7f]|\z))"
HEAD_7 = r"\A" + NUMBER_7 + 5 * TEXT_7 + 6 * NUMBER_7
CLIENT_7 = r"\G" + 2 * TEXT_7 + 3 * NUMBER_7
CUT_7 = "\u0100"
MASTER_LIST = "lis2"
RECORD = 18
IPV4_PREFIX = "00000000000000000000FFFF"


def magic_hex(name: str) -> str:
    return MAGIC + name.encode().hex().upper()


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _by_format(value) -> Column:
    """CASE over the format name of a row."""
    column = None
    for name, spec in FORMATS.items():
        branch = value(*spec)
        test = F.col("_format") == name
        column = F.when(test, branch) if column is None else column.when(test, branch)
    return column


def _start(payload: str = "payload") -> Column:
    """Where the four 0xff bytes begin, from 1; null for other datagrams."""
    first = F.hex(F.expr(f"substring({payload}, 1, 1)"))
    return F.when(first == PAYLOAD_MARK, 7).when(first.isin(*PAYLOAD_MARKS_7), 10)


def _format() -> Column:
    """Name of the format, null if unknown."""
    magic = F.hex(F.expr("substring(payload, _start, 8)"))
    found = F.when((magic == magic_hex("inf3")) & (F.col("_start") == 10), "inf3/7")
    for name in FORMATS:
        found = found.when(magic == magic_hex(name), name)
    return found


def unpacked_number(piece: Column) -> Column:
    """Value of a packed number, given as a text of a character per byte."""
    byte = [F.ascii(F.substring(piece, i, 1)) for i in range(1, 6)]
    first = byte[0].bitwiseAND(0x3F)
    whole = first
    for i, mask in enumerate((0x7F, 0x7F, 0x7F, 0x0F)):
        whole = whole.bitwiseOR(F.shiftleft(byte[i + 1].bitwiseAND(mask), 6 + 7 * i))
    value = F.when(byte[0] < 0x80, first).otherwise(whole)
    return value.bitwiseXOR(F.when(byte[0].bitwiseAND(0x40) != 0, -1).otherwise(0))


def _pieces(source: Column, pattern: str, groups: int) -> Column:
    """What the groups of ``pattern`` hold in ``source``, by one match for all of them. No
    byte is the character between them."""
    return F.split(F.regexp_replace(source, F.lit(pattern), F.lit(CUT_7.join(f"${i + 1}" for i in range(groups)))), CUT_7)


def _text_7(piece: Column) -> Column:
    return F.encode(piece, "ISO-8859-1").cast("string")


def _clients_7(found: Column) -> Column:
    """Clients of a 0.7 answer from their bytes."""

    def client(p: Column) -> Column:
        playing = F.ascii(p[4]).bitwiseAND(1) == F.shiftright(F.ascii(p[4]), 6).bitwiseAND(1)  # 1: spectator, 2: bot
        return F.struct(
            _text_7(p[0]).alias("player"), _text_7(p[1]).alias("clan"), unpacked_number(p[2]).alias("country"),
            unpacked_number(p[3]).alias("score"), F.coalesce(playing, F.lit(False)).alias("in_game"))

    # The parameter of the outer lambda holds what is matched, so that no field matches again.
    return F.transform(F.transform(found, lambda c: _pieces(c, CLIENT_7, 5)), client)


def decode_server_info(packets: DataFrame) -> DataFrame:
    """One row per recognised answer: source rank, header fields (null where
    the format has none), ``clients`` and whether the answer is well formed.
    Formats are those of version 0.6 and the packed one of 0.7.
    Datagrams that are no answers are skipped; an answer of an unknown format is a
    malformed one."""
    packed = F.col("_format") == "inf3/7"
    body = F.expr("substring(payload, _start + 8)")
    rest = F.expr("substring(_body, length(_head) + 1)")
    # A 0.7 answer is a head and whole clients, nothing else.
    whole_7 = (F.col("_head") != "") & (F.length("_head") + F.length(F.array_join("_found", "")) == F.length("_body"))
    rows = (
        packets.withColumn("_start", _start())
        .where("_start is not null")
        .withColumn("_format", _format())
        .withColumn("_body", F.when(packed, F.decode(body, "ISO-8859-1")))
        .withColumn("_head", F.when(packed, F.regexp_extract("_body", HEAD_7, 0)))
        .withColumn("_found", F.when(packed, F.regexp_extract_all(rest, F.lit(CLIENT_7), F.lit(0))))
        # A list of one: filters on what follows can't be pushed below, where they
        # would repeat all of the above for each field that they name.
        .select("poll", "arrival", "_format", F.inline(F.array(F.struct(
            F.when(packed, whole_7).alias("_whole"), F.col("_head"), F.col("_found"),
            F.when(~packed, F.split(body.cast("string"), "\\x00")).alias("_fields")))))
        .withColumn("_pieces", F.when(F.col("_whole"), _pieces(F.col("_head"), HEAD_7, 12)))
        .withColumn("_count", F.size("_fields") - 1)
        .withColumn("_base", _by_format(lambda rank, header, base, stride: F.lit(base)))
        .withColumn("_stride", _by_format(lambda rank, header, base, stride: F.lit(stride)))
        .withColumn("_clients", F.expr("(_count - _base) div _stride"))
    )

    def header_field(i: int) -> Column:
        text = _by_format(
            lambda rank, header, base, stride:
            F.lit(None) if header is None else F.get("_fields", F.lit(header[i]))
        )
        piece = F.get("_pieces", F.lit(FORMATS["inf3/7"][1][i]))
        if i < 4:
            return F.when(packed, _text_7(piece)).otherwise(text)
        return F.when(packed, unpacked_number(piece)).otherwise(_number(text))

    def client(i: Column) -> Column:
        def field(n: int) -> Column:
            return F.get("_fields", F.col("_base") + i * F.col("_stride") + n)

        return F.struct(
            field(0).alias("player"), field(1).alias("clan"),
            _number(field(2)).alias("country"), _number(field(3)).alias("score"),
            F.coalesce(_number(field(4)) != 0, F.lit(True)).alias("in_game"),
        )

    whole = F.col("_base").isNotNull() & (F.col("_count") >= F.col("_base")) & (
        F.col("_count") == F.col("_base") + F.col("_clients") * F.col("_stride")
    ) & (F.get("_fields", F.col("_count")) == "")
    # A list of one dummy index is cut away again for empty client lists.
    last = F.greatest(F.col("_clients"), F.lit(1)).cast("int") - 1
    indices = F.slice(F.sequence(F.lit(0), last), 1, F.greatest("_clients", F.lit(0)).cast("int"))
    return rows.select(
        "poll", "arrival",
        _by_format(lambda rank, header, base, stride: F.lit(rank)).alias("source"),
        _by_format(lambda rank, header, base, stride: F.lit(header is not None)).alias("has_header"),
        *[header_field(i).alias(name) for i, name in enumerate(HEADER)],
        F.when(F.col("_whole"), _clients_7(F.col("_found"))).otherwise(F.transform(indices, client)).alias("clients"),
        F.coalesce(F.when(packed, F.col("_whole")).otherwise(whole), F.lit(False)).alias("valid"),
    )


def merge_polls(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, clients) of each poll from its answers.

    A malformed answer spoils its poll. The last answer with a header gives the
    header (blank and zero when none has one); a player in several answers
    keeps its first place and takes the values of the richest source.
    """
    head = F.struct("arrival", *HEADER)
    # Answers of no poll spoil none.
    latest = (
        responses.groupBy("poll")
        .agg(F.max(F.when(F.col("has_header"), head)).alias("_h"), F.bool_and("valid").alias("_good"))
        .where(F.col("_good") | F.col("poll").isNull())
    )
    headers = latest.select(
        "poll",
        *[
            F.coalesce(F.col(f"_h.{n}"), F.lit("") if i < 4 else F.lit(0)).alias(n)
            for i, n in enumerate(HEADER)
        ],
    )

    spoiled = responses.where(~F.col("valid")).select("poll").distinct()
    good = responses.join(spoiled, "poll", "left_anti")
    # An outer one: for others Spark asks for the size of the list first, and makes it twice.
    rows = good.select("poll", "arrival", "source", F.posexplode_outer("clients").alias("_at", "_c")).where("_at is not null")
    place = F.struct("arrival", "_at")
    values = ["clan", "country", "score", "in_game"]
    best = F.min(F.struct(
        (-F.col("source")).alias("rank"), place.alias("place"),
        *[F.col(f"_c.{v}").alias(v) for v in values],
    ))
    clients = (
        rows.groupBy("poll", F.col("_c.player").alias("player"))
        .agg(F.min(place).alias("ordinal"), best.alias("_best"))
        .select("poll", "player", "ordinal", *[F.col(f"_best.{v}").alias(v) for v in values])
        .withColumn("clan", F.nullif("clan", F.lit("")))
    )
    return headers, clients


def decode_master_list(packets: DataFrame) -> DataFrame:
    """``poll, arrival, ordinal, ip, port`` of every listed server. Addresses
    mapped from IPv4 are dotted, others are groups of hex digits."""
    rows = (
        packets.withColumn("_start", _start())
        .where(F.hex(F.expr("substring(payload, _start, 8)")) == magic_hex(MASTER_LIST))
        .withColumn("_n", F.expr(f"(length(payload) - _start - 7) div {RECORD}").cast("int"))
        .where(F.col("_n") > 0)
        .select("poll", "arrival", "payload", "_start",
                F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("ordinal"))
        .withColumn("_r", F.expr(f"substring(payload, _start + 8 + ordinal * {RECORD}, {RECORD})"))
    )

    def part(position: int, length: int) -> Column:
        return F.hex(F.expr(f"substring(_r, {position}, {length})"))

    def number(hexed: Column) -> Column:
        return F.conv(hexed, 16, 10)

    dotted = F.concat_ws(".", *[number(part(p, 1)) for p in range(13, 17)])
    groups = F.lower(F.concat_ws(":", *[part(p, 2) for p in range(1, 17, 2)]))
    return rows.select(
        "poll", "arrival", "ordinal",
        F.when(part(1, 12) == IPV4_PREFIX, dotted).otherwise(groups).alias("ip"),
        number(part(17, 2)).cast("int").alias("port"),
    )
