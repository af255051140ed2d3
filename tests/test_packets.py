from pyspark.sql import functions as F

from rollcall.operators import prepare
from rollcall.plans import answers
from rollcall.sources import packets
from tests.conftest import rows


def answer(magic, *fields):
    head = b"\xff" * 6 + b"\xff" * 4 + magic.encode()
    return bytearray(head + b"".join(str(f).encode() + b"\0" for f in fields))


def vanilla(clients, magic="inf3", extra=()):
    return answer(magic, "tok", "0.6.4", "srv ü", "ctf5", "CTF", "0", 1, 8, len(clients), 16, *extra,
                  *[f for c in clients for f in c])


def extended(clients):
    return answer("iext", "tok", "0.6.5", "ext", "dm1", "crc", "size", "DM", "0", 2, 8, 3, 32, "",
                  *[f for c in clients for f in (*c, "")])


def more(clients):
    return answer("iex+", "tok", "1", *[f for c in clients for f in (*c, "")])


A, B = ("name1", "clan1", -1, 10, 1), ("name2", "", 64, -3, 0)


def table(spark, *payloads):
    return spark.createDataFrame(
        [(p, i, b) for i, (p, b) in enumerate(payloads)], "poll long, arrival int, payload binary")


def test_all_formats(spark):
    df = table(spark, (1, vanilla([A, B])), (2, vanilla([A, B], "dtsf", ("0",))), (3, extended([A, B])),
               (4, more([A, B])), (5, bytearray(b"\x04" + bytes(11))), (6, vanilla([])))
    got = {r.poll: r for r in packets.decode_server_info(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6] and all(r.valid for r in got.values())
    for p in (1, 2, 3, 4):
        assert [tuple(c) for c in got[p].clients] == [("name1", "clan1", -1, 10, True), ("name2", "", 64, -3, False)]
    assert (got[1].server_name, got[1].map_name, got[1].game_type, got[1].max_clients) == ("srv ü", "ctf5", "CTF", 16)
    assert (got[3].map_name, got[3].game_type, got[3].num_players) == ("dm1", "DM", 2)
    assert got[4].server_name is None and not got[4].has_header and got[6].clients == []
    assert [got[p].source for p in (1, 2, 3, 4)] == [0, 1, 2, 3]


def test_answers_of_a_poll_merge(spark):
    richer = ("name1", "clanX", 5, 99, 0)
    df = table(spark, (1, vanilla([A, B, B])), (1, extended([("name3", "", 0, 1, 1), richer])),
               (1, vanilla([("name1", "late", 0, 0, 1)])), (2, more([A])), (3, vanilla([A])), (3, vanilla([A])[:-1]))
    headers, clients = packets.merge_polls(packets.decode_server_info(df))
    assert rows(headers, "poll", "server_name", "max_clients") == [(1, "srv ü", 16), (2, "", 0)]
    got = [tuple(r) for r in clients.orderBy("poll", "ordinal").select(
        "poll", "player", "clan", "score", "in_game").collect()]
    assert got == [(1, "name1", "clanX", 99, False), (1, "name2", None, -3, False), (1, "name3", None, 1, True),
                   (2, "name1", "clan1", 10, True)]


def test_an_unknown_format_spoils_its_poll(spark):
    df = table(spark, (1, vanilla([A])), (1, answer("what", "tok", "x")), (2, vanilla([B])), (2, bytearray(b"\x04" + bytes(30))))
    found = packets.decode_server_info(df)
    assert rows(found, "poll", "valid") == [(1, False), (1, True), (2, True)]
    headers, clients = packets.merge_polls(found)
    assert rows(headers, "poll") == [(2,)] and rows(clients, "poll", "player") == [(2, "name2")]


def packed(value):
    """A whole number in the packed form of version 0.7."""
    sign, value = (0x40, ~value) if value < 0 else (0, value)
    out, value = [sign | value & 0x3F], value >> 6
    while value:
        out[-1] |= 0x80
        out.append(value & 0x7F)
        value >>= 7
    return bytes(out)


def answer7(*fields, magic="inf3"):
    body = b"".join(packed(f) if isinstance(f, int) else f.encode() + b"\0" for f in fields)
    return bytearray(b"\x21" + bytes(range(1, 9)) + b"\xff" * 4 + magic.encode() + body)


HEAD7 = (0, "0.7.5", "srv ü", "host", "ctf5", "CTF", 1, 1, 1, 8, 2, 16)


def test_packed_numbers(spark):
    values = [0, 1, 63, 64, -1, -64, -65, 8191, 8192, 1234567, -1234567, 2**27 - 1, 2**27, 2**31 - 1, -2**31]
    df = spark.createDataFrame([(v, bytearray(packed(v))) for v in values], "v long, b binary")
    got = df.select("v", packets.unpacked_number(F.decode("b", "ISO-8859-1")).alias("got")).collect()
    assert len(got) == len(values) and all(r.v == r.got for r in got)


def test_merging_does_not_repeat_the_decoding(spark):
    _, clients = packets.merge_polls(packets.decode_server_info(table(spark, (1, vanilla([A])))))
    # Once for the answers and once for the spoiled polls.
    assert clients._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_packed_answers(spark):
    many = [f for i in range(200) for f in (f"p{i}", "", i * 1000 - 50, -i * 777777, i % 4)]
    df = table(
        spark, (1, answer7(*HEAD7, "player1", "clän1", -1, 10, 0, "spectator1", "", 64, -3, 1)), (2, answer7(*HEAD7)),
        (3, answer7(*HEAD7, *many)), (4, bytearray(b"\x04" + bytes(11))), (5, vanilla([A])),
        (5, answer7(*HEAD7, "name1", "seven", 7, -7, 3)))
    found = packets.decode_server_info(df)
    assert all(r.valid and r.has_header for r in found.collect())
    headers, clients = packets.merge_polls(found)
    assert rows(headers, "poll", *packets.HEADER)[0] == (1, "0.7.5", "srv ü", "ctf5", "CTF", 1, 8, 2, 16)
    assert rows(headers, "poll") == [(1,), (2,), (3,), (5,)]
    got = [tuple(r) for r in clients.orderBy("poll", "ordinal").select(
        "poll", "player", "clan", "country", "score", "in_game").collect()]
    assert got[:2] == [(1, "player1", "clän1", -1, 10, True), (1, "spectator1", None, 64, -3, False)]
    assert got[2:-1] == [(3, f"p{i}", None, i * 1000 - 50, -i * 777777, i % 2 == 0) for i in range(200)]
    assert got[-1] == (5, "name1", "seven", 7, -7, False)


def test_broken_packed_answers(spark):
    whole = answer7(*HEAD7, "player1", "c", -1, 100000, 0)
    df = table(
        spark, (1, whole[:-2]), (2, whole[:-8]), (3, answer7(*HEAD7[:-2])), (4, answer7(*HEAD7[:4])[:-1]),
        (5, answer7(0)), (6, answer7(*HEAD7, magic="what")))
    got = {r.poll: r for r in packets.decode_server_info(df).collect()}
    # Numbers that are cut off count as 0, unterminated texts and unknown formats are malformed.
    assert {p: r.valid for p, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert [tuple(c) for c in got[1].clients] == [("player1", "c", -1, 100000 & 0x1FFF, True)]
    assert (got[3].max_players, got[3].num_clients, got[3].max_clients) == (8, 0, 0)


def test_master_lists(spark):
    v4 = bytes(10) + b"\xff\xff\x01\x02\x03\x04\x20\x6f"
    v6 = bytes.fromhex("20010db8000000000000000000000001") + b"\x20\x70"
    old = bytearray(b"\xff" * 10 + b"lis2" + v4 + v6)
    new = bytearray(b"\x21" + bytes(8) + b"\xff" * 4 + b"lis2" + v4)
    df = table(spark, (1, old), (2, new), (3, bytearray(b"\x04" + bytes(30))), (4, bytearray(b"\xff" * 10 + b"lis2")))
    got = rows(packets.decode_master_list(df), "poll", "ordinal", "ip", "port")
    assert got == [(1, 0, "1.2.3.4", 8303), (1, 1, "2001:0db8:0000:0000:0000:0000:0000:0001", 8304),
                   (2, 0, "1.2.3.4", 8303)]


def test_decoding_stays_in_the_engine(spark):
    plan = packets.decode_server_info(table(spark, (1, vanilla([A])), (2, answer7(*HEAD7))).withColumn("x", F.lit(1)))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_fields_are_matched_once(spark):
    """One match for all fields of a head, and one for those of a client."""
    found = packets.decode_server_info(table(spark, (1, answer7(*HEAD7))))
    assert plan_of(found).count("regexp_") <= 10
    headers, clients = packets.merge_polls(found)
    assert plan_of(headers).count("regexp_extract_all(") == 1
    assert plan_of(clients).count("slice(") == 1


def test_answers_of_no_poll_spoil_none(spark):
    df = table(spark, (None, vanilla([A])), (None, answer("what", "x")), (1, vanilla([B])), (1, answer("what", "x")))
    headers, clients = packets.merge_polls(packets.decode_server_info(df))
    assert rows(headers, "poll", "server_name") == [(None, "srv ü")] and rows(clients, "poll", "player") == [(None, "name1")]


def test_validity_needs_no_decoded_clients(spark):
    """Spoiled polls are found without building the fields of any client."""
    found = packets.decode_server_info(table(spark, (1, answer7(*HEAD7, "a", "", 1, 100000, 0)), (2, answer7(*HEAD7, "a", "")[:-1])))
    assert "transform(" not in plan_of(found.select("poll", "valid"))
    assert rows(found, "poll", "valid") == [(1, True), (2, False)]


def test_numbers_are_packed_as_one(spark):
    values = [s * (2**k + d) for k in range(31) for d in (-1, 0, 1) for s in (1, -1)] + [2**31 - 1, -2**31]
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", F.unhex(answers.packed(F.col("v"))).alias("b"))
    assert all(bytes(r.b) == packed(r.v) for r in df.collect())
    plan = plan_of(spark.range(1).select(answers.packed(F.col("id").cast("int")).alias("b")))
    assert plan.count("lpad(") == 1


def test_regrouping_compares_no_struct_within_a_struct(spark):
    place = F.struct(F.col("a"), F.col("b")).alias("ordinal")
    flat = spark.createDataFrame([(1, 2, None, "x"), (1, 1, 5, "y"), (1, None, 7, "z"), (1, 2, 1, "w"), (1, 2, 1, "v")],
                                 "snapshot_id long, a int, b int, player string").select("snapshot_id", place, "player")
    found = prepare.regroup(flat, ["player"])
    assert [c.player for c in found.first().clients] == ["z", "y", "x", "v", "w"]
    assert "struct(ordinal" not in plan_of(found) and "_place_" in plan_of(found)
