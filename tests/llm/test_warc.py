"""WARC archives: the round trip, and what the reader salvages from damaged files."""

import hashlib
import io
import random

import pytest

from rollcall.llm import warc


def plain_pages(rows):
    firsts = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            firsts[data] = min(firsts.get(data, (2, 0)), (page_id is None, page_id or 0))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        none, first = firsts.get(data, (page_id is None, page_id or 0))
        first = None if none else first
        digest = hashlib.sha256(data).hexdigest()
        out.append((page_id, len(data), digest, *(("response", None) if first == page_id else ("revisit", first))))
    return sorted(out, key=str)


PAGES = [
    (5, "http://a.example/", "x" * 100), (3, "http://b.example/ü b", "x" * 100), (9, None, "x" * 100), (None, "http://n/", "x" * 100),
    (4, "http://c/", "x" * 99), (6, "http://d/", "x" * 99), (7, "", None), (8, "u\r\nWARC-Type: no", ""), (10, "http://e/", "é" * 50),
    (11, "http://f/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 40), (12, "http://g/", "\r\n\r\n" * 50), (13, "h", "é" * 50),
    (14, "http://long/", "".join(random.Random(1).choices("abc <>", k=300_000))), (15, "v", "y" * 500), (15, "w", "y" * 500),
]


@pytest.mark.parametrize("packed,file_bytes", [(True, 1 << 28), (False, 1 << 28), (True, 500)])
def test_round_trip(spark, packed, file_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    files = warc.write(pages, folder, packed=packed, file_bytes=file_bytes)
    found = warc.read(spark, folder, files)
    assert warc.gaps(found).count() == 0
    assert sorted((tuple(r) for r in warc.pages_of(found).collect()), key=str) == plain_pages(PAGES)
    held = {r.payload_digest: r.payload for r in warc.records(found).where("record_type = 'response'").collect()}
    assert {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in PAGES} == {k: bytes(v) for k, v in held.items()}
    urls = {r.record_id: r.target_uri for r in warc.records(found).collect()}
    assert urls["page:3"] == "http://b.example/%C3%BC%20b" and urls["page:9"] == "page:9" and "\r" not in urls["page:8"]
    assert files.count() == (files.agg({"records": "sum"}).first()[0] if file_bytes == 500 else files.count())


def test_empty_table_extra_columns_and_no_files(spark):
    kind = "page_id long, url string, html string, digest int, first string, key int"
    folder = warc.new_folder(spark)
    assert warc.read(spark, folder, warc.write(spark.createDataFrame([], kind), folder)).count() == 0
    files = warc.write(spark.createDataFrame([(1, "a", "b", 1, "c", 2)], kind), folder)
    assert warc.pages_of(warc.read(spark, folder, files)).count() == 1


def members(n, packed=True):
    out = []
    for i in range(n):
        payload = hashlib.sha256(str(i).encode()).hexdigest().encode() * (i + 1)
        data = warc.page_record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None, False)
        out.append(warc.member(data) if packed else data)
    return out


def read_back(data):
    found = list(warc.salvage(io.BytesIO(data)))
    return [x[1].record_id for x in found if not isinstance(x, warc.Gap)], [(x.start, x.stop) for x in found if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_what_it_hits_and_is_logged(packed):
    parts = members(6, packed)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    whole, ids = b"".join(parts), [f"page:{i}" for i in range(6)]
    assert read_back(whole) == (ids, [])
    assert read_back(b"junk\r\n" * 9 + whole) == (ids, [(0, 54)])
    for k in range(6):
        without, gap = ids[:k] + ids[k + 1:], [(starts[k], starts[k + 1])]
        flipped = bytearray(whole)
        flipped[(starts[k] + starts[k + 1]) // 2 if packed else starts[k + 1] - 20] ^= 0x55  # heads have no checksum of their own
        assert read_back(bytes(flipped)) == (without, gap)  # a byte differs
        flipped = bytearray(whole)
        flipped[starts[k]] ^= 0x55
        assert read_back(bytes(flipped)) == (without, gap) or not k  # the start is hidden
        lost = whole[:starts[k] + 30] + whole[starts[k + 1]:]
        assert read_back(lost) == (without, [(starts[k], starts[k] + 30)])  # cut in the middle
    assert read_back(whole[:-7]) == (ids[:-1], [(starts[5], starts[6] - 7)])
    assert read_back(whole[:starts[3]] + b"\0" * 3_000_000 + whole[starts[3]:]) == (ids, [(starts[3], starts[3] + 3_000_000)])


def test_random_damage_never_invents_records():
    rnd, parts = random.Random(4), members(8)
    whole, sound = b"".join(parts), {r.record_id: r for _, r in warc.salvage(io.BytesIO(b"".join(parts)))}
    for _ in range(200):
        data = bytearray(whole)
        for _ in range(rnd.randint(1, 4)):
            a = rnd.randrange(len(data))
            data[a:a + rnd.randint(0, 40)] = rnd.randbytes(rnd.randint(0, 40))
        covered = 0
        for x in warc.salvage(io.BytesIO(bytes(data))):
            if isinstance(x, warc.Gap):
                assert covered <= x.start < x.stop <= len(data)
                covered = x.stop
            else:
                assert sound[x[1].record_id] == x[1] and x[0] >= covered


def test_foreign_files():
    lines = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nWARC-Date: 2020\r\n more\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    sha1 = lines.replace(b"Content-Length", b"WARC-Payload-Digest: sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5\r\nContent-Length")
    assert read_back(warc.member(lines + sha1)) == (["urn:a"] * 2, [])  # several in a member
    wrong = sha1.replace(b"abc\r", b"abd\r")
    assert read_back(lines + wrong + lines) == (["urn:a"] * 2, [(len(lines), len(lines + wrong))])
    found = list(warc.salvage(io.BytesIO(warc.member(wrong + lines))))
    assert [type(x) is warc.Gap for x in found] == [True, False] and found[0].reason == "payload digest differs"
    assert read_back(b"") == ([], []) and read_back(b"nothing here") == ([], [(0, 12)])
    assert read_back(lines.replace(b": 3", b": 5000000000"))[1] == [(0, len(lines) + 9)]
