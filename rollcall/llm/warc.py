"""WARC archives of web pages: a writer that replaces repeated payloads by revisit
records, and a reader that salvages what stands behind damage.

A file is a sequence of gzip members of one record each, or of bare records:
a version line, named fields, an empty line, a block of Content-Length bytes and two
line ends. The block of a response is an HTTP head and the payload; that of a revisit
is the head alone, whose Content-Length is that of the payload it stands for.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import passing, staged
from rollcall.llm.token_files import file_system
from rollcall.session import shared_folder

LEAST_PAYLOAD = 100  # bytes from which a repeated payload is replaced
FILE_BYTES = 256 << 20  # of a finished file, about
LARGEST = 1 << 30  # bytes of a record that the reader takes in
DATE = "2000-01-01T00:00:00Z"  # the tables don't tell when a page was fetched
LEVEL = 6
# Fixed values of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
UNSAFE = re.compile(rb"[^\x21-\x7E]")


class Broken(ValueError):
    """What stands at a place isn't a whole and sound record."""


# Writing


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in fields],
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def address(url: str | None, record_id: str) -> str:
    """A URL fit for a field; one that is null or empty becomes the record's own id."""
    return UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode() if url else record_id


def page_id_of(number: int | None) -> str:
    return f"page:{'' if number is None else number}"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    own = page_id_of(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", address(url, own)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        return record("revisit", own, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{page_id_of(first)}>")], head)
    return record("response", own, fields, head + payload)


def with_first(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """(page_id, url, html, digest, first, revisit) of every page. Payloads of at
    least ``least`` bytes are counted by digest; only digests of several pages, a row
    each, meet the pages again."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    number = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    long_ = F.octet_length("html") >= least
    repeated = staged(
        rows.where(long_).groupBy("digest").agg(F.min(number).alias("first"), F.max(number).alias("last"))
        .where("first <> last").select(F.col("digest").alias("of"), F.col("first.page_id").alias("first"))
    )
    # Small payloads can't meet: they go by page, so that empty ones aren't one hot key.
    key = F.when(long_, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(repeated, F.col("key") == F.col("of"), "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))


def write(
    pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD, page_id: str = "page_id", url: str = "url", html: str = "html",
    packed: bool = True, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row to files of about ``file_bytes`` in ``folder``; returns
    the files: (path, records, bytes), already written.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest
    page_id (nulls last) is a response, the others are revisits of it; all others are
    responses. ``packed`` writes a gzip member per record, else bare records. A task
    writes under names of its own attempt, and only those of the attempts that counted
    are returned, so tasks can be repeated. ``folder`` must be reachable by all
    executors.

    A null html is an empty payload, a null url the record's own id. Rows that repeat a
    page_id with an equal payload are all responses: neither is another page. Very long
    payloads are written whole, one at a time. Extra columns are ignored; an empty table
    writes no file.
    """
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fs, base = TaskContext.get(), *file_system(folder)
        out, path, done, size, number = None, "", 0, 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [done], "bytes": [size]})

        for batch in passing(batches):
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc{'.gz' if packed else ''}"
                    out, done, size, number = fs.open_output_stream(f"{base}/{path}", compression=None), 0, 0, number + 1
                    about = record("warcinfo", uuid.uuid5(uuid.NAMESPACE_URL, path).urn, [("WARC-Filename", path), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += out.write(member(about) if packed else about)
                page, url_, html_, digest, first, revisit = (c[i].as_py() for c in columns)
                data = page_record(page, url_, html_.encode(), digest, first, revisit)
                size += out.write(member(data) if packed else data)
                done += 1
                if size >= file_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    rows = with_first(pages, page_id, url, html, least)
    return staged(rows.mapInArrow(store, "path string, records long, bytes long"))


# Reading


class Record(NamedTuple):
    kind: str
    record_id: str
    target_uri: str | None
    refers_to: str | None
    payload_bytes: int | None
    payload_digest: str | None  # SHA-256, lower-case hex
    payload: bytes | None


class Gap(NamedTuple):
    start: int
    stop: int
    reason: str


class Window:
    """Bytes of a stream by their place in it; what lies before the last kept place is let go."""

    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.held, self.base, self.over = stream, size, bytearray(), 0, False

    def _upto(self, stop: int) -> None:
        while not self.over and self.base + len(self.held) < stop:
            data = self.stream.read(max(self.size, stop - self.base - len(self.held)))
            self.held += data
            self.over = not data

    def at(self, start: int, size: int) -> bytes:
        """Up to ``size`` bytes, fewer at the end."""
        self._upto(start + size)
        return bytes(self.held[start - self.base:start - self.base + size])

    def find(self, mark: bytes, start: int) -> int:
        """Place of the next ``mark``, or the stream's end; bytes before it are let go."""
        while True:
            self._upto(start + self.size)
            at = self.held.find(mark, start - self.base)
            if at >= 0:
                return self.base + at
            end = self.base + len(self.held)
            if self.over:
                return end
            start = max(start, end - len(mark) + 1)
            self.keep(start)

    def keep(self, start: int) -> None:
        if start - self.base >= 4 * self.size:
            del self.held[:start - self.base]
            self.base = start


def hex_digest(field: str | None, name: str) -> str | None:
    """The digest in a field as lower-case hex, if it is one by ``name`` (hex or base 32)."""
    label, _, value = (field or "").partition(":")
    if label.lower().replace("-", "") != name:
        return None
    size = hashlib.new(name).digest_size
    if len(value) == 2 * size:
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except binascii.Error:
        return None


def check(field: str | None, data: bytes, what: str) -> None:
    for name in ("sha256", "sha1", "md5"):
        told = hex_digest(field, name)
        if told is not None and told != hashlib.new(name, data).hexdigest():
            raise Broken(f"{what} digest differs")


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields of a head in lower case; a line that begins with a blank goes on with the last."""
    out, last = {}, None
    for line in head.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif text:
            name, colon, value = text.partition(":")
            if not colon:
                raise Broken("a field without a colon")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def parsed(at: Callable[[int, int], bytes], start: int, largest: int = LARGEST) -> tuple[Record, int]:
    """The record at ``start`` of what ``at(place, size)`` gives, and where it ends."""
    size = 4096
    while (end := (head := at(start, size)).find(b"\r\n\r\n")) < 0:
        if len(head) < size or size > 1 << 20:
            raise Broken("no end of the head" if VERSION.match(head) else "no version line")
        size *= 4
    version = VERSION.match(head)
    if not version:
        raise Broken("no version line")
    if VERSION.search(head, version.end(), end):
        raise Broken("a head goes over into another")
    fields = fields_of(head[version.end():end])
    length = fields.get("content-length", "")
    if not length.isdecimal():
        raise Broken("no content length")
    if int(length) > largest:
        raise Broken("longer than a record may be")
    body = start + end + 4
    block, close = at(body, int(length)), at(body + int(length), 4)
    if len(block) < int(length):
        raise Broken("cut off")
    if close != b"\r\n\r\n":
        raise Broken("no line ends behind the block")
    check(fields.get("warc-block-digest"), block, "block")
    return _record(fields, block), body + int(length) + 4


def _record(fields: dict[str, str], block: bytes) -> Record:
    kind = fields.get("warc-type", "").lower()
    told, http = fields.get("warc-payload-digest"), fields.get("content-type", "").lower().startswith("application/http")
    head, _, rest = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if kind == "revisit":
        lines = fields_of(head.partition(b"\r\n")[2]) if http else {}
        length = lines.get("content-length", "")
        payload, size, digest = None, int(length) if length.isdecimal() else None, hex_digest(told, "sha256")
    else:
        check(told, rest, "payload")
        payload, size, digest = rest, len(rest), hashlib.sha256(rest).hexdigest()
    bare = lambda name: (fields.get(name) or "").strip("<>") or None
    return Record(kind, bare("warc-record-id") or "", bare("warc-target-uri"), bare("warc-refers-to"), size, digest, payload)


def unpacked(window: Window, start: int, largest: int = LARGEST) -> tuple[bytes, int]:
    """Content of the gzip member at ``start``, checked by its CRC, and where it ends."""
    unpacker, out, held, at, size = zlib.decompressobj(31), [], 0, start, 1 << 14
    while not unpacker.eof:
        data = window.at(at, size)
        if not data:
            raise Broken("cut off")
        try:
            out.append(unpacker.decompress(data))
        except zlib.error as e:
            raise Broken("no sound gzip member") from e
        held, at, size = held + len(out[-1]), at + len(data), min(4 * size, 1 << 20)
        if held > largest + (1 << 20):
            raise Broken("longer than a record may be")
    return b"".join(out), at - len(unpacker.unused_data)


def salvage(stream, largest: int = LARGEST) -> Iterator[tuple[int, Record] | Gap]:
    """(place, record) of every sound record of a file, and the gaps between them.

    Records are read one after the other. Where the checks fail (gzip's CRC, version
    line, head, length, line ends, digests), the reader goes to the next start of a
    gzip member, or in a file of bare records to the next version line, until a place
    passes all checks; the bytes between are a gap with the reason of its first failure.
    A record is taken as a whole or not at all.
    """
    window, place, gap = Window(stream), 0, None
    packed = window.at(0, 3) == GZIP or not VERSION.match(window.at(0, 10)) and _first(window, GZIP) < _first(window, b"WARC/1.")
    while window.at(place, 1):
        try:
            if packed:
                content, stop = unpacked(window, place, largest)
                found = list(_inside(content, largest))
                if not any(isinstance(x, Record) for x in found):
                    raise Broken(found[0].reason if found else "an empty member")
            else:
                one, stop = parsed(window.at, place, largest)
                found = [one]
        except Broken as e:
            gap = gap or Gap(place, place, str(e))
            place = window.find(GZIP if packed else b"WARC/1.", place + 1)
            continue
        if gap:
            yield gap._replace(stop=place)
            gap = None
        for x in found:
            yield (place, x) if isinstance(x, Record) else Gap(place, stop, x.reason)
        place = stop
        window.keep(place)
    if gap:
        yield gap._replace(stop=place)


def _first(window: Window, mark: bytes) -> int:
    """Place of ``mark`` in the first megabyte, or behind it."""
    data = window.at(0, window.size)
    at = data.find(mark)
    return at if at >= 0 else len(data) + 1


def _inside(content: bytes, largest: int) -> Iterator[Record | Gap]:
    """Records of a gzip member, mostly one, and what isn't sound between them."""
    at, gap = 0, None
    while at < len(content):
        try:
            one, stop = parsed(lambda a, n: content[a:a + n], at, largest)
        except Broken as e:
            gap = gap or Gap(at, at, str(e))
            following = content.find(b"WARC/1.", at + 1)
            at = following if following >= 0 else len(content)
            continue
        if gap:
            yield gap
            gap = None
        yield one
        at = stop
    if gap:
        yield gap


READ = (
    "path string, start long, stop long, reason string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True, largest: int = LARGEST) -> DataFrame:
    """Everything in the files of ``folder`` that ``files(path)`` names, sound or not.

    A record has its place ``start``, its fields, and its payload if ``payloads``; a
    revisit has the length and digest of the payload it stands for. A quarantined gap
    has ``start``, ``stop`` and the ``reason``, and nothing else: :func:`records` and
    :func:`gaps` tell them apart. Members that hold several records share a place.
    ``payload_digest`` is SHA-256; other digests are checked where they are given.

    A task reads a file as a stream and holds one record at a time, of ``largest``
    bytes at most; what is larger is a gap. A null or repeated path is read never or as
    often; an empty file and an empty table of files give no rows.
    """
    paths = files.where("path is not null").select("path")
    todo = paths.repartition(max(1, paths.count()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        kind, rows, held = schema, [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for x in salvage(stream, largest):
                        if isinstance(x, Gap):
                            rows.append((path, *x, *[None] * 7))
                        else:
                            start, r = x
                            rows.append((path, start, None, None, *r[:6], r.payload if payloads else None))
                            held += len(r.payload or b"") if payloads else 0
                        if len(rows) >= 4096 or held >= 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in READ.split(","))])
    return todo.mapInArrow(scan, READ)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason is null").drop("stop", "reason")


def gaps(found: DataFrame) -> DataFrame:
    """The log of what was left out: (path, start, stop, reason)."""
    return found.where("reason is not null").select("path", "start", "stop", "reason")


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages
    that :func:`write` wrote."""
    number = lambda c: F.when(F.length(c) > 5, F.expr(f"substring({c}, 6)").cast("long"))
    return (
        records(found).where("record_type in ('response', 'revisit') and record_id like 'page:%'")
        .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    )


def new_folder(spark: SparkSession) -> str:
    """A folder for archives beside the cluster's checkpoints."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
