"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds, end to end:

* data frames: each an independent zstandard frame of up to ``FRAME_IDS`` ids,
  little-endian unsigned 32-bit integers, documents one after the other;
* an index frame of 16 bytes per document: doc_id (signed, the smallest number
  for a null id) and the number of its ids (unsigned);
* a skippable frame, the seek table: for every frame above its compressed size,
  its content's size and the low 32 bits of the content's XXH64, each 4 bytes;
  then the number of frames (4), a descriptor (1, bit 7: there are checksums) and
  the closing magic number (4). This is the seekable format of zstandard.

A reader takes the table from the end of the file, then the index, and then only
the frames that the wanted documents lie in; each is checked against its checksum.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm.common import Memo, Shipped, few_rows, ids_by_chunk, passing, texts_of
from rollcall.session import shared_folder

FRAME_IDS = 1 << 16
LEVEL = 1
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
NO_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("n", "<u8")])
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
MOST_CHUNKS = 800_000  # chunks of text whose ids a Python worker keeps
DOCS_AT_ONCE = 4096
# Fixed values of tokenizers that split into words, digits and runs of marks
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's address; one without scheme is local."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


class Writer:
    """Writes one file; ids are cut into frames wherever documents begin or end."""

    def __init__(self, out):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []
        self.open, self.held, self.total = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))
        self.total += len(ids) // 4
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME_IDS:
            data = b"".join(self.open)
            whole = len(data) - len(data) % (4 * FRAME_IDS)
            for start in range(0, whole, 4 * FRAME_IDS):
                self._frame(data[start:start + 4 * FRAME_IDS])
            self.open, self.held = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.entries.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(frame)

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.open))
        self._frame(np.array(self.index, dtype=INDEX).tobytes())
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class Reader:
    """Reads documents of one file by their number in it."""

    def __init__(self, source):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("not a file of token ids: no seek table with checksums at its end")
        self.table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype=ENTRY)
        self.place = np.append(0, np.cumsum(self.table["packed"], dtype=np.int64))
        self.starts = np.append(0, np.cumsum(self.table["size"][:-1], dtype=np.int64)) // 4
        self.index = np.frombuffer(self._content(count - 1), dtype=INDEX)
        self.offsets = np.append(0, np.cumsum(self.index["n"].astype(np.int64)))
        self.kept: tuple[int, bytes] = (-1, b"")
        if self.starts[-1] != self.offsets[-1]:
            raise ValueError("index and frames of a file of token ids don't agree")

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _content(self, k: int) -> bytes:
        entry = self.table[k]
        data = self.unpacker.decompress(self._at(int(self.place[k]), int(entry["packed"])), max_output_size=int(entry["size"]))
        if len(data) != entry["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} of a file of token ids doesn't match its checksum")
        return data

    def pieces(self, nth: int) -> Iterator[bytes]:
        """Ids of the document with number ``nth``, frame by frame; the last frame
        read is kept for the next document."""
        start, stop = int(self.offsets[nth]), int(self.offsets[nth + 1])
        k = int(np.searchsorted(self.starts, start, side="right")) - 1
        while start < stop:
            if self.kept[0] != k:
                self.kept = (k, self._content(k))
            first = int(self.starts[k])
            upto = min(stop, first + len(self.kept[1]) // 4)
            yield self.kept[1][4 * (start - first):4 * (upto - first)]
            start, k = upto, k + 1


def _letters(text: str) -> bool:
    """Whether a text has letters only, and still has in lower case."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class Chunks:
    """Ids of texts by a tokenizer whose tokens never reach over ASCII blanks: texts
    are cut there, and each distinct chunk is encoded once and looked up from then on.

    Many chunks go to the tokenizer as one text. If it splits texts by ``WORDS`` and
    marks the ends of words, chunks of letters only are a word each; they go
    separated by blanks, and the marked ids end them. Other chunks go separated by
    the string of a special token: the tokenizer splits there before all else, and
    its id tells them apart. A chunk with that string inside goes alone.
    """

    def __init__(self, content: str):
        self.tokenizer, self.memo = Tokenizer.from_str(content), Memo(self._learn, MOST_CHUNKS)
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())]
        self.id, self.mark = special[0] if special else (-1, "")
        model, split = json.loads(content), None
        if model["pre_tokenizer"]["type"] == "Sequence":
            split = model["pre_tokenizer"]["pretokenizers"][0].get("pattern")
        self.words = split == {"Regex": WORDS} and model["model"].get("end_of_word_suffix") == WORD_END
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        # Between a letter or digit and a mark WORDS ends a match, but for the apostrophe.
        inside = {c for _, t in special for c in t.encode()} | set(b"'")
        after = [c for c in range(33, 127) if not chr(c).isalnum() and c not in inside]
        before = [c for c in range(128) if chr(c).isalnum()]
        self.cut = (np.isin(np.arange(256), before), np.isin(np.arange(256), after)) if self.words else None
        self.folds = self.words and '"Lowercase"' in json.dumps(model["normalizer"])

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _together(self, texts: list[str], mark: str) -> list[bytes]:
        ids = self._encode(mark.join(texts))
        if mark == " ":
            stops = np.flatnonzero(self.ends[ids]) + 1
            starts = np.append(0, stops[:-1])
        else:
            cuts = np.flatnonzero(ids == self.id)
            starts, stops = np.append(0, cuts + 1), np.append(cuts, len(ids))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist())]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        out: list[bytes] = [b""] * len(texts)
        groups: dict[str, list[int]] = {" ": [], self.mark: [], "": []}
        for i, t in enumerate(texts):
            groups[" " if self.words and _letters(t) else "" if self.mark in t else self.mark].append(i)
        for mark, members in groups.items():
            for some in batched(members, 2048 if mark else 1):
                found = self._together([texts[i] for i in some], mark) if mark else [self._encode(texts[some[0]]).tobytes()]
                if len(found) > len(some):  # letters here, but not to the tokenizer
                    found = [self._encode(texts[i]).tobytes() for i in some]
                for i, ids in zip(some, found, strict=True):
                    out[i] = ids
        return out

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        # A-Z may be folded first, but for what could become a special token or compose.
        return self.memo.of([c.strip().lower() if self.folds and c.isascii() and b"<" not in c else c.strip() for c in chunks])

    def encode(self, texts: list[bytes], end: int | None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, ``end`` behind them."""
        close = b"" if end is None else struct.pack("<I", end)
        return [ids + close for ids in ids_by_chunk(texts, self._ids, self.cut)]


@lru_cache(maxsize=2)
def _chunks(file: Shipped) -> Chunks:
    """Built once per Python worker."""
    return Chunks(file.content.decode())


def _ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows dealt to tasks by ranges of doc_id, sorted; a hash of the text cuts a
    doc_id that very many rows share."""
    rows = few_rows(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("mark")]
    return rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)


def write(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int | None = 1,
) -> DataFrame:
    """Encode whole texts and write them to files in ``folder``, in ascending order
    of doc_id (nulls last): over the files by name, and within each. Returns the
    files: (part int, path, docs, ids), a row per file, already written.

    ``tokenizer`` is the path of a tokenizers file, read by the driver and sent to
    the tasks; its pre-tokenizer must not let tokens reach over ASCII blanks
    (:class:`Chunks`). ``end`` is appended to each document. One shuffle deals the
    texts to ranges of ids; each task encodes its range and writes one file under a
    name of its own attempt, moved to its place when whole, so tasks can be repeated.
    ``folder`` must be reachable by all executors and must not exist.

    Null texts count as empty: only ``end`` is written. Rows that repeat an id
    follow each other. Extra columns are ignored; an empty table writes no file.
    """
    file = Shipped(docs.sparkSession, tokenizer)
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, chunks, writer = task.partitionId(), None, None
        fs, base = file_system(folder)
        name, own = f"{base}/part-{part:06d}.ids.zst", f"{base}/.attempt-{part:06d}-{task.taskAttemptId()}"
        for batch in passing(batches):
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(start, DOCS_AT_ONCE)
                if writer is None:
                    chunks = _chunks(file)
                    out = fs.open_output_stream(own)
                    writer = Writer(out)
                ids = chunks.encode(texts_of(some.column("text")), end)
                for key, data in zip(some.column("doc_id").to_pylist(), ids):
                    writer.add(key, data)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [name.rsplit("/", 1)[1]], "docs": [len(writer.index)], "ids": [writer.total],
            })

    files = _ordered(docs, doc_id, text).select("doc_id", "text").mapInArrow(store, "part int, path string, docs long, ids long")
    done = sorted(files.collect())  # a row per file
    return docs.sparkSession.createDataFrame(done, "part int, path string, docs long, ids long")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that
    :func:`write` returned: ``start`` counts the ids of all documents before it,
    ``ids_crc32`` is taken over its ids as read. A task reads a file, a frame at a time."""
    before, rows = 0, []
    for f in sorted(files.collect()):
        rows.append((f["path"], before))
        before += f["ids"]
    todo = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(f"{base}/{path}") as source:
                    reader = Reader(source)
                    for start in range(0, len(reader.index), 1 << 14):
                        stop = min(start + (1 << 14), len(reader.index))
                        crc = []
                        for nth in range(start, stop):
                            value = 0
                            for piece in reader.pieces(nth):
                                value = zlib.crc32(piece, value)
                            crc.append(value)
                        ids = reader.index["doc_id"][start:stop]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            "start": pa.array(before + reader.offsets[start:stop]),
                            "n_tokens": pa.array(reader.index["n"][start:stop].astype(np.int64)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        })

    return todo.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(folder: str, path: str, wanted: list[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of one file; other frames aren't decompressed."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{path}") as source:
        reader = Reader(source)
        found = np.flatnonzero(np.isin(reader.index["doc_id"], np.array(wanted, dtype=np.int64)))
        return {int(reader.index["doc_id"][i]): np.frombuffer(b"".join(reader.pieces(i)), dtype="<u4") for i in found}


def new_folder(spark: SparkSession) -> str:
    """A folder for files beside the cluster's checkpoints."""
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
