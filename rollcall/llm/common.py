"""Helpers shared by the operators."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import remove, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
ROWS_AT_ONCE = 1000
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what is expensive runs
    once, and the loss of any executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame | None) -> None:
    """Remove the files of a staged frame that nothing reads any more."""
    if df is not None and hasattr(df, "_staged_path"):
        remove(df.sparkSession, df._staged_path)


def packed(df: DataFrame, **columns) -> DataFrame:
    """One struct ``row`` with all columns of ``df`` and the given expressions
    beside it, so that names of extra columns can't clash with ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), *[expr.alias(name) for name, expr in columns.items()])


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, whose rows are about to pass through Python with their texts: the
    session then hands over ``ROWS_AT_ONCE`` of them at a time, not ten thousand."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    return df


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a task; Arrow's free memory goes back when they are through."""
    yield from batches
    pa.default_memory_pool().release_unused()


def with_text(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """One struct ``row`` with all columns of ``df``, and the number of the one
    named ``text``, as a string: rows that pass through Python carry texts once."""
    few_rows(df)
    name = next(c for c in df.columns if c.lower() == text.lower())
    if df.schema[name].dataType != T.StringType():
        df = df.withColumn(name, F.col(f"`{name}`").cast("string"))
    return packed(df), df.columns.index(name)


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("row.*", *more)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (runs of bytes other than ASCII blanks), in lists cut
    from about ``size`` bytes, so that a very long text takes bounded memory."""
    start = 0
    while start < len(text):
        cut = BLANK.search(text, min(start + size, len(text)))
        stop = cut.start() if cut else len(text)
        words = text[start:stop].split()
        if words:
            yield words
        start = stop + 1


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` rows by the links (a, b),
    starting from the components in ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; only the rows of
    the last, still open group wait for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        start = group_starts(table, keys)
        cut = int(start[-1]) if len(start) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins."""
    if table.num_rows == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        v = table.column(key).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def block_pairs(df: DataFrame, keys: list[str], spread: str, block: int) -> DataFrame:
    """Deal the rows of each group of ``keys`` to units ``(keys, unit_a, unit_b)``
    in which every pair of rows of the group meets exactly once.

    A group of up to ``block`` rows is one unit. A larger one is cut by hash of
    ``spread`` into blocks, and each pair of blocks is a unit: a row goes to as
    many units as the group has blocks, no unit holds more than about two
    blocks, and no pair of rows is ever written out. Adds ``part``, the row's
    block: rows of a unit with ``unit_a < unit_b`` are compared across parts only.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    blocks = F.ceil(F.col("group_rows") / F.lit(block)).cast("int")
    return (
        df.join(counts, keys)
        .withColumn("part", F.pmod(F.xxhash64(spread, F.lit("part")), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("unit_a", F.least("part", "other"))
        .withColumn("unit_b", F.greatest("part", "other"))
        .drop("other", "group_rows")
    )


class Shipped:
    """A small file's content on its way to the executors: broadcast, and known by
    its digest, so that a Python worker can keep what it built from it."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.digest = hashlib.sha256(content).digest()
        self._content = spark.sparkContext.broadcast(content)

    @property
    def content(self) -> bytes:
        return self._content.value

    def __eq__(self, other):
        return isinstance(other, Shipped) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)


class Memo:
    """Results of ``learn`` (a list of distinct keys to a list of results), kept for
    up to about ``most`` keys; when they are more, those last asked for stay."""

    def __init__(self, learn: Callable[[list], list], most: int):
        self.learn, self.most, self.known = learn, most, {}

    def of(self, keys: list) -> list:
        known = self.known
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            known.update(zip(new, self.learn(new), strict=True))
        out = [known[k] for k in keys]
        if len(known) > self.most:
            self.known = dict(zip(keys, out))
        return out


IS_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
RUN_OF_BLANKS = re.compile(rb"(?<![\x20\x09-\x0D])[\x20\x09-\x0D]")


def chunks_of(texts: list[bytes], cut: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts cut before each run of ASCII blanks: the number of each chunk among
    the distinct ones, those, and the number of chunks up to the end of each text.
    ``cut`` has two tables of bytes; texts are also cut between one of the first
    and one of the second."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    blank = IS_BLANK[data]
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    if cut is not None:
        start[1:] |= cut[0][data[:-1]] & cut[1][data[1:]]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start[(ends - [len(t) for t in texts])[[bool(t) for t in texts]]] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(at, ends)


def ids_by_chunk(
    texts: list[bytes], of: Callable[[list[bytes]], list[bytes]], cut: tuple[np.ndarray, np.ndarray] | None = None, size: int = 1 << 22,
) -> list[bytes]:
    """Ids (4 bytes each) of each text, where ``of`` gives those of chunks
    (:func:`chunks_of`) and no token reaches over a chunk's end. About ``size``
    bytes are held at a time."""
    out = [b""] * len(texts)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        codes, distinct, upto = chunks_of([t for _, t in held], cut)
        ids = of(distinct)
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), dtype="<i4"), np.cumsum(count) - count
        n = count[codes]
        stop = np.append(0, np.cumsum(n))
        data = flat[np.repeat(first[codes] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        ends = 4 * stop[upto]
        for (i, _), a, b in zip(held, np.append(0, ends[:-1]).tolist(), ends.tolist()):
            out[i] = out[i] + data[a:b] if out[i] else data[a:b]
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            blank = RUN_OF_BLANKS.search(text, at + size)
            stop = blank.start() if blank else len(text)
            held.append((i, text[at:stop]))
            waiting, at = waiting + stop - at, stop
            if waiting >= size:
                flush()
                waiting = 0
    if held:
        flush()
    return out
