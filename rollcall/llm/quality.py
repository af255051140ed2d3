"""Quality classifier: boosted trees over statistics of whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm import gbt
from rollcall.llm.common import few_rows, passing, texts_of, unpacked, with_text, word_pieces

MOST_LABELS = 20_000  # labelled documents at most that the trees are fitted on
FEATURES = 24


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` numbers of one whole text. Only the distinct words of a text
    and a piece of it are held at a time; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digit = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    blank, wide = int(byte[32] + byte[9:14].sum()), int(byte[128:].sum())
    marks = np.concatenate([byte[33:48], byte[58:65], byte[91:97], byte[123:127]])
    share = byte[byte > 0] / n
    counts: Counter[bytes] = Counter()
    total = repeats = capital = short = long_ = tailed = 0
    last = b""
    packer, packed_size = zlib.compressobj(1), 0
    for words in word_pieces(text):
        counts.update(words)
        total += len(words)
        repeats += sum(map(bytes.__eq__, words, [last, *words]))
        last = words[-1]
        packed_size += len(packer.compress(b" ".join(words)))
    packed_size += len(packer.flush())
    letterless = 0
    for word, times in counts.items():
        capital += times * (65 <= word[0] <= 90)
        short += times * (len(word) <= 3)
        long_ += times * (len(word) >= 12)
        tailed += times * (len(word) > 1 and word[-1] in b"*%&$#!@^~|+=")
        letterless += times * (not any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in word))
    words_n = max(total, 1)
    lines = Counter(text.split(b"\n")) if byte[10] else Counter([text])
    line_n = sum(lines.values())
    return [
        math.log1p(n), math.log1p(total), (n - blank) / words_n, upper / max(upper + lower, 1), digit / n,
        int(marks.sum()) / n, int(marks.max()) / n, wide / n, blank / n, line_n / words_n,
        float(-(share * np.log(share)).sum()), len(counts) / words_n, max(counts.values(), default=0) / words_n,
        repeats / words_n, 1 - len(lines) / line_n, packed_size / n, letterless / words_n,
        int(byte[46] + byte[63] + byte[33]) / words_n, int(byte[44]) / words_n, short / words_n, long_ / words_n,
        capital / words_n, tailed / words_n, sum(sorted(counts.values())[-3:]) / words_n,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), FEATURES)


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning; a null id's isn't."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "quality",
        most: int = MOST_LABELS) -> gbt.Forest:
    """Trees fitted on the documents of at most ``most`` labels, chosen by hash of
    the id among those not held out. Labels that are null, neither 0 nor 1, or
    contradict each other are left out; of documents that repeat an id, one counts.
    Without any, every score is 0.5. The sample's ids (``most`` at most) are
    broadcast, its statistics (``most`` x ``FEATURES`` doubles) reach the driver."""
    key = F.col(f"`{doc_id}`")
    known = (
        labels.select(key.alias("doc_id"), F.col(f"`{mark}`").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = few_rows(docs).select(key.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            x = matrix(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
            )

    described = rows.mapInArrow(describe, rows.select("doc_id", "y").schema.add("x", T.ArrayType(T.DoubleType())))
    sample = described.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in sample]).reshape(len(sample), FEATURES)
    return gbt.fit(x, np.array([r["y"] for r in sample], dtype=np.float64)) if sample else gbt.constant(0.5)


def scored(docs: DataFrame, forest: gbt.Forest, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as ``row`` beside ``score``, from 0 to 1."""
    rows, nth = with_text(docs, text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            score = forest.score(matrix(texts_of(batch.column("row").field(nth))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(add, T.StructType([rows.schema["row"]]).add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "quality",
             threshold: float = 0.3, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by its whole text.

    ``score`` is the probability of label 1, ``predicted`` is 1 from ``threshold``
    on. Labels of documents whose id has remainder 0 (:func:`remainder`) are never
    learned from. Null texts count as empty, empty texts get a score like any
    other; every row, repeated or with a null id, gets one; extra columns are
    ignored; an empty table gives no rows.
    """
    forest = fit(docs, labels, doc_id, text, mark, most)
    key = F.col(f"`{doc_id}`").alias("doc_id")
    return scored(docs.select(key, F.col(f"`{text}`").alias("text")), forest).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "quality",
              threshold: float = 0.3, most: int = MOST_LABELS) -> DataFrame:
    """The documents that :func:`classify` doesn't reject, with all their columns."""
    forest = fit(docs, labels, doc_id, text, mark, most)
    return unpacked(scored(docs, forest, text).where(F.col("score") >= threshold))
