"""Importance resampling towards a target corpus, over hashed words and word pairs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import passing, staged, texts_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of texts in lower case
SEPARATOR = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")  # the same before that
BUCKETS = 10_000
AT_ONCE = 1 << 22  # bytes of text


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Texts in lots of about ``size`` bytes: the number of each piece's text, the
    pieces, and whether the last text goes on in the next lot. Texts are cut at
    separators only."""
    owners, held, waiting = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            cut = SEPARATOR.search(text, at + size) if len(text) - at > size else None
            stop = cut.start() if cut else len(text)
            owners.append(i)
            held.append(text[at:stop])
            waiting, at = waiting + stop - at, stop
            if waiting >= size:
                yield owners, held, at < len(text)
                owners, held, waiting = [], [], 0
            if at >= len(text):
                break
    if held:
        yield owners, held, False


class Features:
    """Words and pairs of neighbouring words of some texts, each by its bucket.

    ``codes`` and ``pair_codes`` number the distinct ones in the order of the texts,
    ``buckets`` and ``pair_buckets`` are those of the distinct ones, ``owner`` and
    ``pair_owner`` the texts' numbers. A word carried over from the lot before
    starts a pair, but is no feature again."""

    def __init__(self, owners: list[int], pieces: list[bytes], carried: bytes | None, buckets: int):
        if carried is not None:
            owners, pieces = [owners[0], *owners], [carried, *pieces]
        lists = pc.split_pattern_regex(pc.ascii_lower(pa.array(pieces, pa.large_binary()).view(pa.large_string())), SEPARATORS)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        owner = np.asarray(owners)[pc.list_parent_indices(lists).to_numpy()]
        if b"" in words:  # before a leading separator, behind a closing one
            keep = codes != words.index(b"")
            codes, owner = codes[keep], owner[keep]
        # Shifted indices form the pairs; each distinct pair goes on from its first word's CRC.
        near = owner[:-1] == owner[1:]
        pairs = pc.dictionary_encode(pa.array(codes[:-1][near] * len(words) + codes[1:][near]))
        first, second = np.divmod(pairs.dictionary.to_numpy(), max(len(words), 1))
        crc = list(map(zlib.crc32, words))
        opened = [zlib.crc32(b" ", c) for c in crc]
        self.buckets = np.array(crc, dtype=np.int64) % buckets
        self.pair_buckets = np.fromiter(
            (zlib.crc32(words[b], opened[a]) for a, b in zip(first.tolist(), second.tolist())), dtype=np.int64, count=len(first)
        ) % buckets
        self.pair_codes, self.pair_owner = pairs.indices.to_numpy(), owner[1:][near]
        skip = int(carried is not None)
        self.codes, self.owner = codes[skip:], owner[skip:]
        self.last = (int(owner[-1]), words[codes[-1]]) if len(codes) else (-1, None)


def features(texts: list[bytes], buckets: int, size: int = AT_ONCE) -> Iterator[Features]:
    """Features of the texts, lot by lot."""
    carried = None
    for owners, pieces, goes_on in _pieces(texts, size):
        found = Features(owners, pieces, carried, buckets)
        yield found
        carried = found.last[1] if goes_on and found.last[0] == owners[-1] else None


def counts(texts: list[bytes], buckets: int, size: int = AT_ONCE) -> np.ndarray:
    """Features in each bucket."""
    total = np.zeros(buckets, dtype=np.int64)
    for f in features(texts, buckets, size):
        total += np.bincount(f.buckets[f.codes], minlength=buckets)
        total += np.bincount(f.pair_buckets[f.pair_codes], minlength=buckets)
    return total


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by their ascending ``owner``."""
    upto = np.append(0, np.cumsum(values))
    return np.diff(upto[np.searchsorted(owner, np.arange(n + 1))])


def gained(texts: list[bytes], gains: np.ndarray, size: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and the sum of the features' gains of each text."""
    n = len(texts)
    words, pairs, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for f in features(texts, len(gains), size):
        words += np.bincount(f.owner, minlength=n)
        pairs += np.bincount(f.pair_owner, minlength=n)
        total += _sums(f.owner, gains[f.buckets].take(f.codes), n)
        total += _sums(f.pair_owner, gains[f.pair_buckets].take(f.pair_codes), n)
    return words, words + pairs, total


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features of a whole table by bucket. A task adds up its own; a row per task
    and bucket is shuffled, and as many numbers as buckets reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in passing(batches):
            total += counts(texts_of(batch.column(0)), buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    found = texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share of a bucket in the target over that in the source)."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            words, n, total = gained(texts_of(batch.column("text")), gains)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in ``order``: dealt to tasks by range,
    sorted there, and moved by the rows of the ranges before; a row per range
    reaches the driver."""
    ranges = staged(
        rows.orderBy(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before, offsets = 0, []
    for part, n in sorted(ranges.groupBy("part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, before))
        before += n
    places = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return ranges.join(places, "part").withColumn("place", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """A draw of ``percent`` % of the documents of at least ``least_words`` words,
    towards the distribution of ``target``: (doc_id, n_features, weight, score, rank)
    of every document, ``rank`` null if it isn't drawn.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII,
    A-Z in lower case; features are words and pairs of neighbouring words, hashed to
    ``buckets`` by CRC-32. A bucket gains what its share in the target exceeds that in
    ``docs``, in thousandths of a natural logarithm, rounded down. A document's weight
    is the mean gain of its features, its score that and Gumbel noise from ``seed``
    and doc_id: the highest scores are a draw without replacement by weight.

    All texts are read whole, twice: for the counts and for the scores; a text is
    taken in pieces of about four megabytes, cut at separators, so that a very long
    one takes bounded memory. No text is shuffled; ranks come from a sort by range.

    Null texts have no features and weight 0. A null doc_id counts as an empty text in
    the noise and comes last among equal scores. Rows that repeat a doc_id are
    documents of their own. Without documents there are no rows, without a target all
    of its counts are 0. Extra columns are ignored.
    """
    gains = gains_of(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = staged(scored(docs, gains, doc_id, text)).withColumn("score", F.col("weight") + noise)
    rows = rows.withColumn("fits", F.col("n_words") >= least_words)
    drawn = rows.where("fits").count() * percent // 100
    ranked = numbered(rows, F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features")
    rank = F.when(F.col("fits") & (F.col("place") <= drawn), F.col("place"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
