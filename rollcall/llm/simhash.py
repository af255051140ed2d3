"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import block_pairs, group_starts, passing, roots, staged, texts_of, whole_groups, with_text, word_pieces
from rollcall.llm.components import connected_components

BITS = 64
SEED = 42
BANDS, PER_BAND = 20, 5  # MinHash keys of a text, and the minima in each
MULTIPLIERS, ADDENDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * PER_BAND), dtype=np.uint64) * 2 + 1


def hashes_of(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in bounded pieces: words are runs
    of non-blank bytes with A-Z lower-cased, shingles are ``width`` words. A text of
    fewer words has one shingle, one without words has none."""
    last, digest, short = [], xxhash.xxh64_intdigest, True
    for piece in word_pieces(text.lower()):  # bytes: A-Z only
        words = last + piece
        if len(words) >= width:
            shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
            yield np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
            short = False
        last = words[-(width - 1):] if width > 1 else []
    if last and short:
        yield np.array([digest(b" ".join(last), SEED)], dtype="<u8")


def ones_in(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned SimHash of a text: a bit is 1 if set in over half of the hashes of its
    shingles (:func:`hashes_of`). One without words has fingerprint 0."""
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    for hashes in hashes_of(text, width):
        total, ones = total + len(hashes), ones + ones_in(hashes)
    return majority(ones, total)


def with_fingerprint(df: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Rows of ``df`` as ``row`` beside ``fingerprint`` (its 64 bits as a long)."""
    rows, nth = with_text(df, text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            prints = np.fromiter(
                (fingerprint(t, width) for t in texts_of(batch.column("row").field(nth))), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(prints.view(np.int64))], names=["row", "fingerprint"]
            )

    return rows.mapInArrow(add, T.StructType([rows.schema["row"]]).add("fingerprint", "long"))


def blocks_of(distance: int, spare: int = 2) -> list[list[tuple[int, int]]]:
    """Key layouts as lists of bit ranges. The bits are cut into ``distance +
    spare`` blocks; of two fingerprints within ``distance`` at least ``spare``
    blocks agree, so they share the key of one choice of ``spare`` blocks."""
    n = distance + spare
    cuts = [BITS * i // n for i in range(n + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(n), spare)]


def _key(layout: list[tuple[int, int]]):
    key = F.lit(0).cast("long")
    for start, width in layout:
        bits = F.shiftrightunsigned(F.col("fingerprint"), start).bitwiseAND(F.lit((1 << width) - 1))
        key = F.shiftleft(key, width).bitwiseOR(bits)
    return key


def near_links(prints: DataFrame, distance: int = 3, block: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` that join exactly the fingerprints connected by steps of
    at most ``distance`` bits; ``prints`` has distinct ``fingerprint`` longs.

    Every key of :func:`blocks_of` is a bucket. All pairs of a bucket are
    compared, in numpy and within bounded units (:func:`block_pairs`); a unit
    writes a star per component it finds, never its pairs.
    """
    layouts = F.array(*[F.struct(F.lit(i).alias("layout"), _key(x).alias("key")) for i, x in enumerate(blocks_of(distance))])
    rows = prints.select("fingerprint", F.explode(layouts).alias("at")).select("fingerprint", "at.layout", "at.key")
    keys = ["layout", "key"]
    unit = [*keys, "unit_a", "unit_b"]
    units = block_pairs(rows, keys, "fingerprint", block).repartition(*unit).sortWithinPartitions(*unit)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, unit):
            prints = table.column("fingerprint").to_numpy().view(np.uint64)
            starts = group_starts(table, unit)
            ends = np.append(starts[1:], len(prints))
            size = ends - starts
            end = np.repeat(ends, size)
            part = table.column("part").to_numpy()
            across = (table.column("unit_a").to_numpy() != table.column("unit_b").to_numpy())
            label, at, step = np.arange(len(prints)), np.arange(len(prints)), 1
            while True:
                at = at[at + step < end[at]]
                if not len(at):
                    break
                to = at + step
                hit = np.bitwise_count(prints[at] ^ prints[to]) <= distance
                hit &= ~across[at] | (part[at] != part[to])
                label = roots(len(prints), at[hit], to[hit], label)
                step += 1
            moved = np.flatnonzero(label != np.arange(len(prints)))
            signed = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])

    return units.mapInArrow(stars, "a long, b long").distinct()


def marks_of(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *map(np.unique, hashes_of(text, width))]))


def print_and_marks(text: bytes, width: int) -> tuple[int, np.ndarray]:
    """:func:`fingerprint` and :func:`marks_of` in one pass."""
    total, ones, found = 0, np.zeros(BITS, dtype=np.int64), [np.zeros(0, dtype="<u8")]
    for hashes in hashes_of(text, width):
        total, ones = total + len(hashes), ones + ones_in(hashes)
        found.append(np.unique(hashes))
    return majority(ones, total), np.unique(np.concatenate(found))


def bands_of(marks: np.ndarray) -> list[int]:
    """MinHash keys: two sets of similarity 0.8 share one of them with a chance of
    99.96 %, more similar ones with a higher one."""
    if not len(marks):
        return []
    least = np.full(BANDS * PER_BAND, (1 << 64) - 1, dtype=np.uint64)
    for start in range(0, len(marks), 2048):
        least = np.minimum(least, (marks[start:start + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, PER_BAND))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def with_bands(df: DataFrame, text: str, width: int) -> DataFrame:
    """Rows of ``df`` as ``row`` beside ``fingerprint``, a hash of the set of shingles,
    ``simhash``, the :func:`fingerprint` of the text, and ``bands``."""
    rows, nth = with_text(df, text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            prints, simhashes, bands = [], [], []
            for t in texts_of(batch.column("row").field(nth)):
                simhash, marks = print_and_marks(t, width)
                prints.append(xxhash.xxh64_intdigest(marks.tobytes(), SEED))
                simhashes.append(simhash)
                bands.append(bands_of(marks))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (prints, simhashes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *longs, pa.array(bands, pa.list_(pa.int64()))], names=["row", "fingerprint", "simhash", "bands"]
            )

    schema = T.StructType([rows.schema["row"]]).add("fingerprint", "long").add("simhash", "long").add("bands", T.ArrayType(T.LongType()))
    return rows.mapInArrow(add, schema)


def _similar(marks: list[np.ndarray], part: np.ndarray, across: bool, similarity: float) -> np.ndarray:
    """Component of each set by steps of at least ``similarity`` (Jaccard), between
    different parts only if ``across``."""
    n, size = len(marks), np.array(list(map(len, marks)))
    starts = size.cumsum() - size
    distinct, codes = np.unique(np.concatenate(marks), return_inverse=True)
    label = np.arange(n)
    for i in range(n - 1):
        inside = np.zeros(len(distinct), dtype=bool)
        inside[codes[starts[i]:starts[i] + size[i]]] = True
        later = np.arange(i + 1, n)
        shared = np.add.reduceat(inside[codes[starts[i + 1]:]], starts[i + 1:] - starts[i + 1], dtype=np.int64)
        hit = shared >= similarity * (size[i] + size[later] - shared) - 1e-9
        if across:
            hit &= part[later] != part[i]
        label = roots(n, np.full(int(hit.sum()), i), later[hit], label)
    return label


def proposed_by_simhash(rows: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` that join the ``fingerprint`` of texts with words whose
    ``simhash`` are connected by steps of at most ``distance`` bits (:func:`near_links`)."""
    texts = staged(rows.where(F.size("bands") > 0).select("simhash", "fingerprint").distinct())
    least = staged(texts.groupBy("simhash").agg(F.min("fingerprint").alias("least")))
    same = texts.join(least, "simhash").select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))
    near = near_links(least.select(F.col("simhash").alias("fingerprint")), distance)
    a, b = least.toDF("a", "least_a"), least.toDF("b", "least_b")
    return same.union(near.join(a, "a").join(b, "b").select("least_a", "least_b")).where("a <> b")


def similar_links(rows: DataFrame, text: str, width: int, similarity: float, block: int = 256, distance: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of ``rows(row, fingerprint, simhash, bands, row_id)``
    that join those connected by steps of at least ``similarity`` (Jaccard of shingles).

    Texts whose SimHash differs in at most ``distance`` bits are candidates, and so are
    those that share a MinHash key, since similar texts may differ in more bits. Within a component of
    candidates all pairs are compared exactly, on one text per fingerprint and
    within bounded units; a unit writes a star per component, never its pairs.
    """
    prints = staged(rows.groupBy("fingerprint").agg(F.min(F.struct("row_id", "bands")).alias("one")).select("fingerprint", "one.*"))
    keyed = prints.select("fingerprint", F.explode("bands").alias("key"))
    least = staged(keyed.groupBy("key").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("key", "a"))
    by_minhash = keyed.join(least, "key").select("a", F.col("fingerprint").alias("b"))
    near = connected_components(proposed_by_simhash(rows, distance).union(by_minhash).distinct())
    members = near.select(F.col("node").alias("fingerprint"), "component").union(near.select("component", "component").distinct())
    wanted = staged(members.join(prints, "fingerprint").select("row_id", "component"))
    texts = rows.join(wanted, "row_id").select("component", "fingerprint", F.col(f"row.`{text}`").cast("string").alias("text"))
    unit = ["component", "unit_a", "unit_b"]
    units = block_pairs(staged(texts), ["component"], "fingerprint", block).repartition(*unit).sortWithinPartitions(*unit)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(passing(batches), unit):
            starts = group_starts(table, unit).tolist()
            for start, stop in zip(starts, [*starts[1:], table.num_rows]):
                some = table.slice(start, stop - start)
                across = some.column("unit_a")[0] != some.column("unit_b")[0]
                marks = [marks_of(t, width) for t in texts_of(some.column("text"))]
                label = _similar(marks, some.column("part").to_numpy(), across, similarity)
                prints, moved = some.column("fingerprint").to_numpy(), np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[label[moved]])], names=["a", "b"])

    return units.mapInArrow(stars, "a long, b long").distinct()


def components_of(prints: DataFrame, distance: int = 3, links: DataFrame | None = None) -> DataFrame:
    """(fingerprint, component, component_id) per distinct fingerprint of
    ``prints(doc_id, fingerprint)``: ``component`` names the class by one of its
    fingerprints, ``component_id`` is its smallest doc_id (null if it has none).
    ``links`` are edges to use instead of those of at most ``distance`` bits."""
    distinct = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    linked = connected_components(near_links(distinct.select("fingerprint"), distance) if links is None else links)
    classes = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return classes.join(smallest, "component").select("fingerprint", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """Class of near-duplicates of every document: (doc_id, fingerprint, component_id).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    doc_id reachable by links of at most ``distance`` differing bits, itself
    included. Equal fingerprints are collapsed before any comparison, so a group
    of copies of any size is one row there.

    Null texts count as empty; texts without words share fingerprint 0 and link
    like any other. Repeated rows and rows with a null id each get a row; a class
    of null ids only has a null component_id. Extra columns are ignored. An empty
    table gives no rows.
    """
    prints = staged(
        with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", width)
        .select("row.doc_id", "fingerprint")
    )
    classes = components_of(prints, distance).select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3, similarity: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, one per class of near-duplicates: the one with the
    smallest doc_id (ids before nulls; of repeated rows, one). All columns stay.
    With ``similarity``, those within ``distance`` are candidates only, and texts are
    linked by that Jaccard similarity of their shingles (:func:`similar_links`)."""
    keyed = with_fingerprint(docs, text, width) if similarity is None else with_bands(docs, text, width)
    rows = staged(keyed.withColumn("row_id", F.monotonically_increasing_id()))
    prints = rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "fingerprint", "row_id")
    classes = components_of(prints, distance, None if similarity is None else similar_links(rows, text, width, similarity, distance=distance))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    kept = prints.join(classes, "fingerprint").groupBy("component").agg(first.alias("first")).select("first.row_id")
    return rows.join(kept, "row_id", "left_semi").select("row.*")
