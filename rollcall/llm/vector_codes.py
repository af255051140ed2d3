"""Short codes of vectors: a codebook per part, fitted by Lloyd rounds over cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import staged
from rollcall.llm.vectors import usable

ROWS_PER_BLOCK = 4096
LEAF = 24  # a node of so many points isn't split
SHRINK = 0.6  # children lie within this share of their parent's radius
LARGEST = 1 << 28  # components below this keep all sums of squares in 64 bits
SLACK = 1e-9  # of a distance: room for rounding in bounds


class CoverTree:
    """Points in the order of a cover tree's leaves. A node is a run of points, a
    centre among them, the largest distance to it, and its points' sum; its children
    follow each other, and their centres are further apart than ``SHRINK`` times its
    radius."""

    def __init__(self, order, points, start, stop, centre, radius, child, children, sums):
        self.order, self.points = order, points
        self.start, self.stop, self.centre, self.radius = start, stop, centre, radius
        self.child, self.children, self.sums = child, children, sums

    KINDS = ("<i4", "<i4", "<i4", "<i4", "<i4", "<f8", "<i4", "<i4", "<i8")

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """A tree over the rows of ``points`` (whole numbers, at least one row)."""
        p = points.astype(np.float64)
        order = np.arange(len(p))
        middle = int(((p - p.mean(axis=0)) ** 2).sum(axis=1).argmin())
        away = np.sqrt(((p - p[middle]) ** 2).sum(axis=1))
        nodes = [[0, len(p), middle, float(away.max()), 0, 0]]
        at = 0
        while at < len(nodes):
            start, stop, centre, radius, _, _ = nodes[at]
            if stop - start > LEAF and radius > 0:
                mine = order[start:stop]
                here, centres = p[mine], [centre]
                near = np.sqrt(((here - p[centre]) ** 2).sum(axis=1))
                which = np.zeros(len(mine), dtype=np.int64)
                while near.max() > SHRINK * radius:  # a net of far points, the farthest first
                    far = int(near.argmax())
                    to = np.sqrt(((here - here[far]) ** 2).sum(axis=1))
                    closer = to < near
                    which[closer], near = len(centres), np.minimum(near, to)
                    centres.append(int(mine[far]))
                sort = np.argsort(which, kind="stable")
                order[start:stop] = mine[sort]
                ends = np.cumsum(np.bincount(which, minlength=len(centres)))
                near = near[sort]
                nodes[at][4:] = [len(nodes), len(centres)]
                for c, a, b in zip(centres, np.append(0, ends[:-1]).tolist(), ends.tolist()):
                    nodes.append([start + a, start + b, c, float(near[a:b].max()), 0, 0])
            at += 1
        start, stop, centre, radius, child, children = map(np.array, zip(*nodes))
        place = np.empty(len(p), dtype=np.int64)
        place[order] = np.arange(len(p))
        ordered = points[order].astype(np.int32)
        upto = np.vstack([np.zeros((1, p.shape[1]), dtype=np.int64), ordered.cumsum(axis=0, dtype=np.int64)])
        return cls(order, ordered, start, stop, place[centre], radius, child, children, upto[stop] - upto[start])

    def packed(self) -> bytes:
        fields = (self.order, self.points, self.start, self.stop, self.centre, self.radius, self.child, self.children, self.sums)
        head = np.array([len(self.order), self.points.shape[1], len(self.start)], dtype="<i8")
        return b"".join([head.tobytes(), *[np.ascontiguousarray(f).astype(k).tobytes() for f, k in zip(fields, self.KINDS)]])

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        n, width, m = np.frombuffer(data, dtype="<i8", count=3).tolist()
        shapes, at, fields = [(n,), (n, width), *[(m,)] * 6, (m, width)], 24, []
        for shape, kind in zip(shapes, cls.KINDS):
            count = int(np.prod(shape))
            fields.append(np.frombuffer(data, dtype=kind, count=count, offset=at).reshape(shape))
            at += count * np.dtype(kind).itemsize
        return cls(*fields)

    def nearest(self, book: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Nearest entry of ``book`` of all points, ties to the lower number: pieces
        (nodes, entries) for whole subtrees, and (points, entries) for single points.

        If the second nearest entry to a node's centre is further than the nearest by
        more than twice the radius, the nearest is so for all points of the node.
        Other nodes are opened; points of a leaf are compared one by one.
        """
        whole, single, front = [], [], np.zeros(1, dtype=np.int64)
        while len(front):
            square = squares(self.points[self.centre[front]], book)
            best = square.argmin(axis=1)
            least = np.sqrt(square[np.arange(len(front)), best].astype(np.float64))
            square[np.arange(len(front)), best] = np.iinfo(np.int64).max
            second = np.sqrt(square.min(axis=1).astype(np.float64))
            radius = self.radius[front]
            sure = (radius == 0) | (second - least > 2 * radius + SLACK * (second + radius))
            whole.append((front[sure], best[sure]))
            rest = front[~sure]
            leaf = self.children[rest] == 0
            single.append(runs(self.start[rest[leaf]], self.stop[rest[leaf]] - self.start[rest[leaf]]))
            front = runs(self.child[rest[~leaf]], self.children[rest[~leaf]])
        points = np.concatenate(single)
        entries = [squares(self.points[points[i:i + 65536]], book).argmin(axis=1) for i in range(0, len(points), 65536)]
        nodes, of = (np.concatenate(x) for x in zip(*whole))
        return [nodes, of], [points, np.concatenate([*entries, np.zeros(0, dtype=np.int64)])]

    def add_to(self, book: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Add the number and the sum of the points of each entry of ``book``."""
        (nodes, of), (points, entry) = self.nearest(book)
        np.add.at(count, of, self.stop[nodes] - self.start[nodes])
        np.add.at(total, of, self.sums[nodes])
        np.add.at(count, entry, 1)
        np.add.at(total, entry, self.points[points])

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the order the tree was built from."""
        (nodes, of), (points, entry) = self.nearest(book)
        code = np.zeros(len(self.order), dtype=np.int64)
        size = self.stop[nodes] - self.start[nodes]
        code[runs(self.start[nodes], size)] = np.repeat(of, size)
        code[points] = entry
        error = ((self.points.astype(np.int64) - book[code]) ** 2).sum(axis=1)
        out = np.empty((2, len(code)), dtype=np.int64)
        out[:, self.order] = code, error
        return out[0], out[1]


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers."""
    return ((points[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``start`` on, ``size`` of them, one run after the other."""
    size = size.astype(np.int64)
    before = np.cumsum(size) - size
    return np.repeat(start.astype(np.int64) - before, size) + np.arange(size.sum())


def whole_parts(vectors: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of vectors without nulls, ended by zeros to ``width``."""
    sizes = vectors.value_lengths().to_numpy()
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(flat).max():.0f} after scaling is beyond {LARGEST}: squares would not fit in 64 bits")
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), runs(np.zeros(len(sizes), dtype=np.int64), sizes)] = flat.astype(np.int64)
    return out


def planted(rows: DataFrame, scale: int, width: int, parts: int, block: int) -> DataFrame:
    """Blocks of rows of a partition: their (vec_id, label) lists and a cover tree per part."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                whole = whole_parts(some.column("vec"), scale, width)
                trees = [CoverTree.build(x).packed() for x in np.split(whole, parts, axis=1)]
                one = [0, some.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.ListArray.from_arrays(one, some.column(c)) for c in ("vec_id", "label")], pa.array([trees], pa.list_(pa.binary()))],
                    names=["vec_id", "label", "trees"],
                )

    kind = T.StructType().add("vec_id", T.ArrayType(T.LongType())).add("label", T.ArrayType(rows.schema["label"].dataType))
    return rows.select("vec_id", "label", "vec").mapInArrow(plant, kind.add("trees", T.ArrayType(T.BinaryType())))


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """``books`` (part, entry, position) with each entry replaced by the mean of its
    points, rounded down. A task adds up its own blocks and hands on a row per entry."""
    parts, entries, _ = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for i, tree in enumerate(trees):
                    CoverTree.unpacked(tree.as_py()).add_to(books[i], count[i], total[i])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": part, "entry": entry, "n": count[part, entry], "total": pa.array(list(total[part, entry]), pa.list_(pa.int64())),
        })

    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(books.shape[2])]
    found = blocks.select("trees").mapInArrow(add, "part long, entry long, n long, total array<long>")
    out = books.copy()
    for part, entry, n, *total in found.groupBy("part", "entry").agg(F.sum("n"), *sums).collect():
        out[part, entry] = np.array(total, dtype=np.int64) // n
    return out


def fit(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all blocks; entries without points stay."""
    for _ in range(rounds if books.size else 0):
        books = lloyd_round(blocks, books)
    return books


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(batch.column("trees")):
                found = [CoverTree.unpacked(tree.as_py()).codes(book) for tree, book in zip(trees, books)]
                codes = np.column_stack([c for c, _ in found]).astype(np.uint8)
                text = codes.tobytes().hex()
                ids, n = batch.column("vec_id")[i].values, 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column("label")[i].values, pa.array([text[j:j + n] for j in range(0, n * len(codes), n)], pa.string()), pa.array(sum(e for _, e in found))],
                    names=["vec_id", "label", "code", "error"],
                )

    kind = T.StructType().add("vec_id", "long").add("label", blocks.schema["label"].dataType.elementType)
    return blocks.mapInArrow(encode, kind.add("code", "string").add("error", "long"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimals, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = ROWS_PER_BLOCK,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Product codes of all vectors: (vec_id, code, error, label_error, codebooks_sha256).

    Components are floor(scale * x). Vectors are cut into ``parts`` equal parts; the
    codebook of a part starts as that part of the ``entries`` smallest vec_ids and is
    moved by ``rounds`` of Lloyd's method. ``code`` has two hex digits a part, ``error``
    is the sum of squared distances to the entries, ``label_error`` its sum over rows
    of the same label, nulls together. All numbers are whole and exact.

    Each partition's rows are cut into blocks of at most ``block``, and each part of a
    block becomes a cover tree (:class:`CoverTree`), built once and kept in the shared
    folder. A round sends the codebooks to the blocks; a task settles whole subtrees by
    their sums and hands on one row per entry. Vectors are never shuffled, and no task
    holds more than a block beside its codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Shorter
    vectors, empty ones too, count as ended by zeros, up to a multiple of ``parts``.
    Null ids come last in the choice of the start, rows of equal ids in order of their
    vectors; fewer rows than ``entries`` give smaller codebooks. Repeated rows count
    each and get a row each. Components beyond 2^28 after scaling raise an error, since
    distances would not fit in 64 bits. An empty table gives no rows; extra columns are
    ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits: 1 to 256 entries")
    vec = F.col(f"`{vector}`").cast("array<double>")
    rows = table.where(usable(vec)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), vec.alias("vec"))
    width = parts * max(1, -(-(rows.agg(F.max(F.size("vec"))).first()[0] or 0) // parts))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").toArrow()["vec"].combine_chunks()
    start = whole_parts(first, scale, width)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = staged(planted(rows, scale, width, parts, block))
    books = fit(blocks, books, rounds)
    out = staged(coded(blocks, books))
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = out.join(staged(by_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
