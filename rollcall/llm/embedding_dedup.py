"""Near-duplicate vectors: spherical k-means cells, blocked cosines, one kept per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import block_pairs, roots, staged
from rollcall.llm.components import connected_components
from rollcall.llm.vectors import stacked, usable

SAMPLE = 32768  # vectors at most that the centroids are fitted on
SHAPES = [(1, 4), (4, 4), (8, 8), (16, 16), (32, 32)]  # cells of the tree: first level, second level
ROWS_PER_CELL = 4096  # trees with many more cells than rows need aren't tried
COPY = 5000  # comparisons that take as long as to send one copy of a vector
UNSURE = 1e-12  # cosines this close to the threshold are summed again exactly


def spherical_kmeans(unit: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids, started from evenly spaced rows of ``unit``."""
    centroids = unit[np.linspace(0, len(unit) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    m = stacked(vectors, width, np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # keeps the squares in range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    dot = math.fsum(x * y)
    return dot / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``threshold``."""
    cosine = a @ b.T
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < UNSURE)):
        cosine[i, j] = exact_cosine(a[i], b[j])
    return cosine >= threshold


def reach_of(threshold: float) -> float:
    """Largest distance of two unit vectors with a cosine of ``threshold``."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


class Tree:
    """Centroids in two levels: each vector belongs to its nearest one of the first
    level, and there to its nearest one of the second."""

    def __init__(self, unit: np.ndarray, first: int, second: int):
        self.second = second
        tops = spherical_kmeans(unit, first)
        own = (unit @ tops.T).argmax(axis=1)
        self.levels = [tops]
        for t in range(first):
            mine = unit[own == t]
            self.levels.append(spherical_kmeans(mine if len(mine) else tops[t:t + 1], second))
        self.between = [np.linalg.norm(c[:, None] - c[None], axis=2) for c in self.levels]
        self.least, self.most = np.full(first * second, -np.inf), np.full(first * second, np.inf)

    @property
    def cells(self) -> int:
        return len(self.levels[0]) * self.second

    def angles(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its angle to the centroid there."""
        top = (unit @ self.levels[0].T).argmax(axis=1)
        cell, angle = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            near = unit[at] @ self.levels[t + 1].T
            leaf = near.argmax(axis=1)
            cell[at], angle[at] = t * self.second + leaf, np.arccos(np.clip(near[np.arange(len(at)), leaf], -1, 1))
        return cell, angle

    def bound(self, cell: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        """The least and largest angle of the rows of each cell; others are empty."""
        self.least, self.most = np.full(self.cells, np.inf), np.full(self.cells, -np.inf)
        np.minimum.at(self.least, cell, least)
        np.maximum.at(self.most, cell, most)

    def _near(self, unit: np.ndarray, level: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of a level, those whose plane to it is within reach, and all cosines."""
        near = unit @ self.levels[level].T
        own = near.argmax(axis=1)
        gap = near[np.arange(len(unit)), own][:, None] - near
        return own, gap <= reach * self.between[level][own] + 1e-9, near

    def deal(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own cell of the row): each row in its own cell, and again in
        every earlier cell that can hold a vector within ``reach`` of it.

        If y is nearest to centroid c and x to d, then y's distance to the plane
        between them is on c's side, so x is within |x - y| of that plane. This
        holds for the first level, and again among the second-level centroids under
        c, whether or not x belongs there. The angles of x and y to y's centroid differ
        by no more than the one between them, so x stays out of cells none of whose
        rows (:meth:`bound`) has an angle like its own. A pair within reach meets exactly
        once, in the earlier of its two cells.
        """
        wide = 2 * math.asin(min(1.0, reach / 2)) + 1e-6
        top, close, _ = self._near(unit, 0, reach)
        own = np.zeros(len(unit), dtype=np.int64)
        rows, cells = [], []
        for t in range(len(self.levels[0])):
            at = np.flatnonzero(close[:, t] & (top >= t))
            if not len(at):
                continue
            leaf, near, cosine = self._near(unit[at], t + 1, reach)
            angle, here = np.arccos(np.clip(cosine, -1, 1)), np.s_[t * self.second:(t + 1) * self.second]
            near &= (angle >= self.least[here] - wide) & (angle <= self.most[here] + wide)
            mine = top[at] == t
            near[np.flatnonzero(mine), leaf[mine]] = True
            own[at[mine]] = t * self.second + leaf[mine]
            near &= ~mine[:, None] | (np.arange(self.second) <= leaf[:, None])
            i, j = np.nonzero(near)
            rows.append(at[i])
            cells.append(t * self.second + j)
        row, cell = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (rows, cells))
        return row, cell, own


def cost(tree: Tree, probes: np.ndarray, reach: float, group: float, block: int) -> float:
    """Work per vector if labels have about ``group`` of them: comparisons, and
    copies counted as ``COPY`` of them, both measured on ``probes``."""
    row, cell, own = tree.deal(probes, reach)
    n, all_ = np.bincount(own, minlength=tree.cells), np.bincount(cell, minlength=tree.cells)
    compared = (n * all_).sum() / len(probes) ** 2
    blocks = np.maximum(1, all_ / len(probes) * group / block)
    return compared * group + COPY * (all_ * blocks).sum() / len(probes)


def fitted(unit: np.ndarray, rows: int, group: float, reach: float, block: int) -> Tree:
    """The tree of ``SHAPES`` with the least cost: clustered vectors get cells by
    their number, vectors without clusters, which border on most cells, get few."""
    probes, rest = unit[::4], unit if len(unit) < 8 else np.delete(unit, np.s_[::4], axis=0)
    best = None
    for first, second in SHAPES:
        if best and (first * second > 4 * rows / ROWS_PER_CELL or 8 * first * second > len(rest)):
            break
        tree = Tree(rest, first, second)
        cell, angle = tree.angles(unit)
        tree.bound(cell, angle, angle)
        price = cost(tree, probes, reach, group, block)
        if best is None or price < best[0]:
            best = price, tree
    return best[1]


def bounded(vectors: DataFrame, tree: Tree, width: int) -> Tree:
    """``tree`` with the angles of all vectors: two numbers per cell reach the driver."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, angle = tree.angles(unit_rows(pdf["vec"], width))
                yield pd.DataFrame({"cell": cell, "angle": angle}).groupby("cell")["angle"].agg(["min", "max"]).reset_index()

    pieces = vectors.select("vec").mapInPandas(measure, "cell long, min double, max double")
    angles = pieces.groupBy("cell").agg(F.min("min").alias("least"), F.max("max").alias("most")).toPandas()
    tree.bound(*(angles[c].to_numpy() for c in ("cell", "least", "most")))
    return tree


def assign(vectors: DataFrame, tree: Tree, threshold: float, width: int) -> DataFrame:
    """Each vector in its cells (:meth:`Tree.deal`), once of them as ``native``."""
    reach = reach_of(threshold)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            row, cell, own = tree.deal(unit_rows(pdf["vec"], width), reach)
            yield pd.DataFrame({
                "node": pdf["node"].to_numpy()[row], "label": pdf["label"].to_numpy()[row], "copies": pdf["copies"].to_numpy()[row],
                "vec": pdf["vec"].to_numpy()[row], "cell": cell.astype(np.int32), "native": cell == own[row],
            })

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("node", "label", "copies", "vec").mapInPandas(
        deal, f"node long, label long, copies long, vec {kind}, cell int, native boolean"
    )


def compare(threshold: float, width: int, rows_at_once: int = 1024):
    """Solver of a unit: links of each vector and a star per component."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        unit, part = unit_rows(pdf["vec"], width), pdf["part"].to_numpy()
        node, copies, native = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["native"].to_numpy()
        across = pdf["unit_a"].iloc[0] != pdf["unit_b"].iloc[0]
        links, label = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
        natives = np.flatnonzero(native)
        for start in range(0, len(natives), rows_at_once):
            mine = natives[start:start + rows_at_once]
            hit = linked(unit[mine], unit, threshold)
            hit &= (part[mine, None] != part[None]) if across else (node[mine, None] != node[None])
            links[mine] += hit @ copies
            links += np.where(native, 0, copies[mine] @ hit)  # two natives see each other both ways
            i, j = np.nonzero(hit)
            label = roots(len(pdf), mine[i], j, label)
        out = pd.DataFrame({"node": node, "links": links, "root": node[label]})
        return out[links > 0]

    return solve


def near_links(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root) pieces for distinct vectors (node, label, copies, vec):
    ``links`` add up to the linked rows of other nodes, (node, root) are edges
    that join exactly the vectors connected by links."""
    # One row: how many vectors there are, and how many share a vector's label on average.
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"))
    square = F.sum(F.col("n").cast("double") * F.col("n"))
    shape = sizes.agg(F.sum("n").alias("n"), F.max("width").alias("width"), square.alias("square")).first()
    width, rows = shape["width"] or 0, shape["n"] or 0
    spark = vectors.sparkSession
    if rows < 2:
        return spark.createDataFrame([], "node long, links long, root long")
    sample = vectors.orderBy(F.xxhash64("node", F.lit("sample")), "node").select("vec").limit(SAMPLE).toPandas()
    tree = fitted(unit_rows(sample["vec"], width), rows, shape["square"] / rows, reach_of(threshold), block)
    dealt = staged(assign(vectors, bounded(vectors, tree, width), threshold, width))
    keys = ["label", "cell"]
    units = block_pairs(dealt, keys, "node", block)
    return units.groupBy(*keys, "unit_a", "unit_b").applyInPandas(
        compare(threshold, width), "node long, links long, root long"
    )


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.98, block: int = 4096,
) -> DataFrame:
    """Links and group of every vector: (vec_id, n_links, component_id, kept).

    Rows of the same label link from a cosine of ``threshold`` in double
    precision. Centroids, in two levels, are fitted on at most ``SAMPLE`` vectors,
    chosen by hash, and as many as pay (:func:`fitted`); all vectors are dealt to
    cells and compared, and copies near a border of two cells (:meth:`Tree.deal`)
    make the search exact. Equal vectors are collapsed
    first; large cells are cut into blocks whose pairs are tasks
    (:func:`rollcall.llm.common.block_pairs`), so no task holds a cell and no
    pair is written.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows with a null label or id, link with nothing: n_links 0, component_id
    their own vec_id, kept true (null for a null id). Shorter vectors count as ended by zeros. Rows that repeat a
    vec_id, label and vector count as one vector and each get its result; if a
    vec_id has several vectors, its links add up over them. An empty table gives
    no rows; extra columns are ignored.
    """
    # Floats stay floats while they travel; cosines are taken in doubles.
    kind = "array<float>" if table.select(f"`{vector}`").schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast(kind).alias("vec"),
    ).withColumn(
        "compared",
        usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        & F.exists(F.coalesce("vec", F.array().cast(kind)), lambda x: x != 0),
    )
    # A vector is known by its label and 128 bits of its components.
    marks = ["label", "mark_a", "mark_b"]
    rows = rows.withColumns({"mark_a": F.xxhash64("vec"), "mark_b": F.xxhash64(F.lit("b"), "vec")})
    valid = rows.where("compared")
    ids = valid.select("vec_id", *marks).distinct()
    distinct = staged(
        valid.groupBy(*marks).agg(F.min("vec_id").alias("node"), F.first("vec").alias("vec"))
        .join(ids.groupBy(*marks).agg(F.count(F.lit(1)).alias("copies")), marks)
        .select("node", "copies", "vec", *marks)
    )
    found = staged(near_links(distinct, threshold, block))
    # A node stands for one vector: an id that is smallest for two vectors joins them.
    groups = connected_components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        .union(ids.join(distinct.select("node", *marks), marks).where("vec_id <> node").select("vec_id", "node"))
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_mark = (
        distinct.join(links, "node", "left")
        .select(*marks, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    per_id = ids.join(of_mark, marks).groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_id = per_id.join(groups, per_id.vec_id == groups.node, "left").select("vec_id", "links", "component")
    return (
        rows.select("vec_id").join(per_id, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
