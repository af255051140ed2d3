"""Exact top-k inner products by a Voronoi join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.common import staged
from rollcall.llm.vectors import stacked, usable

FEWEST_PIVOTS, MOST_PIVOTS = 128, 1024  # between them, the root of the number of rows
QUERIES_PER_GROUP = 1024
ROWS_PER_BLOCK = 16384
SLACK = 1e-6  # of a distance: room for rounding in bounds
EXACT = 1 << 53  # whole numbers below this are exact in doubles


def whole_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, vec): one row per id with components floor(scale * x)."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    return (
        table.where(usable(vec)).where(F.col(f"`{vec_id}`").isNotNull())
        .select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x * scale)).alias("vec"))
        .groupBy("vec_id").agg(F.min("vec").alias("vec"))
    )


def lifted(m: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more component, so that a data vector is the nearer to a
    query the larger their inner product: |q' - x'|^2 = |q|^2 + longest - 2 q.x"""
    rest = np.zeros(len(m)) if query else np.sqrt(np.maximum(0.0, longest - (m * m).sum(axis=1)))
    return np.column_stack([m, rest])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def _celled(vectors: DataFrame, pivots: np.ndarray, longest: float, query: bool) -> DataFrame:
    """Nearest pivot of each vector, and its distance."""
    width = pivots.shape[1] - 1

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(lifted(stacked(pdf["vec"], width, np.float64), longest, query), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), away=d[np.arange(len(d)), cell])

    return vectors.mapInPandas(nearest, "vec_id long, vec array<long>, cell int, away double")


def _solver(k: int, width: int, least: dict[int, np.ndarray]):
    """Best ``k`` of a block of data for each query of a group. Rows of a block came
    for some cell of the group; each cell of queries leaves out what its own bounds
    (``least``) exclude, if that is a quarter of the block or more."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        data, queries = pdf[~asks].sort_values("vec_id"), pdf[asks].sort_values("vec_id")
        ids, asked = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        if not len(ids) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, q = stacked(data["vec"], width, np.int64), stacked(queries["vec"], width, np.int64)
        size = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
        kind = np.float64 if size < EXACT else np.int64
        x, q = x.astype(kind), q.astype(kind)
        found = []

        def search(q: np.ndarray, asked: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
            for start in range(0, len(q), 64):
                score = (q[start:start + 64] @ x.T).astype(np.int64)
                for row, who in zip(score, asked[start:start + 64]):
                    keep = np.flatnonzero(ids != who)
                    mine = row[keep]
                    if len(mine) > k:
                        last = np.partition(mine, len(mine) - k)[len(mine) - k]
                        keep = keep[mine >= last]
                    # ids ascend, so a stable sort leaves ties to the smaller one
                    best = keep[np.argsort(-row[keep], kind="stable")[:k]]
                    found.append((np.full(len(best), who), ids[best], row[best]))

        cell, away, of = data["cell"].to_numpy(), data["away"].to_numpy(), queries["cell"].to_numpy()
        whole = np.zeros(len(q), dtype=bool)
        for c in np.unique(of):
            mine, use = of == c, away >= least[c][cell]
            if 4 * np.count_nonzero(use) > 3 * len(use):
                whole |= mine
            else:
                search(q[mine], asked[mine], x[use], ids[use])
        search(q[whole], asked[whole], x, ids)
        who, vec, score = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"query_id": who, "vec_id": vec, "score": score})

    return solve


def top_k(
    table: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
    pivots: int | None = None, queries_per_group: int = QUERIES_PER_GROUP, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The ``k`` largest inner products of each query with the other rows of
    ``table``: (query_id, rank, vec_id, score), all rows if there are fewer.

    Components are floor(scale * x), scores are whole numbers (64 bits); ties go
    to the smaller vec_id. A row isn't its own candidate. The result is exact:

    1. ``pivots`` rows, chosen by hash, cut space into Voronoi cells: if not given,
       the root of the number of rows, from 128 to 1024. Queries and data are assigned to the nearest one after a lift that turns inner products
       into distances.
    2. Per cell a summary: row count, largest distance to the pivot, and the k + 1
       smallest ones (pivots * (k + 4) numbers reach the driver). They bound the
       k-th distance of every query of a cell by the triangle inequality.
    3. Query cells are joined to groups of about ``queries_per_group``. A data row
       goes to a group only if some of its cells can have it nearer than its
       bound. Rows of a group are cut into blocks of ``rows_per_block`` by hash; its
       queries go to each block; a cell with many queries is cut as well.
    4. Each block solves its queries, each cell with the rows that its own bounds
       leave; a ranked window merges the lists.

    Null ids and vectors that are null or hold null or non-finite components take
    no part; shorter vectors count as ended by zeros. Rows that repeat an id count
    as one (its smallest vector). Empty input gives no rows; extra columns are
    ignored.
    """
    units, least, width = search_units(table, queries, k, vec_id, vector, scale, pivots, queries_per_group, rows_per_block)
    if units is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = units.groupBy("grp", "part", "block").applyInPandas(_solver(k, width, least), "query_id long, vec_id long, score long")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        lists.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_units(
    table: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str, scale: int,
    pivots: int | None, queries_per_group: int, rows_per_block: int,
) -> tuple[DataFrame | None, dict[int, np.ndarray], int]:
    """Steps 1 to 3 of :func:`top_k`: the rows of each unit (grp, part, block), data
    and queries (``asks``); per query cell the distance to each pivot from which on
    a data row of its cell is of use; the width of the vectors."""
    data = staged(whole_vectors(table, vec_id, vector, scale))
    asked = data.join(queries.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"), F.max(length).alias("longest")).first()
    if shape["width"] is None:
        return None, {}, 0
    pivots = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, math.isqrt(shape["n"])))
    width, longest = shape["width"], shape["longest"]
    chosen = data.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").select("vec").limit(pivots).toPandas()
    points = lifted(stacked(chosen["vec"], width, np.float64), longest, False)
    cells = len(points)

    data_cells = staged(_celled(data, points, longest, False))
    ask_cells = staged(_celled(asked, points, longest, True))
    asks = {r["cell"]: r for r in ask_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect()}
    if not asks:
        return None, {}, width
    # Summary of the data: a query's own row is none of its candidates, hence k + 1.
    counts, far = np.zeros(cells, dtype=np.int64), np.zeros(cells)
    for r in data_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect():
        counts[r["cell"]], far[r["cell"]] = r["n"], r["far"]
    nearest = np.full((cells, k + 1), np.inf)
    by_cell = W.partitionBy("cell").orderBy("away", "vec_id")
    near = data_cells.select("cell", "away", "vec_id").withColumn("at", F.row_number().over(by_cell)).where(F.col("at") <= k + 1)
    for r in near.collect():
        nearest[r["cell"], r["at"] - 1] = r["away"]

    # Bounds per query cell: the k-th distance, and from it the least distance to
    # its pivot from which on a data row of each cell is of use.
    apart = distances(points, points)
    least, groups, filled = {}, {}, 0
    for c, r in sorted(asks.items()):
        bound = np.sort((r["far"] + apart[c][:, None] + nearest).ravel())[k] if counts.sum() > k else np.inf
        least[c] = (apart[c] - r["far"] - bound) - SLACK * (1 + apart[c] + r["far"])
    # Cells are joined in the order of a walk from pivot to nearest pivot.
    order, left = [], set(asks)
    at = min(left)
    while left:
        at = min(left, key=lambda c: (apart[at][c], c))
        left.remove(at)
        order.append(at)
    group, parts = 0, {}
    for c in order:
        if filled and filled + asks[c]["n"] > queries_per_group:
            group, filled = group + 1, 0
        groups.setdefault(group, []).append(c)
        filled += asks[c]["n"]
    reach = np.full((len(groups), cells), np.inf)
    for g, members in groups.items():
        reach[g] = np.min([least[c] for c in members], axis=0)
        parts[g] = max(1, -(-sum(asks[c]["n"] for c in members) // queries_per_group))
    blocks = np.array([max(1, -(-int(counts[far >= reach[g]].sum()) // rows_per_block)) for g in groups])
    group_of = {c: g for g, members in groups.items() for c in members}

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            wanted = pdf["away"].to_numpy()[:, None] >= reach[:, pdf["cell"].to_numpy()].T
            row, g = np.nonzero(wanted)
            block = pdf["spread"].to_numpy()[row] % blocks[g]
            times = np.array([parts[x] for x in g], dtype=np.int64)
            row, g, block = np.repeat(row, times), np.repeat(g, times), np.repeat(block, times)
            part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, dtype=np.int64)
            yield _unit(pdf, row, g, part, block, False)

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            g = np.array([group_of[c] for c in pdf["cell"]], dtype=np.int64)
            part = pdf["spread"].to_numpy() % np.array([parts[x] for x in g])
            row = np.repeat(np.arange(len(pdf)), blocks[g])
            block = np.concatenate([np.arange(blocks[x]) for x in g])
            yield _unit(pdf, row, g[row], part[row], block, True)

    def _unit(pdf, row, g, part, block, asks):
        return pd.DataFrame({
            "grp": g.astype(np.int64), "part": part.astype(np.int64), "block": block.astype(np.int64), "asks": asks,
            "cell": pdf["cell"].to_numpy()[row], "away": pdf["away"].to_numpy()[row],
            "vec_id": pdf["vec_id"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row],
        })

    kind = "grp long, part long, block long, asks boolean, cell int, away double, vec_id long, vec array<long>"
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)).alias("spread")
    units = data_cells.select("*", spread).mapInPandas(replicate, kind).union(
        ask_cells.select("*", spread).mapInPandas(to_blocks, kind)
    )
    return units, least, width
