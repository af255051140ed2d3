"""Vector codes against plain Lloyd rounds, and the cover trees under them."""

import hashlib
import math

import numpy as np
import pytest

from rollcall.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = parts * max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    whole = [[math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = [[v[p * width // parts:(p + 1) * width // parts] for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [[min((square(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        for p in range(parts if turn < rounds else 0):
            for e in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, near) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in near]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in n), e, by_label[r[2]], mark) for r, n, e in zip(rows, near, error)), key=str)


def coded(spark, rows, **options):
    return sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, KIND), **options).collect()), key=str)


def clustered(n, width, seed=3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(5, width))
    return [(int(i), [float(x) for x in (middle[i % 5] + 0.02 * rnd.normal(size=width)).astype(np.float32)], [1, 2, None][i % 3]) for i in rnd.permutation(n)]


def test_equals_plain_rounds(spark):
    rows = clustered(300, 16)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, block=37) == plain_codes(rows)
    assert coded(spark, rows, parts=4, entries=3, rounds=2, scale=10) == plain_codes(rows, 4, 3, 2, 10)


def test_odd_rows_have_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [0.5, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], None), (5, [], 2), (6, [0.25] * 8, None),
        (6, [0.25] * 8, None), (6, [0.125] * 8, 7), (None, [-0.3] * 8, 2), (9, [0.1, 0.2], 2), (10, [-0.1] * 11, 2),
    ]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, entries=2) == plain_codes(rows, entries=2)
    assert coded(spark, []) == [] and coded(spark, rows[:3]) == []
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e30] * 8, 1)])


def test_extra_columns_are_ignored(spark):
    rows = [(i, x, label, 1, "a") for i, x, label in clustered(20, 8)]
    df = spark.createDataFrame(rows, KIND + ", error int, code string")
    assert sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str) == plain_codes([r[:3] for r in rows])


def points_of(kind):
    rnd = np.random.default_rng(5)
    if kind == "copies":
        return np.repeat(rnd.integers(-99, 99, (7, 4)), 300, axis=0)
    if kind == "clusters":
        return (rnd.integers(-4000, 4000, (6, 4))[rnd.integers(0, 6, 3000)] + rnd.integers(-9, 9, (3000, 4)))
    return rnd.integers(-50, 50, (1500, 4))


@pytest.mark.parametrize("kind", ["copies", "clusters", "noise"])
def test_a_cover_tree_holds_its_promises(kind):
    points = points_of(kind)
    tree = vector_codes.CoverTree.unpacked(vector_codes.CoverTree.build(points).packed())
    assert sorted(tree.order) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.start)):
        run = tree.points[tree.start[i]:tree.stop[i]].astype(np.int64)
        away = np.sqrt(((run - tree.points[tree.centre[i]]) ** 2).sum(axis=1))
        assert tree.start[i] <= tree.centre[i] < tree.stop[i]
        assert away.max() == tree.radius[i] and (run.sum(axis=0) == tree.sums[i]).all()
        below = slice(tree.child[i], tree.child[i] + tree.children[i])
        if tree.children[i]:
            assert tree.start[below][0] == tree.start[i] and tree.stop[below][-1] == tree.stop[i]
            centres = tree.points[tree.centre[below]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2)) + 1e9 * np.eye(len(centres))
            assert apart.min() > vector_codes.SHRINK * tree.radius[i] >= tree.radius[below].max()


@pytest.mark.parametrize("kind", ["copies", "clusters", "noise"])
def test_subtrees_are_settled_as_wholes(kind):
    points = points_of(kind)
    tree = vector_codes.CoverTree.build(points)
    for book in (points[::len(points) // 16][:16], points[:1], points[[0, 0, 5]]):
        code, error = tree.codes(book)
        square = vector_codes.squares(points, book)
        assert (code == square.argmin(axis=1)).all() and (error == square.min(axis=1)).all()
    alone = lambda book: len(tree.nearest(book)[1][0])  # noqa: E731  points compared one by one
    assert alone(points[:1]) == 0
    if kind == "copies":
        assert alone(points[::len(points) // 16][:16]) == 0
    if kind == "clusters":  # entries of far clusters are told apart by their centres
        apart = [int(i) for i in np.unique(points // 100, axis=0, return_index=True)[1]]
        far = [i for n, i in enumerate(apart) if all(abs(points[i] - points[j]).sum() > 200 for j in apart[:n])]
        assert len(far) == 6 and alone(points[far]) == 0
