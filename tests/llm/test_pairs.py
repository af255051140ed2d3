"""kNN, embedding and SimHash operators against brute force, with odd rows."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import embedding_dedup, knn, simhash
from rollcall.llm.common import staged
from rollcall.llm.components import connected_components

VECTORS = "vec_id long, embedding array<float>, label int, score string, cell int"


def classes(n, linked):
    """Smallest member of each one's component."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def vectors(seed, n, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, width))
    rows = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, width)) * rng.choice([0, 0.02, 0.3], (n, 1))
    return rows.astype(np.float32)


def odd_rows(start):
    nan, inf = float("nan"), float("inf")
    return [
        (start, None, 1, "x", 0), (start + 1, [1.0, None], 1, "x", 0), (start + 2, [nan, 1.0], 1, None, 0),
        (start + 3, [inf, 1.0], 1, None, 0), (None, [1.0, 2.0], 1, None, None),
    ]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 6, "queries_per_group": 5, "rows_per_block": 30}])
def test_top_k(spark, sizes):
    m = vectors(1, 240)
    rows = [(i, [float(x) for x in v], 0, "s", 1) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows + rows[:3] + odd_rows(1000), VECTORS)
    got = knn.top_k(df, df.where("vec_id % 7 = 0"), k=5, **sizes).collect()
    w = np.floor(1024 * m.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 240, 7):
        s = w @ w[q]
        best = sorted((-int(s[i]), i) for i in range(240) if i != q)[:5]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_prunes_far_cells(spark):
    """Rows around eight far points: the queries lie near two of them and get no others' rows."""
    rng = np.random.default_rng(2)
    points = 8 * np.eye(8)
    m = (points[np.arange(320) % 8] + rng.normal(size=(320, 8)) * 0.01).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, "s", 1) for i, v in enumerate(m)], VECTORS)
    asked = df.where("vec_id < 80 and vec_id % 8 in (1, 4)")
    sizes = {"pivots": 64, "queries_per_group": 1, "rows_per_block": 16}
    units, least, _ = knn.search_units(df, asked, 3, "vec_id", "embedding", 1024, **sizes)
    rows = units.where("not asks").collect()
    assert rows and {r["vec_id"] % 8 for r in rows} == {1, 4}
    of = {(r["grp"], r["cell"]) for r in units.where("asks").collect()}
    assert all(any(r["away"] >= least[c][r["cell"]] for g, c in of if g == r["grp"]) for r in rows)
    # One group for all queries: rows of both points are in each block, and each cell skips the other's.
    for per_group in (1, 1000):
        got = knn.top_k(df, asked, k=3, **sizes | {"queries_per_group": per_group}).collect()
        w = np.floor(1024 * m.astype(np.float64)).astype(np.int64)
        want = []
        for q in [i for i in range(80) if i % 8 in (1, 4)]:
            s = w @ w[q]
            best = sorted((-int(s[i]), i) for i in range(320) if i != q)[:3]
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "", 0), (5, [2.0, 1.0], 0, "", 0), (7, [], 0, "", 0)], VECTORS)
    got = knn.top_k(df, df, k=10).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [
        (0, 5, 2 << 20), (0, 7, 0), (5, 0, 2 << 20), (5, 7, 0), (7, 0, 0), (7, 5, 0)]
    assert knn.top_k(df.limit(0), df.limit(0)).collect() == []
    assert knn.top_k(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("shape", [(1, 4), (4, 4), (3, 5)])
@pytest.mark.parametrize("block", [4096, 7])
def test_embedding_links(spark, monkeypatch, block, shape):
    monkeypatch.setattr(embedding_dedup, "SHAPES", [shape])
    m = vectors(4, 200)
    labels = [(i * 7) % 3 for i in range(200)]
    rows = [(i, [float(x) for x in v], labels[i], "s", 1) for i, v in enumerate(m)]
    odd = [*odd_rows(1000), (2000, rows[0][1], None, "", 0), (2001, [0.0] * 8, 1, "", 0), (2002, [], 1, "", 0)]
    df = spark.createDataFrame([*rows, *odd, rows[0]], VECTORS)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    d = m.astype(np.float64)
    u = d / np.sqrt((d * d).sum(axis=1))[:, None]
    hit = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(hit, False)
    label = classes(200, zip(*np.nonzero(hit)))
    want = {(i, int(hit[i].sum()), label[i], label[i] == i) for i in range(200)}
    want |= {(r[0], 0, r[0], None if r[0] is None else True) for r in odd}
    assert hit.sum() > 100
    assert got == want


@pytest.mark.parametrize("kind", ["array<float>", "array<double>", "array<int>"])
def test_embedding_few_rows_of_any_number(spark, kind):
    """Two and three vectors, of unequal length, large and small components."""
    big = 1 << 30
    rows = [(1, [3, 4], 0), (2, [3 * 2**20, 2**22], 0), (3, [4, -3, 0], 0), (4, [big], 7), (5, [1, 0, 0], 7), (6, [1], 8)]
    whole = kind == "array<int>"
    df = spark.createDataFrame([(i, [x if whole else float(x) for x in v], n) for i, v, n in rows], f"vec_id long, embedding {kind}, label int")
    want = {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)}
    assert {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()} == want
    two = embedding_dedup.near_duplicates(df.where("vec_id < 3")).collect()
    assert {tuple(r) for r in two} == {(1, 1, 1, True), (2, 1, 1, False)}


@pytest.mark.parametrize("shape", [(1, 4), (4, 4), (8, 8)])
def test_tree_lets_each_near_pair_meet_once(shape):
    m = vectors(7, 400).astype(np.float64)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    reach = embedding_dedup.reach_of(0.98)
    tree = embedding_dedup.Tree(unit, *shape)
    cell, angle = tree.angles(unit)
    tree.bound(cell, angle, angle)
    row, cell, own = tree.deal(unit, reach)
    held = [set(cell[row == i].tolist()) for i in range(len(unit))]
    assert len(set(zip(row.tolist(), cell.tolist()))) == len(row) and all(own[i] in held[i] for i in range(len(unit)))
    near = np.linalg.norm(unit[:, None] - unit[None], axis=2) <= reach
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert sum(c in (own[i], own[j]) for c in held[i] & held[j]) == 1


def test_cells_follow_clusters_and_rows():
    """Clustered vectors get cells by their number; noise, of which every cell borders on most, gets few."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 64))
    clustered = centres[rng.integers(0, 300, 8192)] + rng.normal(size=(8192, 64)) * 0.02
    noise = rng.normal(size=(8192, 64))
    trees = {}
    for name, m in (("clustered", clustered), ("noise", noise)):
        unit = m / np.linalg.norm(m, axis=1)[:, None]
        for rows in (8192, 50_000_000):
            tree = embedding_dedup.fitted(unit, rows, rows / 10, embedding_dedup.reach_of(0.98), 4096)
            trees[name, rows] = tree.cells, len(tree.deal(unit, embedding_dedup.reach_of(0.98))[0]) / len(unit)
    assert trees["clustered", 8192][0] == 4 and trees["clustered", 50_000_000][0] >= 64
    assert trees["clustered", 50_000_000][1] < 3
    assert trees["noise", 8192][0] == 4 and trees["noise", 50_000_000][0] == 4


def test_embedding_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(df).collect() == []
    one = spark.createDataFrame([(3, [1.0], 1, "", 0)], VECTORS)
    assert [tuple(r) for r in embedding_dedup.near_duplicates(one).collect()] == [(3, 0, 3, True)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}É" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(n // 5)]
    out = []
    for _ in range(n):
        t = base[rng.integers(len(base))].split()
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(len(t))] = str(rng.choice(words))
        out.append(" ".join(t))
    return out


DOCS = "doc_id long, text string, fingerprint int, component string, row_id string"


def test_simhash(spark):
    some = [*texts(5, 150), "", None, " \t\n", "One", "one two", "ONE Two", "a b c d", "long " * 5000, "x" * 300_000]
    rows = [(i, t, 1, "c", "r") for i, t in enumerate(some)]
    df = spark.createDataFrame([*rows, rows[3], (None, "alone words here", 0, "", "")], DOCS)
    prints = [plain_fingerprint(t) for t in some]
    linked = [(i, j) for i in range(len(some)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = classes(len(some), linked)
    got = simhash.near_duplicates(df).collect()
    want = [(i, f"{prints[i]:016x}", label[i]) for i in range(len(some))]
    want += [want[3], (None, f"{plain_fingerprint('alone words here'):016x}", None)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = simhash.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(label))
    assert len(kept) == len(set(label)) + 1 and kept[0].asDict().keys() == set(df.columns)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_stage_links_by_similarity(spark):
    """The pipeline's stage: exact Jaccard of five-word shingles, 0.8 or more."""
    rng = np.random.default_rng(11)
    some = [*texts(9, 200), "", None, "One", "one two", "ONE Two"]
    long = [f"v{i}" for i in range(300)]
    for _ in range(30):
        at = set(rng.choice(300, rng.integers(1, 12), replace=False).tolist())
        some.append(" ".join(f"x{rng.integers(9)}" if i in at else w for i, w in enumerate(long)))
    sets = []
    for t in some:
        words = (t or "").lower().replace("É", "é").split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    label = classes(len(some), [(i, j) for i in range(len(some)) for j in range(i) if alike(sets[i], sets[j])])
    df = spark.createDataFrame([(i, t, 1, "c", "r") for i, t in enumerate(some)], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label))
    few = staged(simhash.with_bands(df, "text", 5).withColumn("row_id", F.monotonically_increasing_id()))
    edges = [simhash.similar_links(few, "text", 5, 0.8, block) for block in (7, 256)]
    found = [{r["node"]: r["component"] for r in connected_components(e).collect()} for e in edges]
    assert found[0] == found[1] and found[0]


def test_stage_proposes_by_simhash(spark):
    """Four of five shingles in common, two or three bits apart, and no MinHash key shared."""
    pairs = [
        ("10028 10029 1002a 1002b 1002c 1002d 1002e 1002f", "38"), ("1ad20 1ad21 1ad22 1ad23 1ad24 1ad25 1ad26 1ad27", "7e"),
        ("1d1e8 1d1e9 1d1ea 1d1eb 1d1ec 1d1ed 1d1ee 1d1ef", "da"),
    ]
    some = [t for a, word in pairs for t in (a, f"{a} {word}")] + ["", None, "quite another text of some eight words here"]
    for a, b in zip(some[:6:2], some[1:6:2]):
        prints, marks = zip(*(simhash.print_and_marks(t.encode(), 5) for t in (a, b)))
        assert (prints[0] ^ prints[1]).bit_count() <= 3 and not set(simhash.bands_of(marks[0])) & set(simhash.bands_of(marks[1]))
    df = spark.createDataFrame([(i, t, 1, "c", "r") for i, t in enumerate(some)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 2, 4, 6, 8]


def test_simhash_proposals_are_checked(spark):
    """Equal or close SimHashes only propose: without any MinHash key in common, copies
    of other shingle counts and close texts are linked, texts less than 0.8 alike not."""
    long = [f"v{i}" for i in range(400)]
    some = [" ".join(long), " ".join([*long, "x"]), " ".join([*long, *long]), " ".join([*long, "y", "z"]), " ".join(f"u{i}" for i in range(50)), "", None]
    df = spark.createDataFrame([(i, t, 1, "c", "r") for i, t in enumerate(some)], DOCS)
    rows = simhash.with_bands(df, "text", 5).withColumn("row_id", F.monotonically_increasing_id())
    alone = F.when(F.size("bands") > 0, F.array(F.col("row_id"))).otherwise(F.col("bands"))
    links = lambda simhash_: connected_components(
        simhash.similar_links(staged(rows.withColumns({"bands": alone, "simhash": simhash_})), "text", 5, 0.8)
    ).count()
    assert links(F.col("simhash")) == 3
    assert links(F.lit(5).cast("long")) == 3  # one SimHash for all: the other text is proposed and not linked
    assert links(F.xxhash64("row.doc_id")) == 0


def test_simhash_large_bucket_in_blocks(spark):
    """One bucket cut into many units finds what one unit does."""
    rng = np.random.default_rng(6)
    prints = {0}
    while len(prints) < 300:
        base = rng.choice(list(prints)) if rng.random() < 0.7 else int(rng.integers(1 << 30))
        prints.add(int(base) ^ (1 << int(rng.integers(40))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = classes(len(prints), linked)
    want = {(prints[i], prints[label[i]]) for i in range(len(prints)) if label[i] != i}
    for block in (11, 2048):
        edges = simhash.near_links(df, 3, block)
        assert {tuple(r) for r in connected_components(edges).collect()} == want


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200}
    assert connected_components(edges.limit(0)).collect() == []


def test_exact_at_the_threshold():
    a = np.array([[1.0, 0.0]])
    b = np.array([[0.98, math.sqrt(1 - 0.98**2)]])
    assert embedding_dedup.linked(a, b, 0.98)[0, 0] == (embedding_dedup.exact_cosine(a[0], b[0]) >= 0.98)
