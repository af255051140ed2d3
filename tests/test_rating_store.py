"""Ratings as a log: a period reads and writes its own buckets."""

from pyspark.sql import functions as F

from rollcall.operators import rating
from rollcall.session import folder_values, remove
from rollcall.sources import rating_store
from rollcall.sources.rating_store import RatingStore
from tests.conftest import rows

KEYS = "map int, player string"


def store(spark, tmp_path, **options):
    return RatingStore(spark, str(tmp_path / "s"), spark.createDataFrame([], KEYS).schema, **options)


def changes(spark, *data):
    return spark.createDataFrame(list(data), KEYS + ", elo_delta double")


def test_log_adds_up(spark, tmp_path):
    s = store(spark, tmp_path, fold_every=2)
    s.start(spark.createDataFrame([(1, "a", 10.0), (1, "n", None), (2, "a", None)], KEYS + ", rating double"))
    batches = [
        [(1, "a", 1.5), (1, "b", 0.0), (2, "a", 2.0)], [(1, "a", -1.5), (1, "a", 4.0), (1, "n", 0.0)], [(3, "c", -7.0)],
        [(1, "b", 1.0), (3, "c", 7.0)], [(2, "a", 1.0)],
    ]
    want = {(1, "a"): 10.0, (1, "n"): None, (2, "a"): None}
    for n, data in enumerate(batches):
        before = dict(want)
        got = {(r.map, r.player): r.rating for r in s.lookup(changes(spark, *data), n).collect()}
        assert got == {k: v for k, v in before.items() if k in {(m, p) for m, p, _ in data}}
        for again in (1, 2):  # a period that runs again changes nothing
            s.add(changes(spark, *data), n)
        for m, p, d in data:
            if d or (m, p) not in want:
                want[m, p] = (want.get((m, p)) or 0.0) + d
        assert {(r.map, r.player): r.rating for r in s.read().collect()} == want
    assert sorted(s._bases()) == [1, 3] and s._periods() == [2, 3, 4]
    got = {(r.map, r.player): r.rating for r in s.lookup(changes(spark, (2, "a", 0.0)), 3).collect()}
    assert got == {(2, "a"): 2.0}  # as period 3 found it


def test_what_a_period_reads_does_not_follow_the_stored_ratings(spark, tmp_path):
    wanted = changes(spark, *[(1, f"p{i}", 1.0) for i in range(4)])
    read = {}
    for size in (2_000, 32_000):
        s = store(spark, tmp_path / str(size), rows_per_bucket=100)
        s.start(spark.range(size).select(F.lit(1).alias("map"), F.concat(F.lit("p"), "id").alias("player"), F.col("id").cast("double").alias("rating")))
        df = s.lookup(wanted, 0)
        assert rows(df, "player", "rating") == [(f"p{i}", float(i)) for i in range(4)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan
        hit = {r.bucket for r in wanted.select(s._bucket(s._bases()[-1]).alias("bucket")).collect()}
        files = spark.read.schema(s.schema).parquet(f"{s.root}/base").where(F.col("bucket").isin(sorted(hit)))
        read[size] = files.count()
        assert len(hit) <= 4 and s._bases()[-1] >= size / 200
        s.add(wanted, 0)
        assert {int(v) for v in folder_values(spark, f"{s.root}/changes/period=0", "bucket")} == hit
    assert read[32_000] < 2 * max(read[2_000], 400) and read[32_000] < 1_000


def test_empty_store(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read().count() == 0 and s.lookup(changes(spark, (1, "a", 1.0))).columns == ["map", "player", "rating"]
    remove(spark, s.root)


def test_rounds_fold_to_the_same_ratings(spark):
    matches = spark.createDataFrame(
        [(f"{d}-{m}", d, 1, p, (p * 7 + d * m) % 5, 3, 0.0) for d in range(7) for m in range(2) for p in range(m, 3 + m)],
        "snapshot_id string, day int, map int, player int, score_delta int, players long, mean_delta double",
    ).withColumn("player", F.col("player").cast("string"))
    start = spark.createDataFrame([(1, "0", 100.0), (1, "x", None), (2, "0", 5.0)], KEYS + ", rating double")
    results = [rows(rating.elo_rounds(matches, "map", F.col("day"), start, fold_every=n).withColumn("rating", F.round("rating", 9))) for n in (1, 3, 100)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 6
    assert rating_store.FIRST_BUCKETS == 16
