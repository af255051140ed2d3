"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.common import WORD, packed, staged, unpacked

ROWS_BY_ROOT = 16  # rows per bucket, as a multiple of the root of a source's rows
MOST_REPEATS = 3
BROADCAST_SOURCES = 10_000  # source tables of up to so many rows are broadcast
LEAST_QUALITY = 1e-6


def words_in(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mark_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def uniform(doc_id: Column, mark: Column, seed: int) -> Column:
    """A number above 0 and below 1 for a document, the same in every run: 52 bits
    of the MD5 of ``seed/id/mark``."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), mark).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes(source, source_size, weight)`` with ``target``: ``share`` of all
    sizes dealt out by weight; no source gets over ``most`` times its size, and
    what is left over is dealt to the others by weight until none is above.

    Each round is one grouped sum over the sources, and finds those that reach
    their limit at the level of the round before; the level only rises, so a
    source that has reached its limit stays there. Null or negative weights are 0.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    total, level, full = None, 0.0, -1
    while True:
        reached = F.col("limit") <= F.lit(level) * F.col("weight")
        r = sizes.agg(
            F.sum("source_size").alias("size"), F.count_if(reached).alias("full"),
            F.sum(F.when(reached, F.col("limit"))).alias("used"), F.sum(F.when(~reached, F.col("weight"))).alias("weight"),
        ).first()
        total = share * (r["size"] or 0) if total is None else total
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], max(level, (total - (r["used"] or 0.0)) / r["weight"])
    return sizes.select("source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


def _by_source(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Inner join on the null-safe key ``source``; a table of few rows is broadcast,
    one of many is joined on the key, where a hot source can be split."""
    table = table.withColumnRenamed("source", "of")
    table = F.broadcast(table) if n <= BROADCAST_SOURCES else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix(
    docs: DataFrame, weights: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", share: float = 1.0, most: int = MOST_REPEATS, seed: int = 0, rows_by_root: float = ROWS_BY_ROOT,
) -> DataFrame:
    """How much of each document the mix takes: (doc_id, source, size, source_size,
    target, copies, taken), by DataFrame functions only.

    ``size`` is the number of words; ``target`` is the budget of the document's
    source (:func:`targets`, with ``weights(source, weight)``; sources without a
    weight get none). A source whose target is e times its size or more gives e
    complete epochs; for the rest its documents are drawn without replacement by
    Efraimidis and Spirakis: each has an exponential key -ln(u) / quality, keys are
    sorted within the source and sizes summed, and documents are taken while the
    middle of a document's span of words is within the rest. So the words taken
    miss a target by half a document at most. ``taken`` is size times ``copies``.
    ``quality(doc_id, quality)`` holds positive weights, 1 where it has none.

    u is a hash of ``seed``, doc_id and text, so reruns agree and equal rows follow
    each other. Keys, scaled by the source's mean quality, are cut into buckets of
    about ``rows_by_root`` times the root of the source's number of documents:
    bucket sums show in which one the rest ends, and only that one is sorted.

    Null texts have size 0; a null source is a source of its own; null ids are
    drawn like others. Texts without words take no part in sums and keep a row.
    Extra columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        words_in(F.col(f"`{text}`")).alias("size"), mark_of(F.col(f"`{text}`")).alias("mark"),
    )
    return drawn(staged(rows), weights, quality, share, most, seed, rows_by_root).drop("mark")


def drawn(
    rows: DataFrame, weights: DataFrame, quality: DataFrame | None, share: float, most: int, seed: int, rows_by_root: float,
) -> DataFrame:
    """:func:`mix` of staged rows (doc_id, source, size, mark), whose columns stay."""
    if quality is not None:
        known = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(known, "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    rows = rows.withColumn("quality", F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(LEAST_QUALITY)).cast("double"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), F.col("mark"), seed)) / F.col("quality"))

    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean_quality")
    )
    known = weights.select(F.col("source").alias("of"), "weight")
    sums = staged(sums.join(known, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))
    n = sums.count()
    budget = targets(sums, share, most).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    buckets = sums.select("source", F.ceil(F.sqrt("n") / rows_by_root).alias("buckets"), "mean_quality")
    budget = budget.join(buckets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    placed = _by_source(rows, budget, n).withColumn(
        "bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_quality"))) * F.col("buckets")).cast("long")
    )
    filled = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (
        filled.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("last"))
        .select("source", F.col("last.bucket").alias("last"), F.col("last.before").alias("before"))
    )
    last = staged(last).withColumnRenamed("source", "of")
    last = F.broadcast(last) if n <= BROADCAST_SOURCES else last
    placed = placed.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    out = [c for c in rows.columns if c not in ("quality", "key")]
    head = [*out, "source_size", "target", "epochs"]
    whole = placed.where("last is null or bucket <> last").select(
        *head, (F.coalesce(F.col("bucket") < F.col("last"), F.lit(True)) & (F.col("rest") > 0)).cast("long").alias("more")
    )
    # Only the bucket in which the rest ends is sorted.
    ordered = W.partitionBy("source").orderBy("key", "doc_id", "mark", "size")
    middle = F.col("before") + F.sum("size").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2
    cut = placed.where("bucket = last").withColumn("more", ((middle <= F.col("rest")) & (F.col("rest") > 0)).cast("long")).select(*head, "more")
    mixed = whole.union(cut).withColumn("copies", F.col("epochs") + F.col("more"))
    return mixed.withColumn("taken", F.col("copies") * F.col("size")).drop("epochs", "more")


def by_rank(docs: DataFrame, pattern: list[float], source: str = "source") -> DataFrame:
    """Weights (source, weight) that repeat ``pattern`` over the sources by code
    point, null last. Numbers the distinct sources in one task; documents are
    reduced to them first."""
    names = docs.select(F.col(f"`{source}`").alias("source")).distinct()
    at = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    return names.withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), (at % len(pattern) + 1).cast("int")))


def repeated(
    docs: DataFrame, weights: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", share: float = 1.0, most: int = MOST_REPEATS, seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it."""
    rows = staged(
        packed(
            docs, doc_id=F.col(f"`{doc_id}`"), source=F.col(f"`{source}`"), size=words_in(F.col(f"`{text}`")),
            mark=mark_of(F.col(f"`{text}`")), nth=F.monotonically_increasing_id(),
        )
    )
    copies = drawn(rows.drop("row"), weights, quality, share, most, seed, ROWS_BY_ROOT).where("copies > 0")
    taken = rows.select("row", "nth").join(copies.select("nth", "copies"), "nth")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
