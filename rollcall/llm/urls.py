"""URL filter: host and path rules, and boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import A_TO_Z, staged

MOST_URLS = 20_000  # labelled URLs at most that the trees are fitted on
PRIOR = 10.0  # weight of the overall share in a suffix's share
FOLDS = 5  # of hosts: a row's suffix is described by the other folds' rows while fitting


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with /

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty without ://"""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, A_TO_Z, A_TO_Z.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ? or #; empty without ://"""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(name, verdict) of the longest rule that fits, null if none does. A rule
    fits its host and all subdomains, if the path starts with its path; of equal
    rules a block wins."""
    fitting = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        fitting = F.when(fits, found).otherwise(fitting)
    return fitting


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")
    terms = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda total, c: total + F.when(
            F.length(c) > 0, (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
            * F.log2((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
        ).otherwise(0.0),
    )
    return F.when(size > 0, -terms).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / size,
        "f_host_digits": F.regexp_count(host, F.lit("[0-9]")).cast("double"),
        "f_marks": F.regexp_count(url, F.lit("[^A-Za-z0-9]")) / size,
        "f_host_dashes": F.regexp_count(host, F.lit("-")).cast("double"),
        "f_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "f_query_length": F.length(query).cast("double"),
        "f_entropy": _entropy(url),
        "f_host_entropy": _entropy(host),
        "f_secure": url.startswith("https:").cast("double"),
        "f_fragment": url.contains("#").cast("double"),
    }


def _share(blocked: Column, rows: Column, overall: float) -> list[Column]:
    """Smoothed share of blocked URLs, and how many it rests on."""
    share = (blocked + F.lit(PRIOR * overall)) / (rows + F.lit(PRIOR))
    return [share.alias("f_suffix"), F.log1p(rows).alias("f_suffix_seen")]


def _out_of_fold(known: DataFrame, overall: float) -> DataFrame:
    """``known`` with the share of its suffix among rows of other folds of hosts, so
    that no label, and no label of the same host, describes the row it is fitted on."""
    sums = [F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")]
    own = known.groupBy("suffix", "fold").agg(*sums)
    total = own.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    others = own.join(total, "suffix").select(
        "suffix", "fold", *_share(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n"), overall))
    return known.join(others, ["suffix", "fold"])


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with their lexical features."""
    return rows.select("*", *[c.alias(n) for n, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])


class Learned:
    """Boosted trees fitted on described URLs (url, host, path, suffix, label 0.0 or 1.0)."""

    def __init__(self, known: DataFrame, trees: int, depth: int):
        known = known.withColumn("fold", F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)))
        self.overall = known.agg(F.avg("label")).first()[0]
        # A row per suffix of the sample, as many as its URLs at most.
        self.seen = staged(known.groupBy("suffix").agg(*_share(F.sum("label"), F.count(F.lit(1)), self.overall)))
        names = [*lexical(F.col("url"), F.col("host"), F.col("path")), "f_suffix", "f_suffix_seen"]
        self.assemble = VectorAssembler(inputCols=names, outputCol="features")
        learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, labelCol="label", featuresCol="features")
        self.model = learner.fit(self.assemble.transform(_out_of_fold(known, self.overall)).select("label", "features"))

    def judged(self, rows: DataFrame) -> DataFrame:
        """Described ``rows`` with a ``prediction``, 1.0 to block."""
        rows = rows.join(F.broadcast(self.seen), "suffix", "left")
        rows = rows.fillna({"f_suffix": self.overall, "f_suffix_seen": 0.0})
        return self.model.transform(self.assemble.transform(rows))


def with_parts(pages: DataFrame, rules: list[Rule], page_id: str, url: str) -> DataFrame:
    """(page_id, url, host, path, fit, suffix): ``fit`` is the rule that decides."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix_of(F.col("host")))


def known_urls(rows: DataFrame, labelled: DataFrame | None, most: int) -> DataFrame:
    """Described URLs with a label: those of ``labelled``, or else the verdicts of
    rules; ``most`` distinct ones at most, chosen by hash, none with both labels."""
    if labelled is None:
        known = rows.where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("int").alias("label"))
    else:
        known = labelled.select("url", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    known = (
        known.where("url is not null").groupBy("url").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").drop("other")
        .orderBy(F.xxhash64("url"), "url").limit(most)
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    return _described(known).withColumn("label", F.col("label").cast("double"))


def held_out(
    pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
    most: int = MOST_URLS, trees: int = 20, depth: int = 4,
) -> DataFrame:
    """(label, prediction, urls): how trees fitted without a fifth of the hosts, chosen
    by hash, judge the URLs of those hosts. No rows if the others' labels are of one kind."""
    known = known_urls(with_parts(pages, rules, page_id, url), labelled, most).persist()
    try:
        out = F.pmod(F.xxhash64("host", F.lit("held out")), F.lit(5)) == 0
        rest = known.where(~out)
        if rest.select("label").distinct().count() < 2:
            return known.sparkSession.createDataFrame([], "label double, prediction double, urls long")
        judged = Learned(rest, trees, depth).judged(known.where(out))
        return staged(judged.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("urls")))
    finally:
        known.unpersist()


def judge(
    pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
    most: int = MOST_URLS, trees: int = 20, depth: int = 4,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, by DataFrame functions only.

    The longest rule that fits decides; ``rules`` is a list in the plan, so it
    should stay within some hundreds. Other URLs are judged by gradient-boosted
    trees on lexical features and on the share of blocked URLs of their host's
    last two labels. They learn from ``labelled`` (url, label: 1 to block, 0 to
    allow), by default from the pages that a rule decides; at most ``most``
    distinct URLs, chosen by hash, are used and a URL with both labels isn't.
    While fitting, a suffix's share comes from other hosts only; :func:`held_out`
    measures the trees on hosts they haven't seen. Without labels of both kinds
    the method allows all.

    Null URLs and URLs without :// have an empty host and path and are judged by
    the method as well. Every row, repeated or with a null id, gets one; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = with_parts(pages, rules, page_id, url)
    known = known_urls(rows, labelled, most).persist()
    try:
        if known.select("label").distinct().count() < 2:
            return _verdicts(rows.withColumn("prediction", F.lit(0.0)))
        learned = Learned(known, trees, depth)
    finally:
        known.unpersist()
    return _verdicts(learned.judged(_described(rows)))


def _verdicts(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict")
    )
