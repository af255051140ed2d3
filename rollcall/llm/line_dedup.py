"""Line dedup by a log-template tree, as DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import drop_staged, packed, staged, unpacked

LEADING = 3  # tokens that lead to a leaf, besides the number of tokens
RUNS = 10  # runs of tokens in which the lines of a leaf are compared
ALIKE = 0.8  # share of the runs in which lines of one template agree
VARIANTS = 3  # different lines from which a template that leaves out runs is one
VARIABLE = "<*>"
# The runs that a template leaves out, by the number of a line's runs
LEFT_OUT = {n: list(combinations(range(n), int(n * (1 - ALIKE) + 1e-9))) for n in range(1, RUNS + 1)}
# Runs of pairs of blocks (0-1, 2-3, 4-5, 6-7, 8-9), so that each three blocks hold a pair
PREFILTER = [(0, 1, 2, 3), (4, 5, 6, 7), (4, 5, 8, 9), (6, 7, 8, 9)]
LAST = (1 << 63) - 1  # stands for a null doc_id
# A token with a digit, from 64 characters before its first digit on: so that long
# runs without one are passed in linear time.
FIELD = r"[^\s\d]{0,64}+\d\S*"
# Runs of blanks within a line that aren't a single space, and what shows that it has some
BLANKS = r"\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20{2,}"
SHOW_BLANKS = ["  ", "\t", "\x0b", "\x0c", "\r"]


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, line, leaf, template, runs) of each line with tokens of ``docs(key, text)``.

    Tokens with a digit are variable fields. ``leaf`` stands for the number of
    tokens and the leading ones, ``template`` for all tokens, ``runs`` for the
    ``RUNS`` runs of tokens one by one, or for each of fewer tokens. A line with
    fields in over half of its tokens is taken as it is: its numbers are its content.
    Patterns are looked for only in lines that have blanks or digits to replace.
    """
    line, masked, tokens = F.col("plain"), F.col("masked"), F.col("tokens")
    blanks = reduce(Column.__or__, [line.contains(x) for x in SHOW_BLANKS])
    lines = (
        docs.select("key", F.posexplode(F.split("text", "\n")).alias("line", "plain"))
        .where(F.btrim(line, F.lit("".join(SHOW_BLANKS))) != "")
        .select("key", "line", F.trim(F.when(blanks, F.regexp_replace(line, BLANKS, " ")).otherwise(line)).alias("plain"))
        .withColumn("masked", F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, VARIABLE)).otherwise(line))
        .withColumn("tokens", F.split(masked, " "))
    )
    n = F.size(tokens)
    fields = F.when(masked.contains(VARIABLE), _count(masked, VARIABLE)).otherwise(0)
    count = F.least(n, F.lit(RUNS))
    bound = lambda i: F.floor(n * i / count).cast("int")
    runs = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.hash(F.slice(tokens, bound(i) + 1, bound(i + 1) - bound(i))),
    )
    literal = 2 * fields > n
    return lines.select(
        "key", "line",
        F.when(literal, F.xxhash64(line)).otherwise(F.xxhash64(n, F.slice(tokens, 1, LEADING))).alias("leaf"),
        F.when(literal, F.xxhash64(line)).otherwise(F.xxhash64(masked)).alias("template"),
        F.when(literal, F.array().cast("array<int>")).otherwise(runs).alias("runs"),
    )


def _count(text: Column, part: str) -> Column:
    """How often ``part`` (ASCII) stands in a text."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _agreeing(kinds: DataFrame) -> DataFrame:
    """The ``kinds`` that may share a key of :func:`generalised` with others. Two lines
    of ten runs that differ in two agree in at least three of five blocks of two runs,
    and each three of those hold one of the pairs ``PREFILTER``: lines without another
    of several documents under any of the pairs needn't be looked into."""
    pairs = [F.struct(F.lit(i).alias("pair"), F.xxhash64(*[F.get("runs", F.lit(r)) for r in runs_]).alias("hash")) for i, runs_ in enumerate(PREFILTER)]
    long_ = kinds.where(F.size("runs") == RUNS)
    at = long_.select("leaf", "template", "first", "last", F.explode(F.array(*pairs)).alias("at")).select("*", "at.*").drop("at")
    crowded = staged(
        at.groupBy("leaf", "pair", "hash").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("n"))
        .where((F.col("a") != F.col("b")) & (F.col("n") >= VARIANTS)).select("leaf", "pair", "hash")
    )
    found = staged(at.join(crowded, ["leaf", "pair", "hash"], "left_semi").select("leaf", "template").distinct())
    return long_.join(found, ["leaf", "template"], "left_semi").unionByName(kinds.where(F.size("runs") < RUNS))


def generalised(kinds: DataFrame) -> DataFrame:
    """(leaf, key, template, first): ``kinds`` under each template that leaves out as
    many runs as may differ (``ALIKE``), and that has at least ``VARIANTS`` different
    lines and lines in several documents. Lines of a leaf share a ``key`` if they agree
    in all other runs, whatever else is in the leaf."""
    mixed = staged(
        kinds.groupBy("leaf").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("kinds"))
        .where((F.col("a") != F.col("b")) & (F.col("kinds") >= VARIANTS)).select("leaf")
    )
    marks = F.array(*[F.xxhash64(F.lit(i), F.get("runs", F.lit(i))) for i in range(RUNS)])
    mark = lambda i: F.coalesce(F.get("marks", i), F.lit(0).cast("long"))
    rest = reduce(Column.bitwiseXOR, [mark(F.lit(i)) for i in range(RUNS)] + [mark(F.get("out", F.lit(k))) for k in (0, 1)])
    outs = F.lit(None)
    for n, left_out in LEFT_OUT.items():
        if left_out != [()]:
            outs = F.when(F.size("runs") == n, F.array(*[F.array(*map(F.lit, out)) for out in left_out])).otherwise(outs)
    alike = staged(
        _agreeing(kinds.join(mixed, "leaf", "left_semi")).withColumn("marks", marks).select("*", F.explode(outs).alias("out"))
        .select("leaf", F.xxhash64("out", rest).alias("key"), "template", "first", "last")
    )
    shared = staged(
        alike.groupBy("leaf", "key").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("n"))
        .where((F.col("a") != F.col("b")) & (F.col("n") >= VARIANTS)).select("leaf", "key")
    )
    return alike.join(shared, ["leaf", "key"], "left_semi").drop("last")


def folded(alike: DataFrame) -> DataFrame:
    """(leaf, template, holder): lines that give way to a line of an earlier document,
    with that document's key. ``alike`` has (leaf, key, template, first).

    Rounds of leader election: a line that comes first under all its keys stays; lines
    that share a key with one that stays, and come later, give way; the rest goes into
    the next round. So what gives way is alike to a line that stays, never only to one
    that gives way itself. A round decides at least the first line of every chain."""
    left, out = staged(alike), None
    while not left.isEmpty():
        lowest = staged(left.groupBy("leaf", "key").agg(F.min("first").alias("lowest")))
        leaders = staged(
            left.join(lowest, ["leaf", "key"]).groupBy("leaf", "template").agg(F.bool_or(F.col("lowest") < F.col("first")).alias("later"))
            .where("not later").select("leaf", "template")
        )
        held = staged(left.join(leaders, ["leaf", "template"], "left_semi").groupBy("leaf", "key").agg(F.min("first").alias("holder")))
        gone = staged(
            left.join(held, ["leaf", "key"]).where("holder < first").groupBy("leaf", "template").agg(F.min("holder").alias("holder"))
        )
        out = gone if out is None else out.unionByName(gone)
        decided = staged(leaders.unionByName(gone.select("leaf", "template")))
        now = staged(left.join(decided, ["leaf", "template"], "left_anti"))
        for done in (lowest, leaders, held, decided, left):
            drop_staged(done)
        left = now
    return left.select("leaf", "template", F.col("first").alias("holder")) if out is None else out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, gone): numbers of the lines of ``docs(key, text)`` with a template
    that occurs in a document of a smaller key. Equal lines are counted together before
    the tree is walked, so a line that very many documents share is one row there."""
    lines = staged(lines_of(docs))
    # Staged, so that both sides of the join are dealt anew and a hot leaf can be split.
    leaves = staged(lines.groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("leaf"))
    lines = staged(lines.join(leaves, "leaf", "left_semi"))  # others meet no other document
    kinds = staged(
        lines.groupBy("leaf", "template", "runs").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    )
    places = staged(
        kinds.join(folded(generalised(kinds)), ["leaf", "template"], "left")
        .select("leaf", "template", F.coalesce("holder", "first").alias("first"), "last").where("first <> last")
    )
    return (
        lines.join(places, ["leaf", "template"]).where("key <> first")
        .groupBy("key").agg(F.collect_set("line").alias("gone"))  # rows that repeat hold a line twice
    )


def _without(text: Column, gone: Column) -> Column:
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as ``row`` with its text and a key that sorts by doc_id, nulls last."""
    number, body = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)), F.col(f"`{text}`").cast("string")
    return packed(docs, key=F.struct(number.alias("id"), mark_of(body).alias("mark")), text=body)


def _deduplicated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = _keyed(docs, doc_id, text)
    gone = repeated_lines(rows.select("key", "text"))
    joined = rows.join(gone, rows.key == gone.key, "left").drop(gone.key)
    return joined.select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(_count(F.col("text"), "\n") + 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document without the lines that repeat a template of an earlier one:
    (doc_id, text, n_lines, n_dropped), by DataFrame functions only.

    Lines go down a tree of fixed depth: by their number of tokens, by their
    first ``LEADING`` tokens, tokens with digits being variable fields. A line has
    the template of its fixed tokens and those that leave out a few of its runs of
    tokens (:func:`generalised`); a leaf holds any number of them. Equal lines, but for
    fields with digits, are a template from two documents on; one that leaves out runs
    has ``VARIANTS`` different lines beside, so that two sentences that differ in a
    word or two are none. A line is dropped if it is equal to a line of a document with
    a smaller doc_id, or shares a template with such a line that stays there
    (:func:`folded`): whatever goes has its like in the output. Lines that repeat
    within one document only stay.

    Blank lines stay and count for nothing. Null texts stay null, empty ones empty.
    Null ids come last. Rows equal in doc_id and text are one document, of rows with one
    doc_id and several texts the one with the smallest hash comes first. Texts are
    taken whole, however long; a line of any length is its hashes. Extra columns are
    ignored; an empty table gives no rows. Only hashes of lines are
    grouped; texts are shuffled once, to meet the numbers of their dropped lines.
    """
    out = _deduplicated(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), "doc_id", "text")
    return out.select("row.doc_id", "text", "n_lines", "n_dropped")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with the texts of :func:`deduplicate` and all other columns;
    ``n_chars`` names a column that follows the text's length. Documents of which
    no token stays, though they had dropped lines, go."""
    out = _deduplicated(docs, doc_id, text).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col("row").withField(f"`{text}`", F.col("text"))
    if n_chars is not None:
        length = F.when(F.col("n_dropped") == 0, F.col(f"row.`{n_chars}`")).otherwise(F.length("text").cast("long"))
        row = row.withField(f"`{n_chars}`", length)
    return unpacked(out.withColumn("row", row))
