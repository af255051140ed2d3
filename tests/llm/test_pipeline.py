"""The pipeline's stages on a small folder, each against its own input."""

import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from rollcall.llm import bpe, mixing, quality, simhash
from rollcall.llm.common import staged

from .test_pairs import classes
from .test_texts import plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_order_and_columns(spark, outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == names for df in outputs[:-1])
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, outputs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows(outputs[0])} == good and 0 < len(good) < docs.count()
    marked = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()
    clean = [d for d, in marked if zlib.crc32(str(d).encode()) % 5]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)


def test_line_stage(outputs):
    before, after = rows(outputs[0]), {r["doc_id"]: r for r in rows(outputs[1])}
    gone = plain_lines([(r["doc_id"], r["text"]) for r in before])
    for r in before:
        lost = gone.get((False, r["doc_id"], r["text"]), set())
        kept = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in lost)
        if lost and not kept.strip():
            assert r["doc_id"] not in after
        else:
            assert after[r["doc_id"]]["text"] == kept
            assert after[r["doc_id"]]["n_chars"] == (len(kept) if lost else r["n_chars"])


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(docs):
    """The first of each class by steps of at least 0.8 of five-word shingles, all pairs compared."""
    sets = [shingles(r["text"]) for r in docs]
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b) - 1e-9 if a and b else not a and not b
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    return {docs[i]["doc_id"] for i in set(classes(len(sets), linked))}


def test_simhash_stage(outputs):
    before = sorted(rows(outputs[1]), key=lambda r: r["doc_id"])
    first = plain_kept(before)
    assert {r["doc_id"] for r in rows(outputs[2])} == first and outputs[2].count() == len(first)


def test_simhash_stage_on_raw_documents(spark):
    """The documents as given hold copies, and near ones that only a part of the shingles tells apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = sorted(rows(docs), key=lambda r: r["doc_id"])
    text = max((r["text"] for r in before if r["text"]), key=len)
    near = [text + " one more word", text.replace(" ", "  "), "x " + text, text[len(text) // 2:], text[:len(text) // 4]]
    more = [{**before[0], "doc_id": 10**6 + i, "text": t} for i, t in enumerate(near)]
    first = plain_kept(before + more)
    out = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF)
    assert {r["doc_id"] for r in rows(out)} == first and out.count() == len(first) < len(before)
    assert not {10**6, 10**6 + 1, 10**6 + 2} & first and {10**6 + 3, 10**6 + 4} <= first


def test_simhash_stage_on_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = simhash.one_of_each(docs.union(docs))
    classes_ = simhash.near_duplicates(docs)
    assert one.count() == classes_.select("component_id").distinct().count()


def test_mix_stage(spark, outputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mixed = mixing.mix(outputs[2], mixing.by_rank(outputs[2], [1.0, 2.0, 3.0]), corpus_pipeline.marked_quality(labels))
    want = Counter({r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in rows(outputs[3])) == want


def test_bpe_stage(outputs):
    with open(corpus_pipeline.VOCABULARY, "rb") as file:
        ranks = bpe.Vocabulary(file.read(), public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows(outputs[3])}
    got = rows(outputs[4])
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows(outputs[3]))
    assert all(r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in got)


LONG = " ".join(f"w{i % 997}x{i % 1009}" for i in range(60_000))
SHARED = "This line stands in several documents"


def frame(spark, pairs, more=""):
    kind = "doc_id long, text string, lang string, source string, n_chars long" + more
    return spark.createDataFrame([(i, t, None, s, 7, *["z"] * more.count(",")) for i, t, s in pairs], kind)


ODD = [(1, None, None), (None, "a b c d e", "s"), (1, "", None), (1, "", None), (2, f"x\n{SHARED}", "t"), (3, f"{SHARED}\ny", "t"), (4, SHARED, None), (5, LONG, "s"), (6, LONG + " z", "s"), (None, "a b c d e", "s")]
BESIDE = ", row string, key string, gone string, fingerprint string, bands string, copies string, size string, ids string"


@pytest.mark.parametrize("more", ["", BESIDE])
def test_odd_rows_stage_by_stage(spark, more):
    """Nulls, empty, repeated and very long texts, extra columns with the stages' own names."""
    docs = frame(spark, ODD, more)
    kept = rows(corpus_pipeline.classify(spark, docs, SF))
    scores = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in scores.collect())

    out = corpus_pipeline.drop_lines(spark, docs, SF)
    assert out.columns == docs.columns
    # 4 had nothing but the line that 2 keeps; texts that were empty before stay.
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in rows(out)) == Counter([
        (1, None, 7), (None, "a b c d e", 7), (1, "", 7), (1, "", 7), (2, f"x\n{SHARED}", 7), (3, "y", 1), (5, LONG, 7), (6, LONG + " z", 7), (None, "a b c d e", 7),
    ])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    # Texts without words are one class, and rows that repeat one; 6 is 5 and a word.
    got = Counter((r["doc_id"], r["text"] or "") for r in rows(out))
    assert got == Counter([(1, ""), (None, "a b c d e"), (2, f"x\n{SHARED}"), (3, f"{SHARED}\ny"), (4, SHARED), (5, LONG)])

    out = corpus_pipeline.mix(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mixed = mixing.mix(docs, mixing.by_rank(docs, [1.0, 2.0, 3.0]), corpus_pipeline.marked_quality(labels)).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += r["copies"]
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in rows(out)) == +want and want.total() > 0

    out = {(r["doc_id"], r["n_tokens"]) for r in rows(corpus_pipeline.tokenize(spark, docs, SF))}
    assert {(1, 0), (4, 6), (3, 8)} <= out and len(out) == 7


def test_empty_tables_go_through(spark):
    docs = frame(spark, []).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF))
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)
