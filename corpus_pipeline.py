"""From raw documents to token ids: five stages over the operators of rollcall.llm.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet before the next one reads it. Texts are taken whole, however
long; an empty table stays empty, and columns with names that an operator uses
itself don't get in its way.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import bpe, line_dedup, mixing, quality, simhash
from rollcall.llm.common import staged
from rollcall.llm.queries import MIX_PATTERN, marked_quality, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all columns stay. Null texts
    are scored as empty ones; rows that repeat are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template occurs in an earlier document go, and documents of
    which nothing is left; ``n_chars`` follows the text. Null and empty texts stay as
    they are, rows equal in doc_id and text are one document and all stay."""
    return line_dedup.without_repeats(docs, n_chars="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest
    doc_id (nulls last): texts of which 80 % of the five-word shingles are common, in
    steps. SimHash fingerprints within three bits propose them, MinHash keys those whose
    fingerprints lie further apart, and the shingles are compared exactly. Texts without
    words, null ones too, are one group; of rows that repeat, one stays."""
    return simhash.one_of_each(docs, distance=3, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 1, 2, 3, repeating, a null one last; a document that
    the mix takes several times is a row as often, one that it doesn't take goes. Texts
    without words are taken as often as their source's whole epochs."""
    labels = table(spark, sf_dir, "labels")
    return mixing.repeated(docs, mixing.by_rank(docs, MIX_PATTERN), marked_quality(labels))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row; a null
    text has no tokens."""
    tokens = bpe.encode(docs.select("doc_id", "source", "text"), VOCABULARY, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(tokens).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix),
    ("byte_bpe", tokenize),
]

# Trees, 64-bit hashes and merges have no SQL form; tests hold the rows against a
# plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
