"""The operators over the given tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (
    bpe, embedding_dedup, importance, knn, line_dedup, mixing, pii, quality, simhash, token_files, urls, vector_codes, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


ORACLES["op1_knn_join"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(d.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), c AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT c.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, c.a = c.c AS kept
FROM c LEFT JOIN n USING (a)
"""


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


MIX_PATTERN = [1.0, 2.0, 3.0]


def marked_quality(labels: DataFrame) -> DataFrame:
    """Weights (doc_id, quality) from marks: good documents are drawn earlier."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return labels.select("doc_id", weight.alias("quality")).where("quality is not null")


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.by_rank(docs, MIX_PATTERN), marked_quality(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLES["op7_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(text, '')) AS mark
  FROM documents
), q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS quality
  FROM labels GROUP BY doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), w AS (  -- sources in the order in which they reach their limits as the level rises
  SELECT *, 3.0::DOUBLE * source_size AS top,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
         sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)
), lv AS (
  SELECT max((total - used) / left_weight) AS level FROM w
), t AS (
  SELECT source, source_size, least(top, coalesce(level, 1e300) * weight) AS target FROM w, lv
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), k AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         -ln((('0x' || substr(md5('0/' || coalesce(d.doc_id::VARCHAR, '') || '/' || mark), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0::DOUBLE) / coalesce(q.quality, 1.0::DOUBLE) AS key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN q ON d.doc_id = q.doc_id
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, mark, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM k
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(tokens).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    files = token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder, files)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


PII_KEY = "rollcall.pii.key"  # setting that holds the secret; without it a key for trials is used


@query
def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, "")
    if not key:
        warnings.warn(f"{PII_KEY} is not set: pseudonyms of a public trial key can be turned back", stacklevel=2)
        key = "trial key"
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key.encode())


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 bit by bit: of each byte's eight steps, the first takes the byte in.
ORACLES["op11_importance_resampling"] = r"""
WITH words AS (
  SELECT doc_id, 'd' AS side, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT NULL, 't', row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), f AS (
  SELECT side, row, feature, count(*) AS n FROM (
    SELECT side, row, unnest(w) AS feature FROM words
    UNION ALL
    SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  ) GROUP BY ALL
), b AS (
  SELECT feature,
    xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, strlen(feature) + 1),
      lambda i: [('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1)))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f)
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM f JOIN b USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS gain FROM c
), d AS (
  SELECT row, sum(n) AS n, sum(n * gain) AS gain FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row
), r AS (
  SELECT doc_id, row, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(gain / n), 0) AS BIGINT) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM words LEFT JOIN d USING (row) WHERE words.side = 'd'
), k AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM k
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM o
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    files = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.pages_of(warc.read(spark, folder, files, payloads=False))


ORACLES["op12_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int = 6) -> str:
    """The codes in SQL: components by (vector, part), an assignment and a mean per round."""
    steps = ["""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p AS part, list_slice(vec, p * len(vec) // 8 + 1, (p + 1) * len(vec) // 8)::DOUBLE[] AS x FROM v, range(8) AS r(p)
), b0 AS MATERIALIZED (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, x AS c
  FROM parts JOIN (SELECT row, vec_id FROM v ORDER BY vec_id LIMIT 16) USING (row)
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
, a{i} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, CAST(min(d) AS BIGINT) AS d FROM (
    SELECT row, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN b{i} USING (part)
  ) GROUP BY row, part
)""")
        if i < rounds:
            steps.append(f"""
, m{i} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, floor(sum(y) / count(*)) AS mean FROM (
      SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{i} JOIN parts USING (row, part)
    ) GROUP BY part, entry, pos
  ) GROUP BY part, entry
), b{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry)
)""")
    return "".join(steps) + f"""
, codes AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row
), books AS (
  SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN codes USING (row), books
"""


ORACLES["op13_vector_codes"] = lloyd_sql()
