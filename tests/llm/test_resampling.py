"""Importance resampling against a plain version, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from rollcall.llm import importance

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def plain_features(text):
    words = plain_words(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t))
    t = Counter(bucket(f) for x in target for f in plain_features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for doc_id, text in docs:
        found = [gain(bucket(f)) for f in plain_features(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, len(plain_words(text)) >= least])
    fits = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(fits[:percent * len(fits) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=str)


def drawn(spark, docs, target, **options):
    df = importance.resample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), **options
    )
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_up(n, seed=1):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "für", "naïve", "42", "x", "日本", "İstanbul", "K", "ß"]
    marks = [" ", "\n", ", ", "--", "\t", "\x00", "_", "{", "\x7f"]
    return [(i, "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]


def test_equals_the_plain_version(spark):
    docs, target = made_up(120), [t for _, t in made_up(9, seed=2)]
    assert drawn(spark, docs, target) == plain_resample(docs, target)
    assert drawn(spark, docs, target, percent=60, least_words=4, seed=3) == plain_resample(docs, target, 60, 4, 3)


def test_odd_rows_have_defined_results(spark):
    long_ = "one two three " * 10
    docs = [(1, None), (2, ""), (3, " .,;"), (None, long_), (5, long_), (5, long_), (6, "word"), (7, "." + long_)]
    for target in ([], [None, ""], ["two three", None]):
        got = drawn(spark, docs, target, percent=80)
        assert got == plain_resample(docs, target, percent=80)
    assert [r[1:3] for r in got if r[0] in (1, 2, 3)] == [(0, 0)] * 3
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3]
    assert drawn(spark, [], ["two"]) == []


def test_extra_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, score int, rank int")
    target = spark.createDataFrame([("a", 1)], "text string, doc_id int")
    assert importance.resample(docs, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_a_long_text_is_the_same_in_pieces():
    text = (" ".join(t for _, t in made_up(40)) + " ").encode()
    texts = [b"a b", text, b"", b"...", text[:50], b"c" * 300 + b" d"]
    whole = importance.counts(texts, 1000)
    assert whole.sum() == sum(len(plain_features(t.decode())) for t in texts)
    for size in (1, 7, 64, 1000):
        assert (importance.counts(texts, 1000, size) == whole).all()
        gains = np.arange(1000) - 500
        for a, b in zip(importance.gained(texts, gains), importance.gained(texts, gains, size)):
            assert (a == b).all()


def test_texts_like_the_target_are_drawn(spark):
    docs = [(i, " ".join(f"{'law' if i % 4 == 0 else 'pop'}{(i * 7 + j) % 30}" for j in range(40))) for i in range(400)]
    target = [" ".join(f"law{j}" for j in range(30))] * 5
    ranked = {r[0] for r in drawn(spark, docs, target) if r[4]}
    assert len(ranked) == 100 and sum(i % 4 == 0 for i in ranked) > 60  # 25 by chance
