"""Importance resampling against plain Python: zlib's CRC, the gain formula and a sorted draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from storelens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, targets, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in targets for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n, len(fs), weight, score, None])
    eligible = sorted((r for r in rows if r[0] is not None and r[1] >= 20), key=lambda r: (-r[4], r[0], r[2]))
    for place, r in enumerate(eligible[: len(eligible) * 5 // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


def test_crc_matrices_equal_zlib():
    rng = random.Random(4)
    values = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 7, 300, 5000]))) for _ in range(400)]
    assert resampling.crc32_many(values).tolist() == [zlib.crc32(v) for v in values]


def test_feature_buckets_against_plain():
    texts = [None, "", "A b. c", "x", "Épée épée ÉPÉE 42 x1 x1 x1", "a b a b a b"]
    rows, places, n_words, n_features = resampling.feature_buckets(texts, 97)
    got = [sorted(places[rows == i].tolist()) for i in range(len(texts))]
    assert got == [sorted(zlib.crc32(f.encode()) % 97 for f in features(t)[1]) for t in texts]
    assert n_words.tolist() == [features(t)[0] for t in texts] and n_features.tolist() == [len(features(t)[1]) for t in texts]


def test_resample_against_plain(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "épée", "x1", "the", "of", "42", "zeta"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(3, 10)]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(7, text(30)), (None, text(30)), (401, None), (402, "")]
    docs += [(403, docs[5][1]), (403, docs[5][1])]
    targets = [text(rng.randint(0, 40)) for _ in range(30)] + [None]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as rank", "1 as weight")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id bigint, text string")
    got = sorted((tuple(r) for r in resampling.resample(d, b).collect()), key=repr)
    assert got == plain(docs, targets)


def test_empty_tables(spark, nothing):
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample(nothing, b).count() == 0
    assert np.all(resampling.gains(np.zeros(5, np.int64), np.zeros(5, np.int64)) == 0)
