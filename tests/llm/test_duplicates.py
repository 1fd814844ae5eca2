"""Repeated strings, near-duplicate texts and vectors against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from storelens.llm import components, embedding_dedup, shingle_dedup, simhash, suffix_dedup


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_removal(rows, width):
    count = Counter(b[i : i + width] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if count[data[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_runs", [20_000, 2])
def test_repeated_strings(spark, monkeypatch, group_runs):
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", ("doc_id", "text", 40, 13, group_runs))
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcde fghé") for _ in range(rng.randint(5, 90))) for _ in range(30)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "a" * 300), (903, "ab" * 200), (904, "q" * 41), (904, "q" * 41), (905, "u" * 10), (906, "v" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in suffix_dedup.without_repeats(docs, width=40).collect()), key=str)
    assert got == plain_removal(rows, 40)


def test_long_text_in_overlapping_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 12)
    rng = random.Random(6)
    passage = "".join(rng.choice("klmnop") for _ in range(700))
    long = "".join(rng.choice("abcdef") for _ in range(30_000))
    rows = [(1, long[:8100] + passage + long[8100:]), (2, passage), (3, long[16_000:16_500])]
    got = sorted((tuple(r) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == plain_removal(rows, 200)


def test_removal_of_odd_rows(odd, nothing):
    rows = suffix_dedup.without_repeats(odd).collect()
    assert len(rows) == 9 and {r.n_removed for r in rows if r.doc_id != 6} == {0}
    assert next(r for r in rows if r.doc_id == 6).n_removed > 290_000
    assert suffix_dedup.without_repeats(nothing).count() == 0


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicate_texts(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdÉ日") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for k in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        for j in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k * 10 + j, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {k: plain_fingerprint(t) for k, t in rows}
    near = [(a, b) for a, b in itertools.combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 4]
    root = smallest_reachable(want, near)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    assert {k: r.component_id for k, r in got.items()} == root and len(set(root.values())) < len(rows)


def clustered(count, centres, seed):
    rng = random.Random(seed)
    made = [rng.getrandbits(64) for _ in range(centres)]
    flips = lambda: sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))})
    return sorted({rng.choice(made) ^ flips() for _ in range(count)})


@pytest.mark.parametrize("count, centres", [(3000, 2), (600, 40), (30, 2), (1, 1)])
def test_gray_index_gives_a_spanning_forest(count, centres):
    values = np.array(clustered(count, centres, count), np.uint64)
    links = simhash.spanning_links(values)
    assert len(links) < max(len(values), 1)
    assert all(np.bitwise_count(values[a] ^ values[b]) <= 4 for a, b in links)
    first, second = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4, 1))
    every = smallest_reachable(range(len(values)), zip(first.tolist(), second.tolist(), strict=True))
    assert smallest_reachable(range(len(values)), links) == every


def test_buckets_miss_no_pair():
    rng = random.Random(8)
    for distinct in (10, 1 << 24, 1 << 30, 1 << 34):
        masks = simhash.bucket_masks(distinct)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a ^ sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(a & m == b & m for m in masks)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash.chunked, "__defaults__", (16,))
    values = clustered(300, 1, 3)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp bigint, rep bigint")
    links = [tuple(r) for r in simhash.fingerprint_links(table).collect()]
    array = np.array(values, np.uint64)
    first, second = np.nonzero(np.triu(np.bitwise_count(array[:, None] ^ array[None, :]) <= 4, 1))
    every = smallest_reachable(range(len(values)), zip(first.tolist(), second.tolist(), strict=True))
    assert smallest_reachable(range(len(values)), links) == every


def test_simhash_of_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {("0" * 16, 1)}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 900), (900, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = smallest_reachable({n for x in links for n in x}, links)
    assert got == {n: c for n, c in want.items() if n != 7}


@pytest.mark.parametrize("bucket_rows", [1024, 8])
def test_near_duplicate_vectors(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(int(k), (centres[k % 12] + rng.normal(size=16) * 0.14).tolist()) for k in range(240)]
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(400, (np.array(rows[0][1]) * 3).tolist())]
    bad = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, [float("inf")] + [1.0] * 15), (506, [1.0] * 7)]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    pairs = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    root = smallest_reachable([k for k, _ in rows + bad], pairs)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(table).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: sum(k in p for p in pairs) for k in root}
    assert {k: r.component_id for k, r in got.items()} == root
    assert all(r.kept == (k == root[k]) for k, r in got.items())
    assert embedding_dedup.near_duplicate_vectors(table.where("false")).count() == 0
    assert embedding_dedup.near_duplicate_vectors(table.where("vec_id = 500")).first().n_links == 0


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    sets = {k: plain_shingles(t) for k, t in rows}
    near = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    ]
    return smallest_reachable(sets, near)


@pytest.mark.parametrize("group_rows", [512, 8])
def test_lightly_edited_copies_are_one_group(spark, monkeypatch, group_rows):
    import corpus_pipeline

    monkeypatch.setattr(shingle_dedup, "GROUP_ROWS", group_rows)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for k in range(90):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 100, 300]))]
        for j in range(rng.choice([1, 2, 3, 12])):
            words = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.02, 0.04]) else w for w in base]
            rows.append((k * 20 + j, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "Short text"), (5004, "short  TEXT")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_groups(rows)
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(docs).collect()}
    assert got == want
    full = docs.selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    kept = corpus_pipeline.drop_near_duplicates(spark, full, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_sketches_find_pairs_at_the_threshold():
    rng = np.random.default_rng(12)
    missed = 0
    for _ in range(2000):  # sets of 180 with 160 in common: Jaccard 0.8
        values = rng.integers(0, 1 << 63, 200, np.uint64)
        _, sketch = shingle_dedup.sketches(np.concatenate([np.sort(values[:180]), np.sort(values[20:])]), np.array([0, 180, 360]))
        bands = sketch.reshape(2, shingle_dedup.BANDS, shingle_dedup.BAND)
        missed += not ((bands[0] == bands[1]).all(1).any() and shingle_dedup.sketch_links([s.tobytes() for s in sketch]))
    assert missed <= 2


def test_shingles_of_odd_rows(odd, nothing):
    rows = shingle_dedup.near_duplicates(odd).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert shingle_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicate_stage_takes_simhash_candidates(spark, monkeypatch):
    """Without any sketch link, texts of one SimHash component are compared exactly and linked."""
    import corpus_pipeline

    monkeypatch.setattr(shingle_dedup, "LEAST_EQUAL", shingle_dedup.BANDS * shingle_dedup.BAND + 1)
    rng = random.Random(13)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows.append((10 * k, " ".join(words)))
        words[rng.randrange(400)] = "other"
        rows.append((10 * k + 1, " ".join(words)))
    # One fingerprint, far apart as sets: a repeated line outweighs the rest. Compared and not linked.
    line = "the same line again and again now "
    rows += [(1000, line * 60 + " ".join(f"a{k}" for k in range(40))), (1001, line * 60 + " ".join(f"b{k}" for k in range(40)))]
    # Two texts of one id: the key of id and text tells them apart.
    rows += [(2000, "one text under an id of its own kind"), (2000, "quite another text under that very id here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    full = docs.selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    texts = docs.selectExpr(f"{shingle_dedup.text_key()} as k2", "doc_id", "text")
    alike = {r.k2: r.component_id for r in simhash.near_duplicates(texts, "k2", shingle=shingle_dedup.SHINGLE).collect()}
    group = {r.doc_id: alike[r.k2] for r in texts.collect()}
    near = [k for k in range(30) if group[10 * k] == group[10 * k + 1]]
    assert len(near) >= 5 and group[1000] == group[1001]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, full, "").select("doc_id").collect()}
    assert {k for k in range(30) if 10 * k + 1 not in kept} == set(near)
    assert {10 * k for k in range(30)} | {1000, 1001, 2000} <= kept


@pytest.mark.parametrize("broadcast", [-1, 10 << 20])
def test_near_duplicate_stage_compares_rows_without_id_and_texts_of_one_id(spark, broadcast):
    """Every row is judged by its own text: null ids are compared too, and an id with two texts loses neither."""
    import corpus_pipeline

    rng = random.Random(17)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([3, 60, 200]))]
        for _ in range(rng.choice([1, 2, 4])):
            words = [f"w{rng.randrange(2000)}" if rng.random() < rng.choice([0, 0.01]) else w for w in base]
            rows.append((rng.choice([None, None, rng.randrange(25)]), " ".join(words), "en", "s", len(base)))
    rows += [(None, None, "en", "s", 0), (30, "", "en", "s", 0), (None, " ", None, "s", 0)]
    rows += [(None, "abc", None, "s", 3), (None, None, "abc", "s", 3)]  # equal but for the place of the null
    rows += rng.sample(rows, 20)
    group = plain_groups([(k, r[1]) for k, r in enumerate(rows)])
    ids = {g: [rows[k][0] for k in group if group[k] == g] for g in set(group.values())}
    want = Counter((g, min((i for i in members if i is not None), default=None)) for g, members in ids.items())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(kept) <= set(rows)
    assert Counter((group[rows.index(r)], r[0]) for r in kept) == want
    texts = Counter(i for i in (r[0] for r in kept) if i is not None)
    assert max(texts.values()) > 1 and sum(r[0] is None for r in kept) > 1  # the rows hold both cases
