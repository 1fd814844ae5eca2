"""Product-quantisation codes against plain k-means over all entries, with no bounds."""

import hashlib
import math

import numpy as np

from storelens.llm import vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = {k: np.array([math.floor(256 * float(c)) for c in v], np.int64).reshape(parts, -1) for k, (_, _, v) in enumerate(kept)}
    seeds = sorted((i, k) for k, (i, _, _) in enumerate(kept) if i is not None)[:entries]
    book = np.stack([x[k] for _, k in seeds], 1)  # parts, entries, width

    def assign():
        return {k: [min(range(book.shape[1]), key=lambda e: (int(((v[p] - book[p, e]) ** 2).sum()), e)) for p in range(parts)] for k, v in x.items()}

    for _ in range(rounds):
        a = assign()
        new = book.copy()
        for p in range(parts):
            for e in range(book.shape[1]):
                members = [x[k][p] for k in x if a[k][p] == e]
                if members:
                    new[p, e] = np.sum(members, 0) // len(members)
        book = new
    a = assign()
    out = []
    errors = {k: sum(int(((x[k][p] - book[p, a[k][p]]) ** 2).sum()) for p in range(parts)) for k in x}
    digest = hashlib.sha256(",".join(str(v) for v in book.ravel().tolist()).encode()).hexdigest()
    for k, (i, lab, _) in enumerate(kept):
        same = sum(errors[j] for j, (_, other, _) in enumerate(kept) if other == lab)
        out.append((i, "".join(f"{e:02x}" for e in a[k]), errors[k], same, digest))
    return sorted(out, key=repr)


def test_against_plain_kmeans(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 32))
    rows = [(int(i), int(rng.integers(0, 3)) if i % 7 else None, (centres[i % 5] + 0.3 * rng.normal(size=32)).tolist()) for i in range(300)]
    rows += [(1000, 1, None), (1001, 1, [float("nan")] * 32), (1002, 2, [None] * 32), (None, 2, rows[3][2]), (5, 2, rows[5][2])]
    rows += [(1003, 0, [0.0] * 32), (1004, 0, [0.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").selectExpr(
        "*", "'x' as assign", "'y' as code", "1 as same")
    got = sorted((tuple(r) for r in vector_codes.compressed(df).collect()), key=repr)
    f32 = [(i, lab, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, lab, v in rows]
    assert got == plain(f32)


def test_few_vectors_and_empty(spark):
    rows = [(3, 1, [0.5] * 16), (1, 1, [0.25] * 16), (2, None, [0.5] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = sorted((tuple(r) for r in vector_codes.compressed(df).collect()), key=repr)
    assert got == plain(rows)
    assert vector_codes.compressed(df.where("false")).count() == 0
