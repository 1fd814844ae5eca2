"""Ordered scans over range partitions, and the cool-down of a store with very many requests in one hour."""

import datetime as dt
import random

from pyspark.sql import functions as F

from storelens.operators.cooldown import cooldown_replay
from storelens.operators.scans import fill_forward, positions


def test_positions_and_fill_cross_partitions(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c"] * 5 + ["d"]), i, rng.choice([None, None, rng.randint(0, 99)])) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = positions(table, [F.col("k"), F.col("i")], "p").collect()
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    assert sorted((r.k, r.i, r.p) for r in got) == [(k, i, p) for p, (k, i, _) in enumerate(order)]
    filled = {(r.k, r.i): r.f for r in fill_forward(table, "k", [F.col("i")], "v", "f").collect()}
    last = {}
    for k, i, v in order:
        last[k] = v if v is not None else last.get(k)
        assert filled[(k, i)] == last[k]
    assert fill_forward(table.where("false"), "k", [F.col("i")], "v", "f").count() == 0


def greedy(rows):
    last, out = {}, set()
    for i, store, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        if store not in last or ts - last[store] >= dt.timedelta(hours=24):
            out.add((store, i))
            if ok:
                last[store] = ts
    return out


def test_hot_store_in_one_hour(spark):
    """Most requests of one store fall into one hour; chunks of 40 rows cut through it."""
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", start + dt.timedelta(seconds=rng.randint(0, 3599)), rng.random() < 0.3) for i in range(1500)]
    rows += [(2000 + i, rng.choice(["hot", "cold"]), start + dt.timedelta(hours=rng.randint(0, 300)), rng.random() < 0.5) for i in range(300)]
    rows += [(5000, "hot", start, False), (5001, "hot", start, True)]  # ties in time go by id
    table = spark.createDataFrame(rows, "id int, store_url string, ts timestamp, ok boolean").repartition(6)
    got = cooldown_replay(table, success="ok", chunk_rows=40).collect()
    assert {(r.store_url, r.id) for r in got} == greedy(rows) and len(got) == len(set(got))
