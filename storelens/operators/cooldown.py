"""Cool-down replay: which requests of a log lead to an extraction.

A request is accepted when the last accepted *successful* one of its store lies at least the cool-down back.
The rule is greedy, so it is a walk in time order per store and no window function. Walks run over
sorted Arrow batches with the state carried along; no store is collected.

A store with more than ``chunk_rows`` requests is never walked by one task: its successes point to the next
success a cool-down later, the counted chain is marked by pointer doubling, and requests are judged by a forward
fill of the last counted success (``busy_accepted``); all of it is range sorts and joins on unique places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.scans import fill_forward, positions
from storelens.session import narrow_join, stored

DAY = 24 * 3600
CHUNK_ROWS = 2_000_000
NEVER = -(2**62)


def walk(ts: np.ndarray, ok: np.ndarray, last: int, gap: int) -> tuple[np.ndarray, int]:
    """Accepted mask of one store's time-ordered requests and the last counted success afterwards."""
    good = np.flatnonzero(ok)
    times = ts[good]
    chain, states = [], [last]
    at = np.searchsorted(times, last + gap)
    while at < len(times):
        chain.append(good[at])
        states.append(times[at])
        at = np.searchsorted(times, times[at] + gap)
    before = np.searchsorted(np.asarray(chain, dtype=np.int64), np.arange(len(ts)), side="left")
    return ts - np.asarray(states, dtype=np.int64)[before] >= gap, int(states[-1])


def segments(*columns: pd.Series) -> np.ndarray:
    """Start offsets of runs of equal values, with the length appended."""
    n = len(columns[0])
    edge = np.zeros(n, dtype=bool)
    edge[:1] = True
    for column in columns:
        values = column.to_numpy()
        edge[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(edge), n)


def _replay(gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, NEVER
        for batch in batches:
            ts, ok = batch["_us"].to_numpy(), batch["_ok"].to_numpy()
            keep = np.zeros(len(batch), dtype=bool)
            cuts = segments(batch["_key"], batch["_chunk"])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                group = (batch["_key"].iat[lo], batch["_chunk"].iat[lo])
                if group != current:
                    current, last = group, int(batch["_entry"].iat[lo])
                keep[lo:hi], last = walk(ts[lo:hi], ok[lo:hi], last, gap)
            yield batch.loc[keep, ["_key", "_us", "_id"]]

    return run


def busy_accepted(rows: DataFrame, gap: int) -> DataFrame:
    """Accepted rows ``(_key, _us, _id)`` of busy stores, without any task that holds a whole store.

    1. Every row gets its place in (store, time, id) order by one range sort (``positions``).
    2. Every success points to the next success of its store at least ``gap`` later (the first one counted after
       it): a forward fill over successes and their *probes* (time + gap), sorted backwards.
    3. The counted successes are the chain from each store's first success. Pointer doubling marks it: the marked
       set and the jump table double each round (``J <- J o J``), so a chain of length L takes log2(L) + 1
       rounds of joins on the place, which is unique, so no key is hot.
    4. A request is accepted when no counted success lies before it, or the last one (a forward fill over the
       places) lies at least ``gap`` back; counted successes are accepted.
    """
    placed = stored(positions(rows, [F.col("_key"), F.col("_us"), F.col("_id")], "_at"), "busy")
    good = placed.where("_ok").select("_key", "_us", "_at")
    probes = good.select("_key", (F.col("_us") + gap).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_to"), F.col("_at").alias("_from"))
    targets = good.select("_key", F.col("_us").alias("_t"), F.lit(1).alias("_kind"), F.col("_at").alias("_to"), F.lit(None).cast("bigint").alias("_from"))
    backwards = [F.col("_t").desc(), F.col("_kind").desc(), F.col("_to").desc_nulls_last()]
    filled = fill_forward(probes.unionByName(targets), "_key", backwards, "_to", "_next")
    jump = stored(filled.where("_kind = 0").select(F.col("_from").alias("_at"), "_next"), "jump")
    marked = stored(good.groupBy("_key").agg(F.min("_at").alias("_at")).select("_at"), "chain")
    size = marked.count()
    while True:
        reached = marked.join(jump, "_at").where("_next is not null").select(F.col("_next").alias("_at"))
        grown = stored(marked.unionByName(reached).distinct(), "chain")
        now = grown.count()
        if now == size:
            break
        marked, size = grown, now
        twice = jump.join(jump.select(F.col("_at").alias("_next"), F.col("_next").alias("_far")), "_next", "left")
        jump = stored(twice.select("_at", F.col("_far").alias("_next")), "jump")
    chain = narrow_join(placed, marked.withColumn("_counted", F.lit(True)), "_at", "left")
    chain = chain.withColumn("_last", F.when(F.col("_counted"), F.col("_us")))
    last = fill_forward(chain, "_key", [F.col("_at")], "_last", "_before")
    due = F.expr(f"_counted or _before is null or _us - _before >= {gap}")
    return last.where(due).select("_key", "_us", "_id")


def cooldown_replay(
    requests: DataFrame,
    key: str = "store_url",
    ts: str = "ts",
    id: str = "id",
    success: str | None = None,
    seconds: int = DAY,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Accepted requests as ``(key, ts, id)``.

    Equal times are taken in ``id`` order. With ``success`` given, failed extractions are accepted when due
    but do not start a cool-down.
    """
    gap = seconds * 1_000_000
    types = dict(requests.dtypes)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    narrow = requests.select(
        F.col(key).alias("_key"),
        micros.alias("_us"),
        F.col(id).alias("_id"),
        (F.lit(True) if success is None else F.coalesce(F.col(success), F.lit(False))).alias("_ok"),
    ).where("_key is not null and _us is not null")
    busy = narrow.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("_key")
    if busy.isEmpty():
        states, hot = narrow.withColumns({"_chunk": F.lit(0), "_entry": F.lit(NEVER)}), None
    else:
        busy = stored(busy, "busy-stores")
        hot = busy_accepted(narrow_join(narrow, busy, "_key", "left_semi"), gap)
        states = narrow_join(narrow, busy, "_key", "left_anti").withColumns({"_chunk": F.lit(0), "_entry": F.lit(NEVER)})
    accepted = (
        states.select("_key", "_chunk", "_us", "_id", "_ok", "_entry")
        .repartition("_key", "_chunk")
        .sortWithinPartitions("_key", "_chunk", "_us", "_id")
        .mapInPandas(_replay(gap), f"_key {types[key]}, _us bigint, _id {types[id]}")
    )
    if hot is not None:
        accepted = accepted.unionByName(hot)
    return accepted.select(
        F.col("_key").alias(key), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(id)
    )
