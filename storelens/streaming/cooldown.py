"""Cool-down as a stream: one timestamp of state per store."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storelens.operators.cooldown import DAY, NEVER, walk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keep the state of queries started inside on disk next to the executors; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def accepted_requests(
    requests: DataFrame,
    key: str = "store_url",
    ts: str = "ts",
    id: str = "id",
    success: str | None = None,
    seconds: int = DAY,
) -> DataFrame:
    """Streaming form of ``cooldown_replay``; files must arrive in time order.

    Only a successful accepted request moves the state. Rows of one store and one micro-batch are ordered
    here, on three narrow columns; ``maxFilesPerTrigger`` of the source bounds them.
    """
    gap = seconds * 1_000_000
    types = dict(requests.dtypes)

    def step(store: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["_us", "_id"], kind="stable")
        last = state.get[0] if state.exists else NEVER
        keep, last = walk(rows["_us"].to_numpy(), rows["_ok"].to_numpy(), last, gap)
        if last != NEVER:
            state.update((last,))
        out = rows.loc[keep, ["_us", "_id"]]
        out.insert(0, "_key", store[0])
        yield out

    narrow = requests.select(
        F.col(key).alias("_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
        F.col(id).alias("_id"),
        (F.lit(True) if success is None else F.coalesce(F.col(success), F.lit(False))).alias("_ok"),
    ).where("_key is not null and _us is not null")
    accepted = narrow.groupBy("_key").applyInPandasWithState(
        step,
        f"_key {types[key]}, _us bigint, _id {types[id]}",
        "last bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return accepted.select(
        F.col("_key").alias(key), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(id)
    )


def write_accepted(accepted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append accepted requests to Parquet, taking all input there is and then stopping."""
    return (
        accepted.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
