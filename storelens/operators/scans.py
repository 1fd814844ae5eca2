"""Ordered scans over whole tables without one task per key: positions and forward fills.

Both sort the table once by range (a key that holds a third of all rows is cut over many partitions), number the
rows inside each partition, and send one summary row per partition to the driver, where the partitions are chained
in order. The chained values come back as a broadcast table of one row per partition; nothing else is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import stored


def _placed(table: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows sorted by range with their partition and a number that rises within it, stored."""
    sorted_rows = table.orderBy(*order)
    return stored(
        sorted_rows.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_pos")),
        name,
    )


def positions(table: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``table`` with 0, 1, 2 ... in ``order`` (ties in no stated order) as column ``name``."""
    placed = _placed(table, order, "positions")
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first")).collect()
    shifts, before = [], 0
    for pid, n, first in sorted(counts):  # one row per partition
        shifts.append((pid, before - first))
        before += n
    shift = table.sparkSession.createDataFrame(shifts or [(0, 0)], "_pid int, _shift bigint")
    out = placed.join(F.broadcast(shift), "_pid")
    return out.withColumn(name, F.col("_pos") + F.col("_shift")).drop("_pid", "_pos", "_shift")


def fill_forward(table: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``table`` with ``name``: the last non-null ``value`` of the same ``key`` at or before each row in ``order``.

    Within a partition the fill is a window over (partition, key), whose rows the range sort has bounded; across
    partitions, the last value of each partition's last key is carried to the partitions that follow.
    """
    placed = _placed(table, [F.col(key), *order], "fill")
    inside = Window.partitionBy("_pid", key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = stored(placed.withColumn("_local", F.last(value, ignorenulls=True).over(inside)), "fill-local")
    ends = local.groupBy("_pid").agg(
        F.min_by(key, "_pos").alias("first_key"),
        F.max_by(key, "_pos").alias("last_key"),
        F.max_by("_local", "_pos").alias("last_value"),
    )
    carries, running_key, running = [], None, None
    for pid, first_key, last_key, last_value in sorted(ends.collect(), key=lambda r: r[0]):  # one row per partition
        carries.append((pid, first_key, running if running_key == first_key else None))
        if last_value is not None:
            running_key, running = last_key, last_value
        elif last_key != running_key:
            running_key, running = last_key, None
    kinds = dict(table.dtypes)
    carry = table.sparkSession.createDataFrame(
        carries or [(0, None, None)], f"_pid int, _carry_key {kinds[key]}, _carry {kinds[value]}"
    )
    out = local.join(F.broadcast(carry), "_pid")
    carried = F.when(F.col(key) == F.col("_carry_key"), F.col("_carry"))
    return out.withColumn(name, F.coalesce("_local", carried)).drop("_pid", "_pos", "_local", "_carry_key", "_carry")
