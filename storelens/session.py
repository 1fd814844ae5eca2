"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Timestamps are UTC. Everything else is Spark's default; Arrow batches of wide pages are bounded by bytes.
JOB_CONF = {"spark.sql.session.timeZone": "UTC"}

# Bytes of one default split of a scan.
ONE_SPLIT = 128 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here assumes (UTC)."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("storelens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="storelens-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder below ``spark.checkpoint.dir``, the place all executors share.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    It is then computed once however often it is used, and losing executors does not bring its lineage back.
    """
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def narrow_join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Join a wide ``left`` with a narrow ``right`` that is stored first.

    Its size in bytes is then known from the files, so Spark's own threshold decides between broadcasting it and an
    ordinary shuffle join, which AQE may split on skew.
    """
    return left.join(stored(right, "narrow"), on, how)


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    For inputs headed for CPU-bound parsing. Only a table that fits in one default split is dealt out; whatever is
    larger stays in its own splits and is never shuffled for this.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size <= ONE_SPLIT else table
