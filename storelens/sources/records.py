"""The record table: one row per extraction, Parquet partitioned by attempt and day, with a commit log."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.schemas import RECORD, REPORT, REPORT_FIELDS
from storelens.session import narrow_join


def to_document(columns: DataFrame) -> Column:
    """JSON text of a report row."""
    return F.to_json(F.struct(*[F.col(c) for c in REPORT_FIELDS if c in columns.columns]))


def from_document(doc: Column) -> Column:
    """Report struct of a stored JSON text; NULL when it cannot be read as an object."""
    return F.when(doc.rlike(r"^[ \t\r\n]*\{"), F.from_json(doc, REPORT))


def as_records(reports: DataFrame) -> DataFrame:
    """Record rows of report rows: success and failure alike, errors as text on failure."""
    at = F.timestamp_seconds(F.col("scraped_at"))
    ok = F.coalesce("success", F.lit(True))
    return reports.select(
        F.sha2(F.concat_ws("|", "store_url", F.unix_micros(at)), 256).alias("id"),
        "store_url",
        "store_name",
        to_document(reports).alias("insights_data"),
        at.alias("scraped_at"),
        "processing_time",
        ok.alias("success"),
        F.when(~ok, F.to_json("errors")).alias("error_message"),
        F.to_date(at).alias("scraped_date"),
    )


def _writer_name(writer: str) -> str:
    """A writer id as a folder name: letters, digits, '-' and '_' only."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", writer)


def append_records(records: DataFrame, path: str, batch: int | None = None, writer: str | None = None) -> str:
    """Append records to the table at ``path`` and commit them; returns the attempt id.

    Commit protocol: every call is one *attempt* of the batch ``(writer, batch)``. Its rows are written below
    ``data/attempt=<id>/scraped_date=<day>/``, a folder of its own (with its own staging), sorted by store so that
    lookups by store skip row groups. Only then is a commit marker written, a new folder below ``_commits/`` that
    names writer, batch, attempt and the time of the commit; markers are never overwritten. Readers see only the
    attempt of the latest commit of each ``(writer, batch)``, so

    * a retried batch (a task, a job or a whole driver that failed, also past midnight) replaces its own earlier
      attempt and nothing else; an attempt that failed before its commit is never seen;
    * two writers (two streams, a stream with a new checkpoint, batch jobs) never touch each other's rows;
    * a record written again by another writer (same id) is read once: the row of the latest commit counts.

    ``writer`` defaults to a new id per call (a batch job); streams pass one id per checkpoint. ``batch`` defaults
    to 0.
    """
    spark = records.sparkSession
    writer = _writer_name(writer or f"job-{uuid.uuid4().hex}")
    batch = 0 if batch is None else int(batch)
    attempt = uuid.uuid4().hex
    ordered = records.select(*[c.split()[0] for c in RECORD.split(", ")]).sortWithinPartitions("scraped_date", "store_url")
    ordered.write.partitionBy("scraped_date").parquet(f"{path}/data/attempt={attempt}")
    committed = int(time.time() * 1_000_000)
    marker = spark.createDataFrame([(writer, batch, attempt, committed)], COMMIT)
    marker.coalesce(1).write.parquet(f"{path}/_commits/{writer}-{batch}-{committed}-{attempt}")
    return attempt


COMMIT = "writer string, batch bigint, attempt string, committed_us bigint"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The attempt of the latest commit of every ``(writer, batch)``, with its commit time."""
    markers = spark.read.schema(COMMIT).parquet(f"{path}/_commits/*")
    latest = markers.groupBy("writer", "batch").agg(F.max(F.struct("committed_us", "attempt")).alias("c"))
    return latest.select("writer", "batch", "c.attempt", "c.committed_us")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The committed records; ``insights_data`` stays text until ``from_document`` is applied.

    One attempt per ``(writer, batch)`` counts (the latest commit's). Where those attempts hold one id more than
    once, the rows of the latest commit count; repeated ids within one attempt stay as written. Which rows lose is
    found on narrow columns (ids and attempts, partially aggregated); documents are read by it afterwards.
    """
    rows = spark.read.schema(f"{RECORD}, attempt string").parquet(f"{path}/data")
    live = narrow_join(rows, commits(spark, path), "attempt", "inner")
    per_id = live.groupBy("id").agg(
        F.min("attempt").alias("_lo"),
        F.max("attempt").alias("_hi"),
        F.max(F.struct("committed_us", "writer", "batch", "attempt")).alias("_win"),
    )
    contested = per_id.where("_lo <> _hi").select("id", F.col("_win.attempt").alias("_keep"))
    losers = live.select("id", "attempt").join(contested, "id").where("attempt <> _keep").select("id", "attempt").distinct()
    return live.join(losers, ["id", "attempt"], "left_anti").select(*[c.split()[0] for c in RECORD.split(", ")])
