"""Questions to the record table: latest per store, paged history, service statistics, reuse."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.sql import lit
from storelens.functions.urls import normalize_url
from storelens.sources.records import from_document

HISTORY_FIELDS = ("id", "store_url", "store_name", "scraped_at", "processing_time", "success", "insights_data")
REUSE_SECONDS = 24 * 3600
STATS_ROWS = 1000


def latest_records(records: DataFrame) -> DataFrame:
    """Newest successful record of every store; equal times are settled by ``id``.

    The newest key of every store is found on narrow columns, combined before the shuffle; documents are read by
    that key afterwards. A record that was appended twice counts once.
    """
    good = records.where("success")
    newest = good.groupBy("store_url").agg(F.max(F.struct("scraped_at", "id")).alias("r")).select("store_url", "r.*")
    return good.join(newest, ["store_url", "scraped_at", "id"], "left_semi").dropDuplicates(["store_url"])


def cached_report(records: DataFrame, url: str) -> DataFrame:
    """Stored report of one store, any age: at most one row; unknown stores give none."""
    wanted = records.where(F.expr(f"store_url = {normalize_url(lit(url))}"))
    return latest_records(wanted).withColumn("report", from_document(F.col("insights_data")))


def page_bounds(limit: int = 50, offset: int = 0) -> tuple[int, int]:
    """Limit and offset as served: at most 100 rows, 10 for a limit below 1, no negative offset."""
    return 10 if limit < 1 else min(limit, 100), max(offset, 0)


def history_page(records: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Records ``offset .. offset+limit`` from newest to oldest.

    The page is found on the narrow sort columns (top-k, no full sort); documents are read afterwards for at
    most 100 keys, which are broadcast, and only from the days concerned when the table is partitioned by day.
    """
    limit, offset = page_bounds(limit, offset)
    key = [c for c in ("scraped_date", "scraped_at", "id") if c in records.columns]
    newest_first = [F.col("scraped_at").desc(), F.col("id").desc()]
    page = records.select(*key).orderBy(*newest_first).offset(offset).limit(limit)
    rows = records.join(F.broadcast(page), key, "left_semi")
    return rows.select(*HISTORY_FIELDS).orderBy(*newest_first)


def service_stats(records: DataFrame, rows: int = STATS_ROWS) -> DataFrame:
    """One row of statistics over the newest records: counts, success rate, mean time, table in use.

    The mean divides by all records, those without a time included; an unknown ``success`` counts as true.
    """
    recent = (
        records.select("scraped_at", "id", "success", "processing_time")
        .orderBy(F.col("scraped_at").desc(), F.col("id").desc())
        .limit(rows)
    )
    total = F.count(F.lit(1))
    good = F.count_if(F.coalesce("success", F.lit(True)))
    seconds = F.coalesce(F.sum("processing_time"), F.lit(0.0))

    def per_row(value: Column) -> Column:
        return F.when(total > 0, F.round(value / total, 2)).otherwise(F.lit(0.0))

    return recent.agg(
        total.alias("total_requests"),
        good.alias("successful_requests"),
        (total - good).alias("failed_requests"),
        per_row(good * 100).alias("success_rate_percent"),
        per_row(seconds).alias("average_processing_time_seconds"),
        (total > 0).alias("database_enabled"),
    )


def fresh_records(records: DataFrame, as_of: dt.datetime, seconds: int = REUSE_SECONDS) -> DataFrame:
    """Latest successful record of each store that is younger than the limit and still readable.

    The age filter reaches the scan, so only the last day of the table is read.
    """
    since = as_of - dt.timedelta(seconds=seconds)
    recent = records.where(F.col("scraped_at") > F.lit(since))
    if "scraped_date" in records.columns:
        recent = recent.where(F.col("scraped_date") >= F.lit(since.date()))
    return latest_records(recent).where(from_document(F.col("insights_data")).isNotNull())


def stale_requests(requests: DataFrame, records: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Requests (with ``store_url``) that need a new extraction."""
    return requests.join(fresh_records(records, as_of), "store_url", "left_anti")


def fresh_hits(requests: DataFrame, records: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Requests served from the table, with the stored document."""
    served = fresh_records(records, as_of).select("store_url", "store_name", "scraped_at", "insights_data")
    return requests.join(served, "store_url", "inner")
