"""Incremental extraction: new page files in, records out."""

from __future__ import annotations

import hashlib

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from storelens.functions.urls import extract_domain
from storelens.sources.records import append_records, as_records


#: Host buckets of the page store: a micro-batch reads the pages of the buckets its hosts fall in.
BUCKETS = 256
STORE_SCHEMA = "page_id bigint, url string, html string, batch bigint, bucket int"


def host_bucket(url: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a page's host (lower-cased authority)."""
    return F.expr(f"pmod(xxhash64({extract_domain(url)}), {buckets})").cast("int")


def add_to_store(batch: DataFrame, store: str, number: int, buckets: int = BUCKETS) -> list[int]:
    """Write a micro-batch's pages into the page store, partitioned by host bucket; returns the buckets it touched.

    The pages of batch ``number`` lie below ``batch=<number>/``, which a retry of that batch overwrites and nothing
    else does. The touched buckets (at most ``buckets`` numbers) come back to the driver.
    """
    rows = batch.select("page_id", "url", "html", host_bucket("url", buckets).alias("bucket"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def pages_of_hosts(spark, store: str, hosts: DataFrame, touched: list[int]) -> DataFrame:
    """All stored pages of some hosts: only the files of their buckets are listed and read (partition pruning)."""
    table = spark.read.schema(STORE_SCHEMA).parquet(store).where(F.col("bucket").isin(touched))
    host = F.expr(extract_domain("url"))
    return table.withColumn("_host", host).join(hosts, "_host", "left_semi").select("page_id", "url", "html")


def extract_stream(
    pages: DataFrame,
    to_reports: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    all_pages: Callable[[], DataFrame] | None = None,
    page_store: str | None = None,
) -> StreamingQuery:
    """Run ``to_reports`` for the hosts of every micro-batch of pages and store the records, then stop.

    The pages of a store may arrive in pieces. With ``page_store`` (a folder all executors share) every micro-batch
    adds its pages to a page store partitioned by host bucket, names the hosts that changed, and makes their reports
    from all their stored pages; it reads only the buckets of those hosts, so the bytes a batch reads follow the
    batch, not the crawl. (``all_pages``, the whole page table as of now, is the older way: every batch scans it.) The stream writes as one writer named
    after its checkpoint: a retried micro-batch replaces its own attempt, a record made again in a later batch is
    read from the latest commit, and other streams or jobs writing the same table are never touched.
    """
    writer = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:20]

    def store(batch: DataFrame, number: int) -> None:
        rows = batch
        if page_store is not None:
            touched = add_to_store(batch, page_store, number)
            if not touched:
                return
            hosts = batch.select(F.expr(extract_domain("url")).alias("_host")).distinct()
            rows = pages_of_hosts(batch.sparkSession, page_store, hosts, touched)
        elif all_pages is not None:
            host = F.expr(extract_domain("url"))
            touched = batch.select(host.alias("_host")).distinct()
            rows = all_pages().withColumn("_host", host).join(touched, "_host", "left_semi").drop("_host")
        append_records(as_records(to_reports(rows)), path, batch=number, writer=writer)

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
