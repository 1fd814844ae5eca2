"""Page tables: batch and streaming readers, page keys, one version per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.urls import extract_domain, page_key, url_path
from storelens.session import narrow_join

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages; a failed fetch is an absent row or NULL html."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """The same table as a stream of new files."""
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def keyed(pages: DataFrame) -> DataFrame:
    """Add ``host`` (lower-cased authority) and ``path`` (no query, fragment or trailing slash)."""
    return pages.withColumns({"host": F.expr(extract_domain("url")), "path": F.expr(url_path("url"))})


def latest_pages(pages: DataFrame) -> DataFrame:
    """Keep the newest good copy of every URL; a failed fetch (NULL html) is no copy.

    What is joined to the HTML are the ids of older copies, which are few unless the crawl repeats itself.
    """
    good = pages.where("html is not null")
    key = F.expr(page_key("url")).alias("_key")
    copies = good.groupBy(key).agg(F.max("page_id").alias("_newest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    older = good.select("page_id", "url", key).join(copies, "_key").where("page_id < _newest").select("page_id", "url")
    return narrow_join(good, older, ["page_id", "url"], "left_anti")


def first_page_per_host(pages: DataFrame) -> DataFrame:
    """``(host, page_id)`` of the lowest good page id per host: the home page of a crawl without root pages."""
    good = pages.where("html is not null")
    return good.groupBy(F.expr(extract_domain("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
