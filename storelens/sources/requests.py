"""Request tables: normalise and split into valid stores and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.urls import is_valid_url, normalize_url


def read_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(website_url, include_competitors?)`` into requests with ``store_url`` and rejects with ``reason``."""
    if "include_competitors" not in requests.columns:
        requests = requests.withColumn("include_competitors", F.lit(False))
    checked = requests.withColumns(
        {
            "include_competitors": F.expr("coalesce(include_competitors, false)"),
            "store_url": F.expr(normalize_url("website_url")),
        }
    ).withColumn(
        "reason",
        F.expr(
            "case when coalesce(website_url, '') = '' then 'Website URL is required' "
            f"when not {is_valid_url('store_url')} then concat('Invalid website URL: ', website_url) end"
        ),
    )
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")
