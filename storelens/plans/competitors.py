"""Competitor profiles for given pairs of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sql import rows_of
from storelens.operators.catalog import parse_products
from storelens.schemas import REPORT_FIELDS


def store_profiles(catalogs: DataFrame, social: DataFrame | None = None) -> DataFrame:
    """Product count, price range and social presence per store, from its own payload row.

    ``social`` is an optional ``(store_url, social_handles)`` table. Prices that are no numbers do not count.
    """
    prices = "filter(transform(products, p -> try_cast(p.price as decimal(18,2))), p -> p is not null)"
    table = (
        parse_products(catalogs, fields=("price",))
        .selectExpr("store_url", "total_products as estimated_products", f"{prices} as _prices")
        .selectExpr(
            "store_url",
            "estimated_products",
            "if(size(_prices) > 0, concat(array_min(_prices), ' - ', array_max(_prices)), null) as price_range",
        )
    )
    if social is None:
        return table.withColumn("social_presence", F.create_map().cast(REPORT_FIELDS["social_handles"]))
    named = social.select("store_url", F.col("social_handles").alias("social_presence"))
    return table.join(named, "store_url", "left")


def competitor_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile columns for ``(store_url, competitor_url, ...)``; unknown competitors keep NULLs."""
    return pairs.join(profiles.withColumnRenamed("store_url", "competitor_url"), "competitor_url", "left")


def attach_competitors(reports: DataFrame, wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill ``competitors`` of the reports that asked for them and have a name.

    ``wanted`` holds one row ``(store_url, competitor_urls array)`` per store, so what meets in one row again is no
    more than came from one row. The order of that array is kept.
    """
    pairs = rows_of(wanted, "store_url", competitor_url="competitor_urls")
    entry = (
        "named_struct('pos', pos, 'c', named_struct('name', competitor_url, 'website_url', competitor_url, "
        "'description', cast(null as string), 'estimated_products', estimated_products, "
        "'price_range', price_range, 'social_presence', social_presence))"
    )
    listed = competitor_profiles(pairs, profiles).groupBy("store_url").agg(F.collect_list(F.expr(entry)).alias("_found"))
    by_pos = "(x, y) -> case when x.pos < y.pos then -1 when x.pos > y.pos then 1 else 0 end"
    asked = "include_competitors and coalesce(store_name, '') <> '' and _found is not null"
    filled = f"if({asked}, cast(array_sort(_found, {by_pos}).c as {REPORT_FIELDS['competitors']}), competitors)"
    joined = reports.join(listed, "store_url", "left")
    return joined.selectExpr(*[f"{filled} as competitors" if c == "competitors" else c for c in reports.columns])
