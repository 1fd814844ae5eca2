"""Ordered candidate paths of a store, answered without building store x path pairs.

A page knows from its own path which section it may serve and with which rank, so the candidates are a filter on
the page scan and "first hit wins" is a ``min_by`` per store with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sql import lit

# Where a store may keep a page of each section, in order of preference.
POLICY_PATHS = {
    "privacy_policy": ("/pages/privacy-policy", "/privacy-policy", "/pages/privacy"),
    "return_refund_policy": ("/pages/refund-policy", "/pages/returns", "/refund-policy", "/returns"),
    "terms_of_service": ("/pages/terms-of-service", "/terms-of-service", "/pages/terms"),
    "shipping_policy": ("/pages/shipping-policy", "/shipping-policy", "/pages/shipping"),
}
FAQ_PATHS = ("/pages/faq", "/pages/frequently-asked-questions", "/faq", "/help", "/support")
ABOUT_PATHS = ("/pages/about", "/about", "/pages/about-us", "/about-us")
CATALOG_PATH = "/products.json"

SECTION_PATHS: dict[str, Sequence[str]] = {**POLICY_PATHS, "faq": FAQ_PATHS, "about": ABOUT_PATHS}


def section_of(path: str, sections: Mapping[str, Sequence[str]] = SECTION_PATHS) -> str:
    """Struct ``(section, rank)`` a path may serve, NULL for any other path."""
    known = [
        f"{lit(p)}, named_struct('section', {lit(name)}, 'rank', {rank})"
        for name, paths in sections.items()
        for rank, p in enumerate(paths)
    ]
    return f"try_element_at(map({', '.join(known)}), {path})"


def candidate_pages(
    pages: DataFrame, sections: Mapping[str, Sequence[str]] = SECTION_PATHS, path: str = "path"
) -> DataFrame:
    """Pages on a candidate path with their ``section`` and ``rank``."""
    every = [p for paths in sections.values() for p in paths]
    return (
        pages.where(F.col(path).isin(every))
        .withColumn("_hit", F.expr(section_of(path, sections)))
        .select(*pages.columns, "_hit.section", "_hit.rank")
    )


def first_hit(hits: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Row of the lowest ``order`` per ``keys``; non-hits must be filtered out before."""
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_best")
    return hits.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])
