"""The main flow: requests in, one answer per request out, new records to append."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.history import fresh_records
from storelens.plans.competitors import attach_competitors
from storelens.plans.report import store_reports
from storelens.session import stored
from storelens.sources.records import append_records, as_records
from storelens.sources.requests import read_requests


def fetch_insights(
    requests: DataFrame,
    records: DataFrame,
    pages: DataFrame,
    as_of: dt.datetime,
    path: str | None = None,
    catalogs: DataFrame | None = None,
    competitors: tuple[DataFrame, DataFrame] | None = None,
    home: str = "exact",
) -> DataFrame:
    """``(website_url, outcome, store_url, insights_data, success, message)``, one row per request.

    A request is ``rejected`` when its URL is invalid, ``reused`` when the store has a successful record younger than
    the reuse limit, and ``extracted`` otherwise. Stores are extracted once however often they are asked for, and
    their records are appended to the table at ``path``. ``competitors`` is a pair of tables ``(wanted, profiles)``
    as ``attach_competitors`` takes them.
    """
    valid, rejects = read_requests(requests)
    fresh = stored(fresh_records(records, as_of).select("store_url", "insights_data"), "fresh")
    due = valid.join(fresh.select("store_url"), "store_url", "left_anti")
    reports = store_reports(pages, due, catalogs, home=home, as_of=as_of)
    if competitors is not None:
        reports = attach_competitors(reports, *competitors)
    made = stored(as_records(reports), "made")
    if path is not None:
        append_records(made, path)
    served = fresh.selectExpr("store_url", "'reused' as outcome", "insights_data", "true as success", "cast(null as string) as message")
    done = made.selectExpr("store_url", "'extracted' as outcome", "insights_data", "success", "error_message as message")
    answered = valid.select("website_url", "store_url").join(served.unionByName(done), "store_url")
    refused = rejects.selectExpr(
        "website_url", "'rejected' as outcome", "store_url", "cast(null as string) as insights_data", "false as success", "reason as message"
    )
    return answered.unionByName(refused).select("website_url", "outcome", "store_url", "insights_data", "success", "message")
