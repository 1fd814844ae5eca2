"""Full reports on a handful of stores, and the plans behind them."""

import datetime as dt
import json

import pytest

from storelens.operators.lookup import SECTION_PATHS, candidate_pages, first_hit
from storelens.plans.report import _needed_pages, page_sections, report_summary, store_reports
from storelens.queries import QUERIES, _host_requests, _pages, host_reports
from storelens.session import scratch_path
from storelens.sources.pages import keyed, latest_pages, read_pages, stream_pages
from storelens.sources.records import append_records, as_records, read_records
from storelens.sources.requests import read_requests
from storelens.streaming.extract import add_to_store, extract_stream, pages_of_hosts

AS_OF = dt.datetime(2024, 5, 2, 12, tzinfo=dt.timezone.utc)
HOME = (
    "<title>Shop</title><div class='featured-product'><h3>P</h3><a href='/p'></a><span class='price'>$1</span></div>"
    "<p>mail a@b.co</p><nav><a href='/contact-us'>Contact</a></nav><div class='hero'>" + "word " * 30 + "</div>"
    "<a href='https://twitter.com/shop'>t</a>"
)
CRAWL = [
    (1, "https://a.com/", HOME),
    (2, "http://A.com/pages/privacy-policy?x=1", "<h1>Empty</h1><main> </main>"),
    (3, "https://a.com/privacy-policy/", "<main>Second</main>"),
    (4, "https://a.com/pages/privacy", "<main>Third</main>"),
    (5, "https://a.com/returns", "<h1>Returns</h1><main>R</main>"),
    (6, "https://a.com/pages/faq", "<p>nothing</p>"),
    (7, "https://a.com/help", "<dl><dt>Q</dt><dd>A</dd></dl>"),
    (8, "https://a.com/support", "<dl><dt>later</dt><dd>A</dd></dl>"),
    (9, "https://a.com/pages/about", "<p>no content</p>"),
    (10, "https://a.com/about", "<main>About us</main>"),
    (11, "https://b.com/shop", "<title>B</title>"),
    (12, "https://b.com/about-us", "<main></main>"),
    (13, "https://b.com", "<title>Root of b</title><nav><a href='help'>Help</a></nav>"),
    (14, "https://c.com/pages/faq", "<dl><dt>Q</dt><dd>A</dd></dl>"),
    (15, "https://d.com", None),
    (16, "https://a.com/other", "<title>no</title>"),
]
CATALOGS = [
    ("https://a.com", json.dumps({"products": [{"title": "x", "variants": [{"price": "1.00"}]}, {"tags": None}]})),
    ("https://b.com/shop", "{bad"),
    ("b.com", "[]"),
]


@pytest.fixture(scope="module")
def reports(spark):
    pages = spark.createDataFrame(CRAWL, "page_id long, url string, html string")
    urls = ["a.com", "http://a.com", "https://b.com/shop", "b.com/", "c.com", "d.com", "https://a.com", "bad url"]
    requests, _ = read_requests(spark.createDataFrame([(u,) for u in urls], "website_url string"))
    catalogs = spark.createDataFrame(CATALOGS, "store_url string, payload string")
    rows = store_reports(pages, requests, catalogs, as_of=AS_OF)
    return {r.store_url: r for r in rows.collect()}


def test_one_row_per_requested_store(reports):
    assert sorted(reports) == ["http://a.com", "https://a.com", "https://b.com/", "https://b.com/shop", "https://c.com", "https://d.com"]


def test_full_report(reports):
    r = reports["https://a.com"]
    assert r.success and r.store_name == "Shop" and r.errors == [] and r.warnings == [] and r.scraped_at == AS_OF.timestamp()
    assert (r.product_catalog.total_products, r.product_catalog.products[0].price, r.product_catalog.has_more) == (1, "1.00", False)
    assert r.hero_products[0].product_url == "https://a.com/p" and r.hero_products[0].price == "$1"
    assert (r.privacy_policy.title, r.privacy_policy.content, r.privacy_policy.url) == ("Privacy Policy", "Second", "https://a.com/privacy-policy")
    assert (r.return_refund_policy.title, r.return_refund_policy.type) == ("Returns", "return_refund_policy")
    assert r.terms_of_service is None and r.shipping_policy is None and r.other_policies == []
    assert [(f.question, f.answer) for f in r.faqs] == [("Q", "A")]
    assert r.contact_info.emails == ["a@b.coContactword"]  # visible text has no separators between elements
    assert r.contact_info.contact_form_url == "https://a.com/contact-us"
    assert r.social_handles == {"twitter": ["shop", "b.coContactword"]} and r.brand_context.description == "About us" and r.brand_context.name == "Shop"
    assert [(x.url, x.category) for x in r.important_links] == [("https://a.com/contact-us", "contact")]


def test_scheme_of_the_request_decides_the_urls(reports):
    r = reports["http://a.com"]
    assert r.important_links[0].url == "http://a.com/contact-us" and r.privacy_policy.url == "http://a.com/privacy-policy"
    assert r.warnings == [] and r.product_catalog.total_products == 1  # the catalogue belongs to the host


def test_home_page_is_the_requested_page(reports):
    shop, root = reports["https://b.com/shop"], reports["https://b.com/"]
    assert shop.store_name == "B" and root.store_name == "Root of b"
    assert shop.warnings == ["Could not parse product catalog JSON"] and shop.success
    assert shop.brand_context.description == "" and root.important_links[0].url == "https://b.com/help"


@pytest.mark.parametrize("store", ["https://c.com", "https://d.com"])
def test_missing_home_page(reports, store):
    r = reports[store]
    assert not r.success and r.errors == ["Failed to fetch the main page"] and r.warnings == []
    assert r.store_name is None and r.faqs == [] and r.contact_info.emails == [] and r.product_catalog.total_products == 0


def test_summary(spark, reports):
    pages = spark.createDataFrame(CRAWL, "page_id long, url string, html string")
    requests, _ = read_requests(spark.createDataFrame([("a.com",)], "website_url string"))
    row = report_summary(store_reports(pages, requests, as_of=AS_OF)).first()
    assert tuple(row) == ("https://a.com", 1, 0, 0, 2, 0, 1, 1, 1)


def test_catalog_of_wrong_shape_is_an_error_only(spark):
    pages = spark.createDataFrame(CRAWL, "page_id long, url string, html string")
    requests, _ = read_requests(spark.createDataFrame([("a.com",)], "website_url string"))
    catalogs = spark.createDataFrame([("https://a.com", "[]")], "store_url string, payload string")
    row = store_reports(pages, requests, catalogs, as_of=AS_OF).first()
    assert row.success and row.errors == ["Product catalog error: products is not a list"] and row.store_name == "Shop"


def test_latest_pages(spark):
    rows = [(i, "https://hot.com/x" if i % 3 else f"http://h{i}.com/?a", str(i)) for i in range(300)]
    rows += [(1000, "http://HOT.com/x/#y", "new"), (1001, "https://h0.com", "newer")]
    kept = latest_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(kept) == 101 and {r.page_id for r in kept} >= {1000, 1001} and 0 not in {r.page_id for r in kept}


def test_candidates(spark):
    pages = keyed(spark.createDataFrame(CRAWL, "page_id long, url string, html string"))
    hits = first_hit(candidate_pages(pages), ["host", "section"], ["rank", "page_id"], ["path"])
    got = {(r.host, r.section): r.path for r in hits.collect()}
    assert got["a.com", "privacy_policy"] == "/pages/privacy-policy" and got["b.com", "about"] == "/about-us"
    every = [p for paths in SECTION_PATHS.values() for p in paths]
    assert len(every) == len(set(every)) == 22


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_parses_once_and_prunes(spark, folder):
    pages = spark.createDataFrame([], "page_id long, host string, path string, html string, is_home boolean, section string, rank int")
    assert plan(page_sections(pages)).count("ArrowEvalPython") == 1
    text = plan(host_reports(spark, folder))
    assert not any(word in text for word in ("EvalPython", "html", "CartesianProduct", "NestedLoop"))
    assert "ReadSchema: struct<url:string>" in plan(_host_requests(_pages(spark, folder)))


NO_PYTHON = (
    "emails_docs phones_docs addresses_docs clean_text url_absolute url_domain candidate_lookup catalog_products catalog_rollup "
    "latest_record history_page service_stats stale_requests fresh_hits competitor_profile"
).split()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_plans_stay_in_the_jvm(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert not any(word in text for word in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop"))


def test_history_reads_narrow_columns_first(spark, folder):
    text = plan(QUERIES["service_stats"](spark, folder))
    assert "TakeOrderedAndProject" in text and "props" not in text


def test_stream_of_pages_equals_batch(spark):
    folder = scratch_path(spark, "crawl")
    schema = "page_id long, url string, html string"
    # Files that cut through the stores.
    for k in range(3):
        spark.createDataFrame(CRAWL[k::3], schema).coalesce(1).write.mode("append").parquet(folder)
    requests, _ = read_requests(spark.createDataFrame([("a.com",), ("b.com/shop",)], "website_url string"))

    def to_reports(pages):
        hosts = keyed(pages).select("host").distinct()
        asked = requests.where("true").join(hosts, requests["store_url"].contains(hosts["host"]), "left_semi")
        return store_reports(pages, asked, as_of=AS_OF)

    out = scratch_path(spark, "insights")
    extract_stream(stream_pages(spark, folder, files_per_batch=1), to_reports, out, scratch_path(spark, "progress"), lambda: read_pages(spark, folder)).awaitTermination()
    append_records(as_records(store_reports(read_pages(spark, folder), requests.limit(0), as_of=AS_OF)), out)  # one layout
    stored = read_records(spark, out).orderBy("store_url").collect()
    direct = store_reports(read_pages(spark, folder), requests, as_of=AS_OF).orderBy("store_url").collect()
    assert [(r.store_url, r.store_name, r.success) for r in stored] == [(r.store_url, r.store_name, r.success) for r in direct]
    assert json.loads(stored[0].insights_data)["privacy_policy"]["content"] == direct[0].privacy_policy.content


def test_stream_with_page_store_equals_batch(spark):
    """Pages of a store in several micro-batches; each batch reads only its hosts' buckets of the page store."""
    folder = scratch_path(spark, "crawl")
    schema = "page_id long, url string, html string"
    for k in range(3):
        spark.createDataFrame(CRAWL[k::3], schema).coalesce(1).write.mode("append").parquet(folder)
    requests, _ = read_requests(spark.createDataFrame([("a.com",), ("b.com/shop",)], "website_url string"))

    def to_reports(pages):
        hosts = keyed(pages).select("host").distinct()
        asked = requests.where("true").join(hosts, requests["store_url"].contains(hosts["host"]), "left_semi")
        return store_reports(pages, asked, as_of=AS_OF)

    out, store = scratch_path(spark, "insights"), scratch_path(spark, "page-store")
    pages = stream_pages(spark, folder, files_per_batch=1)
    extract_stream(pages, to_reports, out, scratch_path(spark, "progress"), page_store=store).awaitTermination()
    stored = read_records(spark, out).orderBy("store_url").collect()
    direct = store_reports(read_pages(spark, folder), requests, as_of=AS_OF).orderBy("store_url").collect()
    assert [(r.store_url, r.store_name, r.success) for r in stored] == [(r.store_url, r.store_name, r.success) for r in direct]
    assert json.loads(stored[0].insights_data)["privacy_policy"]["content"] == direct[0].privacy_policy.content


def test_page_store_reads_the_buckets_of_a_batch(spark):
    """Bytes a micro-batch reads follow the batch: files of other buckets are not listed for it."""
    store = scratch_path(spark, "page-store")
    schema = "page_id long, url string, html string"
    crawl = [(i, f"https://h{i % 40}.com/p{i}", "<p>x</p>") for i in range(400)]
    add_to_store(spark.createDataFrame(crawl, schema), store, 0, buckets=32)
    batch = spark.createDataFrame([(1000, "https://h7.com/new", "<p>y</p>")], schema)
    touched = add_to_store(batch, store, 1, buckets=32)
    hosts = spark.createDataFrame([("h7.com",)], "_host string")
    table = pages_of_hosts(spark, store, hosts, touched)
    plan = table._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "PartitionFilters" in line]
    assert len(touched) == 1 and len(scan) == 1 and f"= {touched[0]})]" in scan[0].split("PartitionFilters: ")[1]
    assert sorted(r.page_id for r in table.collect()) == sorted([i for i in range(400) if i % 40 == 7] + [1000])
    add_to_store(batch.limit(0), store, 2, buckets=32)  # an empty batch touches nothing


def test_failed_fetch_is_no_copy(spark):
    crawl = [(1, "https://n.com/", "<title>N</title>"), (2, "https://n.com", None), (3, "https://n.com/faq", None)]
    pages = spark.createDataFrame(crawl, "page_id long, url string, html string")
    assert [r.page_id for r in latest_pages(pages).collect()] == [1]
    requests, _ = read_requests(spark.createDataFrame([("n.com",)], "website_url string"))
    row = store_reports(pages, requests, as_of=AS_OF).first()
    assert row.success and row.store_name == "N"


def test_one_report_per_store(spark):
    pages = spark.createDataFrame([(1, "https://o.com/", "<title>O</title>")], "page_id long, url string, html string")
    asked = spark.createDataFrame([("o.com", False), ("o.com", True)], "website_url string, include_competitors boolean")
    payloads = spark.createDataFrame(
        [("https://o.com", '{"products": [{}]}'), ("https://o.com", "{bad"), ("http://o.com/x", '{"products": []}')],
        "store_url string, payload string",
    )
    rows = store_reports(pages, read_requests(asked)[0], payloads, as_of=AS_OF).collect()
    assert len(rows) == 1 and rows[0].include_competitors and rows[0].product_catalog.total_products == 0


def test_parse_errors_are_told(spark, monkeypatch):
    from storelens.operators import dom

    plain = dom._Outline.handle_starttag

    def strict(self, tag, attrs):
        if tag == "bad":
            raise ValueError("no")
        plain(self, tag, attrs)

    monkeypatch.setattr(dom._Outline, "handle_starttag", strict)
    crawl = [(1, "https://e.com/", "<title>E</title>"), (2, "https://e.com/faq", "<bad>"), (3, "https://f.com", "<bad>")]
    pages = spark.createDataFrame(crawl, "page_id long, url string, html string")
    requests, _ = read_requests(spark.createDataFrame([("e.com",), ("f.com",)], "website_url string"))
    rows = {r.store_url: r for r in store_reports(pages, requests, as_of=AS_OF).collect()}
    assert rows["https://e.com"].success and rows["https://e.com"].errors == ["Error parsing /faq: ValueError: no"]
    assert not rows["https://f.com"].success
    assert rows["https://f.com"].errors == ["Failed to fetch the main page", "Error parsing : ValueError: no"]


def test_html_meets_keys_once(spark):
    """Without broadcasting, HTML enters one exchange only: that of the join with the needed pages."""
    pages = spark.createDataFrame(CRAWL, "page_id long, url string, html string")
    requests, _ = read_requests(spark.createDataFrame([("a.com",)], "website_url string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = requests.selectExpr("store_url", "'a.com' as host", "'a.com' as page_key")
        plan = _needed_pages(pages, wanted, "exact")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "page_id" in joins[0]
