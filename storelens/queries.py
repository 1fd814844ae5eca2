"""Registered queries: one per operator, each over whole tables of a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens import fixtures as X
from storelens.functions import select as Q
from storelens.functions import text as T
from storelens.functions import urls as U
from storelens.functions.sql import let, lit, lits, rows_of
from storelens.operators import catalog as C
from storelens.operators import history as H
from storelens.operators import sections as S
from storelens.operators.cooldown import cooldown_replay as replay
from storelens.operators.dom import to_nodes, with_dom
from storelens.operators.lookup import candidate_pages, first_hit
from storelens.plans import competitors as K
from storelens.plans import report as R
from storelens.plans.fetch import fetch_insights as fetch
from storelens.session import prepare, scratch_path, spread
from storelens.sources.pages import keyed, latest_pages, read_pages, stream_pages
from storelens.sources.records import append_records, as_records, from_document, read_records
from storelens.sources.requests import read_requests
from storelens.streaming.cooldown import accepted_requests, rocksdb_state, write_accepted
from storelens.streaming.extract import extract_stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.datetime(2024, 1, 30, 12, tzinfo=dt.timezone.utc)
N, V = "nodes", "visible_text"

# Words put into links, so that every category occurs, and categories told by letters.
LINK_WORDS = (
    "Track", "orders", "Contact", "support", "HELP", "Blog", "news", "Articles", "FAQ", "Shipping", "delivery", "Returns",
    "refund", "Size", "guide", "fitting", "plain", "border", "x",
)
PAGE_CATEGORIES = {"early": ("a", "b", "c"), "late": ("u", "w", "y")}

# References resolved against every page, next to the page's own links.
SAMPLE_REFS = ("/x", "y/z?q=1", "//cdn.example.com/a", "?p=2", "#f", "../up", "mailto:a@b.c", "https://o.example.com/x")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose every row is about to be parsed."""
    return spread(_table(spark, folder, name))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(prepare(spark), f"{folder}/pages.parquet")


def _records(spark, folder) -> DataFrame:
    return X.records(_table(spark, folder, "events"))


def _catalogs(spark, folder) -> DataFrame:
    return X.catalogs(_texts(spark, folder, "part"))


def _contact_pages(spark, folder) -> DataFrame:
    return X.contact_pages(_texts(spark, folder, "supplier"), _table(spark, folder, "nation"))


# --- sources ---


def pages_scan(spark, folder):
    return _pages(spark, folder).selectExpr("page_id", "url", "cast(length(html) as bigint) as html_chars")


def catalog_status(spark, folder):
    return C.catalog_rollup(_catalogs(spark, folder)).select("store_url", "catalog_status")


def records_scan(spark, folder):
    rows = _records(spark, folder).withColumn("doc", from_document(F.col("insights_data")))
    return rows.selectExpr(
        "id", "store_url", "doc.store_name as doc_name", "doc.success as doc_success", "processing_time"
    )


def records_roundtrip(spark, folder):
    """Records are written as a table, read back and decoded."""
    path = scratch_path(spark, "records")
    rows = _records(spark, folder).withColumns(
        {"id": F.col("id").cast("string"), "scraped_date": F.to_date("scraped_at")}
    )
    append_records(rows, path)
    back = read_records(spark, path).withColumn("doc", from_document(F.col("insights_data")))
    return back.selectExpr(
        "cast(id as bigint) as id",
        "store_url",
        "unix_micros(timestamp_seconds(doc.scraped_at)) as scraped_us",
        "doc.store_name as store_name",
        "processing_time",
        "success",
        "error_message",
    )


def rejected_requests(spark, folder):
    """Pages' URLs and some broken forms of them, as requests; only the rejects come out."""
    _, rejects = read_requests(_url_variants(spark, folder).withColumnRenamed("raw", "website_url"))
    return rejects.select("page_id", "form", "reason")


# --- URLs ---


def _url_variants(spark, folder) -> DataFrame:
    host = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
    forms = (
        "array(url, concat(' \\t', bare, '\\n '), concat('HTTP://', bare), "
        f"concat('https://user:pw@', upper({host}), ':8080/a b'), replace({host}, '.', '-'), '')"
    )
    bare = _pages(spark, folder).selectExpr("page_id", "url", "regexp_replace(url, '^https?://', '') as bare")
    return bare.selectExpr("page_id", f"posexplode({forms}) as (form, raw)")


def url_normalize(spark, folder):
    return _url_variants(spark, folder).selectExpr("page_id", "form", f"{U.normalize_url('raw')} as normalized")


def url_validity(spark, folder):
    valid = U.is_valid_url(U.normalize_url("raw"))
    return _url_variants(spark, folder).selectExpr("page_id", "form", f"{valid} as valid")


def url_domain(spark, folder):
    return _url_variants(spark, folder).selectExpr("page_id", "form", f"{U.extract_domain('raw')} as domain")


def platform_hint(spark, folder):
    forms = "array(url, concat('https://Shop-', page_id, '.MyShopify.com/'), concat(url, '&next=shopify-checkout'))"
    rows = _pages(spark, folder).selectExpr("page_id", f"posexplode({forms}) as (form, u)")
    return rows.selectExpr("page_id", "form", f"{U.platform_hint('u')} as is_platform")


def url_absolute(spark, folder):
    rows = _pages(spark, folder).selectExpr(
        "page_id",
        f"concat('https://', {U.extract_domain('url')}, '/a/b') as base",
        f"posexplode(array({lits(SAMPLE_REFS)})) as (ref, href)",
    )
    return rows.selectExpr("page_id", "ref", f"{U.absolute_url('base', 'href')} as resolved")


# --- text ---


def clean_text(spark, folder):
    tail = lit("&amp;lt; &quot;x&quot;&nbsp; \x1c")
    text = T.clean_text(f"concat('  ', text, {tail})")
    rows = _texts(spark, folder, "documents").selectExpr("doc_id", f"{text} as t")
    return rows.selectExpr("doc_id", "cast(length(t) as bigint) as chars", "md5(t) as digest")


def emails_docs(spark, folder):
    return _texts(spark, folder, "documents").transform(rows_of, "doc_id", email=T.emails('text')).drop("pos")


def emails_pages(spark, folder):
    return _pages(spark, folder).transform(rows_of, "page_id", email=T.emails('html')).drop("pos")


def phones_docs(spark, folder):
    return _texts(spark, folder, "documents").transform(rows_of, "doc_id", phone=T.phones('text')).drop("pos")


def phones_pages(spark, folder):
    return _pages(spark, folder).transform(rows_of, "page_id", phone=T.phones('html')).drop("pos")


def addresses(spark, folder):
    return R.parsed(_contact_pages(spark, folder)).transform(rows_of, "page_id", address=T.addresses(V)).drop("pos")


def addresses_docs(spark, folder):
    """Addresses in every document, to which one of each shape is added from its own values."""
    number = "lpad(doc_id, 5, '0')"
    text = f"concat(text, '. ', doc_id, ' Main Street, Town ', {number}, '; New ', source, ', CA ', {number})"
    docs = _texts(spark, folder, "documents").selectExpr("doc_id", f"{text} as text")
    return docs.transform(rows_of, "doc_id", address=T.addresses("text")).drop("pos")


def link_category(spark, folder):
    """Categories of every navigation link of the supplied pages, a word of the vocabulary put into text or target."""
    word = f"element_at(array({lits(LINK_WORDS)}), cast((page_id + pos) % {len(LINK_WORDS)} as int) + 1)"
    links = nav_links(spark, folder).selectExpr("page_id", "pos", "title", "href", f"{word} as word")
    worded = links.selectExpr(
        "page_id", "pos", "if(page_id % 2 = 0, concat(title, ' ', word), title) as title",
        "if(page_id % 2 = 0, href, concat(href, '/', word)) as href",
    )
    return worded.selectExpr("page_id", "pos", f"{T.link_category('title', 'href')} as category")


def policy_titles(spark, folder):
    """Fallback titles made from keys, over the distinct sources of the documents."""
    sources = _table(spark, folder, "documents").select("source").distinct()
    key = "concat(source, '_policy_page')"
    return sources.selectExpr("source", f"{T.title_from_key(key)} as title")


# --- nodes and selectors ---


def node_counts(spark, folder):
    nodes = to_nodes(with_dom(_texts(spark, folder, "pages"), attrs=[]), "page_id")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_text_stats(spark, folder):
    return with_dom(_texts(spark, folder, "pages"), tags=[]).selectExpr(
        "page_id", "cast(length(visible_text) as bigint) as chars", "md5(visible_text) as digest"
    )


def titles(spark, folder):
    title = let("hit", Q.select_first(N, Q.tag("title")), Q.node_text(V, "hit"))
    return with_dom(_texts(spark, folder, "pages"), tags=["title"], attrs=[]).selectExpr("page_id", f"{title} as title")


def first_heading(spark, folder):
    """First of ``p, h1`` in document order, whatever the order of the group."""
    first = Q.select_first(N, Q.any_of(Q.tag("p"), Q.tag("h1")))
    return with_dom(_texts(spark, folder, "pages"), tags=["h1", "p"], attrs=[]).selectExpr("page_id", f"{first}.tag as tag")


def priority_select(spark, folder):
    """``h1`` wins over the earlier ``.ad`` because it comes first in the list; ``aside`` never matches."""
    hit = Q.select_priority(N, [Q.tag("aside"), Q.tag("h1"), Q.cls("ad")])
    text = let("hit", hit, f"struct(hit.tag, {T.clean_text(Q.node_text(V, 'hit'))} as t)")
    parsed = with_dom(_texts(spark, folder, "pages"), tags=["h1", "aside"], classes=["ad"], attrs=[])
    return parsed.selectExpr("page_id", f"{text} as h").selectExpr("page_id", "h.tag as tag", "md5(h.t) as digest")


def _with_nav(spark, folder) -> DataFrame:
    return with_dom(
        _texts(spark, folder, "pages"), tags=["nav", "footer", "a"], classes=["navigation", "menu"], attrs=["href"]
    )


def nav_links(spark, folder):
    rows = rows_of(_with_nav(spark, folder), "page_id", l=S.nav_links(N, V))
    return rows.select("page_id", "pos", "l.title", "l.href")


def nav_links_table(spark, folder):
    """The same links from the node table: one window per page instead of arrays."""
    nodes = rows_of(_with_nav(spark, folder), "page_id", "visible_text", n=N)
    title = T.clean_text(Q.node_text("visible_text", "n"))
    links = Q.select_nodes(nodes.selectExpr("page_id", "n.*", f"{title} as title"), S.NAV_LINKS)
    return links.selectExpr("page_id", "title", "attrs['href'] as href")


def contact_link(spark, folder):
    return R.parsed(_contact_pages(spark, folder)).selectExpr("page_id", f"{S.contact_href(N)} as href")


def candidate_lookup(spark, folder):
    """First page per host over language folders in order of preference."""
    languages = {"home": ("/en", "/fr", "/de", "/es")}
    pages = keyed(_pages(spark, folder)).selectExpr(
        "page_id", "host", "regexp_extract(path, '^/[a-z]{2}(?=/)', 0) as path"
    )
    hits = candidate_pages(pages, languages)
    return first_hit(hits, ["host", "section"], ["rank", "page_id"], ["rank", "page_id"])


# --- sections ---


def store_name(spark, folder):
    """Names of the supplied pages (title) and of supplier pages (title, then logo text)."""
    both = _texts(spark, folder, "pages").unionByName(_contact_pages(spark, folder))
    return R.parsed(both).selectExpr("page_id", "url", f"{S.store_name(N, V)} as store_name")


def catalog_products(spark, folder):
    rows = C.catalog_products(_catalogs(spark, folder))
    return rows.selectExpr(
        "store_url", "pos", "id", "title", "handle", "description", "vendor", "product_type",
        "array_join(tags, '|') as tags", "price", "compare_at_price", "available",
        "array_join(images, '|') as images", "size(variants) as n_variants",
        "unix_seconds(created_at) as created_s", "unix_seconds(updated_at) as updated_s",
    )


def catalog_rollup(spark, folder):
    return C.catalog_rollup(_catalogs(spark, folder))


def hero_products(spark, folder):
    pages = R.parsed(X.hero_pages(_texts(spark, folder, "part")))
    heroes = pages.selectExpr("page_id", "url", f"{S.hero_products(N, V)} as heroes")
    return rows_of(heroes, "page_id", h=S.resolve_heroes("heroes", "url")).select("page_id", "pos", "h.*")


def _document_sections(spark, folder) -> DataFrame:
    pages = candidate_pages(keyed(X.document_pages(_texts(spark, folder, "documents"))))
    return R.host_sections(R.page_sections(pages.withColumn("is_home", F.lit(False))))


def policies(spark, folder):
    rows = rows_of(_document_sections(spark, folder), "host", p=f"array_compact(array({', '.join(R.POLICY_PATHS)}))")
    return rows.selectExpr("host", "p.type", "p.title", "p.url as path", "md5(p.content) as digest")


def _faq(extract):
    def query(spark, folder):
        pages = with_dom(X.faq_pages(_texts(spark, folder, "conversations")))
        return rows_of(pages, "page_id", f=extract(N, V)).select("page_id", "pos", "f.*")

    return query


def contact_info(spark, folder):
    info = R.parsed(_contact_pages(spark, folder)).selectExpr(
        "page_id", "url", f"{S.contact_info(V)} as c", f"{S.contact_href(N)} as href"
    )
    return info.selectExpr(
        "page_id",
        "array_join(c.emails, '|') as emails",
        "array_join(c.phone_numbers, '|') as phone_numbers",
        "array_join(c.addresses, '|') as addresses",
        f"{U.absolute_url('url', 'href')} as contact_form_url",
    )


def social_handles(spark, folder):
    pages = R.parsed(_contact_pages(spark, folder), keep_html=True)
    found = pages.selectExpr("page_id", f"explode_outer({T.social_handles(V, 'html')}) as (platform, names)")
    return rows_of(found, "page_id", "platform", handle="names")


def brand_context(spark, folder):
    """About text of document stores by host, and of supplier pages by their banners."""
    about = _document_sections(spark, folder).selectExpr("host", "md5(about) as digest")
    homes = R.parsed(keyed(_contact_pages(spark, folder)))
    return about.unionByName(homes.selectExpr("host", f"md5({S.about_home_text(N, V)}) as digest"))


def _links(pages: DataFrame, base: str, categories=T.LINK_CATEGORIES) -> DataFrame:
    found = R.parsed(pages).selectExpr("page_id", f"{base} as base", f"{S.important_links(N, V, categories)} as links")
    return rows_of(found, "page_id", l=S.resolve_links("links", "base")).select("page_id", "pos", "l.*")


def important_links(spark, folder):
    return _links(_contact_pages(spark, folder), "url")


def important_links_pages(spark, folder):
    """Links of the supplied pages in categories of our own, kept once per URL."""
    base = f"concat('https://', {U.extract_domain('url')})"
    return _links(_texts(spark, folder, "pages"), base, PAGE_CATEGORIES).drop("pos")


# --- reports ---


def _host_requests(pages: DataFrame) -> DataFrame:
    hosts = pages.selectExpr(f"concat('https://', {U.extract_domain('url')}) as website_url").distinct()
    return read_requests(hosts)[0]


def host_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: a full report for every host of the page table."""
    pages = _pages(spark, folder)
    return R.store_reports(latest_pages(pages), _host_requests(pages), home="first", as_of=AS_OF)


def store_report(spark, folder):
    return host_reports(spark, folder).selectExpr(
        "store_url", "store_name", "is_shopify_store", "success", "size(contact_info.emails) as n_emails",
        "size(contact_info.phone_numbers) as n_phones", "size(important_links) as n_links",
        "array_join(errors, '|') as errors", "array_join(warnings, '|') as warnings",
    )


def _exact_reports(spark, folder) -> DataFrame:
    """Reports by exact home page: document stores, supplier stores and stores nobody crawled, in one run."""
    docs, suppliers = _texts(spark, folder, "documents"), _contact_pages(spark, folder)
    catalogs = _catalogs(spark, folder)
    asked = X.document_requests(docs).unionByName(
        suppliers.selectExpr("url as website_url", "false as include_competitors")
    )
    lost = catalogs.selectExpr("concat(store_url, '/shop') as website_url", "true as include_competitors")
    requests, _ = read_requests(asked.unionByName(lost))
    payloads = catalogs.selectExpr("replace(store_url, 'https://p', 'https://s') as store_url", "payload")
    pages = X.document_pages(docs).unionByName(suppliers)
    return R.store_reports(pages, requests, catalogs=payloads, home="exact", as_of=AS_OF)


def report_summary(spark, folder):
    return R.report_summary(_exact_reports(spark, folder))


def report_errors(spark, folder):
    return _exact_reports(spark, folder).selectExpr(
        "store_url", "success", "array_join(errors, '|') as errors", "array_join(warnings, '|') as warnings"
    )


def competitor_profile(spark, folder):
    """Each part store against the store of the next part."""
    pairs = _table(spark, folder, "part").selectExpr(
        "concat('https://p', p_partkey, '.example.com') as store_url",
        "concat('https://p', p_partkey + 1, '.example.com') as competitor_url",
    )
    rows = K.competitor_profiles(pairs, K.store_profiles(_catalogs(spark, folder)))
    return rows.select("store_url", "competitor_url", "estimated_products", "price_range")


def report_competitors(spark, folder):
    """Supplier stores of which every other one asks for its two neighbours among the part stores."""
    suppliers = _contact_pages(spark, folder)
    asked = suppliers.selectExpr("url as website_url", "page_id % 2 = 0 as include_competitors")
    reports = R.store_reports(suppliers, read_requests(asked)[0], as_of=AS_OF)
    named = "concat('https://p', k, '.example.com')"
    wanted = suppliers.selectExpr("url as store_url", f"transform(array(page_id + 1, page_id), k -> {named}) as competitor_urls")
    rows = K.attach_competitors(reports, wanted, K.store_profiles(_catalogs(spark, folder)))
    return rows_of(rows, "store_url", c="competitors").selectExpr(
        "store_url", "pos", "c.website_url", "c.estimated_products", "c.price_range"
    )


# --- records ---


def _requests(spark, folder) -> DataFrame:
    """One request per customer; stores of busy users are among them."""
    customers = _table(spark, folder, "customer")
    valid, _ = read_requests(customers.selectExpr("concat('store-', c_custkey, '.example.com') as website_url"))
    return valid.select("store_url")


def latest_record(spark, folder):
    rows = H.latest_records(_records(spark, folder))
    return rows.selectExpr("store_url", "id", "unix_micros(scraped_at) as scraped_us", "processing_time")


def cached_report(spark, folder):
    rows = H.cached_report(_records(spark, folder), " store-7.example.com")
    return rows.selectExpr("store_url", "id", "report.store_name as store_name", "report.success as success")


def history_page(spark, folder):
    rows = H.history_page(_records(spark, folder), limit=500, offset=20)
    return rows.selectExpr(
        "id", "store_url", "store_name", "unix_micros(scraped_at) as scraped_us", "processing_time", "success"
    )


def service_stats(spark, folder):
    return H.service_stats(_records(spark, folder))


def stale_requests(spark, folder):
    return H.stale_requests(_requests(spark, folder), _records(spark, folder), AS_OF)


def fresh_hits(spark, folder):
    rows = H.fresh_hits(_requests(spark, folder), _records(spark, folder), AS_OF)
    return rows.selectExpr("store_url", "store_name", "unix_micros(scraped_at) as scraped_us")


def _accepted(df: DataFrame) -> DataFrame:
    return df.selectExpr("user_id", "event_id", "unix_micros(ts) as ts_us")


def cooldown_replay(spark, folder):
    return _accepted(replay(_table(spark, folder, "events"), key="user_id", id="event_id"))


def cooldown_failures(spark, folder):
    """Failed requests are extracted when due but do not start a cool-down."""
    events = _table(spark, folder, "events").withColumn("ok", F.col("event_type") != "error")
    return _accepted(replay(events, key="user_id", id="event_id", success="ok"))


# --- streams ---


def cooldown_stream(spark, folder):
    prepare(spark)
    source = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = scratch_path(spark, "accepted")
    accepted = accepted_requests(events, key="user_id", id="event_id")
    with rocksdb_state(spark):
        write_accepted(accepted, out, scratch_path(spark, "state")).awaitTermination()
    return _accepted(spark.read.schema(accepted.schema).parquet(out))


def stream_extract(spark, folder):
    """Pages arrive in four files that cut through the stores, one file per micro-batch."""
    parts, out = scratch_path(spark, "page-files"), scratch_path(spark, "insights")
    _pages(spark, folder).repartition(4, "page_id").write.parquet(parts)
    pages = stream_pages(prepare(spark), parts, files_per_batch=1)

    def reports(batch: DataFrame) -> DataFrame:
        return R.store_reports(latest_pages(batch), _host_requests(batch), home="first", as_of=AS_OF)

    store = scratch_path(spark, "page-store")
    extract_stream(pages, reports, out, scratch_path(spark, "progress"), page_store=store).awaitTermination()
    rows = read_records(spark, out).withColumn("doc", from_document(F.col("insights_data")))
    return rows.selectExpr(
        "store_url", "store_name", "success", "size(doc.important_links) as n_links",
        "array_join(doc.warnings, '|') as warnings",
    )


def fetch_insights(spark, folder):
    """The main flow over customers (some of whom have fresh records, some a broken URL) and crawled hosts."""
    store = "case when c_custkey % 4 = 3 then concat('not-a-url-', c_custkey) else concat('store-', c_custkey, '.example.com') end"
    pages = _pages(spark, folder)
    asked = _table(spark, folder, "customer").selectExpr(f"{store} as website_url")
    asked = asked.unionByName(_host_requests(pages).select("website_url"))
    out = scratch_path(spark, "records")
    answers = fetch(asked, _records(spark, folder), pages, AS_OF, out, home="first")
    return answers.withColumn("doc", from_document(F.col("insights_data"))).selectExpr(
        "website_url", "outcome", "doc.store_name as store_name", "success", "message"
    )


def records_written(spark, folder):
    """Reports become record rows; the key is a digest of store and time."""
    rows = as_records(host_reports(spark, folder)).withColumn("doc", from_document(F.col("insights_data")))
    return rows.selectExpr(
        "id", "store_url", "store_name", "success", "error_message", "unix_micros(scraped_at) as scraped_us",
        "size(doc.important_links) as n_links",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        pages_scan, catalog_status, records_scan, records_roundtrip, rejected_requests, url_normalize, url_validity,
        url_domain, platform_hint, url_absolute, clean_text, emails_docs, emails_pages, phones_docs, phones_pages,
        addresses, addresses_docs, link_category, policy_titles, node_counts, page_text_stats, titles, first_heading, priority_select,
        nav_links, nav_links_table, contact_link, candidate_lookup, store_name, catalog_products, catalog_rollup,
        hero_products, policies, contact_info, social_handles, brand_context, important_links, important_links_pages,
        store_report, report_summary, report_errors, report_competitors, competitor_profile, latest_record, cached_report, history_page,
        service_stats, stale_requests, fresh_hits, cooldown_replay, cooldown_failures, cooldown_stream,
        stream_extract, records_written, fetch_insights,
    )
} | {
    "faq_items": _faq(S.faq_items),
    "faq_dl": _faq(S.faq_definitions),
    "faq_headings": _faq(S.faq_headings),
    "faqs": _faq(S.faqs),
}
