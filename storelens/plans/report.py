"""The full report: one row per requested store, from one pass over the pages it needs.

Order of work: decide on ids and URLs which pages are needed, join those keys to the HTML once, parse, take every
section of a page in the same projection, store those small rows, combine them per host and join them to the requests.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.sql import NO_TEXT, let, lit, lits
from storelens.functions.text import NO_HANDLES, social_handles, title_from_key
from storelens.functions.urls import absolute_url, extract_domain, page_key, platform_hint, url_path
from storelens.operators import sections as S
from storelens.operators.catalog import ERROR_PREFIX, WARN_BAD_JSON, WARN_MISSING, parse_products
from storelens.operators.dom import SECTION_ATTRS, SECTION_TAGS, with_dom
from storelens.operators.lookup import POLICY_PATHS, first_hit, section_of
from storelens.schemas import REPORT_FIELDS
from storelens.session import narrow_join, stored
from storelens.sources.pages import keyed

NO_HOME = "Failed to fetch the main page"
PARSE_PREFIX = "Error parsing "


def parsed(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """Pages with the nodes the section rules read."""
    return with_dom(
        pages, keep_html=keep_html, tags=SECTION_TAGS, classes=S.SECTION_CLASSES, attrs=SECTION_ATTRS
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """Every section a page serves, from one parse and one projection; pages that serve none are left out.

    ``pages`` carries ``is_home`` and the ``section`` and ``rank`` of a candidate page. URLs stay as written.
    """
    n, t = "nodes", "visible_text"
    home = {
        "store_name": S.store_name(n, t),
        "heroes": S.hero_products(n, t),
        "contact": S.contact_info(t),
        "contact_href": S.contact_href(n),
        "social": social_handles(t, "html"),
        "about_home": S.about_home_text(n, t),
        "links": S.important_links(n, t),
    }
    fields = ", ".join(f"{lit(name)}, {text}" for name, text in home.items())
    dom = parsed(pages.where("html is not null"), keep_html=True)
    return dom.selectExpr(
        *[c for c in pages.columns if c != "html"],
        "parse_error",
        f"if(is_home and parse_error is null, named_struct({fields}), null) as home",
        f"if(section in ({lits(POLICY_PATHS)}), {S.policy(n, t)}, null) as policy",
        f"if(section = 'faq', {S.faqs(n, t)}, null) as faqs",
        f"if(section = 'about', {S.about_text(n, t)}, null) as about",
    ).where("home is not null or policy is not null or faqs is not null or about is not null or parse_error is not null")


def host_sections(sections: DataFrame) -> DataFrame:
    """One row per host: the first hit of every section among its candidate pages."""
    found = sections.where("policy is not null or faqs is not null or about is not null")
    hits = first_hit(found, ["host", "section"], ["rank", "page_id"], ["path", "policy", "faqs", "about"])
    full = (
        f"named_struct('title', coalesce(policy.title, {title_from_key('section')}), 'content', policy.content, "
        "'url', path, 'last_updated', cast(null as timestamp), 'type', section)"
    )

    def of(section: str, value: str) -> Column:
        return F.expr(f"any_value(case when section = {lit(section)} then {value} end, true)")

    found = hits.groupBy("host").agg(
        *[of(name, full).alias(name) for name in POLICY_PATHS],
        of("faq", "faqs").alias("faqs"),
        of("about", "about").alias("about"),
    )
    # A host has one page per path and a few candidate paths, so its errors are few.
    broken = sections.where("parse_error is not null").groupBy("host").agg(
        F.array_sort(F.collect_set(F.concat(F.lit(PARSE_PREFIX), "path", F.lit(": "), "parse_error"))).alias("parse_errors")
    )
    return found.join(broken, "host", "full")


def _report_columns(as_of: dt.datetime) -> dict[str, str]:
    """Report fields from joined sections; a store whose home page was not found keeps only defaults."""

    def resolved_policy(name: str) -> str:
        fields = f"p.title, p.content, {absolute_url('store_url', 'p.url')}, p.last_updated, p.type"
        return f"if(_found and {name} is not null, {let('p', name, f'struct({fields})')}, null)"

    def listed(value: str) -> str:
        return f"if(_found, coalesce({value}, array()), array())"

    contact = ", ".join(
        f"if(_found, coalesce(contact.{f}, {NO_TEXT}), {NO_TEXT})" for f in ("emails", "phone_numbers", "addresses")
    )
    contact_url = f"if(_found and contact_href is not null, {absolute_url('store_url', 'contact_href')}, null)"
    about = "if(_found, coalesce(nullif(about, ''), about_home, about), null)"
    name = "if(_found, store_name, null)"
    errors = (
        f"concat(case when not _found then array({lit(NO_HOME)}) "
        f"when catalog_status = 'error' then array({lit(ERROR_PREFIX + 'products is not a list')}) else array() end, "
        f"coalesce(parse_errors, {NO_TEXT}))"
    )
    warnings = (
        f"case when _found and coalesce(catalog_status, 'missing') = 'missing' then array({lit(WARN_MISSING)}) "
        f"when _found and catalog_status = 'bad_json' then array({lit(WARN_BAD_JSON)}) else array() end"
    )
    return {
        "store_url": "store_url",
        "store_name": name,
        "is_shopify_store": platform_hint("store_url"),
        "product_catalog": (
            "struct(if(_found, coalesce(total_products, 0), 0), if(_found, coalesce(products, array()), array()), "
            "_found and coalesce(has_more, false), null)"
        ),
        "hero_products": listed(S.resolve_heroes("heroes", "store_url")),
        **{p: resolved_policy(p) for p in POLICY_PATHS},
        "other_policies": "array()",
        "faqs": listed("transform(faqs, q -> struct(q.question, q.answer, null, null))"),
        "contact_info": f"struct({contact}, {contact_url}, null)",
        "social_handles": f"if(_found, coalesce(social, {NO_HANDLES}), {NO_HANDLES})",
        "brand_context": f"struct({name}, {about}, null, null, {NO_TEXT}, null, null)",
        "important_links": listed(
            f"transform({S.resolve_links('links', 'store_url')}, l -> struct(l.title, l.url, null, l.category))"
        ),
        "competitors": "array()",
        "scraped_at": repr(as_of.timestamp()) + "D",
        "processing_time": "null",
        "success": "_found",
        "errors": errors,
        "warnings": warnings,
    }


def _needed_pages(pages: DataFrame, wanted: DataFrame, home: str) -> DataFrame:
    """Pages that are the home page of a requested store or one of its candidate pages, flagged as such.

    Which pages are needed, and in which role, is decided on id and URL alone: newest good copy of its URL, on a
    requested host, home or candidate path. That table of keys is stored and meets the HTML in one join; Spark
    broadcasts it by its size in bytes, or prunes the HTML with a Bloom filter before it shuffles.
    """
    good = pages.where("html is not null").select("page_id", "url")
    table = keyed(good).withColumn("page_key", F.expr(page_key("url")))
    table = table.join(wanted.select("host").distinct(), "host", "left_semi")
    newest = table.groupBy("page_key").agg(F.max("page_id").alias("page_id"))
    table = table.join(newest, ["page_key", "page_id"], "left_semi")
    if home == "first":
        homes = table.groupBy("host").agg(F.min("page_id").alias("_home"))
        table, is_home = table.join(homes, "host"), "page_id = _home"
    else:
        deep = wanted.where(f"{url_path('store_url')} <> ''").selectExpr("page_key", "true as _named").distinct()
        table, is_home = table.join(deep, "page_key", "left"), "path = '' or _named is not null"
    role = section_of("path")
    needed = table.selectExpr(
        "page_id", "url", "host", "path", "page_key", f"{is_home} as is_home", f"{role}.section as section", f"{role}.rank as rank"
    ).where("is_home or section is not null")
    html = pages.where("html is not null").select("page_id", "url", "html")
    return narrow_join(html, needed, ["page_id", "url"], "inner").drop("url")


def _one_payload(catalogs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One catalogue per requested host, as ``(host, payload)``: ``/products.json`` belongs to the host.

    Of several payloads that of the smallest store URL counts, then that of least hash. Payloads nobody asked for
    are left out before they are parsed.
    """
    keyed_rows = catalogs.withColumns({"host": F.expr(extract_domain("store_url")), "_hash": F.xxhash64("payload")})
    asked = keyed_rows.join(wanted.select("host").distinct(), "host", "left_semi")
    first = asked.groupBy("host").agg(F.min(F.struct("store_url", "_hash")).alias("_first"))
    first = first.select("host", "_first.store_url", "_first._hash")
    return asked.join(first, ["host", "store_url", "_hash"], "left_semi").select("host", "payload")


def store_reports(
    pages: DataFrame,
    requests: DataFrame,
    catalogs: DataFrame | None = None,
    home: str = "exact",
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Report rows for valid requests ``(store_url, include_competitors)``.

    Of several copies of a URL in ``pages`` the newest good one counts; ``catalogs`` is ``(store_url, payload)`` and
    belongs to the host. There is one report per store, however often it was requested. ``home`` is
    ``exact`` (page with the requested key) or ``first`` (lowest page id of the host). The section rows are stored
    before assembly, so that pages are read and parsed once.
    """
    as_of = as_of or dt.datetime.now(dt.timezone.utc)
    wanted = requests.selectExpr(
        "store_url", "include_competitors", f"{extract_domain('store_url')} as host", f"{page_key('store_url')} as page_key"
    )
    # One report per store, with competitors if any of its requests asked for them.
    wanted = wanted.groupBy("store_url", "host", "page_key").agg(F.bool_or("include_competitors").alias("include_competitors"))
    wanted = stored(wanted, "wanted")
    sections = stored(page_sections(_needed_pages(pages, wanted, home)), "sections")
    on = "host" if home == "first" else "page_key"
    per_home = sections.where("is_home and home is not null").selectExpr(on, "home.*", "true as _found")
    joined = wanted.join(per_home, on, "left").join(host_sections(sections), "host", "left")
    catalog_columns = ("catalog_status", "total_products", "products", "has_more")
    if catalogs is None:
        joined = joined.selectExpr("*", *[f"null as {c}" for c in catalog_columns])
    else:
        products = parse_products(_one_payload(catalogs, wanted)).select("host", *catalog_columns).dropDuplicates(["host"])
        joined = joined.join(products, "host", "left")
    joined = joined.withColumn("_found", F.expr("coalesce(_found, false)"))
    return joined.selectExpr(
        "include_competitors",
        *[f"cast({text} as {REPORT_FIELDS[name]}) as {name}" for name, text in _report_columns(as_of).items()],
    )


def report_summary(reports: DataFrame) -> DataFrame:
    """Counts per section of each report."""
    return reports.selectExpr(
        "store_url",
        "size(contact_info.emails) as emails",
        "size(contact_info.phone_numbers) as phone_numbers",
        "size(contact_info.addresses) as addresses",
        "aggregate(map_values(social_handles), 0, (total, names) -> total + size(names)) as social_handles",
        "cast(product_catalog.total_products as int) as products",
        "size(hero_products) as hero_products",
        "size(faqs) as faqs",
        "size(important_links) as important_links",
    )
