"""Catalogue payloads: typed products, dropped products, roll-ups."""

import datetime as dt
import json

import pytest

from storelens.operators.catalog import catalog_products, catalog_rollup, parse_products
from storelens.plans.competitors import attach_competitors, competitor_profiles, store_profiles

GOOD = {
    "updated_at": "2021-06-30T22:30:00-01:30",
    "created_at": "2021-07-01T00:00:00Z",
    "images": [{}, {"src": "//img.shop.test/kettle-front.png"}, {"src": ""}],
    "variants": [{"id": 41, "available": False, "price": "8.05"}, {"id": 42, "available": True, "price": "9"}],
    "tags": ["steel", "kitchen", "1 litre"],
    "product_type": "Kettles",
    "vendor": "Blech & Sohn",
    "handle": "kettle-1l",
    "title": "\tKettle,   one litre ",
    "body_html": "Boils <b>fast</b>.\n\nNo whistle",
    "id": 9007199254740993,
}
GONE = object()


def product(spark, **changes):
    """The parsed product with some fields changed or left out; None when it is dropped."""
    raw = {k: v for k, v in {**GOOD, **changes}.items() if v is not GONE}
    table = spark.createDataFrame([("s", json.dumps({"products": [raw]}))], "store_url string, payload string")
    return catalog_products(table).first()


def test_good_product(spark):
    p = product(spark)
    assert (p.pos, p.id, p.title, p.description) == (0, 9007199254740993, "Kettle, one litre", "Boils <b>fast</b>. No whistle")
    assert (p.price, p.compare_at_price, p.available) == ("8.05", None, True)
    assert p.tags == ["steel", "kitchen", "1 litre"] and p.images == ["//img.shop.test/kettle-front.png"]
    assert [json.loads(v)["id"] for v in p.variants] == [41, 42]
    assert p.created_at == p.updated_at == dt.datetime(2021, 7, 1)


DROPPED = [
    {"id": "abc"}, {"id": 1.5}, {"title": 5}, {"title": ["x"]}, {"body_html": True}, {"handle": 1}, {"vendor": {}},
    {"product_type": 2.5}, {"tags": None}, {"tags": "a, b"}, {"tags": ["a", 1]}, {"tags": ["a", None]}, {"tags": [1]},
    {"variants": None}, {"variants": "x"}, {"variants": {}}, {"variants": [1]}, {"variants": [{"price": "1"}, None]},
    {"images": "x"}, {"images": [1]}, {"images": [{"src": 5}]}, {"images": {"a": 1}}, {"images": [None]},
    {"created_at": "soon"}, {"updated_at": True}, {"created_at": []},
    {"variants": [{"price": "1", "compare_at_price": 0}]}, {"variants": [{"price": "1", "compare_at_price": False}]},
]


def test_dropped_products(spark):
    raws = [{**GOOD, **c} for c in DROPPED] + [5, "x", None, [], GOOD]
    table = spark.createDataFrame([("s", json.dumps({"products": raws}))], "store_url string, payload string")
    rows = catalog_products(table).collect()
    assert [(r.pos, r.id) for r in rows] == [(0, GOOD["id"])]
    total = catalog_rollup(table).first()
    assert (total.catalog_status, total.total_products, total.has_more) == ("parsed", 1, False)


KEPT = [
    ({"id": "77"}, "id", 77), ({"id": 7.0}, "id", 7), ({"id": None}, "id", None), ({"id": True}, "id", 1),
    ({"title": None}, "title", ""), ({"title": GONE}, "title", ""), ({"title": 0}, "title", ""), ({"title": "0"}, "title", "0"),
    ({"title": "false"}, "title", "false"), ({"title": []}, "title", ""), ({"handle": None}, "handle", None),
    ({"tags": GONE}, "tags", []), ({"tags": []}, "tags", []), ({"images": None}, "images", []), ({"images": 0}, "images", []),
    ({"variants": GONE}, "price", None), ({"variants": []}, "available", False), ({"created_at": None}, "created_at", None),
    ({"created_at": "2024-03-01"}, "created_at", dt.datetime(2024, 3, 1)), ({"created_at": 86400}, "created_at", dt.datetime(1970, 1, 2)),
    ({"created_at": "86400000000"}, "created_at", dt.datetime(1972, 9, 27)),
    ({"variants": [{}]}, "price", ""), ({"variants": [{"price": None}]}, "price", None), ({"variants": [{"price": 30.0}]}, "price", "30.0"),
    ({"variants": [{"price": 30}]}, "price", "30"), ({"variants": [{"price": 12345678.9}]}, "price", "12345678.9"),
    ({"variants": [{"price": True}]}, "price", "True"), ({"variants": [{"compare_at_price": ""}]}, "compare_at_price", ""),
    ({"variants": [{"compare_at_price": 9.5}]}, "compare_at_price", "9.5"), ({"variants": [{}, {"available": "false"}]}, "available", True),
    ({"variants": [{"available": 0}, {"available": None}, {"available": ""}]}, "available", False),
]


def test_kept_products(spark):
    raws = [{k: v for k, v in {**GOOD, **c}.items() if v is not GONE} for c, _, _ in KEPT]
    table = spark.createDataFrame([("s", json.dumps({"products": raws}))], "store_url string, payload string")
    rows = catalog_products(table).orderBy("pos").collect()
    assert len(rows) == len(KEPT)
    wrong = [(c, r[f], want) for r, (c, f, want) in zip(rows, KEPT) if r[f] != want]
    assert not wrong


def test_large_and_exponent_prices(spark):
    payload = '{"products":[{"variants":[{"price":1e7}]},{"variants":[{"price":1.5e3}]},{"variants":[{"price":29.90}]}]}'
    table = spark.createDataFrame([("s", payload)], "store_url string, payload string")
    assert [r.price for r in catalog_products(table).orderBy("pos").collect()] == ["10000000.0", "1500.0", "29.9"]


@pytest.mark.parametrize(
    "payload, status",
    [(None, "missing"), ("{bad", "bad_json"), ("[]", "error"), ('{"products": 5}', "error"), ('{"products": null}', "error"), ("{}", "parsed"), ('{"products": []}', "parsed")],
)
def test_catalog_status(spark, payload, status):
    row = catalog_rollup(spark.createDataFrame([("s", payload)], "store_url string, payload string")).first()
    assert (row.catalog_status, row.total_products, row.has_more) == (status, 0, False)


def test_has_more_counts_raw_products(spark):
    payload = json.dumps({"products": [{"title": "x", "tags": None if i else []} for i in range(250)]})
    row = parse_products(spark.createDataFrame([("s", payload)], "store_url string, payload string")).first()
    assert row.total_products == 1 and row.has_more


def test_competitors(spark):
    payload = json.dumps({"products": [{"variants": [{"price": p}]} for p in ("9.50", "10", "n/a", None)] + [{}]})
    catalogs = spark.createDataFrame([("https://c.com", payload)], "store_url string, payload string")
    pairs = spark.createDataFrame(
        [("https://a.com", "https://c.com"), ("https://a.com", "https://x.com"), ("https://b.com", "https://c.com")],
        "store_url string, competitor_url string",
    )
    social = spark.createDataFrame([("https://c.com", {"twitter": ["c"]})], "store_url string, social_handles map<string,array<string>>")
    profiles = store_profiles(catalogs, social)
    row = competitor_profiles(pairs, profiles).where("store_url = 'https://b.com'").first()
    assert (row.estimated_products, row.price_range, row.social_presence) == (5, "9.50 - 10.00", {"twitter": ["c"]})
    from storelens.schemas import REPORT_FIELDS

    reports = spark.createDataFrame(
        [("https://a.com", "A", True, []), ("https://b.com", "B", False, []), ("https://c.com", None, True, [])],
        f"store_url string, store_name string, include_competitors boolean, competitors {REPORT_FIELDS['competitors']}",
    )
    wanted = spark.createDataFrame(
        [("https://a.com", ["https://x.com", "https://c.com"]), ("https://b.com", ["https://c.com"]), ("https://c.com", ["https://a.com"])],
        "store_url string, competitor_urls array<string>",
    )
    rows = {r.store_url: r.competitors for r in attach_competitors(reports, wanted, profiles).collect()}
    assert [c.website_url for c in rows["https://a.com"]] == ["https://x.com", "https://c.com"]
    assert rows["https://a.com"][1].social_presence == {"twitter": ["c"]} and rows["https://a.com"][0].estimated_products is None
    assert rows["https://b.com"] == [] and rows["https://c.com"] == []
