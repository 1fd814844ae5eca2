"""Text and URL expressions: hand-written results, and properties on adversarial strings."""

import random
from urllib.parse import urljoin

import pytest

from storelens.functions import text as T
from storelens.functions import urls as U

ODD = ["\xa0", "\x85", "\x1c", "\x0b", "\r", "\n", " ", "é", "ß", "Ü", "日", "²", "́", "ı", "ſ", "K", "_", "٣"]


def strings(seed: int, pieces: list[str], count: int = 3000, longest: int = 14) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def column(spark, rows, expression, names="s string"):
    """Values of an expression for every row, in order."""
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    table = spark.createDataFrame(data, f"i int, {names}").repartition(8)
    return [r[1] for r in sorted(table.selectExpr("i", f"{expression} as v").collect())]


def agree(rows, got, want):
    wrong = [(r, g, w) for r, g, w in zip(rows, got, want) if g != w]
    assert not wrong, (len(wrong), wrong[:3])


def sets_of(spark, rows, expression):
    """Results as they are, after a check that they are sorted and distinct."""
    got = column(spark, rows, expression)
    assert all(g == sorted(set(g)) for g in got)
    return got


EMAILS = [
    ("write to b@x.org or a@x.org, b@x.org", ["a@x.org", "b@x.org"]),
    ("A@X.ORG a@x.org", ["A@X.ORG", "a@x.org"]),
    ("first.last+tag%1@sub-1.host.co.uk.", ["first.last+tag%1@sub-1.host.co.uk"]),
    ("a@b.c a@b a@.com @b.com a@b.c1", []),
    ("éa@b.com", []),
    ("x@y.co|z", ["x@y.co|z"]),
    ("a@b.com@c.org", ["a@b.com"]),
    ("", []),
]


def test_emails(spark):
    assert sets_of(spark, [s for s, _ in EMAILS], T.emails("s")) == [want for _, want in EMAILS]


def test_emails_are_parts_of_the_text(spark):
    rows = strings(1, ["a", "Bc", "1", ".", "-", "%", "+", "@", "x@y.", "com", "|", " ", ",", *ODD])
    for text, found in zip(rows, sets_of(spark, rows, T.emails("s")), strict=True):
        assert all(m in text and m.count("@") == 1 and "." in m.split("@")[1] for m in found)


PHONES = [
    ("call 555-123-4567", ["5551234567"]),
    ("(555) 123-4567", ["(555) 123-4567", "5551234567"]),
    ("+1-234-567-8900", ["+1-234-567-8900", "2345678900"]),
    ("+44 20 7946 0958", ["+44 20 7946 0958"]),
    ("id:12345678901234", ["2345678901"]),
    ("id 12345678901234", ["1234567890"]),
    ("555 12 34567", []),
    ("555\xa0123\xa04567", ["5551234567"]),
    ("", []),
]


def test_phones(spark):
    assert sets_of(spark, [s for s, _ in PHONES], T.phones("s")) == [want for _, want in PHONES]


def test_phones_hold_digits(spark):
    rows = strings(2, ["1", "23", "456", "7890", "+", "(", ")", "(555)", "-", ".", " ", "a", *ODD], longest=12)
    got = sets_of(spark, rows, T.phones("s"))
    assert sum(map(bool, got)) > 20
    for text, found in zip(rows, got, strict=True):
        digits = "".join(c for c in text if c.isdecimal())
        assert all("".join(c for c in m if c.isdecimal()) in digits for m in found)


ADDRESSES = [
    ("12 Main Street, Springfield 12345", ["12 Main Street, Springfield 12345"]),
    ("at 7 Elm St 90210!", ["7 Elm St 90210"]),
    ("Springfield, IL 62704", ["Springfield, IL 62704"]),
    ("Nice town, ca 123456", ["Nice town, ca 12345"]),
    ("12 Main Street", []),
    ("Springfield IL 62704", []),
    ("", []),
]


def test_addresses(spark):
    assert sets_of(spark, [s for s, _ in ADDRESSES], T.addresses("s")) == [want for _, want in ADDRESSES]


def test_addresses_are_parts_of_the_text(spark):
    pieces = ["1", "12345", "678901", " ", "  ", ",", ", ", "Main", "St", "street", "dr ", "CA ", "ny", ".", "x"]
    pieces += ["7 Elm St ", "12  Main Road", ", CA 90210", " 12345"] * 3 + ODD
    rows = strings(3, pieces, 6000, 22)
    got = sets_of(spark, rows, T.addresses("s"))
    assert sum(map(bool, got)) > 200
    assert all(m in text and m[-5:].isdecimal() for text, found in zip(rows, got, strict=True) for m in found)


def test_addresses_stay_linear(spark):
    """Long runs without a match, which the plain patterns take minutes for."""
    rows = ["12 ab " * 20000 + "99999", "word " * 40000 + ", " + "1 2 " * 20000, "st 1 " * 20000]
    assert column(spark, rows, f"size({T.addresses('s')})") == [0, 0, 0]


HANDLES = [
    ("https://www.instagram.com/a.b and INSTAGRAM.com/c", {"instagram": ["a.b", "c"]}),
    ("@me on instagram", {"instagram": ["me"]}),
    ("@first @second on instagram", {"instagram": ["first"]}),
    ("@me\n instagram", {}),
    ("fb.com/two facebook.com/one", {"facebook": ["one", "two"]}),
    ("netflix.com/show", {"twitter": ["show"]}),
    ("x.com/b twitter.com/a", {"twitter": ["a", "b"]}),
    ("tiktok.com/@t tiktok.com/u", {"tiktok": ["t"]}),
    ("youtube.com/channel/c-1 youtube.com/watch?v=2", {"youtube": ["c-1", "watch"]}),
    ("linkedin.com/company/acme-1 linkedin.com/in/jo", {"linkedin": ["acme-1", "jo"]}),
    ("pinterest.com/p.q", {"pinterest": ["p.q"]}),
    ("nothing here", {}),
]


def test_social_handles(spark):
    assert column(spark, [s for s, _ in HANDLES], T.social_handles("s")) == [want for _, want in HANDLES]
    pairs = [("on @x", "instagram.com/y twitter")]
    assert column(spark, pairs, T.social_handles("t", "h"), "t string, h string") == [{"instagram": ["y", "x"], "twitter": ["x"]}]


CLEANED = [
    (" a \t\n b ", "a b"),
    ("\xa0a\x85b\x1c", "a b"),
    ("&amp;lt;", "<"),
    ("&nbsp;x", " x"),
    ("&lt;b&gt; &quot;q&quot; &#39;s&#39;", "<b> \"q\" 's'"),
    ("&AMP;", "&AMP;"),
    ("", ""),
]


def test_clean_text(spark):
    assert column(spark, [s for s, _ in CLEANED], T.clean_text("s")) == [want for _, want in CLEANED]
    assert column(spark, [(None,), ("",)], T.clean_text("s")) == ["", ""]
    rows = strings(5, ["a", " ", "\t", *ODD])
    once = column(spark, rows, T.clean_text("s"))
    assert column(spark, once, T.clean_text("s")) == once
    assert all(o.split() == s.split() for s, o in zip(rows, once, strict=True))


def test_link_category(spark):
    custom = {"wood": ["oak", "ash"], "metal": ["tin", "ash"]}
    cases = [("Oak doors", "/d", "wood"), ("x", "/TIN", "metal"), ("Ash", "/", "wood"), ("Glass", "/g", None)]
    got = column(spark, [c[:2] for c in cases], T.link_category("t", "h", custom), "t string, h string")
    assert got == [c[2] for c in cases]
    known = [("Help", "/x"), ("FAQ", "/x"), ("Border", "/x"), ("x", "/SIZE"), ("News", "/"), ("x", "/refund"), ("Delivery", "/"), ("x", "/y")]
    want = ["contact", "support", "order tracking", "size guide", "blog", "returns", "shipping", None]
    assert column(spark, known, T.link_category("t", "h"), "t string, h string") == want


def test_titles(spark):
    assert column(spark, ["return_refund_policy"], T.title_from_key("s")) == ["Return Refund Policy"]
    assert column(spark, ["Shop - Home - x", "Shop", ""], T.head_of_title("s")) == ["Shop", "Shop", ""]


def test_normalize_url(spark):
    cases = [
        ("a.com", "https://a.com"),
        (" http://a.com/ ", "http://a.com/"),
        ("HTTP://a.com", "https://HTTP://a.com"),
        ("\xa0https://a.com\x85", "https://a.com"),
        ("ftp://a.com", "https://ftp://a.com"),
        ("", ""),
    ]
    assert column(spark, [s for s, _ in cases], U.normalize_url("s")) == [want for _, want in cases]
    assert column(spark, [(None,)], U.normalize_url("s")) == [""]
    rows = strings(6, ["http://", "https://", "a.com", "/", " ", *ODD], 800, 4)
    once = column(spark, rows, U.normalize_url("s"))
    assert column(spark, once, U.normalize_url("s")) == once


def test_extract_domain(spark):
    cases = [
        ("https://A.com/x", "a.com"),
        ("http://u:p@H.org:80?q", "u:p@h.org:80"),
        ("//cdn.x/y", "cdn.x"),
        ("https://a b.com|c/#f", "a b.com|c"),
        ("a.com/x", ""),
        ("mailto:a@b.c", ""),
        ("", ""),
    ]
    assert column(spark, [s for s, _ in cases], U.extract_domain("s")) == [want for _, want in cases]


@pytest.mark.parametrize("base", ["https://a.com", "https://a.com/", "http://A.com:80/x/y?z=1#f", "https://a.com/x/"])
def test_absolute_url(spark, base):
    pieces = ["/", "//", "..", ".", "./", "../", "a", "b.html", "?", "q=1", "#", "f", "http:", "https:", "mailto:", "HTTPS://", "h.com", ";p", " "]
    refs = strings(len(base), pieces, 1500, 6)
    got = column(spark, [(base, r) for r in refs], U.absolute_url("b", "r"), "b string, r string")
    agree(refs, got, [urljoin(base, r) for r in refs])


def test_page_key(spark):
    rows = ["http://A.com/x/?q#f", "https://a.com/x", "https://a.com", "https://a.com/"]
    assert column(spark, rows, U.page_key("s")) == ["a.com/x", "a.com/x", "a.com", "a.com"]


def test_is_valid_url(spark):
    good = ["https://example.com", "http://a.b.co/x?y#z", "https://localhost:8000/", "http://10.1.1.1", "https://münchen.de"]
    bad = ["https://not-a-valid-url", "https://", "https://HTTP://x.com", "https://a b.com", "", "https://999.1.1.1", "ftp://a.com"]
    assert column(spark, good + bad, U.is_valid_url("s")) == [True] * len(good) + [False] * len(bad)


def test_platform_hint(spark):
    rows = ["https://x.MyShopify.com", "https://cdn.shopifycdn.com/x", "https://a.com/shopify-checkout", "https://a.com"]
    assert column(spark, rows, U.platform_hint("s")) == [True, True, True, False]
    assert column(spark, rows, U.platform_hint("s", ["a.com"])) == [False, False, True, True]
