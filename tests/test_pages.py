"""Nodes, selectors and sections on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from storelens.functions import select as Q
from storelens.functions.sql import let
from storelens.operators import sections as S
from storelens.operators.dom import to_nodes, with_dom
from storelens.plans import report as R

HOME = (
    "<!doctype html><title>Blech &amp; Sohn | Kettles</title><nav class='menu'><a href='/help'>Help</a></nav>"
    "<section class='homepage-product'><a class='product-name' href='/k/1'>Kettle</a><p>Boils fast</p>"
    "<b class='money'>8,05 EUR</b><img data-src='k1.webp'></section>"
    "<address><a href='mailto:werk@blech.test'>Write</a> or <a href='tel:0301234567'>ring</a></address>"
)


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")


def value(spark, html, expression, **wanted):
    """Value of an expression over the nodes of one page."""
    return with_dom(pages(spark, html), **wanted).selectExpr(f"{expression} as v").first()[0]


def texts(spark, html, selector):
    nodes = Q.select("nodes", selector)
    return value(spark, html, f"transform({nodes}, x -> {Q.node_text('visible_text', 'x')})")


def test_nodes_nest_by_interval(spark):
    html = '<div id="1"><p>a<br>b<p class="x y">c</div></span><ul><li>d<li>e</ul>'
    rows = to_nodes(with_dom(pages(spark, html)), "page_id").orderBy("id").collect()
    assert [(r.tag, r.id, r.last) for r in rows] == [
        ("div", 0, 3), ("p", 1, 3), ("br", 2, 2), ("p", 3, 3), ("ul", 4, 6), ("li", 5, 6), ("li", 6, 6),
    ]
    assert rows[3].classes == ["x", "y"] and rows[0].attrs == {"id": "1"}


def test_visible_text(spark):
    html = (
        "<title>T&amp;x</title><style>s</style><script>var a='</p>';</script><td>a</td><td>b</td>\n  \n<!-- c --><i>d</i>   "
        "<template><b>t</b></template><ruby>r<rt>u</rt></ruby><pre>  </pre>&copy;&nbsp;é<![CDATA[q]]>"
    )
    assert value(spark, html, "visible_text", tags=[]).startswith("T&xab\nd r  ©\xa0é")


def test_bad_page_does_not_fail_the_job(spark, monkeypatch):
    from storelens.operators import dom

    plain = dom._Outline.handle_starttag

    def strict(self, tag, attrs):
        if tag == "bad":
            raise ValueError("no")
        plain(self, tag, attrs)

    monkeypatch.setattr(dom._Outline, "handle_starttag", strict)
    rows = with_dom(pages(spark, "<p class='k'>x</p>", "<b a='1'>y</b><bad>", None, "<i>z</i>")).orderBy("page_id").collect()
    assert [r.parse_error for r in rows] == [None, "ValueError: no", None, None]
    assert [r.visible_text for r in rows] == ["x", None, None, "z"]
    assert [n.tag for n in rows[3].nodes] == ["i"] and rows[0].nodes[0].classes == ["k"] and rows[1].nodes == []


def test_kept_nodes_only(spark):
    html = '<div><section><p class="k" href="1" id="2">a</p><span>b</span></section></div><p>c</p>'
    rows = value(spark, html, "nodes", tags=["div"], classes=["k"], attrs=["href"])
    assert [(n.tag, n.id, n.last, n.attrs) for n in rows] == [("div", 0, 1, {}), ("p", 1, 1, {"href": "1"})]


def test_selectors(spark):
    html = (
        '<nav><a href="/1">one</a><div class="menu"><a href="/contact">two</a></div></nav><p class="logo a">p</p>'
        '<div class="logo"><img alt="x"><img></div><a href="/Contact">three</a>'
    )
    assert texts(spark, html, Q.tag("a")) == ["one", "two", "three"]
    assert texts(spark, html, S.NAV_LINKS) == ["one", "two"]
    assert texts(spark, html, Q.tag_cls("p", "logo")) == ["p"]
    assert texts(spark, html, Q.cls("a", "menu")) == ["two", "p"]
    assert texts(spark, html, S.CONTACT_LINK) == ["two"]
    assert value(spark, html, f"size({Q.select('nodes', Q.Inside(Q.cls('logo'), Q.tag('img')))})") == 2


def test_select_priority_follows_the_list(spark):
    html = "<p>later in list</p><h2>first in list</h2>"
    first = Q.select_priority("nodes", [Q.tag("h1"), Q.tag("h2"), Q.tag("p")])
    assert value(spark, html, f"{first}.tag") == "h2"
    assert value(spark, html, Q.select_first("nodes", Q.any_of(Q.tag("h2"), Q.tag("p"))) + ".tag") == "p"


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "nav", "p", "dt", "dd", "a", "br", "section"])
        klass = rng.choice(["", ' class="menu"', ' class="x menu"'])
        body = random_page(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice("abc")
        out.append(f"<{tag}{klass}>{body}" + ("" if rng.random() < 0.2 else f"</{tag}>"))
    return "".join(out)


def test_node_table_agrees_with_arrays(spark):
    rng = random.Random(3)
    table = with_dom(pages(spark, *[random_page(rng) for _ in range(60)])).cache()
    nodes = to_nodes(table, "page_id")
    inside = Q.Inside(Q.cls("menu"), Q.tag("a", "dd"))
    left = table.selectExpr("page_id", f"explode(transform({Q.select('nodes', inside)}, x -> x.id)) as id")
    right = Q.select_nodes(nodes, inside).select("page_id", "id")
    brute = nodes.alias("x").join(
        nodes.alias("a"), F.expr("x.page_id = a.page_id and x.id > a.id and x.id <= a.last and array_contains(a.classes, 'menu') and x.tag in ('a', 'dd')")
    ).selectExpr("x.page_id", "x.id").distinct()
    want = {tuple(r) for r in brute.collect()}
    assert {tuple(r) for r in left.collect()} == want == {tuple(r) for r in right.collect()} and want
    pair = let("dds", Q.select("nodes", Q.tag("dd")), f"transform({Q.select('nodes', Q.tag('dt'))}, q -> struct(q.id as a, {Q.next_sibling('dds', 'q')}.id as b))")
    local = {tuple(r) for r in table.selectExpr("page_id", f"inline({pair})").where("b is not null").collect()}
    joined = Q.next_sibling_nodes(nodes, Q.tag("dt"), Q.tag("dd")).select("page_id", "id", "sibling.id")
    assert local == {tuple(r) for r in joined.collect()} and local


def section(spark, html, extract):
    return value(spark, html, extract("nodes", "visible_text"))


@pytest.mark.parametrize(
    "html, name",
    [
        (HOME, "Blech & Sohn | Kettles"),
        ("<title> A \n B </title>", "A B"),
        ("<title></title><div class='logo'><img alt='Logo'></div>", "Logo"),
        ("<title></title><div class='logo'><img></div><b class='site-title'>S</b>", "S"),
        ("<title></title>", ""),
        ("<title>A - B</title>", "A - B"),
        ("<title> </title><h1 class='site-title'>S</h1>", ""),
        ("<p>none</p>", None),
    ],
)
def test_store_name(spark, html, name):
    assert section(spark, html, S.store_name) == name


def heroes(spark, html, base="https://a.com"):
    expression = S.resolve_heroes(S.hero_products("nodes", "visible_text"), f"'{base}'")
    return [tuple(h) for h in value(spark, html, expression) or []]


def test_hero_products(spark):
    assert heroes(spark, HOME) == [("Kettle", "Boils fast", "https://a.com/k1.webp", "https://a.com/k/1", "8,05 EUR", "homepage")]
    cards = "".join(f"<div class='product-card'><h2>P{i // 2}</h2><a href='p{i // 2}'></a></div>" for i in range(9))
    found = heroes(spark, "<div class='grid-product'>g</div>" + cards)
    assert [h[0] for h in found] == ["P0", "P1", "P2"] and found[1][3] == "https://a.com/p1"
    assert heroes(spark, "<div class='featured-product'><img src='' data-src='//c.d/x.png'></div>") == [
        ("Unknown Product", None, "https://c.d/x.png", None, None, "homepage")
    ]
    assert heroes(spark, "<p>x</p>") == []


def test_faq_methods(spark):
    items = (
        "<div class='faq-item'><h3 class='faq-question'>Q1?</h3><div class='faq-answer'>A1</div></div>"
        "<div class='faq-item'><h4 class='question'>Q2?</h4><p class='answer'>A2</p></div><div class='faq-item'><h3>no answer</h3></div>"
    )
    terms = "<dl><dt>T1</dt><dt>T2</dt><dd>D</dd><dt>T3</dt></dl>"
    heads = "<h3>Why?</h3><span>x</span><p>Because</p></p><h4>Not a question</h4><p>y</p><h5>Last?</h5>"
    faq = lambda html: [tuple(f) for f in section(spark, html, S.faqs) or []]
    assert faq(items + terms) == [("Q1?", "A1"), ("Q2?", "A2")]
    assert faq(terms + heads) == [("T1", "D"), ("T2", "D")]
    assert faq(heads) == [("Why?", "Because")]
    assert faq("<h3>Why?</h3>") == []


def test_policy_and_about(spark):
    policy = lambda html: section(spark, html, S.policy)
    assert tuple(policy("<h1>Title</h1><main>Body</main>")) == ("Title", "Body")
    assert tuple(policy("<div class='content'>B</div><div class='policy-content'>A</div>")) == (None, "A")
    assert policy("<div class='page-content'> </div><main>Body</main>") is None
    assert policy("<h1>Title</h1>") is None
    about = lambda html: section(spark, html, S.about_text)
    assert about("<main>A</main><div class='page-content'>B</div>") == "A"
    assert about("<main> </main>") == "" and about("<p>x</p>") is None
    home = f"<div class='hero'>short</div><div class='intro'>{'long ' * 30}</div>"
    assert section(spark, home, S.about_home_text) == ("long " * 30).strip()
    assert section(spark, f"<div class='hero'>{'x' * 100}</div>", S.about_home_text) is None


def test_contact_uses_visible_text_only(spark):
    info = value(spark, HOME, S.contact_info("visible_text"))
    assert info.emails == [] and info.phone_numbers == []
    found = value(spark, "<p>a@b.co, (555) 123-4567</p>", S.contact_info("visible_text"))
    assert found.emails == ["a@b.co"] and found.phone_numbers == ["(555) 123-4567", "5551234567"]


def test_important_links(spark):
    html = (
        "<nav><a href='/track'>Track</a><a href='track'>Again</a><a href='/help'>Help</a><a href='/x'>plain</a>"
        "<a href='/blog'> </a><a>contact</a><a href='/track'>Order</a></nav><a href='/contact'>outside</a>"
    )
    links = value(spark, html, S.resolve_links(S.important_links("nodes", "visible_text"), "'https://a.com'"))
    assert [tuple(x) for x in links] == [
        ("Track", "https://a.com/track", "order tracking"),
        ("Help", "https://a.com/help", "contact"),
    ]
    many = "".join(f"<a href='/help{i % 4000}'>Help {i}</a>" for i in range(8000))
    kept = value(spark, f"<nav>{many}</nav>", S.resolve_links(S.important_links("nodes", "visible_text"), "'https://a.com'"))
    assert [x.title for x in kept] == [f"Help {i}" for i in range(4000)]
    only = value(spark, html, S.important_links("nodes", "visible_text", {"none": ("plain",)}))
    assert [x.title for x in only] == ["plain"]


def test_section_classes_are_complete(spark):
    """The nodes kept for sections give the same sections as all nodes."""
    rng = random.Random(5)
    body = []
    for i, klass in enumerate(S.SECTION_CLASSES * 3):
        tag = rng.choice(["div", "section", "p", "span", "h3"])
        body.append(f"<{tag} class='{klass}'>t{i}<img src='i{i}'><a href='/help{i}'>l{i}</a>" + ("</%s>" % tag if rng.random() < 0.6 else ""))
    table = pages(spark, "<title></title>" + "".join(body), HOME)
    every = [S.store_name, S.hero_products, S.policy, S.faqs, S.about_text, S.about_home_text, S.important_links]
    columns = [f"{e('nodes', 'visible_text')} as {e.__name__}" for e in every]
    full = with_dom(table).selectExpr("page_id", *columns).orderBy("page_id").collect()
    kept = R.parsed(table).selectExpr("page_id", *columns).orderBy("page_id").collect()
    assert full == kept and full[0].important_links and full[0].hero_products and full[0].faqs


def test_next_sibling_by_search_equals_scan(spark):
    """The binary search over nodes sorted by parent finds what the scan of all candidates finds."""
    rng = random.Random(4)
    html = "".join(f"<dl>{''.join(rng.choice(['<dt>t</dt>', '<dd>d</dd>', '<dl><dt>x</dt><dd>y</dd></dl>']) for _ in range(rng.randint(0, 12)))}</dl>" for _ in range(40))
    table = with_dom(pages(spark, html, "<dt>a</dt><dd>b</dd>", "<p>none</p>"))
    asked = Q.select("nodes", Q.tag("dt"))
    scan = let("dds", Q.select("nodes", Q.tag("dd")), f"transform({asked}, q -> {Q.next_sibling('dds', 'q')}.id)")
    search = let("dds", Q.by_parent(Q.select("nodes", Q.tag("dd"))), f"transform({asked}, q -> {Q.next_sibling_sorted('dds', 'q')}.id)")
    rows = table.selectExpr(f"{scan} as a", f"{search} as b").collect()
    assert all(r.a == r.b for r in rows) and any(x is not None for r in rows for x in r.a)


def test_many_questions_are_not_quadratic(spark):
    """50,000 definition pairs on one page: the pairs cost about twice 25,000 of them."""
    import time

    def took(n):
        table = with_dom(pages(spark, "<dl>" + "<dt>q?</dt><dd>a</dd>" * n + "</dl>")).cache()
        table.count()
        start = time.time()
        assert table.selectExpr(f"size({S.faq_definitions('nodes', 'visible_text')})").first()[0] == n
        return time.time() - start

    took(1000)
    assert took(50_000) < 4 * took(25_000) + 2


def test_parse_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    from storelens.operators import dom

    page = "<main>" + "<p class='a b' href='/x'>some words</p><div>more</div>" * 400 + "</main>"
    peaks = []
    for n in (100, 800):
        batch = pa.array([f"{k}{page}" for k in range(n)])
        tracemalloc.start()
        rows = sum(len(dom.outlines(part, None, frozenset(), None)) for part in dom.page_slices(batch))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.2 * peaks[0]


def test_batches_are_parsed_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from storelens.operators import dom

    html = [None, "<p>a</p>" * 9, "", "<div>b</div>", None, "<i>" + "c" * 200 + "</i>", "<p>é</p>" * 3, None]
    slices = list(dom.page_slices(pa.array(html), 40))
    assert pa.concat_arrays(slices).to_pylist() == html and len(slices) > 3
    assert all(len(s) == 1 or sum(len((x or "").encode()) for x in s.to_pylist()) <= 40 for s in slices)
    assert not list(dom.page_slices(pa.array([], pa.string())))
    table = pages(spark, *html).coalesce(1)
    whole = with_dom(table).orderBy("page_id").collect()
    monkeypatch.setattr(dom, "PARSE_BYTES", 40)
    assert with_dom(table).orderBy("page_id").collect() == whole
    assert [r.visible_text for r in whole][:4] == [None, "a" * 9, "", "b"]
