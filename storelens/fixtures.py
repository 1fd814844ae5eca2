"""Store inputs derived row by row from the general tables.

The supplied pages hold no catalogues, product cards, questions or social links. These functions write such
markup from the rows of another table: one row gives one page or payload, nothing is grouped, so the inputs
grow with their table and no key can make a task large. The matching SQL reads the same table directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from storelens.functions.sql import lit
from storelens.operators.lookup import ABOUT_PATHS, FAQ_PATHS, POLICY_PATHS

# Paths of the document stores, by position: root, every policy path, every FAQ path, every about path.
DOC_PATHS = ("", *(p for paths in POLICY_PATHS.values() for p in paths), *FAQ_PATHS, *ABOUT_PATHS)
DOC_STORE_SIZE = 25  # documents per store; positions past DOC_PATHS become blog pages


def _cat(*parts: str) -> str:
    """Concatenation of SQL expressions; a part that starts with ``=`` is literal text."""
    return f"concat({', '.join(lit(p[1:]) if p[:1] == '=' else p for p in parts)})"


def _str(expression: str) -> str:
    return f"cast({expression} as string)"


def escape(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = f"replace({text}, {lit(raw)}, {lit(entity)})"
    return text


def _pick(choices, position: str) -> str:
    return f"get(array({', '.join(map(lit, choices))}), cast({position} as int))"


def records(events: DataFrame) -> DataFrame:
    """Extraction records: the store is the user, ``error`` events are failures, ``view`` events have no time."""
    url, name = "concat('https://store-', user_id, '.example.com')", "concat('Store ', user_id)"
    at = "cast(ts as timestamp)"
    doc = (
        f"to_json(named_struct('store_url', {url}, 'store_name', {name}, "
        f"'scraped_at', unix_micros({at}) / 1000000, 'success', event_type <> 'error'))"
    )
    return events.selectExpr(
        "event_id as id",
        f"{url} as store_url",
        f"{name} as store_name",
        f"{doc} as insights_data",
        f"{at} as scraped_at",
        "if(event_type <> 'view', value, null) as processing_time",
        "event_type <> 'error' as success",
        "if(event_type = 'error', '[\"Failed to fetch the main page\"]', null) as error_message",
    )


def catalogs(part: DataFrame) -> DataFrame:
    """One catalogue payload per part with up to 260 products; kinds 0-5 of 20 are malformed on purpose."""
    kind, ident = "((p_partkey + i) % 20)", "cast(p_partkey * 1000 + i as string)"
    amount = "(cast(round(p_retailprice * 100) as bigint) + i * 100)"
    text = f"concat(cast(floor({amount} / 100) as string), '.', lpad(cast({amount} % 100 as string), 2, '0'))"
    price = f"case {kind} when 7 then {_cat('=\"price\":', text, '=,')} when 8 then '' else {_cat('=\"price\":\"', text, '=\",')} end"
    compare = f"case when {kind} = 5 then '0' when i % 3 = 0 then {_cat('=\"', text, '=\"')} else 'null' end"
    variants = _cat(
        '=[{"id":1,', price, '="compare_at_price":', compare, '=,"available":', "if((p_partkey + i) % 2 = 0, 'true', 'false')",
        '=},{"id":2,"price":"1.00","available":', "if(i % 5 = 0, 'true', 'false')", "=}]",
    )
    image = _cat('={"src":"https://img.example.com/', "p_partkey", "=/", "j", '=.jpg"}')
    images = f"array_join(transform(sequence(0, i % 4), j -> if(j = 0, {lit('{"src":""}')}, {image})), ',')"
    created = "concat(date_format(date_add(date'2024-01-01', p_size), 'yyyy-MM-dd'), 'T10:00:00Z')"
    product = _cat(
        '={"id":', f"case {kind} when 1 then '\"abc\"' when 10 then {_cat('=\"', ident, '=\"')} else {ident} end",
        '=,"title":', f"if({kind} = 3, '5', {_cat('=\"', 'p_name', '=  ', 'i', '= &amp; co\"')})",
        '=,"handle":"h-', "i", '=","body_html":"<p>', "p_type", '=\\n item</p>","vendor":"', "p_brand",
        '=","product_type":"', "p_type", '=","tags":', f"if({kind} = 0, 'null', {_cat('=[\"', 'p_brand', '=\",\"', 'p_type', '=\"]')})",
        '=,"variants":', f"case {kind} when 4 then 'null' when 6 then '[]' else {variants} end",
        '=,"images":[', images, '=],"created_at":"', f"if({kind} = 2, 'soon', {created})", '=","updated_at":null}',
    )
    count = "case p_size when 50 then 260 when 49 then 0 else p_size % 7 + 1 end"
    products = f"array_join(transform(slice(sequence(0, 259), 1, {count}), i -> {product}), ',')"
    payload = (
        f"case p_size when 48 then {lit('{"products": [')} when 47 then null when 46 then '[]' "
        f"else {_cat('={"products":[', products, '=]}')} end"
    )
    return part.selectExpr("concat('https://p', p_partkey, '.example.com') as store_url", f"{payload} as payload")


# Markup around and class of the cards, by position of the selector they are meant for.
_CARDS = (
    ("", "featured-product", ""),
    ("", "hero-product", ""),
    ("", "product-hero", ""),
    ('<section class="featured-collection">', "product-item", "</section>"),
    ('<section class="collection-hero">', "product", "</section>"),
    ("", "homepage-product", ""),
    ("", "product-card", ""),
    ("", "grid-product", ""),
)


def hero_pages(part: DataFrame) -> DataFrame:
    """One home page per part with 0-8 cards, equal in pairs; two grid cards stand behind them."""

    def at(position: int) -> str:
        return _pick([c[position] for c in _CARDS], "p_partkey % 8")

    k = "cast(floor(i / 2) as string)"
    even = "(floor(i / 2) % 2 = 0)"
    card = _cat(
        '=<div class="card ', at(1), '=">',
        f"if({even}, {_cat('=<h3 class=\"product-title\">', 'p_name', '= ', k, '=</h3>')}, '')",
        '=<a href="/products/', "p_partkey", "=-", k, '=">', "p_name", "= ", k, "= link</a><img ", f"if({even}, 'src', 'data-src')",
        '==\"//img.example.com/', "p_partkey", '=.jpg"><p>', "p_type", "= &amp; more",
        f"if(floor(i / 2) = 3, '', {_cat('=<span class=\"money\"> $', 'p_size', '=\n</span>')})", "=</div>",
    )
    cards = f"array_join(transform(slice(sequence(0, 7), 1, p_size % 9), i -> {card}), '\n')"
    grid = lit('<div class="grid-product"><h2>Grid</h2></div><div class="grid-product"></div>')
    html = _cat(
        "=<html><head><title>Shop ", "p_partkey", "=</title></head><body>", at(0), cards, at(2),
        f"if(p_size % 9 > 0 and p_partkey % 8 = 7, '', {grid})", "=</body></html>",
    )
    return part.selectExpr(
        "p_partkey as page_id", "concat('https://p', p_partkey, '.example.com/') as url", f"{html} as html"
    )


def faq_pages(conversations: DataFrame) -> DataFrame:
    """One FAQ page per turn: sentences in pairs of question and answer, in one of three markups."""
    items = _cat('=<div class="faq-item"><h3 class="faq-question">', "p.q", '=</h3><div class="answer">', "p.a", "=</div></div>")
    terms = _cat("=<dt>", "p.q", "=</dt><dt>again</dt><dd>", "p.a", "=</dd>")
    heads = _cat("=<h4>", "p.q", "=?</h4><span>-</span><p>", "p.a", "=</p><h5>", "p.q", "=</h5>")
    block = f"case (conv_id + turn) % 3 when 0 then {items} when 1 then {terms} else {heads} end"
    pair = f"named_struct('q', {escape('get(parts, 2 * k)')}, 'a', {escape('get(parts, 2 * k + 1)')})"
    pairs = f"filter(transform(sequence(0, cast(size(parts) / 2 as int)), k -> {pair}), p -> p.a is not null)"
    return conversations.selectExpr("*", f"split(text, {lit('[.] ')}) as parts").selectExpr(
        "conv_id * 1000 + turn as page_id",
        "concat('https://c', conv_id, '.example.com/pages/faq?turn=', turn) as url",
        f"concat('<html><body><dl>', array_join(transform({pairs}, p -> {block}), ''), '</dl></body></html>') as html",
    )


def contact_pages(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """One home page per supplier with mail, phones, address, social links, banners and navigation."""
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).selectExpr(
        "*",
        "lpad(cast(s_suppkey % 100000 as string), 5, '0') as zip",
        "lpad(cast(s_suppkey % 10000 as string), 4, '0') as line",
        "replace(lower(s_name), '#', '_') as handle",
        "concat('s', s_suppkey, '.example.com') as host",
    )
    banner = "if(s_suppkey % 2 = 0, repeat('short ', 3), repeat(concat(n_name, ' brand story. '), 12))"
    html = _cat(
        "=<html><head><title> ", "if(s_suppkey % 5 = 0, '', concat(s_name, ' - Home'))", "=</title>",
        '=<script>var x = "hidden@example.com";</script></head><body>',
        '=<div class="logo"><img alt="', "if(s_suppkey % 3 = 0, '', s_name)", '="></div>',
        '=<nav><a href="/track-order">Track your order</a><a href="/contact">Reach us</a><a href="contact">Reach us too</a>',
        '=<a href="/news">Our &amp; News</a><a href="/x"></a><a>contact</a><a href="/plain">Plain</a></nav>',
        '=<div class="banner">', banner, '=</div><div class="intro">', "repeat(concat('Intro of ', s_name, '. '), 8)", "=</div>",
        "=<p>Mail: info@", "host", "=; Sales@", "host", "=; info@", "host", "=.</p>",
        "=<p>Call: (555) 123-", "line", "= or +44-20-555-", "line", "=.</p>",
        "=<p>Visit: ", "s_suppkey % 900 + 1", "= Main Street, ", "n_name", "=, CA ", "zip", "=.</p>",
        '=<footer class="menu"><a href="https://www.instagram.com/', "handle", '=">Photos</a>',
        '=<a href="https://facebook.com/', "handle", '=?ref=1">Friends</a><a href="http://youtube.com/channel/', "handle", '=-tv">Videos</a>',
        '=<a href="https://x.com/', "handle", '=/">Posts</a><a href="/size-guide#top">Size guide</a>',
        '=<a href="https://linkedin.com/company/', "handle", '=-inc">Jobs</a></footer>',
        "=<p>Follow @", "handle", "= on Instagram</p></body></html>",
    )
    return joined.selectExpr("s_suppkey as page_id", "concat('https://', host) as url", f"{html} as html")


def document_pages(documents: DataFrame) -> DataFrame:
    """One page per document; runs of 25 documents share a store and take its known paths in turn.

    Of three pages in turn, one has an empty first content block, one has content and one has no block at all.
    """
    path = f"coalesce({_pick(DOC_PATHS, f'doc_id % {DOC_STORE_SIZE}')}, concat('/blog/', doc_id))"
    body = escape("text")
    content = (
        f"case doc_id % 3 when 0 then {_cat('=<div class=\"page-content\"> </div><div class=\"content\">', body, '=</div>')} "
        f"when 1 then {_cat('=<main><p class=\"page\">', body, '=</p></main>')} "
        f"else {_cat('=<div class=\"other\">', body, '=</div>')} end"
    )
    heading = "if(doc_id % 4 = 0, '', concat('<h1>Doc ', doc_id, '</h1>'))"
    return documents.selectExpr(
        "doc_id as page_id",
        f"concat('http://D', floor(doc_id / {DOC_STORE_SIZE}), '.Example.com', {path}, if(doc_id % 2 = 0, '/?v=1', '')) as url",
        f"concat('<html><head><title>', source, '</title></head><body>', {heading}, {content}, '</body></html>') as html",
    )


def document_requests(documents: DataFrame) -> DataFrame:
    """One request per document store."""
    return documents.selectExpr(
        f"concat('d', floor(doc_id / {DOC_STORE_SIZE}), '.example.com') as website_url", "false as include_competitors"
    ).distinct()
