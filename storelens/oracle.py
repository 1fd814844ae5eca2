"""SQL twins of the registered queries, for an engine that reads the same tables.

They compute the expected rows from the tables themselves, not from the markup or JSON the Spark side derives
and takes apart again.
"""

from __future__ import annotations

from storelens.operators.lookup import POLICY_PATHS

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STORE_SIZE = 25


def _clean(x: str) -> str:
    out = f"trim(regexp_replace({x}, '{_BLANK}+', ' ', 'g'))"
    for raw, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{raw}', '{plain}')"
    return out


def _decode(x: str) -> str:
    """Entities that occur in the pages."""
    for raw, plain in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{raw}', '{plain}')"
    return x


_TEXT = _decode(
    r"regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), "
    r"'<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')"
)
_TITLE = _decode("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_BARE = "regexp_replace(url, '^https?://', '')"
_FORMS = (
    f"[url, ' ' || chr(9) || {_BARE} || chr(10) || ' ', 'HTTP://' || {_BARE}, "
    "'https://user:pw@' || upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || ':8080/a b', "
    "replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', '-'), '']"
)
_VARIANTS = (
    f"select page_id, form, list_extract(forms, form + 1) as raw from (select page_id, {_FORMS} as forms from pages), "
    "(select unnest(range(6))::int as form)"
)
_NORMAL = (
    "case when raw = '' then '' when regexp_matches(trim(raw, ' ' || chr(9) || chr(10)), '^https?://') "
    "then trim(raw, ' ' || chr(9) || chr(10)) else 'https://' || trim(raw, ' ' || chr(9) || chr(10)) end"
)
_VALID = (
    r"regexp_matches(u, '^https?://([^\s/?#@]+@)?(localhost|[0-9]{1,3}([.][0-9]{1,3}){3}|"
    r"([\p{L}\p{N}][\p{L}\p{N}_-]*[.])+\p{L}{2,63})(:[0-9]{1,5})?([/?#]\S*)?$')"
)
_EMAIL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_GAP = r"[-.\s\x{a0}]?"
_US = rf"\+?1?{_GAP}\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{4}}"
_INTL = rf"\+\d{{1,3}}{_GAP}\d{{1,4}}{_GAP}\d{{1,4}}{_GAP}\d{{1,9}}"
_BRACKET = rf"\(\d{{3}}\)[\s\x{{a0}}]*\d{{3}}{_GAP}\d{{4}}"


def _emails(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{_EMAIL}'))"


def _phones(x: str) -> str:
    ten = f"[right(regexp_replace(m, '[^0-9]', '', 'g'), 10) for m in regexp_extract_all({x}, '{_US}')]"
    return (
        f"list_distinct(list_concat(list_concat({ten}, regexp_extract_all({x}, '{_INTL}')), "
        f"regexp_extract_all({x}, '{_BRACKET}')))"
    )


_W, _S = r"\p{L}\p{N}_", _BLANK[1:-1]
_STREET = rf"(?i)\d+[{_S}]+[{_W}{_S}]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)[{_W}{_S},]*\d{{5}}"
_TOWN = rf"(?i)[{_W}{_S}]+,[{_S}]*[A-Z]{{2}}[{_S}]+\d{{5}}"

_NAV = (
    "select page_id, pos - 1 as pos, list_extract(hrefs, pos) as href, "
    f"{_clean(_decode('list_extract(texts, pos)'))} as title from (select page_id, generate_subscripts(hrefs, 1)::int as pos, hrefs, texts "
    "from (select page_id, regexp_extract_all(nav, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) as hrefs, "
    "regexp_extract_all(nav, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) as texts "
    "from (select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') as nav from pages)))"
)


_LETTERS = {"early": ("a", "b", "c"), "late": ("u", "w", "y")}
# Keywords of the link categories, in order.
_KEYWORDS = {
    "order tracking": ("track", "order", "tracking"),
    "contact": ("contact", "support", "help"),
    "blog": ("blog", "news", "articles"),
    "support": ("support", "help", "faq"),
    "shipping": ("shipping", "delivery"),
    "returns": ("return", "refund"),
    "size guide": ("size", "guide", "fitting"),
}


def _category(title: str, href: str, words: dict = _KEYWORDS) -> str:
    cases = [
        f"when regexp_matches(lower({title}) || chr(10) || lower({href}), '{'|'.join(w)}') then '{name}'"
        for name, w in words.items()
    ]
    return f"case {' '.join(cases)} end"


_STORE = "'https://store-' || user_id || '.example.com'"
_ERROR = "case when event_type = 'error' then '[\"Failed to fetch the main page\"]' end"
_TIME = "case when event_type <> 'view' then value end"

# One row per product of the part catalogues, before malformed ones are dropped.
_RAW_PRODUCTS = (
    "select *, (p_partkey + i) % 20 as kind, round(p_retailprice * 100)::bigint + i * 100 as cents from "
    "(select *, unnest(range(case p_size when 50 then 260 when 49 then 0 else p_size % 7 + 1 end))::bigint as i "
    "from part where p_size not in (46, 47, 48))"
)
_PRODUCTS = f"select * from ({_RAW_PRODUCTS}) where kind > 5"
_PRICE = "(cents // 100) || '.' || lpad((cents % 100)::varchar, 2, '0')"
_STATUS = "case p_size when 46 then 'error' when 47 then 'missing' when 48 then 'bad_json' else 'parsed' end"
_PART_URL = "'https://p' || p_partkey || '.example.com'"
_PROFILES = (
    "select p_partkey, coalesce(n, 0)::bigint as n, price_range from part left join "
    "(select p_partkey, count(*) as n, min(price) || ' - ' || max(price) as price_range from (select p_partkey, "
    f"case when kind not in (6, 8) then (cents / 100.0)::decimal(18, 2) end as price from ({_PRODUCTS})) group by 1) using (p_partkey)"
)

_HERO_ROWS = """
select p_partkey, 0 as pos, 'Grid' as title, null as description, null as image_url, null as product_url, null as price
from part where p_size % 9 = 0
union all
select p_partkey, 1, 'Unknown Product', null, null, null, null from part where p_size % 9 = 0
union all
select p_partkey, k, p_name || ' ' || k || case when k % 2 = 1 then ' link' else '' end, p_type || ' & more' || case when k < 3 then ' $' || p_size else '' end,
  'https://img.example.com/' || p_partkey || '.jpg', 'https://p' || p_partkey || '.example.com/products/' || p_partkey || '-' || k,
  case when k < 3 then '$' || p_size end
from (select *, unnest(range((least(p_size % 9, 5) + 1) // 2))::int as k from part where p_size % 9 > 0)
"""


def _faq(where: str) -> str:
    """Pairs of sentences as ``(page_id, k, kind, q, a)``."""
    return (
        "select conv_id * 1000 + turn as page_id, (conv_id + turn) % 3 as kind, k, list_extract(parts, 2 * k + 1) as q, "
        "list_extract(parts, 2 * k + 2) as a from (select *, unnest(range(len(parts) // 2))::int as k from "
        f"(select conv_id, turn, string_split(text, '. ') as parts from conversations)) where {where}"
    )


_FAQ_ITEMS = (
    f"select page_id, k as pos, {_clean('q')} as question, {_clean('a')} as answer from ({_faq('(conv_id + turn) % 3 = 0')})"
)
_FAQ_DL = (
    f"select page_id, 2 * k + j as pos, case j when 0 then {_clean('q')} else 'again' end as question, {_clean('a')} as answer "
    f"from ({_faq('(conv_id + turn) % 3 = 1')}), (select unnest([0, 1])::int as j)"
)
# Each pair also leaves an h5 with the bare question: it counts when the sentence itself asks.
_FAQ_HEADS = (
    "select page_id, (row_number() over (partition by page_id order by k, j) - 1)::int as pos, question, answer from ("
    f"select page_id, k, j, case j when 0 then {_clean('q || ' + repr('?'))} else {_clean('q')} end as question, "
    f"case j when 0 then {_clean('a')} else lead({_clean('a')}) over (partition by page_id, j order by k) end as answer "
    f"from ({_faq('(conv_id + turn) % 3 = 2')}), (select unnest([0, 1])::int as j)) "
    "where contains(question, '?') and answer is not null"
)

_PATHS = [""] + [p for paths in POLICY_PATHS.values() for p in paths]
_SLOTS = ", ".join(
    f"({1 + sum(len(v) for v in list(POLICY_PATHS.values())[:i]) + r}, '{name}', {r}, '{p}')"
    for i, (name, paths) in enumerate(POLICY_PATHS.items())
    for r, p in enumerate(paths)
)
_DOC_HOST = f"'d' || (doc_id // {_STORE_SIZE}) || '.example.com'"
_POLICIES = f"""
select host, type, title, path, md5(content) as digest from (
  select {_DOC_HOST} as host, s.type, s.path,
    case when doc_id % 4 = 0 then array_to_string([upper(w[1]) || w[2:] for w in string_split(s.type, '_')], ' ')
    else 'Doc ' || doc_id end as title, {_clean('text')} as content,
    row_number() over (partition by doc_id // {_STORE_SIZE}, s.type order by s.rank) as rn
  from documents join (values {_SLOTS}) s(slot, type, rank, path) on doc_id % {_STORE_SIZE} = s.slot
  where doc_id % 3 = 1 and {_clean('text')} <> '')
where rn = 1
"""
# About pages sit in slots 19-22; a page without content element passes on to the next. A host appears when any
# of its sections was found.
_ABOUT = f"""
select host, md5(about) as digest from (
  select {_DOC_HOST} as host,
    arg_min(case doc_id % 3 when 0 then '' else {_clean('text')} end, doc_id) filter (doc_id % {_STORE_SIZE} between 19 and 22 and doc_id % 3 < 2) as about,
    count(*) filter (doc_id % {_STORE_SIZE} between 1 and 13 and doc_id % 3 = 1 and {_clean('text')} <> '') as policies
  from documents group by 1)
where about is not null or policies > 0
union all
select 's' || s_suppkey || '.example.com', md5(case when s_suppkey % 2 = 1 and length({_clean("repeat(n_name || ' brand story. ', 12)")}) > 100
  then {_clean("repeat(n_name || ' brand story. ', 12)")} else {_clean("repeat('Intro of ' || s_name || '. ', 8)")} end)
from supplier join nation on s_nationkey = n_nationkey
"""

_SUPPLIER = """
select s_suppkey, s_name, n_name, lpad((s_suppkey % 100000)::varchar, 5, '0') as zip, lpad((s_suppkey % 10000)::varchar, 4, '0') as line,
  replace(lower(s_name), '#', '_') as handle, 's' || s_suppkey || '.example.com' as host
from supplier join nation on s_nationkey = n_nationkey
"""
_ADDRESSES = "[' ' || n_name || ', CA ' || zip, (s_suppkey % 900 + 1) || ' Main Street, ' || n_name || ', CA ' || zip]"
_HANDLES = """
select s_suppkey as page_id, platform, pos, handle from (
  select s_suppkey, unnest([
    {platform: 'instagram', pos: 0, handle: handle}, {platform: 'instagram', pos: 1, handle: host},
    {platform: 'facebook', pos: 0, handle: handle}, {platform: 'twitter', pos: 0, handle: handle},
    {platform: 'youtube', pos: 0, handle: handle || '-tv'}, {platform: 'linkedin', pos: 0, handle: handle || '-inc'}
  ], recursive := true) from (%s))
""" % _SUPPLIER
_LINKS = """
select s_suppkey as page_id, unnest([
  {pos: 0, title: 'Track your order', url: 'https://' || host || '/track-order', category: 'order tracking'},
  {pos: 1, title: 'Reach us', url: 'https://' || host || '/contact', category: 'contact'},
  {pos: 2, title: 'Our & News', url: 'https://' || host || '/news', category: 'blog'},
  {pos: 3, title: 'Size guide', url: 'https://' || host || '/size-guide#top', category: 'size guide'}
], recursive := true) from (%s)
""" % _SUPPLIER

# First page of every host with what its report shows.
_HOMES = f"select * from (select *, {_HOST} as host, row_number() over (partition by {_HOST} order by page_id) as rn from pages) where rn = 1"
_PAGE_LINKS = (
    f"select page_id, pos, title, href, {_category('title', 'href')} as category from ({_NAV}) where href <> '' and title <> ''"
)
_HOST_LINKS = f"select page_id, count(distinct href)::int as n from ({_PAGE_LINKS}) where category is not null group by 1"
_REPORT = (
    f"select h.*, {_clean(_TITLE)} as store_name, coalesce(l.n, 0)::int as n_links from ({_HOMES}) h left join ({_HOST_LINKS}) l using (page_id)"
)
_WARN = "'Product catalog not accessible'"

# Stores of the exact reports: document stores, supplier stores, part stores that were never crawled.
_DOC_TEXT = (
    "source || case when doc_id % 4 = 0 then '' else 'Doc ' || doc_id end || case when doc_id % 3 = 0 then ' ' else '' end || text"
)
_EXACT = f"""
select 'https://' || {_DOC_HOST} as store_url, true as success, 'Product catalog not accessible' as warnings,
  len({_emails(_DOC_TEXT)}) as emails, len({_phones(_DOC_TEXT)}) as phones, 0 as addresses, 0 as handles, 0 as products, 0 as links
from documents where doc_id % {_STORE_SIZE} = 0
union all
select 'https://s' || s_suppkey || '.example.com', true, case coalesce(c.status, 'missing') when 'missing' then 'Product catalog not accessible'
    when 'bad_json' then 'Could not parse product catalog JSON' else '' end, 3, 3, 2, 6, coalesce(c.n, 0), 4
from supplier left join (select p_partkey, {_STATUS} as status, (select count(*) from ({_PRODUCTS}) q where q.p_partkey = part.p_partkey) as n from part) c
  on c.p_partkey = s_suppkey
union all
select {_PART_URL} || '/shop', false, '', 0, 0, 0, 0, 0, 0 from part
"""

_AS_OF_US = "epoch_us(timestamp '2024-01-30 12:00:00')"
_FRESH = (
    f"select user_id, max(epoch_us(ts)) as us from events where event_type <> 'error' "
    f"and {_AS_OF_US} - epoch_us(ts) < 86400000000 group by 1"
)


def _cooldown(counts: str) -> str:
    """Greedy walk, one accepted request per step; ``counts`` says which accepted requests start a cool-down."""
    return f"""
with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn,
    {counts} as ok from events),
walk as (
  select user_id, min(rn) as rn from e where ok group by 1
  union all
  select w.user_id, (select min(n.rn) from e n where n.user_id = w.user_id and n.ok and n.us >= c.us + 86400000000)
  from walk w join e c on c.user_id = w.user_id and c.rn = w.rn
  where w.rn is not null),
chain as (select e.user_id, e.rn, e.us from walk w join e on e.user_id = w.user_id and e.rn = w.rn)
select user_id, event_id, us as ts_us from e
where us - coalesce((select max(c.us) from chain c where c.user_id = e.user_id and c.rn < e.rn), -4611686018427387904) >= 86400000000
"""


ORACLE: dict[str, str] = {
    "pages_scan": "select page_id, url, length(html)::bigint as html_chars from pages",
    "catalog_status": f"select {_PART_URL} as store_url, {_STATUS} as catalog_status from part",
    "records_scan": (
        f"select event_id as id, {_STORE} as store_url, 'Store ' || user_id as doc_name, event_type <> 'error' as doc_success, "
        f"{_TIME} as processing_time from events"
    ),
    "records_roundtrip": (
        f"select event_id as id, {_STORE} as store_url, epoch_us(ts) as scraped_us, 'Store ' || user_id as store_name, "
        f"{_TIME} as processing_time, event_type <> 'error' as success, {_ERROR} as error_message from events"
    ),
    "rejected_requests": (
        "select page_id, form, case when raw = '' then 'Website URL is required' else 'Invalid website URL: ' || raw end as reason "
        f"from (select *, {_NORMAL} as u from ({_VARIANTS})) where not {_VALID}"
    ),
    "url_normalize": f"select page_id, form, {_NORMAL} as normalized from ({_VARIANTS})",
    "url_validity": f"select page_id, form, {_VALID} as valid from (select *, {_NORMAL} as u from ({_VARIANTS}))",
    "url_domain": (
        f"select page_id, form, case form when 0 then {_HOST} when 2 then {_HOST} when 3 then 'user:pw@' || {_HOST} || ':8080' else '' end "
        "as domain from pages, (select unnest(range(6))::int as form)"
    ),
    "platform_hint": (
        "select page_id, form, form > 0 or regexp_matches(lower(url), '[.]myshopify[.]com|shopifycdn[.]com|shopify-checkout') as is_platform "
        "from pages, (select unnest(range(3))::int as form)"
    ),
    "url_absolute": (
        "select page_id, ref, case ref when 0 then o || '/x' when 1 then o || '/a/y/z?q=1' when 2 then 'https://cdn.example.com/a' "
        "when 3 then o || '/a/b?p=2' when 4 then o || '/a/b#f' when 5 then o || '/up' when 6 then 'mailto:a@b.c' "
        f"else 'https://o.example.com/x' end as resolved from (select page_id, 'https://' || {_HOST} as o from pages), "
        "(select unnest(range(8))::int as ref)"
    ),
    "clean_text": (
        "select doc_id, length(t)::bigint as chars, md5(t) as digest from (select doc_id, "
        + _clean("'  ' || text || '&amp;lt; &quot;x&quot;&nbsp; ' || chr(28)")
        + " as t from documents)"
    ),
    "emails_docs": f"select doc_id, unnest({_emails('text')}) as email from documents",
    "emails_pages": f"select page_id, unnest({_emails('html')}) as email from pages",
    "phones_docs": f"select doc_id, unnest({_phones('text')}) as phone from documents",
    "phones_pages": f"select page_id, unnest({_phones('html')}) as phone from pages",
    "addresses": f"select s_suppkey as page_id, unnest({_ADDRESSES}) as address from ({_SUPPLIER})",
    "addresses_docs": (
        f"select doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '{_STREET}'), regexp_extract_all(text, '{_TOWN}')))) "
        "as address from (select doc_id, text || '. ' || doc_id || ' Main Street, Town ' || lpad(doc_id::varchar, 5, '0') || "
        "'; New ' || source || ', CA ' || lpad(doc_id::varchar, 5, '0') as text from documents)"
    ),
    "link_category": (
        f"select page_id, pos, {_category('title', 'href')} as category from (select page_id, pos, "
        "case when page_id % 2 = 0 then title || ' ' || word else title end as title, "
        "case when page_id % 2 = 0 then href else href || '/' || word end as href from (select *, list_extract(["
        "'Track', 'orders', 'Contact', 'support', 'HELP', 'Blog', 'news', 'Articles', 'FAQ', 'Shipping', 'delivery', "
        f"'Returns', 'refund', 'Size', 'guide', 'fitting', 'plain', 'border', 'x'], (page_id + pos) % 19 + 1) as word from ({_NAV})))"
    ),
    "policy_titles": "select distinct source, upper(source[1]) || lower(source[2:]) || ' Policy Page' as title from documents",
    "node_counts": (
        "select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(regexp_replace(html, "
        "'<(script|style)>.*?</(script|style)>', '<\\1></\\1>', 'gs'), '<([a-z][a-z0-9]*)', 1)) as tag from pages) group by all"
    ),
    "page_text_stats": f"select page_id, length(t)::bigint as chars, md5(t) as digest from (select page_id, {_TEXT} as t from pages)",
    "titles": f"select page_id, {_TITLE} as title from pages",
    "first_heading": "select page_id, regexp_extract(html, '<(h1|p)>', 1) as tag from pages",
    "priority_select": (
        "select page_id, 'h1' as tag, md5(" + _clean(_decode("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")) + ") as digest from pages"
    ),
    "nav_links": f"select page_id, pos, title, href from ({_NAV})",
    "nav_links_table": f"select page_id, title, href from ({_NAV})",
    "contact_link": "select s_suppkey as page_id, '/contact' as href from supplier",
    "candidate_lookup": (
        "select host, 'home' as section, rank, page_id from (select *, row_number() over (partition by host order by rank, page_id) as rn "
        f"from (select page_id, {_HOST} as host, list_position(['en', 'fr', 'de', 'es'], regexp_extract(url, '^https?://[^/]*/([a-z][a-z])/[^/?#]', 1)) - 1 as rank "
        "from pages) where rank >= 0) where rn = 1"
    ),
    "store_name": (
        f"select page_id, url, {_clean(_TITLE)} as store_name from pages union all "
        "select s_suppkey, 'https://' || host, case when s_suppkey % 5 > 0 then s_name || ' - Home' else '' end "
        f"from ({_SUPPLIER})"
    ),
    "catalog_products": (
        f"select {_PART_URL} as store_url, (row_number() over (partition by p_partkey order by i) - 1)::int as pos, "
        "p_partkey * 1000 + i as id, p_name || ' ' || i || ' & co' as title, 'h-' || i as handle, '<p>' || p_type || ' item</p>' as description, "
        "p_brand as vendor, p_type as product_type, p_brand || '|' || p_type as tags, "
        f"case kind when 6 then null when 7 then (cents / 100.0)::double::varchar when 8 then '' else {_PRICE} end as price, "
        f"case when kind <> 6 and i % 3 = 0 then {_PRICE} end as compare_at_price, "
        "kind <> 6 and ((p_partkey + i) % 2 = 0 or i % 5 = 0) as available, "
        "array_to_string(['https://img.example.com/' || p_partkey || '/' || j || '.jpg' for j in range(1, i % 4 + 1)], '|') as images, "
        "case kind when 6 then 0 else 2 end as n_variants, epoch(date '2024-01-01' + p_size)::bigint + 36000 as created_s, null::bigint as updated_s "
        f"from ({_PRODUCTS})"
    ),
    "catalog_rollup": (
        f"select {_PART_URL} as store_url, {_STATUS} as catalog_status, coalesce(n, 0)::bigint as total_products, p_size = 50 as has_more "
        f"from part left join (select p_partkey, count(*) as n from ({_PRODUCTS}) group by 1) using (p_partkey)"
    ),
    "hero_products": (
        f"select p_partkey as page_id, pos, title, description, image_url, product_url, price, 'homepage' as featured_section from ({_HERO_ROWS})"
    ),
    "policies": _POLICIES,
    "faq_items": _FAQ_ITEMS,
    "faq_dl": _FAQ_DL,
    "faq_headings": _FAQ_HEADS,
    "contact_info": (
        "select s_suppkey as page_id, 'Sales@' || host || '|info@' || host || '|info@' || host || '.Call' as emails, "
        "'(555) 123-' || line || '|+44-20-555-' || line || '|555123' || line as phone_numbers, "
        f"array_to_string({_ADDRESSES}, '|') as addresses, 'https://' || host || '/contact' as contact_form_url from ({_SUPPLIER})"
    ),
    "social_handles": _HANDLES,
    "brand_context": _ABOUT,
    "important_links": _LINKS,
    "important_links_pages": (
        f"select page_id, title, 'https://' || {_HOST} || href as url, category from pages join (select *, row_number() over "
        f"(partition by page_id, href order by pos) as rn from (select page_id, pos, title, href, {_category('title', 'href', _LETTERS)} as category "
        f"from ({_NAV}) where href <> '' and title <> '') where category is not null) using (page_id) where rn = 1"
    ),
    "store_report": (
        "select 'https://' || host as store_url, store_name, false as is_shopify_store, true as success, "
        f"len({_emails(_TEXT)})::int as n_emails, len({_phones(_TEXT)})::int as n_phones, n_links, '' as errors, {_WARN} as warnings "
        f"from ({_REPORT})"
    ),
    "report_summary": (
        "select store_url, emails::int as emails, phones::int as phone_numbers, addresses, handles as social_handles, products::int as products, "
        f"0 as hero_products, 0 as faqs, links as important_links from ({_EXACT})"
    ),
    "report_errors": (
        "select store_url, success, case when success then case when regexp_matches(store_url, '^https://s[0-9]+[.]') and "
        "(select p_size from part where 'https://s' || p_partkey || '.example.com' = store_url) = 46 then "
        "'Product catalog error: products is not a list' else '' end else 'Failed to fetch the main page' end as errors, warnings "
        f"from ({_EXACT})"
    ),
    "report_competitors": (
        "select 'https://s' || s_suppkey || '.example.com' as store_url, pos, 'https://p' || k || '.example.com' as website_url, "
        "n as estimated_products, price_range from (select s_suppkey, pos, s_suppkey + 1 - pos as k from supplier, (select unnest([0, 1])::int as pos)) "
        f"left join ({_PROFILES}) on k = p_partkey where s_suppkey % 2 = 0 and s_suppkey % 5 > 0"
    ),
    "competitor_profile": (
        f"select {_PART_URL} as store_url, 'https://p' || (p_partkey + 1) || '.example.com' as competitor_url, n as estimated_products, "
        f"price_range from part left join (select p_partkey - 1 as p_partkey, n, price_range from ({_PROFILES})) using (p_partkey)"
    ),
    "latest_record": (
        f"select {_STORE} as store_url, event_id as id, epoch_us(ts) as scraped_us, {_TIME} as processing_time from (select *, row_number() over "
        "(partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'error') where rn = 1"
    ),
    "cached_report": (
        f"select {_STORE} as store_url, event_id as id, 'Store 7' as store_name, true as success from events "
        "where user_id = 7 and event_type <> 'error' order by ts desc, event_id desc limit 1"
    ),
    "history_page": (
        f"select event_id as id, {_STORE} as store_url, 'Store ' || user_id as store_name, epoch_us(ts) as scraped_us, {_TIME} as processing_time, "
        "event_type <> 'error' as success from events order by ts desc, event_id desc limit 100 offset 20"
    ),
    "service_stats": (
        "select count(*) as total_requests, count(*) filter (ok) as successful_requests, count(*) filter (not ok) as failed_requests, "
        "round(count(*) filter (ok) * 100 / count(*), 2) as success_rate_percent, round(coalesce(sum(t), 0) / count(*), 2) as average_processing_time_seconds, "
        f"count(*) > 0 as database_enabled from (select event_type <> 'error' as ok, {_TIME} as t from events order by ts desc, event_id desc limit 1000)"
    ),
    "stale_requests": (
        "select 'https://store-' || c_custkey || '.example.com' as store_url from customer "
        f"where c_custkey not in (select user_id from ({_FRESH}))"
    ),
    "fresh_hits": (
        "select 'https://store-' || c_custkey || '.example.com' as store_url, 'Store ' || c_custkey as store_name, us as scraped_us "
        f"from customer join ({_FRESH}) on user_id = c_custkey"
    ),
    "cooldown_replay": _cooldown("true"),
    "cooldown_stream": _cooldown("true"),
    "cooldown_failures": _cooldown("event_type <> 'error'"),
    "stream_extract": (
        f"select 'https://' || host as store_url, store_name, true as success, n_links, {_WARN} as warnings from ({_REPORT})"
    ),
    "fetch_insights": (
        "select 'store-' || c_custkey || '.example.com' as website_url, case when us is null then 'extracted' else 'reused' end as outcome, "
        "case when us is not null then 'Store ' || c_custkey end as store_name, us is not null as success, "
        "case when us is null then '[\"Failed to fetch the main page\"]' end as message "
        f"from customer left join ({_FRESH}) on user_id = c_custkey where c_custkey % 4 <> 3 "
        "union all select 'not-a-url-' || c_custkey, 'rejected', null, false, 'Invalid website URL: not-a-url-' || c_custkey "
        "from customer where c_custkey % 4 = 3 "
        f"union all select 'https://' || host, 'extracted', store_name, true, null from ({_REPORT})"
    ),
    "records_written": (
        f"select sha256('https://' || host || '|' || {_AS_OF_US}) as id, 'https://' || host as store_url, store_name, true as success, "
        f"null::varchar as error_message, {_AS_OF_US} as scraped_us, n_links from ({_REPORT})"
    ),
}
ORACLE["faqs"] = f"select * from ({_FAQ_ITEMS}) union all select * from ({_FAQ_DL}) union all select * from ({_FAQ_HEADS})"
