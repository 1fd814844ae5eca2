"""Section extractors: each is an expression over one parsed page, so all sections come from a single pass.

Nothing here shuffles. URLs stay as written in the page and are resolved once the store is known, because
pages of one host may serve several stores.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from storelens.functions import text as T
from storelens.functions.select import (
    Inside,
    Selector,
    any_of,
    attr,
    attr_contains,
    by_parent,
    cls,
    inner,
    next_sibling_sorted,
    node_text,
    select,
    select_first,
    select_priority,
    tag,
    tag_cls,
)
from storelens.functions.sql import let
from storelens.functions.urls import absolute_url

# What to look for, in order where order matters.
NAME_SELECTORS: tuple[Selector, ...] = (
    tag("title"),
    Inside(cls("site-header__logo"), tag("img")),
    Inside(cls("header__logo"), tag("img")),
    Inside(cls("logo"), tag("img")),
    tag_cls("h1", "site-title"),
    cls("site-title"),
    cls("header-logo"),
)
HERO_SELECTORS: tuple[Selector, ...] = (
    cls("featured-product"),
    cls("hero-product"),
    cls("product-hero"),
    Inside(cls("featured-collection"), cls("product-item")),
    Inside(cls("collection-hero"), cls("product")),
    cls("homepage-product"),
    cls("product-card"),
    cls("grid-product"),
)
HERO_TITLE = any_of(cls("product-title", "product-name"), tag("h3", "h2", "a"))
HERO_TEXT = any_of(cls("product-description", "product-summary"), tag("p"))
HERO_PRICE = cls("price", "product-price", "money")
HERO_LIMIT = 5
POLICY_CONTENT: tuple[Selector, ...] = (
    cls("page-content"),
    cls("policy-content"),
    cls("main-content"),
    cls("content"),
    tag("main"),
    cls("page"),
)
POLICY_TITLE = any_of(tag("h1"), cls("page-title", "policy-title"))
FAQ_ITEM = cls("accordion-item", "faq-item", "collapsible-item")
FAQ_QUESTION = any_of(cls("accordion-title", "faq-question", "question"), tag("h3", "h4"))
FAQ_ANSWER = cls("accordion-content", "faq-answer", "answer", "content")
ABOUT_CONTENT = any_of(cls("page-content", "about-content", "content"), tag("main"))
ABOUT_HOME = cls("hero", "banner", "intro", "about-section")
ABOUT_MIN_LENGTH = 100
NAV_LINKS = Inside(any_of(tag("nav", "footer"), cls("navigation", "menu")), tag("a"))
CONTACT_LINK = attr_contains("a", "href", "contact")

# Every class named above: with dom.SECTION_TAGS, all that the parser must return.
SECTION_CLASSES = (
    "site-header__logo header__logo logo site-title header-logo featured-product hero-product product-hero "
    "featured-collection product-item collection-hero product homepage-product product-card grid-product "
    "product-title product-name product-description product-summary price product-price money page-content "
    "policy-content main-content content page page-title policy-title accordion-item faq-item collapsible-item "
    "accordion-title faq-question question accordion-content faq-answer answer about-content hero banner intro "
    "about-section navigation menu"
).split()


def _clean(page_text: str, node: str) -> str:
    """Cleaned text of a node; NULL without a node."""
    return f"if({node} is null, null, {T.clean_text(node_text(page_text, node))})"


def _first_text(nodes: str, page_text: str, selector: Selector) -> str:
    return let("hit", select_first(nodes, selector), _clean(page_text, "hit"))


def _first_nonempty(*arrays: str) -> str:
    return f"coalesce({', '.join(let('found', a, 'if(size(found) > 0, found, null)') for a in arrays)})"


def store_name(nodes: str, page_text: str, selectors: Sequence[Selector] = NAME_SELECTORS) -> str:
    """Name of the store on its home page, NULL when nothing matches.

    Only the first match of each selector is tried; an image counts by its ``alt``. A selector whose match is
    empty passes on to the next. An empty ``title`` is the last resort.
    """
    value = f"coalesce(if(hit.tag = 'img', {attr('hit', 'alt')}, null), nullif({node_text(page_text, 'hit')}, ''))"
    name = f"coalesce({', '.join(let('hit', select_first(nodes, s), value) for s in selectors)})"
    title = T.head_of_title(_first_text(nodes, page_text, tag("title")))
    return let("name", name, f"if(name is null, {title}, {T.clean_text('name')})")


def hero_products(
    nodes: str, page_text: str, selectors: Sequence[Selector] = HERO_SELECTORS, limit: int = HERO_LIMIT
) -> str:
    """Up to ``limit`` featured products from the first selector that matches, URLs unresolved."""
    image = let("hit", select_first("sub", tag("img")), attr("hit", "src", "data-src"))
    link = let("hit", select_first("sub", tag("a")), attr("hit", "href"))
    product = (
        f"named_struct('title', coalesce({_first_text('sub', page_text, HERO_TITLE)}, 'Unknown Product'), "
        f"'description', {_first_text('sub', page_text, HERO_TEXT)}, 'image_url', {image}, 'product_url', {link}, "
        f"'price', {_first_text('sub', page_text, HERO_PRICE)}, 'featured_section', 'homepage')"
    )
    blocks = f"slice({_first_nonempty(*(select(nodes, s) for s in selectors))}, 1, {limit})"
    return f"transform({blocks}, block -> {let('sub', inner(nodes, 'block'), product)})"


def resolve_heroes(heroes: str, base: str) -> str:
    """Absolute URLs, then equal products once, first kept."""

    def url(field: str) -> str:
        return f"if(h.{field} is null, null, {absolute_url(base, f'h.{field}')})"

    fields = (
        f"named_struct('title', h.title, 'description', h.description, 'image_url', {url('image_url')}, "
        f"'product_url', {url('product_url')}, 'price', h.price, 'featured_section', h.featured_section)"
    )
    return f"array_distinct(transform({heroes}, h -> {fields}))"


def policy(nodes: str, page_text: str) -> str:
    """Struct ``(title, content)`` of a policy page, NULL when its content is empty.

    The first content selector that matches decides, even if its text is empty. ``title`` is NULL without heading.
    """
    content = let("hit", select_priority(nodes, POLICY_CONTENT), _clean(page_text, "hit"))
    title = _first_text(nodes, page_text, POLICY_TITLE)
    page = f"named_struct('title', {title}, 'content', content)"
    return let("content", content, f"if(coalesce(content, '') = '', null, {page})")


def _pair(page_text: str, question: str, answer: str) -> str:
    return let(
        "qa",
        f"named_struct('q', {question}, 'a', {answer})",
        f"named_struct('question', {_clean(page_text, 'qa.q')}, 'answer', {_clean(page_text, 'qa.a')})",
    )


def faq_items(nodes: str, page_text: str) -> str:
    """Accordion and item blocks that hold both a question and an answer."""
    pair = _pair(page_text, select_first("sub", FAQ_QUESTION), select_first("sub", FAQ_ANSWER))
    pairs = f"transform({select(nodes, FAQ_ITEM)}, item -> {let('sub', inner(nodes, 'item'), pair)})"
    return f"filter({pairs}, p -> p.question is not null and p.answer is not null)"


def _with_next(nodes: str, page_text: str, asked: str, answer: Selector) -> str:
    """Pairs of each asked node and its next sibling matching ``answer``."""
    pairs = f"transform({asked}, q -> {_pair(page_text, 'q', next_sibling_sorted('answers', 'q'))})"
    return let("answers", by_parent(select(nodes, answer)), f"filter({pairs}, p -> p.answer is not null)")


def faq_definitions(nodes: str, page_text: str) -> str:
    """``dt`` with the next ``dd`` of the same parent."""
    return _with_next(nodes, page_text, select(nodes, tag("dt")), tag("dd"))


def faq_headings(nodes: str, page_text: str) -> str:
    """Headings with a question mark and the next ``p`` or ``div`` of the same parent."""
    headings = select(nodes, tag("h3", "h4", "h5"))
    asked = f"filter({headings}, h -> contains({T.clean_text(node_text(page_text, 'h'))}, '?'))"
    return _with_next(nodes, page_text, asked, tag("p", "div"))


def faqs(nodes: str, page_text: str) -> str:
    """Questions and answers of a page; each method is tried only if the one before found none."""
    return _first_nonempty(*(way(nodes, page_text) for way in (faq_items, faq_definitions, faq_headings)))


def contact_href(nodes: str) -> str:
    """``href`` of the first link whose target mentions contact."""
    return f"{select_first(nodes, CONTACT_LINK)}.attrs['href']"


def about_text(nodes: str, page_text: str) -> str:
    """Content of an about page: NULL without a content element, ``''`` when it is empty."""
    return _first_text(nodes, page_text, ABOUT_CONTENT)


def about_home_text(nodes: str, page_text: str) -> str:
    """First home-page section with more than 100 characters."""
    texts = f"transform({select(nodes, ABOUT_HOME)}, s -> {_clean(page_text, 's')})"
    return f"get(filter({texts}, t -> length(t) > {ABOUT_MIN_LENGTH}), 0)"


def nav_links(nodes: str, page_text: str) -> str:
    """Links of navigation and footer with cleaned text, in document order."""
    link = f"named_struct('title', {_clean(page_text, 'a')}, 'href', a.attrs['href'])"
    return f"transform({select(nodes, NAV_LINKS)}, a -> {link})"


def important_links(
    nodes: str, page_text: str, categories: Mapping[str, Sequence[str]] = T.LINK_CATEGORIES
) -> str:
    """Navigation links with text, target and a category; URLs unresolved."""
    links = f"filter({nav_links(nodes, page_text)}, l -> l.title <> '' and coalesce(l.href, '') <> '')"
    category = T.link_category("l.title", "l.href", categories)
    sorted_in = f"transform({links}, l -> named_struct('title', l.title, 'url', l.href, 'category', {category}))"
    return f"filter({sorted_in}, l -> l.category is not null)"


def resolve_links(links: str, base: str) -> str:
    """Absolute URLs, then the first link per URL: equal URLs meet in sorted order, where the first place counts."""
    fields = f"named_struct('title', l.title, 'url', {absolute_url(base, 'l.url')}, 'category', l.category)"
    placed = f"array_sort(transform({links}, (l, i) -> named_struct('u', {absolute_url(base, 'l.url')}, 'i', i, 'l', {fields})))"
    first = "filter(placed, (x, k) -> k = 0 or get(placed, k - 1).u <> x.u)"
    ordered = "array_sort(transform(kept, x -> named_struct('i', x.i, 'l', x.l)))"
    return let("placed", placed, let("kept", first, f"transform({ordered}, x -> x.l)"))


def contact_info(page_text: str) -> str:
    """E-mails, phone numbers and addresses of the visible text."""
    return (
        f"named_struct('emails', {T.emails(page_text)}, 'phone_numbers', {T.phones(page_text)}, "
        f"'addresses', {T.addresses(page_text)})"
    )
