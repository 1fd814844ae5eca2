"""Text expressions: cleaning, contact patterns, social handles, link categories.

All patterns run in the JVM. Word characters and blanks are spelled out as Unicode classes and ``d`` makes the
line feed the only line end, so that accented text, NBSP and the like are read as such. Patterns whose plain
form rescans a long run once per start are written so that each run is entered once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from storelens.functions.sql import NO_TEXT, either, let, lit
from storelens.functions.urls import BLANK

WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_W, _S, _WS = r"\p{L}\p{N}_", r"\s\x1c-\x1f", r"[\p{L}\p{N}_\s\x1c-\x1f]"

# Entities replaced after trimming, in this order.
ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)

# Link categories in order of precedence with their keywords.
LINK_CATEGORIES = {
    "order tracking": ("track", "order", "tracking"),
    "contact": ("contact", "support", "help"),
    "blog": ("blog", "news", "articles"),
    "support": ("support", "help", "faq"),
    "shipping": ("shipping", "delivery"),
    "returns": ("return", "refund"),
    "size guide": ("size", "guide", "fitting"),
}

# Phone shapes (US with 3-3-4 digits, international, bracketed area code).
_GAP = rf"[-.{_S}]?"
PHONE_US = rf"\+?1?{_GAP}\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{4}}"
PHONE_INTL = rf"\+\d{{1,3}}{_GAP}\d{{1,4}}{_GAP}\d{{1,4}}{_GAP}\d{{1,9}}"
PHONE_BRACKET = rf"\(\d{{3}}\)[{_S}]*\d{{3}}{_GAP}\d{{4}}"

# Words that end a street name.
STREET_WORDS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr")

# Where each platform's handle follows in a link, and the platforms also known by "@name ... word".
_HANDLE, _HANDLE_DASH = "[a-zA-Z0-9._]+", "[a-zA-Z0-9._-]+"
SOCIAL_LINKS = {
    "instagram": (rf"instagram\.com/({_HANDLE})",),
    "facebook": (rf"facebook\.com/({_HANDLE})", rf"fb\.com/({_HANDLE})"),
    "twitter": (rf"twitter\.com/({_HANDLE})", rf"x\.com/({_HANDLE})"),
    "tiktok": (rf"tiktok\.com/@({_HANDLE})",),
    "youtube": (rf"youtube\.com/(?:channel/|user/|c/)?({_HANDLE_DASH})",),
    "linkedin": (rf"linkedin\.com/(?:company/|in/)?({_HANDLE_DASH})",),
    "pinterest": (rf"pinterest\.com/({_HANDLE})",),
}
SOCIAL_MENTIONS = ("instagram", "twitter")
NO_HANDLES = "cast(map() as map<string,array<string>>)"


def _find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def _tidy_set(found: str) -> str:
    return f"array_sort(array_distinct({found}))"


def clean_text(text: str) -> str:
    """Collapse blanks, trim, then replace six entities in order; NULL gives ``''``."""
    out = f"trim(regexp_replace({text}, {lit(f'(?U){BLANK}+')}, ' '))"
    for entity, plain in ENTITIES:
        out = f"replace({out}, {lit(entity)}, {lit(plain)})"
    return f"coalesce({out}, '')"


def emails(text: str) -> str:
    """Distinct e-mail addresses, sorted.

    Each run of local-part characters is entered once (from its left edge, or where the last match ended)
    and only if ``@`` follows it. The top-level class admits ``|``, as in the pattern it must agree with.
    """
    run = "[A-Za-z0-9._%+-]"
    pattern = (
        rf"(?idU)(?:(?<!{run})|\G)(?={run}++@){run}*?{EDGE}({run}++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE})"
    )
    return _tidy_set(f"if(contains({text}, '@'), {_find_all(text, pattern, 1)}, {NO_TEXT})")


def phones(text: str) -> str:
    """Distinct phone numbers of three shapes, sorted.

    The US shape yields its ten digits alone, the others the matched text, so one number can appear twice.
    """
    digits = f"right(regexp_replace(m, {lit('(?U)\\D')}, ''), 10)"
    likely = f"{text} rlike {lit(rf'(?U)\d{{3}}{_GAP}\d{{4}}')}"
    ten = f"if({likely}, transform({_find_all(text, f'(?dU){PHONE_US}')}, m -> {digits}), {NO_TEXT})"
    intl = f"if(contains({text}, '+'), {_find_all(text, f'(?dU){PHONE_INTL}')}, {NO_TEXT})"
    bracket = f"if(contains({text}, '('), {_find_all(text, f'(?dU){PHONE_BRACKET}')}, {NO_TEXT})"
    return _tidy_set(f"if({text} is null, {NO_TEXT}, concat({ten}, {intl}, {bracket}))")


def addresses(text: str) -> str:
    """Distinct postal addresses of two shapes, sorted.

    A street address lies inside one run of word characters, blanks and commas and always ends with the
    last five digits of that run, so each run gives at most one. It is cut to those digits first, then to the
    last street word, which leaves one scan per step.
    """
    words = "|".join(STREET_WORDS)
    runs = f"filter({_find_all(text, rf'(?U)[{_W}{_S},]+')}, r -> r rlike {lit(r'(?U)\d{5}')})"
    until_zip = f"regexp_extract(r, {lit(r'(?sU)^(.*)\d{5}')}, 1)"
    until_word = f"regexp_extract(z, {lit(rf'(?isU)^.*(?:{words})')}, 0)"
    start = f"regexp_extract(w, {lit(rf'(?isU)(?<!\d)\d++[{_S}]+{_WS}+(?:{words}).*$')}, 0)"
    whole = f"if(h = '', null, concat(h, substring(r, length(w) + 1, length(z) - length(w) + 5)))"
    street = let("z", until_zip, let("w", until_word, let("h", start, whole)))
    streets = f"filter(transform({runs}, r -> {street}), m -> m is not null)"
    towns = _find_all(text, rf"(?iU)(?:(?<!{_WS})|\G){_WS}++,[{_S}]*[A-Z]{{2}}[{_S}]+\d{{5}}")
    return _tidy_set(f"if({text} rlike {lit(r'(?U)\d{5}')}, concat({streets}, {towns}), {NO_TEXT})")


def _mentions(text: str, word: str) -> str:
    """Handle of the leftmost ``@name`` before the last ``word`` of each line.

    Lines are cut at that last word, so the search for ``@name`` cannot run past it.
    """
    lines = f"filter(split({text}, '\\n'), s -> contains(s, '@') and s rlike {lit(f'(?iU){word}')})"
    head = f"regexp_extract(s, {lit(f'(?idU)^.*{word}')}, 0)"
    name = f"regexp_extract({head}, {lit(f'(?idU)@({_HANDLE}).*{word}')}, 1)"
    return f"filter(transform({lines}, s -> {name}), s -> s <> '')"


def social_handles(text: str, html: str | None = None) -> str:
    """Map platform -> distinct handles in order of pattern and occurrence; platforms without any are left out."""
    body = f"coalesce({text}, '')" if html is None else f"concat(coalesce({text}, ''), ' ', coalesce({html}, ''))"
    entries = []
    for platform, patterns in SOCIAL_LINKS.items():
        found = [_find_all("b", f"(?idU){p}", 1) for p in patterns]
        if platform in SOCIAL_MENTIONS:
            found.append(_mentions("b", platform))
        entries.append(f"{lit(platform)}, array_distinct(concat({', '.join(found)}))")
    likely = f"b rlike {lit('(?i)[.]com/')} or b rlike {lit('(?iU)' + '|'.join(SOCIAL_MENTIONS))}"
    found = f"map_filter(map({', '.join(entries)}), (k, v) -> size(v) > 0)"
    return let("b", body, f"if({likely}, {found}, {NO_HANDLES})")


def link_category(text: str, href: str, categories: Mapping[str, Sequence[str]] = LINK_CATEGORIES) -> str:
    """First category, in the given order, with a keyword inside the lower-cased text or href; else NULL."""
    cases = [
        f"when {either(f'contains(lower({c}), {lit(w)})' for w in words for c in (text, href))} then {lit(name)}"
        for name, words in categories.items()
        if words
    ]
    return f"case {' '.join(cases)} end" if cases else "cast(null as string)"


def title_from_key(key: str) -> str:
    """``privacy_policy`` -> ``Privacy Policy``."""
    return f"initcap(replace({key}, '_', ' '))"


def head_of_title(title: str) -> str:
    """Part of a title before the first `` - ``."""
    return f"split_part({title}, ' - ', 1)"
