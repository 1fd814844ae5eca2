"""URL expressions: normalise, validate, split, resolve. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from storelens.functions.sql import NO_TEXT, either, let, lit

# Substrings that mark a hosted storefront in a URL.
PLATFORM_MARKS = (".myshopify.com", "shopifycdn.com", "shopify-checkout")

# Unicode blanks plus the four separators U+001C..U+001F, which Java's \s leaves out.
BLANK = r"[\s\x1c-\x1f]"

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)"
_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"

_VALID = (
    r"^https?://(?:[^\s/?#@]+@)?"
    r"(?:localhost|(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    r"|(?:[\p{L}\p{N}](?:[\p{L}\p{N}_-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,63})"
    r"(?::\d{1,5})?(?:[/?#]\S*)?$"
)


def normalize_url(url: str) -> str:
    """Trim and prefix ``https://`` unless the text starts with ``http://`` or ``https://``.

    NULL and empty give ``''``. Host case and trailing slash stay, so ``a.com`` and ``a.com/`` differ.
    """
    trimmed = f"regexp_replace({url}, {lit(f'(?U)^{BLANK}+|{BLANK}+$')}, '')"
    return (
        f"case when coalesce({url}, '') = '' then '' "
        f"when {trimmed} rlike '^https?://' then {trimmed} else concat('https://', {trimmed}) end"
    )


def is_valid_url(url: str) -> str:
    """True for http(s) URLs with a dotted host, an IPv4 address or ``localhost``."""
    return f"coalesce({url} rlike {lit(_VALID)}, false)"


def platform_hint(url: str, marks: Sequence[str] = PLATFORM_MARKS) -> str:
    """True when the lower-cased URL contains one of the marks."""
    return f"coalesce({either(f'contains(lower({url}), {lit(m)})' for m in marks)}, false)"


def _tidy(url: str) -> str:
    """Drop what URL parsers ignore: leading control characters and any tab or line break."""
    return f"translate(regexp_replace({url}, {lit('^[\\x00-\\x20]+')}, ''), {lit('\t\r\n')}, '')"


def _bad_brackets(authority: str) -> str:
    return f"(contains({authority}, '[') <> contains({authority}, ']'))"


def extract_domain(url: str) -> str:
    """Lower-cased authority, port and user info included; ``''`` when there is none."""
    authority = f"regexp_extract({_tidy(url)}, {lit(_AUTHORITY)}, 1)"
    return f"if({_bad_brackets(authority)}, '', coalesce(lower({authority}), ''))"


def url_path(url: str) -> str:
    """Path without query, fragment and trailing slashes; ``''`` for the root."""
    return f"regexp_replace(regexp_extract({_tidy(url)}, {lit(_PATH)}, 1), '/+$', '')"


def page_key(url: str) -> str:
    """Join key of a page: authority and path, scheme and trailing slash ignored."""
    return f"concat({extract_domain(url)}, {url_path(url)})"


def _merge_paths(base: str, path: str) -> str:
    """``path`` seen from the path ``base``, dot segments removed."""
    joined = f"concat(slice(split({base}, '/'), 1, size(split({base}, '/')) - 1), split({path}, '/'))"
    joined = f"if(instr({base}, '/') = 0, concat(array(''), split({path}, '/')), {joined})"
    inner = f"filter({joined}, (s, i) -> i = 0 or i = size({joined}) - 1 or s <> '')"
    parts = f"if(startswith({path}, '/'), split({path}, '/'), {inner})"
    walked = (
        f"aggregate({parts}, {NO_TEXT}, (acc, s) -> case when s = '..' "
        "then slice(acc, 1, greatest(size(acc) - 1, 0)) when s = '.' then acc else concat(acc, array(s)) end)"
    )
    tail = f"if({path} rlike {lit('(?:^|/)[.][.]?$')}, array(''), {NO_TEXT})"
    return f"regexp_replace(array_join(concat({walked}, {tail}), '/'), '^/?', '/')"


def absolute_url(base: str, ref: str) -> str:
    """Resolve ``ref`` against an http(s) ``base``; other schemes (``mailto:`` ...) pass through."""

    def part(text: str, group: int) -> str:
        return f"regexp_extract({text}, {lit(_SPLIT)}, {group})"

    def suffix(query: str) -> str:
        return f"if({query} = '', '', concat('?', {query})), if(u.f = '', '', concat('#', u.f))"

    src, root = _tidy(ref), _tidy(base)
    fields = (
        f"named_struct('base', {base}, 'ref', {ref}, 's', lower({part(src, 1)}), 'a', {part(src, 2)}, "
        f"'p', regexp_replace({part(src, 3)}, ';[^/]*$', ''), 'x', regexp_extract({part(src, 3)}, ';[^/]+$', 0), 'q', {part(src, 4)}, 'f', {part(src, 5)}, 'bs', lower({part(root, 1)}), "
        f"'ba', {part(root, 2)}, 'bp', {part(root, 3)}, 'bq', {part(root, 4)})"
    )
    body = (
        "case when coalesce(u.base, '') = '' then u.ref when coalesce(u.ref, '') = '' then u.base "
        f"when {_bad_brackets('u.a')} then u.ref "
        "when u.s <> '' and u.s <> u.bs then u.ref "
        f"when u.a <> '' then concat(u.bs, '://', u.a, u.p, u.x, {suffix('u.q')}) "
        f"when u.p = '' and u.x = '' then concat(u.bs, '://', u.ba, u.bp, {suffix('if(u.q = \'\', u.bq, u.q)')}) "
        f"when startswith(u.p, '/') and not u.p rlike {lit('(?:^|/)[.][.]?(?:/|$)')} "
        f"then concat(u.bs, '://', u.ba, u.p, u.x, {suffix('u.q')}) "
        f"else concat(u.bs, '://', u.ba, {_merge_paths('u.bp', 'u.p')}, u.x, {suffix('u.q')}) end"
    )
    return let("u", fields, body)
