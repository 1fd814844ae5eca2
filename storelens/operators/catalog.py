"""Product catalogues: JSON payload -> typed products, per-store roll-up.

A payload is parsed once into a VARIANT; products stay an array in the row of their payload, so neither
parsing nor the roll-up shuffles. The rules say which malformed products are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sql import NO_TEXT, let, lit, rows_of
from storelens.functions.text import clean_text

PAGE_LIMIT = 250  # a payload with this many raw products has a next page

# Texts reported for a payload that is absent, unreadable or of the wrong shape.
WARN_MISSING = "Product catalog not accessible"
WARN_BAD_JSON = "Could not parse product catalog JSON"
ERROR_PREFIX = "Product catalog error: "

# Fields read from a product; each stays a VARIANT so that its JSON type can be checked.
FIELDS = "id title handle body_html vendor product_type tags variants images created_at updated_at".split()
_PRODUCTS = f"array<struct<{', '.join(f'{f}: variant' for f in FIELDS)}>>"
_VARIANTS = "array<struct<price: variant, compare_at_price: variant, available: variant>>"
_IMAGES = "array<struct<src: variant>>"

_ISO = r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
_EMPTY = "('false', '0', '0.0', '-0.0', '[]', '{}')"


def _get(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _typed(values: dict[str, str]) -> str:
    """Struct of ``(k, t)`` per value: JSON type (NULL when absent, VOID for null) and text (NULL for both)."""
    return f"named_struct({', '.join(f'{lit(n)}, struct(schema_of_variant({v}) as k, {_get(v, "string")} as t)' for n, v in values.items())})"


def _present(v: str) -> str:
    """Neither absent, null, false, zero nor an empty string, list or object."""
    return f"({v}.t is not null and {v}.t <> '' and ({v}.k = 'STRING' or {v}.t not in {_EMPTY}))"


def _string_or_none(v: str) -> str:
    return f"({v}.t is null or {v}.k = 'STRING')"


def scalar_text(v: str) -> str:
    """Text of a typed value: numbers keep a fraction (``30.0``), booleans are ``True``/``False``.

    A JSON null gives NULL. Lists and objects give their JSON text.
    """
    number = f"try_cast({v}.t as double)"
    plain = f"trim(trailing '0' from cast(cast({number} as decimal(38,10)) as string))"
    return (
        f"case when {v}.k = 'STRING' then {v}.t "
        f"when startswith({v}.k, 'DECIMAL') and not contains({v}.t, '.') and length({v}.t) < 19 then concat({v}.t, '.0') "
        f"when {v}.k = 'DOUBLE' and abs({number}) >= 1e7 and abs({number}) < 1e16 "
        f"then regexp_replace({plain}, '[.]$', '.0') "
        f"when {v}.k = 'BOOLEAN' then initcap({v}.t) else {v}.t end"
    )


def _integer(v: str) -> tuple[str, str]:
    """(valid, value) of a whole number, also as text, boolean or with a zero fraction."""
    text = f"trim(if({v}.k = 'BOOLEAN', if({v}.t = 'true', '1', '0'), {v}.t))"
    valid = f"({v}.t is null or {text} rlike {lit(r'^[+-]?\d+([.]0*)?(E\d+)?$')})"
    return valid, f"try_cast(try_cast({text} as decimal(38,0)) as bigint)"


def _moment(v: str) -> str:
    """Timestamp of ISO date-time text or epoch seconds (milliseconds when large)."""
    number = f"try_cast(if({v}.k = 'BOOLEAN', null, {v}.t) as double)"
    epoch = f"timestamp_seconds(if(abs({number}) > 2e10, {number} / 1000, {number}))"
    return f"if({v}.t rlike {lit(_ISO)}, try_to_timestamp(translate({v}.t, '_,', 'T.')), {epoch})"


def _list_of(field: str, kind: str) -> str:
    """Array of a uniform JSON list; NULL for anything else."""
    start = {"array<string>": "ARRAY<STRING>"}.get(kind, "ARRAY<OBJECT")
    return f"if(startswith(v.{field}.k, '{start}') or v.{field}.t = '[]', {_get(f'o.{field}', kind)}, null)"


def _whole(items: str) -> str:
    """True for a list whose elements all have the expected type."""
    return f"coalesce(not exists({items}, x -> x is null), false)"


def _product(fields: Sequence[str] | None) -> str:
    """Struct of the wanted fields of product ``o`` (``true`` for none); NULL when the product is malformed."""
    id_ok, ident = _integer("v.id")
    cleaned = {f: f"if({_present(f'v.{f}')}, {clean_text(f'v.{f}.t')}, '')" for f in ("title", "body_html")}
    available = f"exists(a.variants, x -> {let('c', _typed({'v': 'x.available'}), _present('c.v'))})"
    columns = {
        "id": ident,
        "title": cleaned["title"],
        "handle": "v.handle.t",
        "description": cleaned["body_html"],
        "vendor": "v.vendor.t",
        "product_type": "v.product_type.t",
        "tags": f"coalesce(a.tags, {NO_TEXT})",
        "price": f"if(size(a.variants) > 0, if(b.price.k is null, '', {scalar_text('b.price')}), null)",
        "compare_at_price": scalar_text("b.compare"),
        "available": f"coalesce({available}, false)",
        "images": "b.sources.t",
        "variants": f"coalesce({_get('o.variants', 'array<string>')}, {NO_TEXT})",
        "created_at": "b.created",
        "updated_at": "b.updated",
    }
    checks = [
        id_ok,
        *[f"(not {_present(f'v.{f}')} or v.{f}.k = 'STRING')" for f in ("title", "body_html")],
        *[_string_or_none(f"v.{f}") for f in ("handle", "vendor", "product_type")],
        f"(v.tags.k is null or {_whole('a.tags')})",
        f"(v.variants.k is null or {_whole('a.variants')})",
        f"(not {_present('v.images')} or ({_whole('a.images')} and forall(b.sources, x -> x.k = 'STRING')))",
        f"({_string_or_none('b.compare')} or {_present('b.compare')})",
        *[f"(v.{f}_at.t is null or b.{f} is not null)" for f in ("created", "updated")],
    ]
    wanted = [c for c in columns if fields is None or c in fields]
    product = f"named_struct({', '.join(f'{lit(c)}, {columns[c]}' for c in wanted)})" if wanted else "true"
    sources = f"filter(transform(a.images, x -> {let('s', _typed({'v': 'x.src'}), 's.v')}), s -> {_present('s')})"
    first = "get(a.variants, 0)"
    b = (
        f"named_struct('price', p.price, 'compare', p.compare, 'sources', coalesce({sources}, array()), "
        f"'created', {_moment('v.created_at')}, 'updated', {_moment('v.updated_at')})"
    )
    prices = _typed({"price": f"{first}.price", "compare": f"{first}.compare_at_price"})
    a = (
        f"named_struct('tags', {_list_of('tags', 'array<string>')}, 'variants', {_list_of('variants', _VARIANTS)}, "
        f"'images', {_list_of('images', _IMAGES)})"
    )
    result = let("a", a, let("p", prices, let("b", b, f"if({' and '.join(checks)}, {product}, null)")))
    return f"if(o is null, null, {let('v', _typed({f: f'o.{f}' for f in FIELDS}), result)})"


def read_catalog(catalogs: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``catalog_status`` and the raw ``_products`` of each payload.

    Status: ``parsed``, ``missing`` (NULL payload), ``bad_json``, or ``error`` (JSON of another shape). A product
    that is no object becomes NULL.
    """
    products = (
        f"case when not startswith(schema_of_variant(_doc), 'OBJECT') then null "
        f"when try_variant_get(_doc, '$.products', 'variant') is null then cast(array() as {_PRODUCTS}) "
        f"else try_variant_get(_doc, '$.products', '{_PRODUCTS}') end"
    )
    status = (
        f"case when {payload} is null then 'missing' when _doc is null then 'bad_json' "
        "when _products is null then 'error' else 'parsed' end"
    )
    return (
        catalogs.withColumn("_doc", F.try_parse_json(payload))
        .withColumn("_products", F.expr(products))
        .withColumn("catalog_status", F.expr(status))
        .drop("_doc")
    )


def parse_products(
    catalogs: DataFrame,
    payload: str = "payload",
    page_limit: int = PAGE_LIMIT,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``products``, ``total_products``, ``has_more`` and ``catalog_status`` to a payload table.

    Totals count the products that survive, ``has_more`` looks at the raw number. The price is that of the first
    variant: absent gives ``''`` and a JSON null gives NULL; a product without variants has no price and is
    unavailable. ``fields`` limits what is built of each product; all products are checked in full.
    """
    kept = f"filter(transform(_products, o -> {_product(fields)}), p -> p is not null)"
    return (
        read_catalog(catalogs, payload)
        .withColumn("products", F.expr(kept))
        .withColumns(
            {
                "total_products": F.expr("coalesce(cast(size(products) as bigint), 0)"),
                "has_more": F.expr(f"coalesce(size(_products) >= {page_limit}, false)"),
            }
        )
        .drop("_products", payload)
    )


def catalog_products(catalogs: DataFrame, keys: tuple[str, ...] = ("store_url",)) -> DataFrame:
    """One row per surviving product with its position in the catalogue."""
    return rows_of(parse_products(catalogs), *keys, p="products").select(*keys, "pos", "p.*")


def catalog_rollup(catalogs: DataFrame, keys: tuple[str, ...] = ("store_url",)) -> DataFrame:
    """Status, surviving products and ``has_more`` per payload."""
    return parse_products(catalogs, fields=()).select(*keys, "catalog_status", "total_products", "has_more")
