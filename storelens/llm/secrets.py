"""Secrets in whole texts, told apart by how many owners hold them. Built-in SQL functions only.

Base spans follow fixed patterns: assigned values, access keys and long hexadecimal runs. Beside them the method
collects opaque candidates (long runs of mixed letters and digits outside base spans). All values are hashed and
counted over the whole corpus by distinct repositories and owners: a value that many owners hold is a copied
example, one that fewer hold looks like a live credential (leaked, and perhaps mirrored). Opaque candidates of fewer
owners than an example has become spans of kind ``live``; base spans stay whatever their frequency.

Texts are searched where they are read; what is shuffled are hashes and offsets. Counting distinct owners combines
before the shuffle, so a value that a third of all rows hold is a few rows per task.

Null and empty texts have no spans. Null owners and repositories count as one value. Repeated rows get equal spans
and count once for their owner. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.session import stored

# Fixed patterns (quotes as \x22 and \x27); shorter matches of the first are dropped after matching, because
# the search must go on behind them. The others match whole runs, so the least length can be part of the pattern.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
OPAQUE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
)
#: Kinds in the order they are listed.
KINDS = ("assign", "access", "hex", "live")
#: A value of at least so many owners is a copied example; any other looks live.
EXAMPLE_OWNERS = 3
SPANS = "array<struct<s:int,e:int,v:string>>"


def located(text: str, pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern as ``array<struct<s, e, v>>``: start, end, text of a group."""
    found = f"""
        aggregate(
            arrays_zip(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0),
                       regexp_extract_all({text}, r'{pattern}', {group})),
            named_struct('at', 0, 'out', cast(array() as {SPANS})),
            (acc, z) -> named_struct(
                'at', acc.at + length(z.`0`) + coalesce(length(z.`1`), 0),
                'out', if(z.`1` is null, acc.out, array_append(acc.out, named_struct(
                    's', acc.at + length(z.`0`), 'e', acc.at + length(z.`0`) + length(z.`1`), 'v', z.`2`)))),
            acc -> acc.out)"""
    return f"case when {text} rlike r'{pattern}' then {found} else cast(array() as {SPANS}) end"


def _kind(spans: str, number: int) -> str:
    return f"transform({spans}, x -> named_struct('s', x.s, 'k', {number}, 'e', x.e, 'd', sha2(x.v, 256)))"


def _text(spans: str) -> str:
    """Spans (structs s, k, e) as ``kind:start:end``, comma-joined in the order of the array."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """``(id_col, text_hash, base, live, n_live, n_example)``, one row per input row.

    ``base`` and ``live`` are arrays of ``(s, k, e)``: start, place of the kind in ``KINDS``, end, in order of start
    and kind. ``n_live`` counts the values of any kind that fewer than ``EXAMPLE_OWNERS`` owners hold, ``n_example`` the others.
    """
    repository = ", ".join(f"cast(`{c}` as string)" for c in repository_cols)
    read = docs.selectExpr(
        f"`{id_col}` as _id",
        f"coalesce(cast(`{text_col}` as string), '') as t",
        f"coalesce(cast(`{owner_col}` as string), '') as owner",
        f"to_json(struct({repository})) as repository",
    )
    spans = read.selectExpr(
        "_id",
        "owner",
        "repository",
        "xxhash64(t) as text_hash",
        f"filter({located('t', ASSIGN, 2)}, x -> length(x.v) >= {LEAST_VALUE}) as assign",
        f"{located('t', ACCESS)} as access",
        f"{located('t', HEX)} as hex",
        f"{located('t', OPAQUE)} as opaque",
    )
    spans = spans.selectExpr(
        "_id", "owner", "repository", "text_hash",
        f"array_sort(concat({_kind('assign', 0)}, {_kind('access', 1)}, {_kind('hex', 2)})) as base",
        f"{_kind('opaque', 3)} as opaque",
    )
    outside = "filter(opaque, o -> not exists(base, b -> b.s < o.e and o.s < b.e))"
    found = stored(spans.withColumn("opaque", F.expr(outside)), "spans")
    # Rows of one text by one id have the same spans: the key names both.
    key = "concat(coalesce(cast(_id as string), '~'), ':', text_hash)"
    values = found.where("size(base) + size(opaque) > 0").selectExpr(
        f"{key} as row_key", "owner", "repository", "explode(concat(base, opaque)) as x"
    )
    held = values.groupBy("x.d").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")
    )
    told = values.join(held, values["x.d"] == held["d"]).select("row_key", "x", "owners", "repositories")
    per_row = told.groupBy("row_key").agg(
        F.expr(f"array_sort(collect_set(case when x.k = 3 and owners < {EXAMPLE_OWNERS} then x end)) as live"),
        F.expr(f"count(distinct case when owners < {EXAMPLE_OWNERS} then x end) as n_live"),
        F.expr(f"count(distinct case when owners >= {EXAMPLE_OWNERS} then x end) as n_example"),
    )
    plain = "transform({0}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    joined = found.withColumn("row_key", F.expr(key)).join(per_row, "row_key", "left")
    return joined.selectExpr(
        f"_id as `{id_col}`",
        "text_hash",
        f"{plain.format('base')} as base",
        f"coalesce({plain.format('live')}, array()) as live",
        "coalesce(n_live, 0) as n_live",
        "coalesce(n_example, 0) as n_example",
    )


def summarised(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, checksum of the base spans, and all spans as text."""
    counts = [f"cast(size(filter(base, x -> x.k = {k})) as bigint) as n_{KINDS[k]}" for k in range(3)]
    return found.selectExpr(
        f"`{id_col}`",
        *counts,
        f"sha2({_text('base')}, 256) as base_sha256",
        f"{_text('array_sort(concat(base, live))')} as spans",
        "n_live",
        "n_example",
    )


def masked(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """SQL for a text with its spans (in order of start) replaced by a mark; overlapping spans share one."""
    return f"""
        case when size({spans}) = 0 then {text} else aggregate({spans},
            named_struct('at', 0, 'out', ''),
            (acc, x) -> case when x.s >= acc.at then named_struct(
                    'at', x.e, 'out', concat(acc.out, substring({text}, acc.at + 1, x.s - acc.at), '{mark}'))
                else named_struct('at', greatest(acc.at, x.e), 'out', acc.out) end,
            acc -> concat(acc.out, substring({text}, acc.at + 1))) end"""
