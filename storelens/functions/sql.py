"""Small helpers for expressions written as SQL text.

Every function below ``storelens.functions`` takes and returns SQL text, to be used with ``selectExpr``, ``F.expr`` or
inside a query. One string per column costs one call into the JVM, where the same tree built from Column
objects costs thousands.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

NO_TEXT = "cast(array() as array<string>)"


def lit(text: str) -> str:
    """String literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r") + "'"


def lits(texts: Iterable[str]) -> str:
    """Comma-separated string literals."""
    return ", ".join(map(lit, texts))


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def either(conditions: Iterable[str]) -> str:
    return "(" + " or ".join(conditions) + ")"


def rows_of(table: DataFrame, *keys: str, **value: str) -> DataFrame:
    """One row per element of an array: ``keys``, its position ``pos`` and the element under the given name.

    The outer form is used because the plain one makes the optimiser copy the array expression into a filter
    below, which would compute it twice.
    """
    ((name, array),) = value.items()
    return table.selectExpr(*keys, f"posexplode_outer({array}) as (pos, {name})").where("pos is not null")
