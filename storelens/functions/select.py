"""Selectors over the node array of a page: no join and no shuffle.

A selector is a function from the name of a node to a SQL condition, so any expression can serve; the helpers
below cover tags, classes, attributes and their combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sql import either, lit, lits

Predicate = Callable[[str], str]


@dataclass(frozen=True)
class Inside:
    """Descendant selector: nodes matching ``node`` below a node matching ``ancestor``."""

    ancestor: Predicate
    node: Predicate


Selector = Predicate | Inside


def tag(*names: str) -> Predicate:
    return lambda n: f"{n}.tag in ({lits(names)})"


def cls(*names: str) -> Predicate:
    """Any of the classes (case-sensitive)."""
    if len(names) == 1:
        return lambda n: f"array_contains({n}.classes, {lit(names[0])})"
    return lambda n: f"arrays_overlap({n}.classes, array({lits(names)}))"


def tag_cls(name: str, klass: str) -> Predicate:
    return lambda n: f"({n}.tag = {lit(name)} and array_contains({n}.classes, {lit(klass)}))"


def attr_contains(name: str, attr: str, part: str) -> Predicate:
    """``name[attr*="part"]``, case-sensitive."""
    return lambda n: f"({n}.tag = {lit(name)} and coalesce(contains({n}.attrs[{lit(attr)}], {lit(part)}), false))"


def any_of(*predicates: Predicate) -> Predicate:
    return lambda n: either(p(n) for p in predicates)


def inner(nodes: str, node: str) -> str:
    """Descendants of ``node``: the slice that follows it."""
    return f"slice({nodes}, {node}.id + 2, {node}.last - {node}.id)"


def select(nodes: str, selector: Selector) -> str:
    """All matching nodes in document order."""
    if not isinstance(selector, Inside):
        return f"filter({nodes}, n -> {selector('n')})"
    above = f"filter({nodes}, n -> {selector.ancestor('n')})"
    below = f"transform(filter({inner(nodes, 'above')}, n -> {selector.node('n')}), n -> n.id)"
    ids = f"array_sort(array_distinct(flatten(transform({above}, above -> {below}))))"
    return f"transform({ids}, i -> get({nodes}, i))"


def select_first(nodes: str, selector: Selector) -> str:
    """First match in document order, NULL without one."""
    return f"get({select(nodes, selector)}, 0)"


def select_priority(nodes: str, selectors: Sequence[Selector]) -> str:
    """First match of the first selector, in list order, that matches anything."""
    return f"coalesce({', '.join(select_first(nodes, s) for s in selectors)})"


def next_sibling(nodes: str, node: str) -> str:
    """First later sibling of ``node`` among ``nodes`` (already narrowed to the wanted tags)."""
    return f"get(filter({nodes}, n -> n.parent = {node}.parent and n.id > {node}.last), 0)"


def by_parent(nodes: str) -> str:
    """Nodes sorted by (parent, id), for ``next_sibling_sorted``: siblings become neighbours."""
    parent = "coalesce({0}.parent, -2147483648)"
    order = (
        f"case when {parent.format('x')} < {parent.format('y')} then -1 when {parent.format('x')} > {parent.format('y')} then 1 "
        "when x.id < y.id then -1 when x.id > y.id then 1 else 0 end"
    )
    return f"array_sort({nodes}, (x, y) -> {order})"


def next_sibling_sorted(ordered: str, node: str) -> str:
    """First later sibling of ``node`` among ``ordered`` (``by_parent`` of the wanted nodes), by binary search.

    The first entry after ``(parent, id)`` of the node either has the same parent, and then it is the next sibling
    (a node of the same parent after it cannot lie inside it), or there is none. log2(n) + 1 halvings per node
    instead of a scan of all candidates, so a page with many questions is no longer quadratic.
    """
    key = f"coalesce({node}.parent, -2147483648)"
    mid = "cast((s.lo + s.hi) div 2 as int)"
    probe = f"element_at({ordered}, {mid} + 1)"
    after = f"(coalesce({probe}.parent, -2147483648) > {key} or (coalesce({probe}.parent, -2147483648) = {key} and {probe}.id > {node}.id))"
    search = (
        f"aggregate(sequence(0, cast(ceil(log2(size({ordered}) + 1)) as int)), named_struct('lo', 0, 'hi', size({ordered})), "
        f"(s, _) -> if(s.lo >= s.hi, s, if({after}, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid} + 1, 'hi', s.hi))), "
        "s -> s.lo)"
    )
    return f"get(filter(array(get({ordered}, {search})), n -> n.parent = {node}.parent), 0)"


def node_text(visible_text: str, node: str) -> str:
    """Text of a subtree, cut from the page text."""
    return f"substring({visible_text}, {node}.t0 + 1, {node}.t1 - {node}.t0)"


def attr(node: str, *names: str) -> str:
    """First non-empty attribute of the given names."""
    return f"coalesce({', '.join(f'nullif({node}.attrs[{lit(n)}], \'\')' for n in names)})"


# --- the same operators over the node table (one row per node), for ad-hoc queries ---


def select_nodes(nodes: DataFrame, selector: Selector, page: str = "page_id") -> DataFrame:
    """Matching rows of a node table.

    Node intervals nest, so a node lies below some ancestor exactly when the largest ``last`` among the
    ancestors before it reaches its id: one sorted pass per page instead of an interval join.
    """
    rows = nodes.alias("n")
    if not isinstance(selector, Inside):
        return rows.where(selector("n"))
    before = Window.partitionBy(page).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.expr(f"case when {selector.ancestor('n')} then n.last end")
    return (
        rows.where(f"{selector.ancestor('n')} or {selector.node('n')}")
        .withColumn("_reach", F.max(ends).over(before))
        .where(f"_reach >= n.id and {selector.node('n')}")
        .drop("_reach")
    )


def next_sibling_nodes(nodes: DataFrame, start: Predicate, wanted: Predicate, page: str = "page_id") -> DataFrame:
    """Rows matching ``start`` with the next later sibling matching ``wanted`` as struct ``sibling``."""
    after = (
        Window.partitionBy(page, "parent").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    hit = F.expr(f"case when {wanted('n')} then struct(n.id, n.last, n.tag, n.t0, n.t1) end")
    return (
        nodes.alias("n")
        .where(f"{start('n')} or {wanted('n')}")
        .withColumn("sibling", F.last(hit, ignorenulls=True).over(after))
        .where(f"{start('n')} and sibling is not null")
    )
