"""Mixing sources to target weights by soft membership. Built-in SQL functions only.

A classifier learnt from a table of labelled texts gives every document a chance for each domain. Documents then get
nonnegative rates (expected copies) such that the expected token totals of the domains match their target weights.

The classifier is naive Bayes over hashed words. It learns from a bounded sample of the labelled rows, so its model
has a fixed size (buckets times domains) and travels as constants. Evidence is the mean over all words of a text,
counted as ``EVIDENCE`` words at most, so that long texts keep soft chances.

Rates solve a weighted least-squares problem: with totals A_k = sum of p_dk n_d r_d and targets T_k, minimise sum of
(A_k - T_k)^2 / (2 T c_k) + RIDGE / 2 * sum of n_d (r_d - 1)^2 over least <= r_d <= most, where n_d are tokens, c_k is
the present share of domain k and T the total. RIDGE is so small that targets are met wherever rates exist that meet
them; it picks the rates nearest to one among those. The optimum is r_d = 1 - sum of p_dk x_k, cut to the bounds, for K
numbers x that minimise a convex piecewise quadratic function (the dual). They are found by Newton steps with
halving: one aggregate over a narrow stored table gives the value, K totals and K^2 second moments, so no rates are
written between steps. Steps end when the optimum's equations hold to ``TOLERANCE`` of all tokens; ``STEPS`` passes
without that are an error. Targets that no rates within the bounds meet are reported by a warning.

With ``growth=None`` the sum of the totals is free: the optimum over it too needs x . targets = 0, a plane in which the
same steps run. With rates of at least one this is the growth the data need to reach the targets by repeating alone.

Null and empty texts have no tokens and the chances of the prior; their rate counts like any other. Repeated rows
get equal rates. Without labelled texts, or with one domain only, all chances are equal and every rate is 1 (or
what the targets say of a single domain). Targets of domains nobody labelled are left out, the others rescaled.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.session import stored

BUCKETS = 2048
#: Bound of the labelled sample, rows per domain.
LABELLED_ROWS = 4000
EVIDENCE = 40
RIDGE = 1e-6
#: Passes over the documents, at most; beyond them the fit is an error.
STEPS = 200
#: What is left of the optimum's equations, and of the targets without a warning, as shares of all tokens.
TOLERANCE = 1e-8
REPORTED = 1e-4
WORDS = r"[^\x20\x09-\x0D]+"


def _buckets(text: str) -> str:
    words = f"regexp_extract_all(coalesce(cast({text} as string), ''), r'{WORDS}', 0)"
    return f"transform({words}, w -> cast(pmod(xxhash64(w), {BUCKETS}) as int))"


def _constants(values) -> str:
    """Array of numbers, as one string that is cut up when the plan is made: thousands of literals fill the driver."""
    return "cast(split('" + ",".join(f"{v:.6f}" for v in values) + "', ',') as array<double>)"


def word_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, rows: int):
    """Domains in order, log priors, and log chances of every bucket per domain."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
    named = named.where("_id is not null and _domain is not null").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    domains = {r["_domain"]: r["n"] for r in named.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(domains)
    if not names:
        return [], [], []
    # A top-k per domain: tasks hand on their own first rows, so no domain is brought together.
    firsts = [named.where(F.col("_domain") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in names]
    sample = functools.reduce(DataFrame.unionByName, firsts)
    texts = docs.select(F.col(id_col).alias("_id"), F.expr(_buckets(f"`{text_col}`")).alias("b"))
    # The sample has at most `rows` narrow rows per domain.
    counted = (
        texts.join(F.broadcast(sample), "_id")
        .select("_domain", F.explode("b").alias("b"))
        .groupBy("_domain", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    import math

    counts = {k: [1.0] * BUCKETS for k in names}
    for r in counted:
        counts[r["_domain"]][r["b"]] += r["n"]
    logs = [[math.log(n / sum(counts[k])) for n in counts[k]] for k in names]
    total = sum(domains.values())
    return names, [math.log(domains[k] / total) for k in names], logs


def with_posteriors(docs: DataFrame, text_col: str, model) -> DataFrame:
    """Documents with ``n_tokens`` and ``chances`` (one per domain, adding up to 1)."""
    names, priors, logs = model
    if not names:
        return docs.withColumn("n_tokens", F.expr(f"cast(size({_buckets(f'`{text_col}`')}) as bigint)")).withColumn(
            "chances", F.expr("array(1d)")
        )
    sums = [
        f"{prior}D + {EVIDENCE}D / greatest(n_tokens, {EVIDENCE}) * "
        f"aggregate(_b, 0d, (a, i) -> a + element_at({_constants(log)}, i + 1))"
        for prior, log in zip(priors, logs, strict=True)
    ]
    hashed = docs.withColumn("_b", F.expr(_buckets(f"`{text_col}`"))).withColumn("n_tokens", F.expr("cast(size(_b) as bigint)"))
    scored = hashed.withColumn("_s", F.expr(f"array({', '.join(sums)})")).drop("_b")
    odds = scored.withColumn("_s", F.expr("transform(_s, x -> exp(x - array_max(_s)))"))
    return odds.withColumn("chances", F.expr("transform(_s, x -> x / aggregate(_s, 0d, (a, y) -> a + y))")).drop("_s")


def slope_sql(weights: list[float]) -> str:
    return "(" + " + ".join(f"chances[{k}] * {float(w)!r}D" for k, w in enumerate(weights)) + ")"


def rate_sql(weights: list[float], least: float, most: float | None = None) -> str:
    """SQL for the rate of a document from its ``chances``."""
    rate = f"greatest({float(least)!r}D, 1d - {slope_sql(weights)})"
    return rate if most is None else f"least({float(most)!r}D, {rate})"


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    labelled_rows: int = LABELLED_ROWS,
    least_rate: float = 0.0,
    growth: float | None = 1.0,
    steps: int = STEPS,
    most_rate: float | None = None,
) -> tuple[DataFrame, list[str]]:
    """``(id_col, text_hash, n_tokens, chances, rate)``, one row per input row, and the order of the domains.

    The totals add up to ``growth`` times the tokens there are, or to whatever the targets need with None. With
    ``least_rate=1`` nothing is thinned out: domains are only repeated.
    """
    model = word_model(docs, labels, id_col, text_col, domain_col, labelled_rows)
    text = f"coalesce(cast(`{text_col}` as string), '')"
    narrow = docs.selectExpr(f"`{id_col}` as _id", f"xxhash64({text}) as text_hash", f"{text} as _t")
    narrow = stored(with_posteriors(narrow, "_t", model).drop("_t"), "posteriors")
    size = max(len(model[0]), 1)
    goal = np.array([max(targets.get(k, 0.0), 0.0) for k in model[0]] or [1.0])
    weights = np.zeros(size)
    if goal.sum() > 0 and narrow.limit(1).count():
        weights = fitted(narrow, goal / goal.sum(), model[0], least_rate, most_rate, growth, steps)
    rated = narrow.withColumn("rate", F.expr(rate_sql(weights.tolist(), least_rate, most_rate)))
    return rated.withColumnRenamed("_id", id_col), model[0]


def _moments(narrow: DataFrame, weights: np.ndarray, least: float, most: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, totals per domain and second moments of the documents within the bounds, at the given weights."""
    size = len(weights)
    top = float("inf") if most is None else most
    rated = narrow.selectExpr(
        "n_tokens", "chances", f"1d - {slope_sql(weights.tolist())} as free", f"{rate_sql(weights.tolist(), least, most)} as rate"
    )
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    inside = f"free > {float(least)!r}D" + ("" if most is None else f" and free < {float(top)!r}D")
    sums = [
        # Half the square of the rate, and beyond a bound on along the tangent.
        "n_tokens * (rate * free - rate * rate / 2)",
        *[f"n_tokens * chances[{k}] * rate" for k in range(size)],
        *[f"case when {inside} then n_tokens * chances[{i}] * chances[{j}] end" for i, j in pairs],
    ]
    row = list(rated.agg(*[F.expr(f"coalesce(sum({x}), 0d)") for x in sums]).first())
    second = np.zeros((size, size))
    for (i, j), v in zip(pairs, row[1 + size :], strict=True):
        second[i, j] = second[j, i] = v
    return row[0], np.array(row[1 : 1 + size]), second


def fitted(narrow: DataFrame, goal: np.ndarray, names: list[str], least: float, most: float | None, growth: float | None, steps: int) -> np.ndarray:
    """Weights ``x`` of the optimal rates; ``goal`` are the target shares, adding up to one."""
    size = len(goal)
    tokens, shares = (lambda r: (r[0] or 1, np.array(r[1:])))(
        list(narrow.selectExpr("coalesce(sum(n_tokens), 0)", *[f"coalesce(sum(chances[{k}] * n_tokens), 0d)" for k in range(size)]).first())
    )
    ridge = RIDGE * np.maximum(shares / tokens, 1e-6)
    aim = goal * (growth or 0.0)
    # Directions the weights may take: all, or those at right angles to the targets.
    plane = np.eye(size) if growth is not None else np.linalg.svd(goal[None, :])[2][1:].T
    weights = np.zeros(size)

    def at(x: np.ndarray):
        value, totals, second = _moments(narrow, x, least, most)
        slope = aim - totals / tokens + ridge * x
        return value / tokens + aim @ x + x @ (ridge * x) / 2, plane.T @ slope, plane.T @ (second / tokens + np.diag(ridge)) @ plane, totals

    value, slope, curve, totals = at(weights)
    passes = 1
    while np.abs(slope).max(initial=0.0) > TOLERANCE:
        move, length = plane @ np.linalg.solve(curve, slope), 1.0
        gain = slope @ np.linalg.solve(curve, slope)
        while True:
            if passes >= steps:
                raise RuntimeError(f"mixing rates still off by {np.abs(slope).max():.2e} of all tokens after {passes} passes")
            tried = at(weights - length * move)
            passes += 1
            if tried[0] <= value - 1e-4 * length * gain + 1e-12 * max(1.0, abs(value)):
                break
            length /= 2
        weights = weights - length * move
        value, slope, curve, totals = tried
    reached = totals / max(totals.sum(), 1e-300) if growth is None else totals / tokens / growth
    if np.abs(reached - goal).max() > REPORTED:
        told = ", ".join(f"{k} {g:.4f} reached {r:.4f}" for k, g, r in zip(names or ["all"], goal, reached, strict=True))
        warnings.warn(f"no rates within the bounds meet the mixing targets: {told}", stacklevel=3)
    return weights


def copies_sql(rate: str, seed: int = 17, keys: str = "text_hash") -> str:
    """SQL for the whole number of copies of a document: its rate, rounded up or down by a hash of its keys."""
    chance = f"(pmod(xxhash64({keys}, {seed}), 1000003) / 1000003d)"
    return f"cast(floor({rate}) + if({chance} < {rate} - floor({rate}), 1, 0) as int)"
