"""Quality rules and robust multivariate outliers per language and source.

Every text gets exact base statistics and a base verdict. Texts that pass are judged once more by how unusual they
are: their statistics are transformed (logarithms, shares), the minimum-covariance-determinant estimate of centre
and spread is taken per group, and a text whose Mahalanobis distance is too large is rejected.

The estimate is FAST-MCD with deterministic starts. All of it are aggregates: one pass makes per-group sums, and the
h smallest distances are told by a histogram of their logarithms, so that a group of any size is never brought
together. Sums are taken over whole numbers (fixed-point values), so that they do not depend on the order of rows.
What is handed around between steps is a table with one row per group.

Null texts are empty texts (they fail the base rule). Null groups form a group of their own. Repeated rows count as
often as they occur. Groups of fewer than ``LEAST_ROWS`` base-passing texts, or without any spread, reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import buffers
from storelens.session import stored

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
#: Share of a group the estimate rests on, and concentration steps taken.
COVERAGE = 0.75
STEPS = 6
LEAST_ROWS = 40
#: Squared distance beyond which a text is an outlier: the 0.9999 quantile of chi-square with 4 degrees of freedom.
MOST_DISTANCE = 23.513
#: Chi-square quantile of COVERAGE at 4 degrees of freedom, and with 6 degrees: consistency of the trimmed spread.
FEATURES = ("size", "word_length", "symbols", "repeats")
QUANTILE, CONSISTENCY = 5.385, 0.505
#: Fixed-point unit of the transformed values, and bins per power of e of the squared distances.
UNIT = 1 << 12
BINS = 256
STATS = "struct<n_words:bigint, word_chars:bigint, n_symbols:bigint, n_dup_lines:bigint, n_repeat_words:bigint>"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def _equal_before(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks of entries whose key occurs at least twice in their group, and of those with an earlier equal."""
    order = np.lexsort((key, group))
    same = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same  # stable: earlier rows come first
    return twice, later


def _repeat_words(code: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words per row that lie in a window of five words found twice or more in the row."""
    n = len(code) - REPEAT_WINDOW + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    at = np.flatnonzero(rows[:n] == rows[REPEAT_WINDOW - 1 :])
    # Windows are told apart exactly: pairs get numbers, pairs of pairs get numbers, then the last word.
    pair = code[:-1] * (int(code.max()) + 1) + code[1:]
    number = np.unique(pair, return_inverse=True)[1]
    four = np.unique(number[at] * len(pair) + number[at + 2], return_inverse=True)[1]
    twice, _ = _equal_before(four * (int(code.max()) + 1) + code[at + 4], rows[at])
    covered = np.zeros(len(code) + 1, np.int64)
    starts = at[twice]
    covered[starts] += 1
    covered[starts + REPEAT_WINDOW] -= 1
    return np.bincount(rows[np.cumsum(covered[:-1]) > 0], minlength=n_rows)


def statistics(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Base statistics of every row of a slice of texts, in the order of ``STATS``."""
    n_rows = len(bounds) - 1
    starts, ends, rows = buffers.words(data, bounds)
    n_words = np.bincount(rows, minlength=n_rows)
    space = buffers.IS_SPACE[data]
    owner = np.repeat(np.arange(n_rows), np.diff(bounds))
    chars = np.bincount(owner[LEAD[data] & ~space], minlength=n_rows)
    symbols = np.bincount(owner[SYMBOL[data]], minlength=n_rows)
    # Lines: maximal runs without line feed that hold a word (an empty line holds none).
    line_starts, line_ends = buffers.runs(data != 10, bounds)
    filled = np.append(0, np.cumsum(~space))
    has_word = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = np.searchsorted(bounds, line_starts, "right") - 1
    dup_lines = np.zeros(n_rows, np.int64)
    if len(line_starts):
        line, _ = buffers.coded(data, line_starts, line_ends)
        _, later = _equal_before(line, line_rows)
        dup_lines = np.bincount(line_rows[later], minlength=n_rows)
    repeats = np.zeros(n_rows, np.int64)
    if len(starts):
        code, _ = buffers.coded(data, starts, ends)
        repeats = _repeat_words(code, rows, n_rows)
    return [n_words, chars, symbols, dup_lines, repeats]


def text_statistics(text: Column) -> Column:
    """Struct of the base statistics of a text column."""

    @F.arrow_udf(STATS)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for texts in batches:
            parts = [statistics(*piece) for piece in buffers.pieces(texts)]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return stats.asNondeterministic()(text.cast("string"))


def _features() -> list[str]:
    """Transformed statistics as fixed-point numbers, in the order of FEATURES."""
    forms = (
        "ln(1d + n_words)",
        "ln(1d + word_chars / greatest(n_words, 1))",
        "sqrt(n_symbols / greatest(word_chars, 1))",
        "sqrt((n_repeat_words + n_dup_lines) / greatest(n_words, 1))",
    )
    return [f"cast(round({UNIT} * {form}) as bigint) as x{k}" for k, form in enumerate(forms)]


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact sums of values and products per group."""
    sums = [F.expr(f"sum(x{i})").alias(f"s{i}") for i in range(P)]
    products = [F.expr(f"sum(cast(x{i} * x{j} as decimal(38,0)))").cast("double").alias(f"q{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums, *products)


def _estimates(moments: DataFrame, keys: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Centre, inverse spread (upper triangle) and log determinant per group, by numpy on one row per group."""
    names = [f"c{i}" for i in range(P)] + [f"w{i}{j}" for i, j in PAIRS] + ["log_det"]
    kept = [f.simpleString() for f in moments.select(*keys).schema.fields]
    schema = ", ".join([k.replace(":", " ", 1) for k in kept] + [f"{n} double" for n in names])
    n_keys = len(keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_keys, batch.num_columns)]
            m, sums, products = values[0], values[1 : P + 1], values[P + 1 :]
            centre = np.array([s / m for s in sums]).T
            spread = np.zeros((len(m), P, P))
            for (i, j), q in zip(PAIRS, products, strict=True):
                spread[:, i, j] = spread[:, j, i] = q / m - centre[:, i] * centre[:, j]
            floor = (UNIT / 200) ** 2  # values closer than half a hundredth are not told apart
            spread += np.eye(P) * floor
            if diagonal:
                spread *= np.eye(P)
            inverse = np.linalg.inv(spread)
            out = [centre[:, i] for i in range(P)] + [inverse[:, i, j] for i, j in PAIRS]
            out.append(np.linalg.slogdet(spread)[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(n_keys)] + [pa.array(x, pa.float64()) for x in out],
                list(batch.schema.names[:n_keys]) + names,
            )

    return moments.mapInArrow(solve, schema)


def _distance() -> str:
    terms = [
        f"{1 if i == j else 2} * w{i}{j} * (x{i} - c{i}) * (x{j} - c{j})" for i, j in PAIRS
    ]
    return "greatest(" + " + ".join(terms) + ", 0d)"


def _bin(distance: str) -> str:
    return f"cast(floor({BINS} * ln({distance} + 1e-9)) as int)"


def _concentrated(rows: DataFrame, estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of the rows of smallest distance that cover ``COVERAGE`` of each group (whole bins)."""
    near = rows.join(estimates, list(keys)).select(*keys, *[f"x{i}" for i in range(P)], F.expr(_distance()).alias("d"))
    near = near.withColumn("bin", F.expr(_bin("d")))
    binned = _moments(near, [*keys, "bin"])
    # Per group there are at most a few thousand bins, whatever its number of rows.
    window = f"(partition by {', '.join(keys)} order by bin rows between unbounded preceding and 1 preceding)"
    share = f"coalesce(sum(m) over {window}, 0) < {COVERAGE} * sum(m) over (partition by {', '.join(keys)})"
    kept = binned.withColumn("inside", F.expr(share)).where("inside")
    names = ["m"] + [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]
    return kept.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def robust_estimates(rows: DataFrame, keys: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate per group from rows with ``x0 .. x3``.

    Two deterministic starts, the classical and the coordinatewise one, are concentrated side by side; per group the
    one of smaller determinant counts.
    """
    starts = F.explode(F.array(F.lit(0), F.lit(1)))
    both = rows.select(*keys, *[f"x{i}" for i in range(P)], starts.alias("start"))
    grouped = [*keys, "start"]
    moments = stored(_moments(rows, keys), "moments")
    first = _estimates(moments, keys).withColumn("start", F.lit(0))
    second = _estimates(moments, keys, diagonal=True).withColumn("start", F.lit(1))
    current = stored(first.unionByName(second), "estimates")
    for _ in range(steps):
        current = stored(_estimates(_concentrated(both, current, grouped), grouped), "estimates")
    values = F.struct(*[f"c{i}" for i in range(P)], *[f"w{i}{j}" for i, j in PAIRS])
    return current.groupBy(*keys).agg(F.min_by(values, F.struct("log_det", "start")).alias("best")).select(*keys, "best.*")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: Sequence[str] = ("lang", "source"),
    most_distance: float = MOST_DISTANCE,
) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept)``.

    One row per input row. ``distance`` is the squared Mahalanobis distance (null where there is no estimate).
    """
    # One text names the group: a null is told apart from any value.
    group = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"g{k}") for k, c in enumerate(group_cols)]))
    keys = ["_group"]
    stats = docs.select(F.col(id_col).alias("_id"), group.alias("_group"), text_statistics(F.col(text_col)).alias("s"))
    stats = stats.select("_id", "_group", "s.*")
    failed = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"
    stats = stored(stats.selectExpr("*", f"{failed} as base_failed", *_features()), "statistics")
    passed = stats.where("not base_failed")
    estimates = robust_estimates(passed, keys)
    sizes = passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    estimates = stored(estimates.join(sizes, keys), "estimates")
    joined = stats.join(estimates, keys, "left")
    # The trimmed spread is too small by a known factor; without it too much would be rejected.
    distance = F.expr(f"case when group_rows >= {LEAST_ROWS} then {CONSISTENCY} * ({_distance()}) end")
    return joined.select(
        F.col("_id").alias(id_col),
        *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split(),
        distance.alias("distance"),
    ).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= most_distance))
