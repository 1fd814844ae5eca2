"""Vector code compression: integer product quantisation, trained by k-means with Drake-Hamerly adaptive bounds.

Rows whose vector is null or holds a null or non-finite component are left out. Every component x becomes the
integer floor(256 * x); a vector is cut into ``parts`` equal consecutive parts, and each part position has its own
codebook of at most ``entries`` entries. The codebooks start as those parts of the ``entries`` kept vectors with the
smallest vec_ids (ascending; fewer entries if fewer vectors). Each of ``rounds`` rounds assigns every part to the
nearest entry of its codebook (squared Euclidean distance, ties to the lower index) and then sets every entry to
the componentwise floor of the mean of its parts; an entry no part chose stays. A last assignment gives the codes.

Vectors of several lengths get one quantiser per length (each with its own seeds); a length that is not a positive
multiple of ``parts`` cannot be cut into equal parts, and such rows get a null code and error.

Drake-Hamerly bounds: beside its assignment, every (vector, part) keeps an upper bound on the distance to its entry,
the ``b`` next-closest entries with lower bounds on their distances (in rising order when set), and one outer lower
bound for all other entries. After the entries move, bounds grow and shrink by the moves (the outer one by the
largest move). A part whose upper bound lies below all its lower bounds keeps its entry without any distance; an
uncertain part computes the exact integer distances to its entry and its ``b`` tracked entries, and only when the
best of those does not lie below the outer bound the distances to all entries. ``b`` adapts: each round it shrinks
to one more than the deepest tracked place at which a new nearest entry was found (at least 2). The state is a
stored table, so a lost executor recomputes one round, not the whole training. Bounds are doubles with a relative
margin; every decision that they do not settle with that margin is taken on integers.

Means are sums of integers in Spark (partial aggregation over (part, entry, position): the codebooks are the only
thing that reaches the driver, ``parts * entries * width`` integers).

Rows: one per kept input row, extra columns and repeated rows included (repeated rows are separate vectors). A null
vec_id is coded like any other vector but never seeds an entry. ``label_error`` sums the error over the rows of the
same label, nulls together. Components must satisfy |256 x| < 2^31 so that squared distances fit in 64 bits.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.session import narrow_join, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Tracked entries per part at the start; it adapts downwards.
TRACKED = 8
MARGIN = 1e-9
STATE = (
    "vec_id bigint, label int, n int, x array<bigint>, assign array<int>, dist array<bigint>, upper array<double>, "
    "tracked array<int>, lower array<double>, outer array<double>, deepest int"
)


def _nearest_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (rows, width) to all entries (entries, width)."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def _rows_of(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The lists of some rows of a list column as one matrix (all those rows hold lists of one length)."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    width = int(offsets[rows[0] + 1] - offsets[rows[0]]) if len(rows) else 0
    return values[offsets[rows][:, None] + np.arange(width)]


def _list_column(parts: list[tuple[np.ndarray, np.ndarray]], n_rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from matrices of some rows each; rows in none of them are null."""
    widths = np.zeros(n_rows, np.int64)
    for rows, matrix in parts:
        widths[rows] = matrix.shape[1]
    offsets = np.zeros(n_rows + 1, np.int64)
    np.cumsum(widths, out=offsets[1:])
    values = np.zeros(int(offsets[-1]), kind.to_pandas_dtype())
    present = np.zeros(n_rows, bool)
    for rows, matrix in parts:
        values[offsets[rows][:, None] + np.arange(matrix.shape[1])] = matrix
        present[rows] = True
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=pa.array(~present)).cast(pa.list_(kind))


def _assign(books: dict, drift: dict, b: int):
    """One assignment of every part of every vector, with the bounds carried from the last one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_rows = batch.num_rows
            if not n_rows:
                continue
            cols = {name: batch.column(name) for name in batch.schema.names}
            lengths = cols["n"].to_numpy(zero_copy_only=False)
            first = cols["assign"].null_count == n_rows
            out = {k: [] for k in ("assign", "dist", "upper", "tracked", "lower", "outer")}
            deepest = -1
            for length in np.unique(lengths):
                book = books.get(int(length))
                rows = np.flatnonzero(lengths == length)
                if book is None:
                    continue
                x = _rows_of(cols["x"], rows).astype(np.int64).reshape(len(rows), PARTS, -1)
                if not first:
                    old = {name: _rows_of(cols[name], rows) for name in ("assign", "upper", "outer")}
                    old_tracked = _rows_of(cols["tracked"], rows).reshape(len(rows), PARTS, -1).astype(np.int64)
                    old_lower = _rows_of(cols["lower"], rows).reshape(len(rows), PARTS, -1)
                k = book.shape[1]
                keep = min(b, k - 1)
                assign = np.zeros((len(rows), PARTS), np.int64)
                dist = np.zeros((len(rows), PARTS), np.int64)
                upper = np.zeros((len(rows), PARTS))
                tracked = np.zeros((len(rows), PARTS, keep), np.int64)
                lower = np.zeros((len(rows), PARTS, keep))
                outer = np.full((len(rows), PARTS), np.inf)
                move = drift.get(int(length))
                for p in range(PARTS):
                    xp, bp = x[:, p, :], book[p]
                    full = np.ones(len(rows), bool)
                    if not first and move is not None:
                        a0 = old["assign"][:, p].astype(np.int64)
                        t0, l0 = old_tracked[:, p, :], old_lower[:, p, :]
                        u = old["upper"][:, p] + move[p][a0]
                        lo = (l0 - move[p][t0]) if t0.size else np.zeros((len(rows), 0))
                        out0 = old["outer"][:, p] - move[p].max()
                        least = np.minimum(lo.min(1) if lo.shape[1] else np.inf, out0)
                        sure = u * (1 + MARGIN) + MARGIN < least
                        # Settled by the bounds: the entry stays; its exact distance is one dot product.
                        da = ((xp - bp[a0]) ** 2).sum(1)
                        unsure = np.flatnonzero(~sure)
                        candidates = np.concatenate([a0[:, None], t0], 1) if t0.size else a0[:, None]
                        exact = ((xp[unsure, None, :] - bp[candidates[unsure]]) ** 2).sum(2)
                        key = exact * (k + 1) + candidates[unsure]  # ties to the lower index
                        at = key.argmin(1)
                        best = exact[np.arange(len(unsure)), at]
                        resolved = np.sqrt(best) * (1 + MARGIN) + MARGIN < out0[unsure]
                        if resolved.any():
                            deepest = max(deepest, int(at[resolved].max()))
                        full[:] = False
                        full[unsure[~resolved]] = True
                        fixed = np.flatnonzero(sure)
                        assign[fixed, p], dist[fixed, p] = a0[fixed], da[fixed]
                        upper[fixed, p], outer[fixed, p] = u[fixed], out0[fixed]
                        if keep:
                            tracked[fixed, p], lower[fixed, p] = t0[fixed][:, :keep], lo[fixed][:, :keep]
                            if lo.shape[1] > keep:
                                outer[fixed, p] = np.minimum(outer[fixed, p], lo[fixed][:, keep:].min(1))
                        settled = unsure[resolved]
                        if len(settled):
                            order = np.argsort(key[resolved], 1, kind="stable")
                            chosen = candidates[settled][np.arange(len(settled))[:, None], order]
                            near = np.sqrt(np.take_along_axis(exact[resolved], order, 1).astype(float))
                            assign[settled, p], dist[settled, p] = chosen[:, 0], best[resolved]
                            upper[settled, p] = near[:, 0]
                            rest = near[:, 1:]
                            if keep:
                                tracked[settled, p] = chosen[:, 1 : keep + 1]
                                lower[settled, p] = rest[:, :keep]
                            tail = rest[:, keep:].min(1) if rest.shape[1] > keep else np.full(len(settled), np.inf)
                            outer[settled, p] = np.minimum(out0[settled], tail)
                    everything = np.flatnonzero(full)
                    if len(everything):
                        d = _nearest_all(xp[everything], bp)
                        order = np.argsort(d, 1, kind="stable")  # stable: equal distances keep the lower index first
                        near = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
                        assign[everything, p], dist[everything, p] = order[:, 0], d[np.arange(len(everything)), order[:, 0]]
                        upper[everything, p] = near[:, 0]
                        tracked[everything, p], lower[everything, p] = order[:, 1 : keep + 1], near[:, 1 : keep + 1]
                        outer[everything, p] = near[:, keep + 1] if k > keep + 1 else np.inf
                for name, matrix in (("assign", assign), ("dist", dist), ("upper", upper), ("outer", outer)):
                    out[name].append((rows, matrix))
                out["tracked"].append((rows, tracked.reshape(len(rows), -1)))
                out["lower"].append((rows, lower.reshape(len(rows), -1)))
            kinds = {"assign": pa.int32(), "dist": pa.int64(), "upper": pa.float64(), "tracked": pa.int32(), "lower": pa.float64(), "outer": pa.float64()}
            arrays = [cols["vec_id"], cols["label"], cols["n"], cols["x"]]
            arrays += [_list_column(out[name], n_rows, kind) for name, kind in kinds.items()]
            arrays += [pa.array(np.full(n_rows, deepest, np.int32))]
            names = ["vec_id", "label", "n", "x", "assign", "dist", "upper", "tracked", "lower", "outer", "deepest"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return step


def _seeds(kept: DataFrame, entries: int) -> dict:
    """Codebooks of every vector length: parts of the ``entries`` smallest vec_ids."""
    books = {}
    lengths = [r.n for r in kept.select("n").distinct().collect()]  # one row per vector length
    for length in sorted(lengths):
        if length <= 0 or length % PARTS:
            continue
        first = kept.where(F.col("n") == length).where("vec_id is not null")
        rows = first.orderBy("vec_id", "x").limit(entries).select("x").collect()
        if rows:
            books[length] = np.array([r.x for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()
    return books


def _means(state: DataFrame, books: dict) -> dict:
    """Entries after one round: componentwise floor of the mean of their parts; unused entries stay."""
    parts = state.where("assign is not null").select("n", F.posexplode("x").alias("pos", "value"), "assign").select(
        "n",
        F.expr(f"cast(pos div (n div {PARTS}) as int)").alias("part"),
        F.expr(f"pos % (n div {PARTS})").alias("at"),
        F.expr(f"assign[cast(pos div (n div {PARTS}) as int)]").alias("entry"),
        "value",
    )
    sums = parts.groupBy("n", "part", "entry", "at").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("count"))
    new = {length: book.copy() for length, book in books.items()}
    for n, part, entry, at, total, count in sums.collect():  # at most parts * entries * width rows per length
        new[n][part, entry, at] = total // count  # Python's floor division: floors go down
    return new


def train_codes(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    tracked: int = TRACKED,
) -> tuple[DataFrame, dict]:
    """Final state of every kept vector (assignment and exact distances per part) and the codebooks per length."""
    finite = f"{vector_col} is not null and not exists({vector_col}, v -> v is null or isnan(v) or v in (double('inf'), double('-inf')))"
    kept = embeddings.where(finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("int").alias("label"),
        F.size(vector_col).alias("n"),
        F.expr(f"transform({vector_col}, v -> cast(floor({SCALE} * cast(v as double)) as bigint))").alias("x"),
    )
    blank = [F.lit(None).cast(t).alias(c) for c, t in (
        ("assign", "array<int>"), ("dist", "array<bigint>"), ("upper", "array<double>"),
        ("tracked", "array<int>"), ("lower", "array<double>"), ("outer", "array<double>"))]
    state = stored(kept.select("*", *blank, F.lit(-1).alias("deepest")), "codes-input")
    books = _seeds(state, entries)
    drift, b = {}, tracked
    for _ in range(rounds + 1):
        state = stored(state.mapInArrow(_assign(books, drift, b), STATE), "codes-state")
        if _ == rounds:
            break
        new = _means(state, books)
        drift = {n: np.sqrt(((new[n] - books[n]) ** 2).sum(2).astype(float)) for n in books}
        deepest = state.agg(F.max("deepest")).first()[0]
        b = max(2, min(b, (deepest if deepest is not None and deepest >= 0 else b) + 1))
        books = new
    return state, books


def codebooks_digest(books: dict) -> str:
    """SHA-256 of all entries' components by length, part, entry and place, comma-joined (lengths by ';')."""
    text = ";".join(",".join(str(v) for v in books[n].ravel().tolist()) for n in sorted(books))
    return hashlib.sha256(text.encode()).hexdigest()


def compressed(embeddings: DataFrame, **options) -> DataFrame:
    """Per kept row: vec_id, code (two hex digits per part), error, label_error, codebooks_sha256."""
    state, books = train_codes(embeddings, **options)
    rows = state.select(
        "vec_id",
        "label",
        F.when(F.col("assign").isNotNull(), F.concat_ws("", F.transform("assign", lambda a: F.lpad(F.lower(F.hex(a)), 2, "0")))).alias("code"),
        F.when(F.col("dist").isNotNull(), F.aggregate("dist", F.lit(0).cast("bigint"), lambda s, d: s + d)).alias("error"),
    )
    per_label = rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    out = narrow_join(rows, per_label, F.expr("label <=> same"), "left")
    return out.select(
        "vec_id", "code", "error", F.col("label_error").cast("bigint").alias("label_error"),
        F.lit(codebooks_digest(books)).alias("codebooks_sha256"),
    )
