"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine check, connected components.

Equal vectors are one class first and are never paired. Every class is hashed by the signs of its products with
random hyperplanes, once per table; classes with the same signs in a table share a bucket, and all pairs of a
bucket are checked by cosine in double precision. The number of planes grows with the logarithm of the number of
classes, which keeps buckets small, and the number of tables is then set so that a pair at the threshold is missed
with a chance below ``MISS`` (closer pairs far less often). A pair that meets in several tables counts in the
first of them. A bucket above ``BUCKET_ROWS`` is cut into chunks and every two chunks meet in a task of their own,
so nothing is capped.

A bucket hands on the number of links of each class and a spanning forest of its links, never its pairs;
components are joined across buckets.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of another length than most
(the most frequent one, the longer if equally frequent), link with nothing. Repeated rows of one id are rows of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.components import Forest, components
from storelens.llm.simhash import chunked
from storelens.session import stored

THRESHOLD = 0.95
MISS = 1e-4
#: Classes a bucket holds on average, and at most without being cut.
MEAN_BUCKET = 128
BUCKET_ROWS = 1024
SEED = 5
#: Chunks a bucket may have, at most (a place value, not a cap: 10^9 classes in one bucket).
CHUNKS = 1_000_003


def layout(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Planes per table and number of tables."""
    planes = min(24, max(4, round(math.log2(max(classes, 2) / MEAN_BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log(1 - meet))


def sign_codes(vectors: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """Code of every vector in every table."""
    normals = np.random.default_rng(SEED).normal(size=(vectors.shape[1], planes * tables))
    signs = (vectors @ normals >= 0).reshape(len(vectors), tables, planes)
    return signs @ (1 << np.arange(planes))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _hashed(width: int, planes: int, tables: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rep, copies, vector) to one row per table."""
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                codes = sign_codes(_matrix(part.column(2), width), planes, tables)
                row = np.repeat(np.arange(part.num_rows), tables)
                taken = pa.Table.from_batches([part]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(tables), part.num_rows), pa.int64()),
                        pa.array(codes.ravel(), pa.int64()),
                        *[c.combine_chunks() for c in taken.columns],
                    ],
                    ["b0", "b1", "rep", "copies", "vector"],
                )

    return hashed


def bucket_pairs(vectors: np.ndarray, chunk: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places at or above the threshold, block by block.

    With chunks given only pairs across them count: pairs within one meet in that chunk's own task.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    for first in range(0, len(vectors), 512):
        rows = slice(first, first + 512)
        close = vectors[rows] @ vectors.T / np.outer(norms[rows], norms) >= threshold - 1e-9
        left, right = np.nonzero(close)
        left += first
        keep = left < right
        if chunk is not None:
            keep &= chunk[left] != chunk[right]
        left, right = left[keep], right[keep]
        exact = np.einsum("ij,ij->i", vectors[left], vectors[right]) / (norms[left] * norms[right])
        yield left[exact >= threshold], right[exact >= threshold]


def _linked(width: int, planes: int, tables: int, threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (b0, b1, b2, chunk, rep, copies, vector) in order of their bucket; out (a, b, links)."""
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                rest = fresh if rest is None else pa.concat_tables([rest, fresh])
            if rest is None or not rest.num_rows:
                continue
            keys = [rest.column(k).to_numpy() for k in range(3)]
            change = np.ones(rest.num_rows, bool)
            change[1:] = False
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            edges = np.append(np.flatnonzero(change), rest.num_rows)
            closed = len(edges) - (2 if batch is not None else 1)
            out: list[list] = [[], [], []]
            if closed > 0:
                done = rest.slice(0, int(edges[closed]))
                chunk, rep, copies = (done.column(k).to_numpy() for k in (3, 4, 5))
                vectors = _matrix(done.column(6).combine_chunks(), width)
                codes = sign_codes(vectors, planes, tables)
                for a, b in itertools.pairwise(edges[: closed + 1].tolist()):
                    if b - a < 2:
                        continue
                    table, forest = int(keys[0][a]), Forest(b - a)
                    links = np.zeros(b - a, np.int64)
                    one, other = divmod(int(keys[2][a]), CHUNKS)
                    for left, right in bucket_pairs(vectors[a:b], chunk[a:b] if one != other else None, threshold):
                        new = ~(codes[a + left, :table] == codes[a + right, :table]).any(1)
                        left, right = left[new], right[new]
                        np.add.at(links, left, copies[a + right])
                        np.add.at(links, right, copies[a + left])
                        for i, j in zip(left.tolist(), right.tolist(), strict=True):
                            if forest.join(i, j):
                                out[0].append(rep[a + i])
                                out[1].append(rep[a + j])
                                out[2].append(0)
                    some = np.flatnonzero(links)
                    out[0].extend(rep[a + some])
                    out[1].extend(rep[a + some])
                    out[2].extend(links[some])
            rest = rest.slice(int(edges[closed])) if batch is not None and closed > 0 else rest
            rest = None if batch is None else rest
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "links"])

    return link


def near_duplicate_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: directly linked other vectors, smallest id reachable, id = component."""
    spark = table.sparkSession
    wide = table.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    clean = (
        "_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and "
        "abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    )
    # Equal vectors have equal keys; 0 and -0 are the same number.
    classes = stored(
        wide.where(clean)
        .selectExpr("_id", "transform(vector, x -> x + 0d) as vector")
        .groupBy("vector")
        .agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .select("rep", "copies", "vector"),
        "classes",
    )
    widths = classes.groupBy(F.size("vector").alias("w")).agg(F.sum("copies").alias("n"))
    top = widths.agg(F.max(F.struct("n", "w")).alias("top")).first()["top"]
    width = top["w"] if top else 1
    classes = classes.where(F.size("vector") == width)
    planes, tables = layout(classes.count(), threshold)
    rows = classes.mapInArrow(
        _hashed(width, planes, tables), "b0 bigint, b1 bigint, rep bigint, copies bigint, vector array<double>"
    )
    rows = chunked(rows, ["b0", "b1"], "rep", BUCKET_ROWS)
    rows = rows.selectExpr(
        "b0", "b1", f"cast(c1 as bigint) * {CHUNKS} + c2 as b2", "cast(chunk as bigint) chunk", "rep", "copies", "vector"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "b0", "b1", "b2").sortWithinPartitions("b0", "b1", "b2")
    found = stored(dealt.mapInArrow(_linked(width, planes, tables, threshold), "a bigint, b bigint, links bigint"), "links")
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"))
    named = (
        classes.join(links, classes["rep"] == links["a"], "left")
        .join(joined, classes["rep"] == joined["node"], "left")
        .selectExpr("vector as v", "coalesce(links, 0) + copies - 1 as n_links", "coalesce(component, rep) as component_id")
    )
    keyed = wide.selectExpr("_id", f"case when {clean} and size(vector) = {width} then transform(vector, x -> x + 0d) end as v")
    return keyed.join(named, "v", "left").selectExpr(
        f"_id as `{id_col}`",
        "coalesce(n_links, 0) as n_links",
        "coalesce(component_id, _id) as component_id",
        "coalesce(component_id, _id) = _id as kept",
    )
