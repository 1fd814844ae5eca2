"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints: a bit is set if it is set in more than half of the 64-bit hashes of a text's word shingles.

Links: two fingerprints link if they differ in at most ``MOST_BITS`` bits. Equal fingerprints are one class first,
so copies are never paired. Distinct fingerprints are dealt to buckets: the 64 bits are cut into blocks, and
two fingerprints within the limit agree on all but ``MOST_BITS`` blocks, so one bucket per choice of the remaining
blocks misses none. The number of blocks follows the number of fingerprints and changes only the size of buckets.
Within a bucket, fingerprints are sorted by their rank in Gray order, in which neighbours differ in few bits;
runs of ``LEAF`` form leaves and runs of leaves form upper nodes, and each node keeps the bits all below it share.
A search adds up differences against the shared bits and drops a whole group as soon as they pass the limit.

A bucket only hands on a spanning forest of its links, found by walking from member to member over those not yet
reached, so a dense bucket yields fewer links than members. A bucket above ``BUCKET_ROWS`` is cut into chunks and
every two chunks meet in a task of their own. Components are then joined across buckets.

Null, empty and blank texts have the fingerprint zero and link like any other. Texts with fewer words than a
shingle hash their whole sequence of words. Repeated rows are equal; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import buffers
from storelens.llm.components import components
from storelens.session import stored

SHINGLE = 4
MOST_BITS = 4
SEED = 42
LEAF = 32
BUCKET_ROWS = 2048
#: Mean bucket size beyond which one more block is cut.
FULL_BUCKET = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprints(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a slice of texts."""
    import xxhash

    n_rows = len(bounds) - 1
    out = np.zeros(n_rows, np.uint64)
    starts, ends, rows = buffers.words(data, bounds)
    if not len(starts):
        return out
    # All words, each followed by one blank: a shingle is then a range of bytes.
    lengths = ends - starts
    at = np.append(0, np.cumsum(lengths + 1))
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[buffers.ranges(at[:-1], lengths)] = LOWER[data[buffers.ranges(starts, lengths)]]
    line = memoryview(joined.tobytes())
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    count = np.diff(first)
    number = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    begin = buffers.ranges(first[:-1], number)
    last = np.minimum(begin + shingle, np.repeat(first[1:], number)) - 1
    low, high = at[begin].tolist(), (at[last + 1] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(low, high, strict=True)), np.uint64, len(low))
    edge = np.append(0, np.cumsum(number))
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    some = np.flatnonzero(number)
    sums = np.add.reduceat(bits, edge[some], axis=0, dtype=np.int32)
    set_ = 2 * sums > number[some][:, None]
    out[some] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [fingerprints(*piece, shingle) for piece in buffers.pieces(texts, 2 << 20)]
            yield pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64), pa.int64())

    return printed.asNondeterministic()(text.cast("string"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Two levels of shared bit patterns over fingerprints in Gray order."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        self.leaves = self._shared(self.values, self.values)
        self.nodes = self._shared(*self._extremes(self.values, self.values))

    @staticmethod
    def _extremes(all_set: np.ndarray, any_set: np.ndarray):
        at = np.arange(0, len(all_set), LEAF)
        return np.bitwise_and.reduceat(all_set, at), np.bitwise_or.reduceat(any_set, at)

    @classmethod
    def _shared(cls, all_set: np.ndarray, any_set: np.ndarray):
        """Mask of the bits every group of LEAF entries agrees on, and their values."""
        low, high = cls._extremes(all_set, any_set)
        return ~(low ^ high), low

    def near(self, queries: np.ndarray, alive: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) within the limit, among the places that are alive."""
        query, group = np.arange(len(queries)), None
        for (mask, value), width in ((self.nodes, LEAF * LEAF), (self.leaves, LEAF)):
            living = np.logical_or.reduceat(alive, np.arange(0, len(alive), width))
            if group is None:
                query, group = (x.ravel() for x in np.meshgrid(query, np.flatnonzero(living), indexing="ij"))
            else:
                query, group = np.repeat(query, LEAF), (group[:, None] * LEAF + np.arange(LEAF)).ravel()
                inside = group < len(mask)
                query, group = query[inside], group[inside]
                keep = living[group]
                query, group = query[keep], group[keep]
            keep = np.bitwise_count((queries[query] ^ value[group]) & mask[group]) <= limit
            query, group = query[keep], group[keep]
        query, place = np.repeat(query, LEAF), (group[:, None] * LEAF + np.arange(LEAF)).ravel()
        inside = place < len(self.values)
        query, place = query[inside], place[inside]
        keep = alive[place]
        query, place = query[keep], place[keep]
        keep = np.bitwise_count(queries[query] ^ self.values[place]) <= limit
        return query[keep], place[keep]


def spanning_links(values: np.ndarray, limit: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links (pairs of places) that join whatever is linked within one bucket, fewer than there are values."""
    links: list[tuple[int, int]] = []
    index = GrayIndex(values)
    alive = np.ones(len(values), bool)
    order = index.order
    for seed in range(len(values)):
        if not alive[seed]:
            continue
        alive[seed] = False
        front = np.array([seed])
        while len(front):
            found = []
            for part in np.array_split(front, -(-len(front) // 128)):
                query, place = index.near(index.values[part], alive, limit)
                place, first = np.unique(place, return_index=True)
                alive[place] = False
                links.extend(zip(order[part[query[first]]].tolist(), order[place].tolist(), strict=True))
                found.append(place)
            front = np.concatenate(found)
    return links


def _small_links(values: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a bucket that is a single leaf."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= limit
    first, second = np.nonzero(np.triu(near, 1))
    return list(zip(first.tolist(), second.tolist(), strict=True)) if len(first) < len(values) else spanning_links(values, limit)


def _block_masks(blocks: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def bucket_masks(distinct: int, limit: int = MOST_BITS) -> list[int]:
    """Bits that name the buckets: one mask per choice of blocks two linked fingerprints may agree on."""
    blocks = limit + 1
    while blocks < limit + 4 and distinct / 2 ** (64 * (blocks - limit) / blocks) > FULL_BUCKET:
        blocks += 1
    parts = _block_masks(blocks)
    return [sum(choice) for choice in itertools.combinations(parts, blocks - limit)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bucket_links(limit: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (b0, b1, b2, fp, rep) in order of their bucket."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if not len(fresh[0]):
                    continue
                rest = fresh if rest is None else [np.concatenate(p) for p in zip(rest, fresh, strict=True)]
            if rest is None:
                continue
            change = np.zeros(len(rest[0]), bool)
            change[0] = True
            for c in rest[:3]:
                change[1:] |= c[1:] != c[:-1]
            edges = np.append(np.flatnonzero(change), len(change))
            closed = len(edges) - (2 if batch is not None else 1)  # the last bucket may go on in the next batch
            fp, rep = rest[3].view(np.uint64), rest[4]
            left, right = [], []
            for a, b in zip(edges[:closed].tolist(), edges[1 : closed + 1].tolist(), strict=True):
                if b - a < 2:
                    continue
                own = fp[a:b]
                for i, j in _small_links(own, limit) if b - a <= LEAF else spanning_links(own, limit):
                    left.append(rep[a + i])
                    right.append(rep[a + j])
            rest = [c[edges[closed] :] for c in rest] if batch is not None else None
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return link


def chunked(rows: DataFrame, keys: list[str], spread: str, limit: int = BUCKET_ROWS) -> DataFrame:
    """Rows with ``c1, c2, chunk``: buckets above ``limit`` rows are cut into chunks, each two of which meet.

    ``spread`` is a column whose hash tells the ``chunk`` of a row. Small buckets have the one pair (0, 0).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {limit}")
    wide = rows.join(sizes, keys, "left").withColumn("_k", F.expr(f"int(ceil(coalesce(_n, 1) / {limit}))"))
    wide = wide.withColumn("_own", F.expr(f"int(pmod(xxhash64({spread}), _k))"))
    pairs = F.expr("transform(sequence(0, _k - 1), i -> struct(least(i, _own) as c1, greatest(i, _own) as c2))")
    wide = wide.select(*rows.columns, F.col("_own").alias("chunk"), F.explode(pairs).alias("_c"))
    return wide.select(*rows.columns, "chunk", "_c.c1", "_c.c2")


def fingerprint_links(classes: DataFrame, limit: int = MOST_BITS) -> DataFrame:
    """Links ``(a, b)`` between representatives of ``classes(fp, rep)`` (distinct fingerprints)."""
    masks = bucket_masks(classes.count(), limit)
    named = [f"struct({k} as b0, fp & {_signed(m)}L as b1)" for k, m in enumerate(masks)]
    rows = classes.select(F.explode(F.expr(f"array({', '.join(named)})")).alias("k"), "fp", "rep")
    rows = chunked(rows.select("k.b0", "k.b1", "fp", "rep"), ["b0", "b1"], "fp")
    rows = rows.selectExpr("cast(b0 as bigint) b0", "b1", "cast(c1 as bigint) * 1000003 + c2 as b2", "fp", "rep")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "b0", "b1", "b2").sortWithinPartitions("b0", "b1", "b2")
    return dealt.mapInArrow(_bucket_links(limit), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: fingerprint as 16 hex digits, smallest id reachable by links."""
    printed = stored(
        docs.select(F.col(id_col).cast("bigint").alias("_id"), fingerprint(F.col(text_col), shingle).alias("fp")),
        "fingerprints",
    )
    classes = stored(printed.groupBy("fp").agg(F.min("_id").alias("rep")).where("rep is not null"), "classes")
    found = components(fingerprint_links(classes, most_bits))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    return printed.join(named, "fp", "left").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
