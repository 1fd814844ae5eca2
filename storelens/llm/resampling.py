"""Target-distribution importance resampling with hashed n-gram features and length-bucketed CRC matrices.

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII characters; the features of a text are all
runs of 1 to ``longest`` consecutive words joined by one blank, repeats counted. A feature's bucket is the unsigned
CRC-32 of its UTF-8 bytes modulo ``buckets``.

CRC method: within a task, the distinct features of a slice of texts are grouped by byte length; each group is one
two-dimensional ``uint8`` array (a row per feature), and the CRC registers of all its rows are updated together,
column by column, through the byte table. The values are then scattered back to the features' places. A group whose
length exceeds 64 times its number of rows (a few very long words) gains nothing from columns and is hashed row by
row by ``zlib.crc32``, which gives the same values.

Weights: with S and s_b the feature counts of all documents (and of bucket b), T and t_b those of the target
(benchmark) texts, the gain of a bucket is ``floor(1000 * ln((t_b + 1) * (S + B) / ((s_b + 1) * (T + B))))`` in
doubles (B: number of buckets), and a document's weight is the sum of the gains of its features. Both tables are
counted over all their rows in a first pass (a vector of ``buckets`` counts per task, summed by Spark); the
second pass computes the weights. Only the two count vectors reach the driver; their size is the parameter
``buckets``.

Draw: Gumbel-top-k. ``h`` is the first 8 hex digits of sha256(``<seed>:<doc_id>``); the score is the weight plus
``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))``. Of the N documents with a doc_id and at least ``least_words`` words,
the ``floor(percent * N / 100)`` highest scores are drawn, ties to the smaller doc_id. Ranks come from one
distributed sort: each partition's count is added up on the driver (one number per partition) and every row gets
its partition's offset plus its place there.

Rows: one per input row. A null text has no words (weight 0); a null doc_id gets no score and no rank and does not
count in N. Repeated rows are separate documents with equal scores; their ranks follow each other. Empty tables give
empty results, an empty target table gives t = T = 0 everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.buffers import coded, ranges, runs, slices, text_bytes
from storelens.session import stored

#: Fixed values of the contract: word pattern, lower-casing of A-Z only, the reflected CRC-32 polynomial.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
POLYNOMIAL = 0xEDB88320
BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Bytes of text a task turns into features at once (a longer text is a slice of its own).
GROUP_CHARS = 4 << 20
#: Bytes: A-Z lower-cased, and which bytes belong to words then (digits, a-z and every byte of a non-ASCII letter).
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 0x20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table.astype(np.uint32)


TABLE = _byte_table()


def crc32_flat(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte strings ``data[offsets[i]:offsets[i + 1]]``, by length-bucketed matrices."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        width = int(lengths[group[0]]) if len(group) else 0
        if not width:
            continue
        if width > 64 * len(group):
            out[group] = [zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()) for i in group]
            continue
        matrix = data[offsets[group][:, None] + np.arange(width)]
        crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in range(width):
            crc = TABLE[(crc ^ matrix[:, column]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[group] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32_many(values: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of every byte string (``crc32_flat`` of their concatenation)."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return crc32_flat(np.frombuffer(b"".join(values), np.uint8), offsets)


def _features(data: np.ndarray, bounds: np.ndarray, buckets: int, longest: int):
    """``feature_buckets`` of texts given as UTF-8 bytes and row bounds; all work on byte arrays."""
    n_rows = len(bounds) - 1
    lower = LOWER_BYTES[data]
    starts, ends = runs(IS_WORD[lower], bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    n_words = np.bincount(row, minlength=n_rows).astype(np.int64)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, n_words, np.zeros(n_rows, np.int64)
    codes, names = coded(lower, starts, ends)
    offsets = np.frombuffer(names.buffers()[1], np.int64 if pa.types.is_large_binary(names.type) else np.int32)
    offsets = offsets[names.offset : names.offset + len(names) + 1].astype(np.int64)
    vocabulary = len(names)
    text = np.append(np.frombuffer(names.buffers()[2], np.uint8), np.uint8(0x20))  # a blank after all words
    blank, word_start, word_len = len(text) - 1, offsets[:-1], np.diff(offsets)
    rows, places = [row], [(crc32_flat(text, offsets) % buckets).astype(np.int64)[codes]]
    keys, members = codes, np.arange(vocabulary)[:, None]
    for k in range(2, longest + 1):
        inside = row[k - 1 :] == row[: len(row) - k + 1] if len(row) >= k else np.zeros(0, bool)
        joined = keys[: len(keys) - 1] * vocabulary + codes[k - 1 :] if len(keys) > 1 else np.zeros(0, np.int64)
        gram, distinct = pd.factorize(joined)
        distinct = np.asarray(distinct, np.int64)
        members = np.concatenate([members[distinct // vocabulary], (distinct % vocabulary)[:, None]], 1)
        # Bytes of every distinct feature: its words with one blank between them, gathered from the dictionary.
        seg_start = np.full((len(members), 2 * k - 1), blank, np.int64)
        seg_len = np.ones((len(members), 2 * k - 1), np.int64)
        seg_start[:, ::2], seg_len[:, ::2] = word_start[members], word_len[members]
        gram_offsets = np.zeros(len(members) + 1, np.int64)
        np.cumsum(seg_len.sum(1), out=gram_offsets[1:])
        values = (crc32_flat(text[ranges(seg_start.ravel(), seg_len.ravel())], gram_offsets) % buckets).astype(np.int64)
        rows.append(row[k - 1 :][inside])
        places.append(values[gram][inside])
        keys = gram.astype(np.int64)
    every = np.concatenate(rows)
    return every, np.concatenate(places), n_words, np.bincount(every, minlength=n_rows).astype(np.int64)


def feature_buckets(texts, buckets: int = BUCKETS, longest: int = LONGEST):
    """Features of some texts (a list or Arrow array; null is empty) as (row of each occurrence, its bucket,
    words per row, features per row)."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    return _features(*text_bytes(column), buckets, longest)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first .. last`` of a text column of about ``GROUP_CHARS`` bytes, with their bytes and bounds."""
    data, bounds = text_bytes(column)
    for first, last in slices(bounds, GROUP_CHARS):
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]


def _bucket_totals(buckets: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in _slices(batch.column(1)):
                total += np.bincount(_features(data, bounds, buckets, longest)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows of a table: partial vectors per task, summed by Spark."""
    texts = table.select(F.lit(None).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    summed = texts.mapInArrow(_bucket_totals(buckets, longest), "bucket int, n bigint").groupBy("bucket").sum("n")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, in doubles and floored, from the two count vectors."""
    s, t = documents.astype(np.float64), target.astype(np.float64)
    size = float(len(s))
    ratio = ((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio))


def _weights(gain: np.ndarray, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, bounds in _slices(batch.column(1)):
                rows, places, n_words, n_features = _features(data, bounds, len(gain), longest)
                weight = np.bincount(rows, weights=gain[places], minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(n_words), pa.array(n_features), pa.array(weight, pa.float64())],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return weigh


def ranked(table: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``table`` with 1, 2, 3 ... in ``order``, by one distributed sort and the counts of its partitions."""
    spark = table.sparkSession
    placed = table.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    placed = stored(placed, "ranked")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    offsets, before = [], 0
    for part, n, first in sorted(counts):  # one row per partition
        offsets.append((part, before - first))
        before += n
    shift = spark.createDataFrame(offsets or [(0, 0)], "_part int, _shift bigint")
    out = placed.join(F.broadcast(shift), "_part")
    return out.withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Per input row: doc_id, n_words, n_features, weight, score (longs) and rank (null where not drawn)."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    named = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    weighed = named.mapInArrow(_weights(gain, longest), "doc_id bigint, n_words bigint, n_features bigint, weight double")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scored")
    eligible = F.expr(f"doc_id is not null and n_words >= {least_words}")
    draws = scored.where(eligible).count() * percent // 100
    # Eligible rows first, so that the first ``draws`` places are the draw; the others lose their place.
    order = [eligible.desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc()]
    ranks = ranked(scored, order, "place")
    return ranks.select(
        "doc_id", "n_words", "n_features", F.col("weight").cast("long").alias("weight"), "score",
        F.when(F.col("place") <= draws, F.col("place")).alias("rank"),
    )
