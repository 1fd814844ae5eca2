"""Removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes are told apart through their first ``width`` bytes only. A most-significant-digit pass splits every group
by its next digit, and a suffix that is alone in its group leaves; what shares a group after the last digit is
a repeated window. Digits need not be read from left to right as long as the content decides their order:

1. The first digit of a suffix is the ``ANCHOR``-byte string of least hash in its window, with its place in it.
   Neighbouring suffixes share that string, so a whole run of them is one row. Strings that occur once leave.
2. The next digit is the bytes of the whole run. If all runs around a string are equal, all their windows repeat;
   so do the windows of runs that have an equal elsewhere.
3. What is left are runs that share a string but differ around it, one of each content. They are brought
   together by that string and their windows are compared one by one. Strings with more than ``GROUP_RUNS``
   different runs go another way, on which every window is a row of its own and is counted before it is shuffled.

Hashes are 64 bits wide and only compared among runs that share the string of the first digit (another 64 bits).
Documents are shuffled once, and only those that may hold a repeated window: which ones is told by a bitmap of fixed
size, which may let others through but none out.

Null and empty texts have no bytes. Matches never cross documents. Repeated rows of one id and text count as
occurrences of their own. Texts of any length are worked on in overlapping slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import buffers
from storelens.session import stored

WIDTH = 200
ANCHOR = 64
#: Different runs around one string that are compared within one task.
GROUP_RUNS = 20_000
#: Bits of the map of documents to look at (a fixed size: 1 MB).
MAP_BITS = 1 << 23
SLICE = 1 << 20
PLACE_BITS = 24

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LETTER = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64)
#: Inverse of STEP modulo 2^64.
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of byte ranges of a buffer."""

    def __init__(self, data: np.ndarray):
        self.down = _powers(BACK, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * _powers(STEP, len(data) + 1)[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        value = (value ^ (value >> np.uint64(31))) * MIX
        return value ^ (value >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, from running minima of blocks in both directions."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - width + 1], forth[width - 1 : len(values)])


def anchored_runs(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR):
    """First window, windows, place of the string, its hash, hash of the run; runs are in order."""
    last = len(data) - width + 1
    if last <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    hashes = Hashes(data)
    places = np.arange(len(data) - anchor + 1)
    digit = hashes.of(places, places + anchor)
    low = np.uint64(PLACE_BITS)
    least = _sliding_least((digit >> low) << low | places.astype(np.uint64), width - anchor + 1)
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(last + 1, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= width)
    inside[bounds[long]] += 1
    np.subtract.at(inside, bounds[long + 1] - width + 1, 1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(start):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    at = at[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, string = start[head], at[head]
    number = np.diff(np.append(head, len(start)))
    place = string - first
    run = hashes.of(first, first + number - 1 + width)
    run ^= (place * 65536 + number).astype(np.uint64) * MIX
    return first, number, place, digit[string], run


def _sliced(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, bounds, first row, offset in the row): a text above the slice comes in parts that overlap."""
    if len(data) <= 4 * SLICE or len(bounds) > 2:
        yield data, bounds, 0, 0
        return
    for first in range(0, len(data) - width + 1, 2 * SLICE):
        part = data[first : first + 2 * SLICE + width - 1]
        yield part, np.array([0, len(part)]), 0, first


RUNS = "k1 bigint, k2 bigint, pos bigint, digit bigint, run bigint"


def _runs(width: int, anchor: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k1, k2, text) to one row per run."""
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            row = 0
            for piece, piece_bounds in buffers.pieces(batch.column(2), SLICE):
                for data, bounds, _, offset in _sliced(piece, piece_bounds, width):
                    first, number, place, digit, run = anchored_runs(data, bounds, width, anchor)
                    owner = np.searchsorted(bounds, first, "right") - 1
                    pos = ((first - bounds[owner] + offset) << 32) | (place << 16) | number
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[row + owner]) for k in keys]
                        + [pa.array(x.view(np.int64)) for x in (pos, digit, run)],
                        ["k1", "k2", "pos", "digit", "run"],
                    )
                row += len(piece_bounds) - 1

    return runs


def _kept_texts(bitmap: bytes):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k1, k2, text) whose place in the map is set, with the text compressed."""
        import zstandard

        packed, bits = zstandard.ZstdCompressor(level=3), np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            place = np.mod(batch.column(1).to_numpy(), MAP_BITS)
            wanted = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
            some = batch.take(pa.array(wanted))
            blobs = [packed.compress((t or "").encode()) for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(blobs, pa.binary())], ["k1", "k2", "packed"]
            )

    return kept


def _document_map(keys: DataFrame) -> bytes:
    """Bitmap of fixed size with the places of all keys set."""
    # Spark's bitmap functions count from one.
    places = keys.selectExpr(f"pmod(k2, {MAP_BITS}) + 1 as p")
    parts = places.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")
    )
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for row in parts.collect():
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _spans_of(width: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k1, k2, packed, open) to (digit, k1, k2, pos, twice, bytes), one per open run."""
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                text = unpack.decompress(batch.column(2)[k].as_buffer())
                out = []
                for x in batch.column(3)[k].as_py():
                    first, number = x["pos"] >> 32, x["pos"] & 0xFFFF
                    out.append((x["digit"], x["pos"], x["twice"], text[first : first + number - 1 + width]))
                digit, pos, twice, blob = zip(*out, strict=True) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit, pa.int64()),
                        pa.array([batch.column(0)[k].as_py()] * len(out), pa.int64()),
                        pa.array([batch.column(1)[k].as_py()] * len(out), pa.int64()),
                        pa.array(pos, pa.int64()),
                        pa.array(twice, pa.bool_()),
                        pa.array(blob, pa.binary()),
                    ],
                    ["digit", "k1", "k2", "pos", "twice", "span"],
                )

    return spans


def _window_hashes(blobs: pa.Array, pos: np.ndarray, width: int):
    """Hash and run of every window of the runs; windows of a run are in order."""
    data, bounds = buffers.text_bytes(blobs.cast(pa.large_binary()))
    number = pos & 0xFFFF
    starts = buffers.ranges(bounds[:-1], number)
    run = np.repeat(np.arange(len(pos)), number)
    # Windows are alike only at the same distance from the shared string; equal bytes imply that.
    return Hashes(data).of(starts, starts + width), run


def _compared(width: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (digit, k1, k2, pos, twice, span) in order of digit to repeated windows (k1, k2, pos)."""
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                rest = fresh if rest is None else pa.concat_tables([rest, fresh])
            if rest is None or not rest.num_rows:
                continue
            digit = rest.column(0).to_numpy()
            change = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
            stop = len(digit) if batch is None else int(change[-1])
            for done in _groups(rest.slice(0, stop), change):
                digit, k1, k2, pos, twice = (done.column(k).to_numpy() for k in range(5))
                value, run = _window_hashes(done.column(5).combine_chunks(), pos, width)
                order = np.lexsort((value, digit[run]))
                same = (value[order][1:] == value[order][:-1]) & (digit[run[order]][1:] == digit[run[order]][:-1])
                hit = np.zeros(len(value), bool)
                hit[order[1:]] |= same
                hit[order[:-1]] |= same
                yield _found(hit & ~twice[run], run, k1, k2, pos)
            rest = rest.slice(stop)

    return compared


def _groups(table: pa.Table, change: np.ndarray) -> Iterator[pa.Table]:
    """Parts of whole groups, of about 20,000 runs."""
    first = 0
    for edge in [*change[change < table.num_rows].tolist()[1:], table.num_rows]:
        if edge - first >= GROUP_RUNS or edge == table.num_rows:
            if edge > first:
                yield table.slice(first, edge - first)
            first = edge


def _found(hit: np.ndarray, run: np.ndarray, k1, k2, pos) -> pa.RecordBatch:
    """Maximal stretches of repeated windows as (k1, k2, pos) with start and number in pos."""
    window = np.arange(len(run)) - np.searchsorted(run, run)
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (run[1:] != run[:-1])
    head = np.flatnonzero(edge)
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (run[1:] != run[:-1])
    number = np.flatnonzero(last) - head + 1
    own = run[head]
    place = (((pos[own] >> 32) + window[head]) << 32) | number
    return pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(place)], ["k1", "k2", "pos"])


def _exploded(width: int):
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as of ``_compared`` to one row per window: (digit, value, k1, k2, pos, twice)."""
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                digit, k1, k2, pos, twice = (part.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                value, run = _window_hashes(part.column(5), pos, width)
                window = np.arange(len(run)) - np.searchsorted(run, run)
                place = (((pos[run] >> 32) + window) << 32) | 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (digit[run], value.view(np.int64), k1[run], k2[run], place, twice[run])],
                    ["digit", "value", "k1", "k2", "pos", "twice"],
                )

    return exploded


def _removed(width: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k1, k2, packed, windows) to (k1, k2, spans, kept)."""
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept = [], []
            for blob, windows in zip(batch.column(2), batch.column(3), strict=True):
                text = np.frombuffer(unpack.decompress(blob.as_buffer()), np.uint8)
                pos = np.sort(windows.values.to_numpy())
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, pos >> 32, 1)
                np.subtract.at(cover, (pos >> 32) + (pos & 0xFFFF) - 1 + width, 1)
                gone = np.cumsum(cover[:-1]) > 0
                starts, ends = buffers.runs(gone, np.array([0, len(gone)]))
                spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["k1", "k2", "spans", "kept"],
            )

    return removed


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of two hashes (of id and text) and the text; null texts are empty."""
    text = f"coalesce(cast(`{text_col}` as string), '')"
    return docs.selectExpr(f"xxhash64(`{id_col}`) as k1", f"xxhash64({text}) as k2", f"{text} as text")


def repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    group_runs: int = GROUP_RUNS,
) -> DataFrame:
    """``(k1, k2, spans, kept)`` of every text with a repeated window, once per key (hash of id, hash of text).

    ``spans`` are the maximal removed runs of bytes (start, end), ``kept`` the remaining bytes.
    """
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col)
    runs = texts.where(f"octet_length(text) >= {width}").mapInArrow(_runs(width, anchor), RUNS)
    # First digit: strings that occur more than once, and whether the runs around them differ.
    strings = runs.groupBy("digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("run").alias("low"), F.max("run").alias("high")
    )
    # Stored, so that the join deals both sides anew and may split a string that very many runs share.
    strings = stored(strings.where("n > 1").selectExpr("digit", "low <> high as mixed"), "strings")
    hits = stored(runs.join(strings, "digit"), "hits")
    # Second digit: contents of the runs around strings of more than one content.
    classes = stored(
        hits.where("mixed").groupBy("digit", "run").agg(
            (F.count(F.lit(1)) > 1).alias("twice"), F.min(F.struct("k1", "k2", "pos")).alias("one")
        ),
        "classes",
    )
    sure = hits.where("not mixed").select("k1", "k2", "pos")
    twins = hits.where("mixed").join(classes.where("twice").select("digit", "run"), ["digit", "run"], "left_semi")
    sure = sure.unionByName(twins.select("k1", "k2", "pos"))
    sizes = classes.groupBy("digit").agg(F.count(F.lit(1)).alias("runs")).where(f"runs > {group_runs}")
    open_ = classes.select("one.*", "digit", "twice")
    entry = F.expr("named_struct('pos', pos, 'digit', digit, 'twice', twice)")
    none = F.lit(None).cast("struct<pos:bigint,digit:bigint,twice:boolean>")
    per_text = sure.select("k1", "k2", "pos", none.alias("o")).unionByName(
        open_.select("k1", "k2", F.lit(None).cast("bigint").alias("pos"), entry.alias("o"))
    )
    per_text = stored(
        per_text.groupBy("k1", "k2").agg(F.collect_list("pos").alias("sure"), F.collect_list("o").alias("open")),
        "per-text",
    )
    bitmap = _document_map(per_text)
    packed = texts.where(f"octet_length(text) >= {width}").mapInArrow(
        _kept_texts(bitmap), "k1 bigint, k2 bigint, packed binary"
    )
    work = stored(packed.join(per_text, ["k1", "k2"]), "work")
    # Last digit: windows of the runs that are left, string by string.
    spans = work.where("size(open) > 0").select("k1", "k2", "packed", "open").mapInArrow(
        _spans_of(width), "digit bigint, k1 bigint, k2 bigint, pos bigint, twice boolean, span binary"
    )
    # Rows of one id and text hold each open run once more; one is compared.
    spans = stored(spans.dropDuplicates(["k1", "k2", "pos"]), "open-runs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "k1 bigint, k2 bigint, pos bigint"
    few = spans.join(sizes, "digit", "left_anti")
    found = few.repartition(parts, "digit").sortWithinPartitions("digit").mapInArrow(_compared(width), schema)
    many = spans.join(sizes, "digit", "left_semi").mapInArrow(
        _exploded(width), "digit bigint, value bigint, k1 bigint, k2 bigint, pos bigint, twice boolean"
    )
    often = many.groupBy("digit", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit", "value")
    found = found.unionByName(many.where("not twice").join(often, ["digit", "value"], "left_semi").select("k1", "k2", "pos"))
    found = stored(found.groupBy("k1", "k2").agg(F.collect_list("pos").alias("more")), "found")
    windows = work.join(found, ["k1", "k2"], "left").selectExpr(
        "k1", "k2", "packed", "concat(sure, coalesce(more, array())) as windows"
    )
    done = windows.where("size(windows) > 0").mapInArrow(
        _removed(width), "k1 bigint, k2 bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return done


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row."""
    gone = repeated_windows(docs, id_col, text_col, width).selectExpr(
        "k1", "k2", "aggregate(spans, 0L, (a, s) -> a + s.end - s.start) as removed",
        "cast(size(spans) as bigint) as n_spans", "sha2(kept, 256) as kept_sha",
    )
    # Rows of one id and text have one key and one result.
    gone = gone.dropDuplicates(["k1", "k2"])
    text = f"coalesce(cast(`{text_col}` as string), '')"
    rows = docs.selectExpr(
        f"`{id_col}`", f"xxhash64(`{id_col}`) as k1", f"xxhash64({text}) as k2",
        f"cast(octet_length({text}) as bigint) as n_bytes", f"sha2(cast({text} as binary), 256) as whole_sha",
    )
    return rows.join(gone, ["k1", "k2"], "left").selectExpr(
        f"`{id_col}`", "n_bytes", "coalesce(removed, 0L) as n_removed", "coalesce(n_spans, 0L) as n_spans",
        "coalesce(kept_sha, whole_sha) as kept_sha256",
    )
