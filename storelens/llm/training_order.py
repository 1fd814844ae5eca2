"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards.

Documents are tokenised and, partition by partition, laid end to end and cut into sequences of ``stride`` ids; the
last sequence of a partition is filled up with the end id. Sequences are numbered through by adding up the counts
of the partitions (one row per task). A keyed Feistel network permutes the numbers: a number that falls outside the
N there are is sent through again until it falls inside (cycle walking), so every sequence gets its own slot in
0..N-1, without a sort or any table of the order. Slots are dealt in ranges of whole shards to tasks (a range is
arithmetic, nothing is sampled), and each task writes its shards one after the other.

A shard is a plain file of ``shard_sequences * stride`` little-endian unsigned 16-bit ids (the last one may be
shorter). Slot s lies in shard ``s div shard_sequences`` at byte ``(s mod shard_sequences) * stride * 2``, so a
reader can resume from any slot by arithmetic. A shard is written under a name of its attempt and then moved into
place: a task that is lost and runs again writes the same bytes.

Null and empty texts give the end id alone. Repeated rows are written as often as they occur. An empty table gives
no shard.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.packing import BATCH_CHARS, text_groups
from storelens.llm.tokens import END_ID, encoder, vocabulary_path
from storelens.session import scratch_path

STRIDE = 2048
SHARD_SEQUENCES = 4096
#: Sequences a writing task takes at least, in whole shards.
ROUNDS = 6
SEQUENCES = "part int, seq int, first_id bigint, n_ids int, ids binary"


def feistel(index: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of sequence numbers below ``count``: a keyed permutation of ``0 .. count - 1``."""
    bits = max(2, int(count - 1).bit_length())
    bits += bits % 2
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << bits // 2) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, rounds, dtype=np.uint64)

    def once(value: np.ndarray) -> np.ndarray:
        left, right = value >> half, value & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    slot = once(index.astype(np.uint64))
    outside = np.flatnonzero(slot >= count)
    while len(outside):  # ends: walking a cycle from inside comes back inside
        slot[outside] = once(slot[outside])
        outside = outside[slot[outside] >= count]
    return slot.astype(np.int64)


def slots(index: Column, count: int, key: int) -> Column:
    """``feistel`` of a column."""

    @F.arrow_udf("bigint")
    def permuted(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel(numbers.to_numpy(zero_copy_only=False), count, key), pa.int64())

    return permuted(index)


def token_sequences(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, stride: int) -> DataFrame:
    """Sequences of every partition: number of the partition and in it, first document, own ids, packed ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, seq, packed = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        rest, rest_docs = np.empty(0, np.uint16), np.empty(0, np.int64)

        def rows(ids: np.ndarray, owner: np.ndarray, number: int) -> pa.RecordBatch:
            lines = ids.reshape(number, stride)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(number, part, np.int32)),
                    pa.array(np.arange(seq, seq + number, dtype=np.int32)),
                    pa.array(owner[::stride][:number], pa.int64()),
                    pa.array(np.full(number, stride, np.int32)),
                    pa.array([packed.compress(x.tobytes()) for x in lines], pa.binary()),
                ],
                ["part", "seq", "first_id", "n_ids", "ids"],
            )

        for batch in batches:
            for names, texts in text_groups(batch, BATCH_CHARS):
                ids, at = encoder(vocabulary).encode(texts, END_ID)
                owner = np.repeat(np.array([-1 if n is None else n for n in names], np.int64), np.diff(at))
                ids, owner = np.append(rest, ids.astype("<u2")), np.append(rest_docs, owner)
                number = len(ids) // stride
                if number:
                    yield rows(ids[: number * stride], owner, number)
                    seq += number
                rest, rest_docs = ids[number * stride :], owner[number * stride :]
        if len(rest):
            last = np.full(stride, END_ID, np.uint16)
            last[: len(rest)] = rest
            yield rows(last, rest_docs, 1).set_column(3, "n_ids", pa.array([len(rest)], pa.int32()))

    named = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return named.mapInArrow(cut, SEQUENCES)


def _shard_writer(folder: str, count: int, stride: int, per_shard: int):
    """Task that writes the shards of its slots (in order) and tells what it wrote, a row per sequence."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        store.create_dir(base, recursive=True)
        unpack, out, shard, temporary = zstandard.ZstdDecompressor(), None, -1, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, posixpath.join(base, f"shard-{shard:08d}.bin"))

        for batch in batches:
            slot = batch.column(0).to_numpy()
            crc = np.empty(len(slot), np.int64)
            for k, blob in enumerate(batch.column(3)):
                own = int(slot[k]) // per_shard
                if own != shard:
                    close()
                    shard, temporary = own, posixpath.join(base, f".shard-{own:08d}-{uuid.uuid4().hex}")
                    out = store.open_output_stream(temporary)
                data = unpack.decompress(blob.as_buffer())
                out.write(data)
                crc[k] = zlib.crc32(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(slot // per_shard),
                    pa.array(slot % per_shard * stride * 2),
                    batch.column(1),
                    batch.column(2),
                    pa.array(crc),
                ],
                ["slot", "shard", "byte_offset", "first_id", "n_ids", "crc32"],
            )
        close()

    return write


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    key: int = 20240229,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    stride: int = STRIDE,
    shard_sequences: int = SHARD_SEQUENCES,
) -> DataFrame:
    """Write the shards below ``folder`` and return the manifest.

    One row per sequence: ``(slot, shard, byte_offset, first_id, n_ids, crc32)`` with the first document's id, the
    number of ids before the filling and the checksum of the stored bytes. The manifest is a lazy table: shards are
    written when it is computed. ``folder`` is any place pyarrow's file systems and all executors reach; without it
    a folder below ``spark.checkpoint.dir`` is taken.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    made = scratch_path(spark, "sequences")
    # The ids are compressed already.
    token_sequences(docs, id_col, text_col, path, stride).write.option("compression", "none").parquet(made)
    found = spark.read.parquet(made)
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col("part"), F.coalesce(before, F.lit(0)).alias("before"))
    total = found.count()
    # One row per task of the tokenising job, so the side sent to all tasks is bounded by the number of tasks.
    numbered = found.join(F.broadcast(firsts), "part").select(
        slots(F.col("before") + F.col("seq"), max(total, 1), key).alias("slot"), "first_id", "n_ids", "ids"
    )
    shards = -(-total // shard_sequences)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    wide = -(-shards // parts) * shard_sequences
    dealt = numbered.repartitionById(parts, F.expr(f"cast(slot div {max(wide, 1)} as int)")).sortWithinPartitions("slot")
    target = folder or scratch_path(spark, "shards")
    schema = "slot bigint, shard bigint, byte_offset bigint, first_id bigint, n_ids int, crc32 bigint"
    return dealt.mapInArrow(_shard_writer(target, total, stride, shard_sequences), schema)
