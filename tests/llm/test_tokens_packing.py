"""Token ids, packing and training order."""

import random
import zlib

import numpy as np
import pytest

from storelens.llm import packing, training_order
from storelens.llm.tokens import encoder, vocabulary_path


def texts(count=1500):
    rng = random.Random(3)
    letters = "abcZÉéßüñ 's'tvelmrd019²³¼ªµº\x85\xa0\x1c\x00\t\n\r-!?.·|<>œ日"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(count)]
    return [*made, "", None, "it's we'll 'tis ''s 's's !'s 'VE", "a<|endoftext|>b", "x" * 5000, "'" * 50]


def test_ids_equal_the_tokenizer():
    own = encoder(vocabulary_path())
    rows = texts()
    ids, at = own.encode(rows)
    for k, text in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == own.slow.encode(text or "", add_special_tokens=False).ids + [1]


def test_assign_takes_the_cheapest_sequence_with_room():
    laid, left = packing.assign([5, 3, 3, 9], [8, 8], 1.0, 1.0)
    placed = {}
    for piece, first, last, sequence, offset in laid:
        placed.setdefault(sequence, []).append((offset, last - first))
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 8
    assert sum(last - first for _, first, last, _, _ in laid) == 16 and sum(b - a for _, a, b in left) == 4


@pytest.mark.parametrize("window", [1 << 20, 3000])
def test_packing_is_complete(spark, window):
    rows = [(k, t) for k, t in enumerate(texts(400))] + [(9000, "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    pieces = packing.pack_documents(docs, window_tokens=window).collect()
    own = encoder(vocabulary_path())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for k, text in rows:
        want = own.slow.encode(text or "", add_special_tokens=False).ids + [1]
        own_pieces = sorted(by_doc[k], key=lambda p: p.start)
        assert [p.start for p in own_pieces] == np.append(0, np.cumsum([p.length for p in own_pieces]))[:-1].tolist()
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own_pieces]).tolist() == want
        assert all(p.doc_tokens == len(want) for p in own_pieces)
    for parts in by_sequence.values():
        size = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == size
            size += p.length
        assert size <= 2048 and size & (size - 1) == 0  # full, or a power of two


def test_packing_of_odd_rows(odd, nothing):
    pieces = packing.pack_documents(odd).collect()
    assert {p.doc_id for p in pieces} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert sum(p.length for p in pieces if p.doc_id in (1, 2, 3)) == 3
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(count):
    slots = training_order.feistel(np.arange(count), count, 5)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 100:
        assert (slots != training_order.feistel(np.arange(count), count, 6)).any()


def test_shards_hold_every_id_once(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(3)
    folder = str(tmp_path / "shards")
    made = training_order.write_shards(docs, folder, stride=16, shard_sequences=32).collect()
    assert sorted(r.slot for r in made) == list(range(len(made)))
    ids = []
    for r in made:
        with open(f"{folder}/shard-{r.shard:08d}.bin", "rb") as file:
            file.seek(r.byte_offset)
            data = file.read(32)
        assert zlib.crc32(data) == r.crc32 and r.slot == r.shard * 32 + r.byte_offset // 32
        ids += np.frombuffer(data, "<u2")[: r.n_ids].tolist()
    own = encoder(vocabulary_path())
    want = [i for _, t in rows for i in own.slow.encode(t or "", add_special_tokens=False).ids + [1]]
    assert sorted(ids) == sorted(want)
    again = training_order.write_shards(docs, folder, stride=16, shard_sequences=32).collect()
    assert sorted(again) == sorted(made)


def test_order_of_odd_rows(odd, nothing):
    assert training_order.write_shards(odd).count() > 29
    assert training_order.write_shards(nothing).count() == 0


def test_packing_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    from storelens.llm import packing

    text = "some plain words of a text " * 40
    peaks = []
    for n in (4_000, 16_000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], ["doc", "text"])
        tracemalloc.start()
        rows = 0
        for ids, texts in packing.text_groups(batch, packing.SLICE_CHARS):
            assert sum(map(len, texts)) < packing.SLICE_CHARS + len(text)
            rows += len(ids)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.2 * peaks[0]


def test_pieces_do_not_depend_on_the_slices(spark, monkeypatch):
    from storelens.llm import packing

    rows = [(k, None if k % 7 == 0 else "word and more " * (k * 37 % 400)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole = sorted(map(tuple, packing.pack_documents(docs).collect()))
    monkeypatch.setattr(packing, "SLICE_CHARS", 500)
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    assert sorted(map(tuple, packing.pack_documents(docs).collect())) == whole
