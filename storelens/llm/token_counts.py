"""Token counts of whole texts under a unigram model, by dynamic programming shared in a trie.

A text is cut into pre-tokens at white space; each begins with the vocabulary's word mark. A pre-token's count is
the number of pieces on its best path: the path of highest total log score, the one of fewer pieces if scores tie.
Pieces come from a public vocabulary; the score of the piece of rank r is ``-log(r + 1)``, and a byte no
piece covers is a byte piece of score ``UNKNOWN``.

The distinct pre-tokens of a slice of texts form a trie. The best score at a node depends only on the bytes on
the way to it, so it is computed once for all words that share the prefix, level by level, for all nodes of a
level at a time; counts are read off at the nodes where words end. Words are sorted, so a trie is just an array
of common-prefix lengths. Texts stay in their tasks: no shuffle, and memory is bounded by the slice.

Null, empty and blank texts have no tokens. Repeated rows are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import buffers
from storelens.llm.tokens import vocabulary_path

#: Word mark of the vocabulary (U+2581).
MARK = "▁".encode()
UNKNOWN = -30.0
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
COUNTS = "struct<n_pre_tokens:bigint, n_tokens:bigint>"


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _piece_hash(pieces: list[bytes]) -> np.ndarray:
    out = []
    for piece in pieces:
        value = 0
        for byte in piece:
            value = (value * int(STEP) + int(_letters()[byte])) % (1 << 64)
        out.append(value)
    return np.array(out, np.uint64)


class Vocabulary:
    """Pieces by length, each length a sorted array of hashes with scores."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p, _ in pieces}):
            own = [(p, s) for p, s in pieces if len(p) == n]
            hashes = _piece_hash([p for p, _ in own])
            order = np.argsort(hashes)
            self.by_length[n] = hashes[order], np.array([s for _, s in own])[order]

    def scores(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Score of each hashed piece of one length; minus infinity where there is no such piece."""
        known, score = self.by_length[length]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, score[at], -np.inf)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Normal pieces of a vocabulary file with their rank scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    return Vocabulary([(p.encode(), -float(np.log(rank + 1))) for rank, p in enumerate(plain, 1)])


def word_counts(names: list[bytes], pieces: Vocabulary) -> np.ndarray:
    """Number of pieces on the best path of every word (distinct, in byte order, without the mark)."""
    if not names:
        return np.empty(0, np.int64)
    words = [MARK + name for name in names]
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(size) - size
    # Bytes a word shares with the one before it.
    shared = np.zeros(len(words), np.int64)
    open_ = np.arange(1, len(words))
    for depth in range(int(size.max())):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[data[first[open_] + depth] == data[first[open_ - 1] + depth]]
        if not len(open_):
            break
        shared[open_] = depth + 1
    longest = max(pieces.by_length)
    count = np.zeros(len(words), np.int64)
    # Node of every word at each of the last levels; columns of a ring by depth.
    ring = longest + 1
    node = np.zeros((ring, len(words)), np.int64)
    score: list[np.ndarray | None] = [None] * ring
    number: list[np.ndarray | None] = [None] * ring
    prefix: list[np.ndarray | None] = [None] * ring
    power = [1]
    for _ in range(longest):
        power.append(power[-1] * int(STEP) % (1 << 64))
    score[0], number[0], prefix[0] = np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64)
    active = np.arange(len(words))
    for depth in range(1, int(size.max()) + 1):
        active = active[size[active] >= depth]
        # A word opens a node at this depth unless the active word before it (its neighbour) shares the prefix.
        opens = shared[active] < depth
        node[depth % ring, active] = np.cumsum(opens) - 1
        head = active[opens]
        here = depth % ring
        byte = data[first[head] + depth - 1]
        parent = node[(depth - 1) % ring, head] if depth > 1 else np.zeros(len(head), np.int64)
        prefix[here] = prefix[(depth - 1) % ring][parent] * STEP + _letters()[byte]
        best = score[(depth - 1) % ring][parent] + UNKNOWN
        fewest = number[(depth - 1) % ring][parent] + 1
        for length in pieces.by_length:
            if length > depth:
                break
            back = (depth - length) % ring
            above = node[back, head] if depth > length else np.zeros(len(head), np.int64)
            piece = prefix[here] - prefix[back][above] * np.uint64(power[length])
            value = score[back][above] + pieces.scores(length, piece)
            steps = number[back][above] + 1
            better = (value > best) | ((value == best) & (steps < fewest))
            best, fewest = np.where(better, value, best), np.where(better, steps, fewest)
        score[here], number[here] = best, fewest
        done = active[size[active] == depth]
        count[done] = fewest[node[here, done]]
    return count


def text_counts(data: np.ndarray, bounds: np.ndarray, pieces: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of every row of a slice of texts."""
    n_rows = len(bounds) - 1
    starts, ends, rows = buffers.words(data, bounds)
    if not len(starts):
        return np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    code, names = buffers.coded(data, starts, ends)
    found = names.to_pylist()
    order = sorted(range(len(found)), key=found.__getitem__)
    count = np.empty(len(found), np.int64)
    count[order] = word_counts([found[k] for k in order], pieces)
    return np.bincount(rows, minlength=n_rows), buffers.per_row(count[code], rows, n_rows)


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Struct ``(n_pre_tokens, n_tokens)`` of a text column."""
    file = path or vocabulary_path("piece_bpe_32k.model")

    @F.arrow_udf(COUNTS)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [text_counts(*piece, vocabulary(file)) for piece in buffers.pieces(texts, 16 << 20)]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 2
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_pre_tokens", "n_tokens"])

    return counts.asNondeterministic()(text.cast("string"))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str | None = None
) -> DataFrame:
    """``(id_col, n_pre_tokens, n_tokens)``, one row per input row."""
    return docs.select(F.col(id_col), count_tokens(F.col(text_col), vocabulary_file).alias("c")).select(id_col, "c.*")
