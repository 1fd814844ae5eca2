"""Toxicity of whole texts by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (3 to 6 bytes, cut at character bounds, with marks for both ends) and of the
whole word, each hashed to a row of an embedding table. A window of a text is the average of its distinct words, and a linear
softmax over that average gives the class; a text scores as its strongest window, so that one insult in a long
text isn't averaged away. Table and softmax are trained together (full-batch Adam in numpy) on a bounded sample of
labelled texts, so a misspelling that was never seen shares most of its vectors with the word it hides.

Because averaging and softmax are linear up to the last step, the trained model is one number per hash bucket:
that array, of fixed size, is all that travels to the tasks. Scoring is one Arrow function over the text column,
without a shuffle. Null, empty and wordless texts get the score of the bias alone. Repeated rows get equal scores.
An empty label table gives a model that calls nothing toxic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import buffers

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5, 6)
#: Bound of the labelled sample the driver fits on: rows per class, and bytes of text in all.
TRAINING_ROWS = 1200
TRAINING_BYTES = 8 << 20
#: Pull of the embeddings towards zero.
DECAY = 1e-6
#: Words averaged at a time; a shorter window counts as filled up with words of no meaning.
WINDOW = 4
#: Stretch of the averages.
SCALE = np.float32(30.0)
#: Share of the subwords left out at each step on windows.
DROPOUT = 0.4
#: The driver trains on slices of this many bytes of text, and adds up this many rows of numbers at a time.
TRAINING_SLICE = 1 << 20
TRAINING_CHUNK = 1 << 16
LOW, HIGH = ord("<"), ord(">")

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True
HASH_STEP = np.uint64(0x100000001B3)
HASH_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Trained scorer: weight of every bucket, weight of the constant."""

    weights: np.ndarray
    bias: float


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and dictionary place of every word of a slice of lower-cased texts, and the dictionary."""
    data, bounds = buffers.text_bytes(texts)
    starts, ends = buffers.runs(WORD_BYTE[data], bounds)
    code, names = buffers.coded(data, starts, ends)
    return np.searchsorted(bounds, starts, "right") - 1, code, names


def subword_parts(names: pa.Array, buckets: int, step: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all subwords of each word and the bounds of the words, some words at a time."""
    return (_subwords(names.slice(k, step), buckets) for k in range(0, max(len(names), 1), step))


def subwords(names: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of each word, one word after the other, and the bounds of the words."""
    parts = list(subword_parts(names, buckets))
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([b for b, _ in parts]), np.append(0, np.cumsum(sizes))


def _subwords(names: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers.text_bytes(names)
    size = np.diff(at) + 2
    bounds = np.append(0, np.cumsum(size))
    marked = np.empty(int(bounds[-1]), np.uint8)
    marked[bounds[:-1]], marked[bounds[1:] - 1] = LOW, HIGH
    marked[np.arange(len(data)) + 2 * np.repeat(np.arange(len(names)), np.diff(at)) + 1] = data
    owner = np.repeat(np.arange(len(names)), size)
    end = bounds[1:][owner]
    whole = (marked & 0xC0) != 0x80  # a character begins here
    whole = np.append(whole, True)
    wide = marked.astype(np.uint64)
    place = np.arange(len(marked))
    found_owner, found_hash = [], []
    for n in NGRAMS:
        if len(marked) < n:
            break
        start = place[: len(marked) - n + 1]
        keep = (start + n <= end[start]) & whole[start] & whole[start + n]
        start = start[keep]
        value = np.full(len(start), n, np.uint64)
        for k in range(n):
            value = (value ^ wide[start + k]) * HASH_STEP
        found_owner.append(owner[start])
        found_hash.append(value)
    value = np.zeros(len(names), np.uint64)  # the whole word: a polynomial over its bytes
    if len(marked):
        power = np.power(HASH_STEP, (place - bounds[owner]).astype(np.uint64))
        value = np.add.reduceat(wide * power, bounds[:-1])
    found_owner.append(np.arange(len(names)))
    found_hash.append(value ^ HASH_MIX)
    who = np.concatenate(found_owner)
    order = np.argsort(who, kind="stable")
    mixed = np.concatenate(found_hash)[order] * HASH_MIX
    bucket = (mixed >> np.uint64(40)) % np.uint64(buckets)
    return bucket.astype(np.int32), np.append(0, np.cumsum(np.bincount(who, minlength=len(names)))).astype(np.int64)


def lowered(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def _sums(part: Callable[[int, int], np.ndarray], starts: np.ndarray, total: int) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``; ``part(first, last)`` makes the rows, a chunk at a time."""
    bounds = np.append(starts, total)
    out = []
    for a, b in buffers.slices(bounds, TRAINING_CHUNK):
        out.append(np.add.reduceat(part(bounds[a], bounds[b]), bounds[a:b] - bounds[a]))
    return np.concatenate(out)


class _Fit:
    """Embedding table and softmax under training, on bags of words (row, word, weight).

    A word is the bag of those of its subwords whose bucket at least ``least`` texts hold; ``texts_of`` counts the
    texts of every word.
    """

    def __init__(self, names: pa.Array, texts_of: np.ndarray, least: int, buckets: int, dim: int):
        held = np.zeros(buckets)
        parts, sizes, first = [], [], 0
        for bucket, bounds in subword_parts(names, buckets):
            size = np.diff(bounds)
            held += np.bincount(bucket, weights=np.repeat(texts_of[first : first + len(size)], size), minlength=buckets)
            parts.append(bucket)
            sizes.append(size)
            first += len(size)
        there = held >= least
        self.used = np.flatnonzero(there)
        place = np.cumsum(there, dtype=np.int32) - 1
        del held
        counts = []
        for k, (bucket, size) in enumerate(zip(parts, sizes, strict=True)):
            keep = there[bucket]
            owner = np.repeat(np.arange(len(size)), size)
            counts.append(np.bincount(owner[keep], minlength=len(size)))
            parts[k] = place[bucket[keep]]
        self.bucket = np.concatenate(parts)
        self.at = np.append(0, np.cumsum(np.concatenate(counts)))
        self.length = np.maximum(np.concatenate(sizes), 1).astype(np.float32)
        random = np.random.default_rng(7)
        self.table = random.normal(0, 0.05, (len(self.used), dim)).astype(np.float32)
        self.soft = random.normal(0, 0.3, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def word_values(self) -> np.ndarray:
        """What each word adds to the odds of label 1, as a share of the whole bag."""
        value = self.table @ (self.soft[:, 1] - self.soft[:, 0])
        out, done = np.zeros(len(self.length)), 0.0
        for a, b in buffers.slices(self.at, TRAINING_CHUNK):
            at = self.at[a : b + 1]
            total = np.cumsum(np.append(done, value[self.bucket[at[0] : at[-1]]]))
            out[a:b] = total[at[1:] - at[0]] - total[at[:-1] - at[0]]
            done = total[-1]
        return out / self.length * SCALE

    def learn(self, row, word, weight, target: np.ndarray, steps: int, dropout: float = 0, rate: float = 0.05) -> None:
        """Adam steps over all bags at once. Rows without a word count through the bias alone.

        With ``dropout`` every step leaves out that share of the subwords, so that no word depends on a few of them:
        a misspelt word has lost some.
        """
        present, word = np.unique(word, return_inverse=True)
        sizes = (self.at[1:] - self.at[:-1])[present]
        present, kept = present[sizes > 0], np.flatnonzero(sizes > 0)
        place = np.full(len(sizes), -1)
        place[kept] = np.arange(len(kept))
        there = place[word] >= 0
        row, word, weight = row[there], place[word[there]], weight[there].astype(np.float32) * SCALE
        if not len(row):
            return
        sizes = sizes[kept]
        flat = np.concatenate(
            [
                self.bucket[buffers.ranges(self.at[:-1][present[a:b]], sizes[a:b])]
                for a, b in buffers.slices(np.append(0, np.cumsum(sizes)), TRAINING_CHUNK)
            ]
        )
        length = self.length[present][:, None]
        word_at = np.append(0, np.cumsum(sizes))[:-1]
        order = np.argsort(row, kind="stable")
        row, word, weight = row[order].astype(np.int32), word[order].astype(np.int32), weight[order][:, None]
        row_at = np.flatnonzero(np.append(True, np.diff(row) > 0))
        back_order = np.argsort(word, kind="stable")
        back_row, back_weight = row[back_order], weight[back_order]
        back_at = np.flatnonzero(np.append(True, np.diff(word[back_order]) > 0))
        by_bucket = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 1 << 31 else np.int64)
        bucket_at = np.flatnonzero(np.append(True, np.diff(flat[by_bucket]) > 0))
        touched = flat[by_bucket[bucket_at]]
        owner = np.repeat(np.arange(len(present), dtype=np.int32), sizes)[by_bucket]
        hit = target.astype(int)
        share = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max(len(target) - target.sum(), 1))[:, None]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.table[touched], self.soft, self.bias)]
        random = np.random.default_rng(len(flat))
        heard = np.empty((len(flat), 1), bool)

        def chosen(a: int, b: int) -> np.ndarray:
            heard[a:b] = random.random((b - a, 1), np.float32) >= dropout
            return self.table[flat[a:b]] * heard[a:b]

        for step in range(1, steps + 1):
            vectors = _sums(chosen, word_at, len(flat)) / length
            doc = np.zeros((len(target), self.table.shape[1]), np.float32)
            doc[row[row_at]] = _sums(lambda a, b: vectors[word[a:b]] * weight[a:b], row_at, len(row))
            logits = doc @ self.soft + self.bias
            logits -= logits.max(1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(target)), hit] -= 1
            delta = (chance * share).astype(np.float32)
            back = delta @ self.soft.T
            word_grad = _sums(lambda a, b: back[back_row[a:b]] * back_weight[a:b], back_at, len(row)) / length
            grads = (
                _sums(lambda a, b: word_grad[owner[a:b]] * heard[by_bucket[a:b]], bucket_at, len(flat)) + DECAY * self.table[touched],
                doc.T @ delta + 1e-4 * self.soft,
                delta.sum(0),
            )
            moves = []
            for grad, (m, v) in zip(grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.02 * (grad * grad - v)
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8))
            self.table[touched] -= moves[0]
            self.soft -= moves[1]
            self.bias -= moves[2]


def _word_slices(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Row and dictionary place of every word, slice by slice of whole texts, and the dictionary of all slices."""
    rows, parts = [], []
    for first, last in buffers.slices(buffers.text_bytes(texts)[1], TRAINING_SLICE):
        row, code, names = word_table(lowered(texts.slice(first, last - first)))
        rows.append((row + first).astype(np.int32))
        parts.append(pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), names))
    chunks = pa.chunked_array(parts).unify_dictionaries().chunks
    return rows, [c.indices.to_numpy() for c in chunks], chunks[0].dictionary


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the window of every word (rows are in order), and the row of every window."""
    if not len(rows):
        return rows, rows
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    position = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    fresh = position % WINDOW == 0
    return np.cumsum(fresh) - 1, rows[fresh]


def fresh_words(window: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Mask of the words that are not a repetition within their window."""
    out = np.ones(len(code), bool)
    for back in range(1, WINDOW):
        out[back:] &= (code[back:] != code[:-back]) | (window[back:] != window[:-back])
    return out


def train(
    texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = 4, steps: int = 40, rounds: int = 5
) -> Model:
    """Fit table and softmax together on labelled texts; the same input gives the same model.

    The first round learns on whole texts, the others on the windows that speak most for label 1: one of every
    text of label 1 and four of every other. A subword is learnt if enough texts hold it. The constant is set last, so
    that the strongest windows of both classes lie on its two sides.
    """
    target = np.array(labels, np.float64)
    blank = np.zeros(buckets, np.float32)
    if not len(texts) or target.min() == target.max():
        return Model(blank, 20.0 if len(texts) and target.min() == 1 else -20.0)
    column = pa.array(texts, pa.large_string())
    rows, codes, names = _word_slices(column)
    del column
    if not len(names):
        return Model(blank, -20.0)
    pairs = [np.unique(r.astype(np.int64) * len(names) + c, return_counts=True) for r, c in zip(rows, codes, strict=True)]
    row, word = (np.concatenate([f(p, len(names)).astype(np.int32) for p, _ in pairs]) for f in (np.floor_divide, np.mod))
    count = np.concatenate([n for _, n in pairs])
    del pairs
    texts_of = np.bincount(word, minlength=len(names)).astype(np.float32)
    pa.default_memory_pool().release_unused()  # else Arrow keeps the slices' memory
    fit = _Fit(names, texts_of, min(8, 2 + int(target.sum()) // 20), buckets, dim)
    size = np.bincount(row, weights=count, minlength=len(texts))
    common = texts_of[word] >= min(2, len(texts) // 50)  # a word of one text says nothing about others
    fit.learn(row[common], word[common], (count / size[row])[common], target, steps // 2)
    del row, word, count, size, common
    cut = [windows(r) for r in rows]  # no window crosses a text, no text a slice
    window_row = np.concatenate([r for _, r in cut])
    first_window = np.append(0, np.cumsum([len(r) for _, r in cut]))
    window = [(w + k).astype(np.int32) for (w, _), k in zip(cut, first_window[:-1], strict=True)]
    del cut, rows
    fresh = [fresh_words(w, c) for w, c in zip(window, codes, strict=True)]

    def window_values() -> np.ndarray:
        value = fit.word_values()
        slices = zip(window, codes, fresh, first_window[:-1], strict=True)
        return np.concatenate([np.bincount(w - k, weights=value[c] * f) for w, c, f, k in slices if len(w)])

    for _ in range(rounds):
        value = window_values()
        order = np.lexsort((-value, window_row))
        first = np.flatnonzero(np.append(True, np.diff(window_row[order]) > 0))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        picked = np.sort(order[rank < np.where(target[window_row[order]] == 1, 1, 4)])
        number = np.full(len(window_row), -1)
        number[picked] = np.arange(len(picked))
        inside = [(number[w] >= 0) & f for w, f in zip(window, fresh, strict=True)]
        bag = np.concatenate([number[w[i]] for w, i in zip(window, inside, strict=True)])
        fit.learn(
            bag,
            np.concatenate([c[i] for c, i in zip(codes, inside, strict=True)]),
            np.full(len(bag), 1 / WINDOW),
            target[window_row[picked]],
            steps,
            DROPOUT,
        )
    pa.default_memory_pool().release_unused()
    blank[fit.used] = fit.table @ (fit.soft[:, 1] - fit.soft[:, 0]) * SCALE
    value = window_values() / WINDOW
    best = np.zeros(len(texts))
    head = np.flatnonzero(np.append(True, np.diff(window_row) > 0))
    best[window_row[head]] = np.maximum.reduceat(value, head)
    return Model(blank, -boundary(best, target))


def boundary(values: np.ndarray, target: np.ndarray) -> float:
    """Value that parts the two classes with the fewest errors, in the middle of the widest such gap."""
    order = np.argsort(values, kind="stable")
    values, target = values[order], target[order]
    # Errors if everything from place k on is called 1; runs of equal values are not parted.
    errors = np.append(0, np.cumsum(target)) + np.append(np.cumsum((1 - target)[::-1])[::-1], 0)
    gap = np.concatenate([[1.0], np.diff(values), [1.0]])
    errors = np.where(gap > 0, errors, np.inf)
    k = int(np.lexsort((-gap, errors))[0])
    if k == 0 or k == len(values):
        return float(values[0] - 1 if k == 0 else values[-1] + 1)
    return float((values[k - 1] + values[k]) / 2)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Chance of label 1 for every text: that of its strongest window."""
    out = []
    lower = lowered(texts)
    _, bounds = buffers.text_bytes(lower)
    for first, last in buffers.slices(bounds):
        rows, code, names = word_table(lower.slice(first, last - first))
        best = np.zeros(last - first)
        if len(names):
            bucket, at = subwords(names, len(model.weights))
            value = np.add.reduceat(model.weights[bucket].astype(np.float64), at[:-1]) / np.diff(at)
            window, window_row = windows(rows)
            total = np.bincount(window, weights=value[code] * fresh_words(window, code)) / WINDOW
            best[np.unique(window_row)] = np.maximum.reduceat(
                total, np.flatnonzero(np.append(True, np.diff(window_row) > 0))
            )
        out.append(1 / (1 + np.exp(-np.clip(best + model.bias, -40, 40))))
    return np.concatenate(out) if out else np.empty(0)


def toxicity_score(model: Model, text: Column) -> Column:
    """Score (0 to 1) of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(model, texts), pa.float64())

    return score.asNondeterministic()(text.cast("string"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int
) -> tuple[list[str], list[int]]:
    """Up to ``rows`` labelled texts of each class, in hash order of their ids, and ``most_bytes`` of text in all.

    Whole texts only: a text that would pass the byte bound is left out of the sample, not cut.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        "_id is not null and _label in (0, 1)"
    )
    named = named.groupBy("_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64("_id")
    parts = [named.where(F.col("_label") == k).orderBy(order, "_id").limit(rows) for k in (0, 1)]
    picked = parts[0].union(parts[1])
    size = F.octet_length(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
        (size > 0) & (size <= most_bytes // 64)
    )
    found = texts.join(F.broadcast(picked), "_id").dropDuplicates(["_id", "_text"])
    taken, total = [], 0
    for row in sorted(found.toLocalIterator(), key=lambda r: (r["_id"] * 0x9E3779B1 % (1 << 32), r["_text"])):
        total += len(row["_text"])
        if total > most_bytes:
            break
        taken.append((row["_text"], row["_label"]))
    return [t for t, _ in taken], [k for _, k in taken]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    training_rows: int = TRAINING_ROWS,
    training_bytes: int = TRAINING_BYTES,
) -> Model:
    """Train on a bounded sample: at most ``training_rows`` texts per class and ``training_bytes`` of text."""
    return train(*labelled_sample(docs, labels, id_col, text_col, label_col, training_rows, training_bytes))


def is_held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by five."""
    return F.crc32(id_col.cast("string")) % 5 == 0
