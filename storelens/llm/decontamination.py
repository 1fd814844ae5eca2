"""Benchmark decontamination by a prefix-filtered set join, in Spark SQL functions alone.

Words are lower-cased runs of letters, digits and non-ASCII characters. A benchmark item of ``width`` words or more
gives every window of ``width`` consecutive words; a shorter item that has words is one window. A document word is
*hit* when it lies inside any occurrence of a window (the same words, consecutively).

Method. An occurrence of a window must hold each of its words, so for exact containment (threshold 1) the necessary
prefix of a window, with its words ordered by rarity, is its single rarest word:

1. *Rarity*: occurrences in the documents of every word that benchmark windows hold, counted over all documents
   (partial aggregation; only benchmark words pass a semi join). Ties break by the word itself.
2. *Prefix join*: every document position is joined on its word with the windows whose prefix word it is. The
   *positional bound* places the occurrence at ``position - j`` (``j``: where the prefix word lies in the window),
   and the *length bound* keeps it only when the window fits between the document's first and last word.
3. *Verification*: candidate documents are met again by their text key and the ``L`` words at the candidate's
   start are compared with the window's words, exactly.

Where the probe rows (prefix word, place, window) fit in ``PROBE_BYTES`` (counted, not guessed), they are broadcast
and candidates are verified in the scan that finds them, against the words of the row at hand: no text is shuffled.
Beyond that the probe join is an ordinary shuffle join on the word, candidates are shuffled, and only the texts with
candidates meet them again by their key. A text repeated in many rows is verified once per row and reported for
every row.

Rows: one output row per input row, repeated rows and extra columns included. A null or empty text has no words:
``n_words`` 0, nothing hit. A null doc_id is carried as null. Items whose text has no words give no window; a null
item_id can hit words but is not counted in ``n_items`` nor written into ``items_sha256``. With no items found,
``items_sha256`` is the hash of the empty string. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.session import stored

#: Fixed values of the contract: the word pattern and the window width.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
#: The characters that end a word once A-Z are lower-cased: ASCII but for digits and a-z.
BREAKS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Windows whose probe rows fit in this many bytes are verified in the scan itself (the probe table broadcast).
PROBE_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z only (the matches of ``WORD``); a null text has none.

    One ``translate`` turns A-Z to a-z and every break character into a blank, and a split on the blank (no regular
    expression) cuts the words: the same words as the pattern, about six times faster.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), BREAKS + UPPER, " " * len(BREAKS) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart: two independent 64-bit hashes of the text (null as empty)."""
    plain = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("decontamination"), plain).alias("h2"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct windows of the benchmark items: ``window`` (array of words), ``n`` (its length), ``items`` (ids)."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = items.select(
        "item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("i")
    )
    windows = starts.select("item", F.expr(f"slice(w, i + 1, least({width}, size(w)))").alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        "window", F.size("window").alias("n"), "items"
    )


def prefix_tokens(words: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window its rarest word ``token`` and where it lies in the window (``j``).

    ``words`` is one row per document word (column ``word``); counts reach only words that some window holds.
    """
    vocabulary = stored(windows.select(F.explode("window").alias("word")).distinct(), "decontam-vocab")
    counts = words.join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    placed = windows.select("window", F.posexplode("window").alias("j", "word"))
    rated = placed.join(counts, "word", "left").select(
        "window", "j", "word", F.coalesce("freq", F.lit(0)).alias("freq")
    )
    best = rated.groupBy("window").agg(F.min(F.struct("freq", "word", "j")).alias("best"))
    return best.select("window", F.col("best.word").alias("token"), F.col("best.j").alias("j"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated."""
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, width), "decontam-windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w")
    )
    positions = texts.select("key", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    prefixes = stored(prefix_tokens(positions.select("word"), windows), "decontam-prefix")
    probes = stored(
        prefixes.join(windows.select("window", "n"), "window").select(F.col("token").alias("word"), "j", "n", "window"),
        "decontam-probes",
    )
    bounds = "start >= 0 and start + n <= n_words"
    probe_bytes = probes.select(F.sum(F.expr("40 + length(word) + aggregate(window, 0L, (s, x) -> s + length(x) + 8)"))).first()[0]
    if (probe_bytes or 0) <= PROBE_BYTES:
        # Prefix join, bounds and exact verification in one pass over the words of each row.
        carried = texts.select("key", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        met = carried.join(F.broadcast(probes), "word").select(
            "key", "w", "n_words", (F.col("pos") - F.col("j")).alias("start"), "n", "window"
        )
        found = met.where(bounds).where("slice(w, start + 1, n) = window").select("key", "start", "n", "window").distinct()
    else:
        # Prefix join with positional and length bounds; candidates of one text are met once however often it repeats.
        candidates = positions.join(probes, "word").select(
            "key", (F.col("pos") - F.col("j")).alias("start"), "n", "window", "n_words"
        )
        bounded = candidates.where(bounds).drop("n_words").distinct()
        wanted = stored(bounded.groupBy("key").agg(F.collect_list(F.struct("start", "n", "window")).alias("c")), "decontam-wanted")
        # Exact verification on the words of the candidate texts only.
        met = texts.join(wanted, "key").select("key", "w", F.explode("c").alias("c"))
        found = met.where("slice(w, c.start + 1, c.n) = c.window").select("key", "c.start", "c.n", "c.window").distinct()
    found = stored(found, "decontam-found")
    hit = found.select("key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
    n_hit = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.join(windows.select("window", "items"), "window").select("key", F.explode("items").alias("item"))
    listed = items.where("item is not null").groupBy("key").agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    per_text = stored(n_hit.join(listed, "key", "full"), "decontam-per-text")
    out = texts.select("doc_id", "key", F.size("w").cast("long").alias("n_words")).join(per_text, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def summarised(found: DataFrame) -> DataFrame:
    """The contract's digest: the items as a SHA-256 of their comma-joined ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
