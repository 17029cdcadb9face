"""Benchmark decontamination by spaced-seed hashing (operator 6, native).

Words are the runs of letters and digits of the lower-cased text. A mask fixes which words of a short window are hashed; the words
between are ignored. Hashes of all windows of the documents are joined with those of the benchmark. Around each hit the two
word sequences are laid over each other, and it counts if some stretch of 16 words (of the whole item, if it is shorter)
agrees in four of five words. The two masks leave no such stretch without a hit for items of eight words or more, whatever
the substituted words are; the tests prove it by trying all. Items of five to seven words must agree in every word. Shorter
items are no passage.

The documents' side is one scan: long texts are cut into overlapping blocks, windows become rows inside the scan's stage, the
seeds of the benchmark are broadcast while they are no more than `SEEDS`, and hits are verified in place, so that no text is shuffled. Of a
larger benchmark the hashes alone meet those of the documents (as a broadcast list up to a million); what hits is then joined with
its seed, frequent seeds by broadcast, and with its block's words, which move once.

Null and empty texts hold no passage and are none. Equal documents each get their rows. Rows with a null key are judged too and
come out with a null key. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import BROADCAST_ROWS, let, materialize, row_named, small, without

#: Fixed masks: the places of a window that are hashed.
MASKS = ((0, 1, 2, 5), (0, 2, 3, 4))
WINDOW = 16
SHARE = 5  # one word in so many may differ
BLOCK = 4096
LEAST, TOLERANT = 5, 8
#: Seeds that a broadcast may hold: 44 words each, some 60 MB in an executor.
SEEDS = 100_000
SPAN = max(p for m in MASKS for p in m) + 1


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def blocks(texts: DataFrame) -> DataFrame:
    """texts: key, words. Rows key, first, words: blocks of BLOCK words and as many around as a verified stretch can reach."""
    around = WINDOW + SPAN
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    one = F.col("words")
    cut = F.transform(begins, lambda b: F.struct(F.greatest(b - around, F.lit(0)).alias("first"), F.slice(one, F.greatest(b - around, F.lit(0)) + 1, BLOCK + 2 * around).alias("words")))
    short = F.array(F.struct(F.lit(0).alias("first"), one.alias("words")))
    return texts.where(F.size("words") > 0).select("key", F.inline(F.when(F.size("words") <= BLOCK, short).otherwise(cut)))


def seeds(parts: DataFrame, *keep: str) -> DataFrame:
    """A row for each window and mask: hash, span (words of the mask), at (of the window in the words) and the kept columns."""
    places = sorted({p for m in MASKS for p in m})
    n = F.size("words")
    shifted = F.arrays_zip(*(F.slice("words", p + 1, F.greatest(n - p, F.lit(0))).alias(f"w{p}") for p in places))
    rows = parts.select(*keep, F.posexplode(shifted).alias("at", "w"))
    hashes = [F.when(F.col(f"w.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w.w{p}") for p in m))) for k, m in enumerate(MASKS)]
    return rows.select(*keep, "at", F.stack(F.lit(len(MASKS)), *(c for h, m in zip(hashes, MASKS, strict=True) for c in (h, F.lit(m[-1] + 1)))).alias("hash", "span")).where("hash is not null")


def meet(rows: DataFrame, table: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a table that may have several rows a key. Keys with more than a `most`-th of all rows are joined by broadcast."""
    counts = materialize(rows.groupBy(on).agg(F.count("*").alias("n")), "counts")
    limit = max(1, rows.count() // most)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(on))  # fewer than `most`
    often = materialize(table.join(hot, on, "left_semi"), "often")
    return rows.join(hot, on, "left_anti").join(table, on).unionByName(rows.join(hot, on, "left_semi").join(small(often, most), on))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_seeds: int = SEEDS, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, matched, window, first_word: for each pair the largest number of agreeing words in a stretch of `window` words.

    first_word is the place in the document of the first such stretch's hit.
    """
    items = benchmark.select(F.col(item).alias("item_id"), word_list(F.col(item_text)).alias("words")).where(F.size("words") >= LEAST)
    around = WINDOW + SPAN
    marked = seeds(items.select("item_id", F.col("words").alias("item"), "words"), "item_id", "item")
    # With each seed go the words that a stretch around it can reach, not the whole item: a row has 44 words at most.
    first = F.greatest(F.col("at") - around, F.lit(0))
    table = materialize(marked.select("hash", "span", "item_id", F.size("item").alias("length"), (F.col("at") - first).alias("item_at"), F.slice("item", first + 1, 2 * around).alias("item")), "seeds")
    parts = blocks(docs.select(F.col(key).cast("bigint").alias("key"), word_list(F.col(text)).alias("words")))
    if table.limit(most_seeds + 1).count() <= most_seeds:
        hits = seeds(parts, "key", "first", "words").drop("span").join(F.broadcast(table), "hash")
    else:
        parts = materialize(parts.withColumn("block", F.monotonically_increasing_id()), "blocks")
        known = materialize(table.select("hash").distinct(), "hashes")
        met = materialize(seeds(parts, "block").drop("span").join(small(known, most), "hash", "left_semi"), "hits")
        hits = meet(met, table, "hash", most).join(parts, "block")
    # Laid over each other: word i of the item faces word i + shift of the block; only what a stretch around the hit can reach counts.
    size = F.least(F.lit(WINDOW), F.col("length"))
    shift = F.col("at") - F.col("item_at")
    low = F.greatest(F.lit(0), -shift, F.col("item_at") + F.col("span") - size)
    high = F.least(F.size("item"), F.size("words") - shift, F.col("item_at") + size)
    hits = hits.select("key", "item_id", "item", "words", (F.col("first") + F.col("at")).alias("place"), size.alias("window"), shift.alias("shift"), F.greatest(low, F.lit(0)).alias("low"), high.alias("high"))
    hits = hits.where("high - low >= window")
    same = F.transform(F.sequence(F.col("low"), F.col("high") - 1), lambda i: F.when(F.get("item", i) == F.get("words", i + F.col("shift")), F.lit(1)).otherwise(F.lit(0)))
    # As a generator, the fold stays above the join: as part of the join's condition it would be evaluated outside generated code,
    # and every window of every document would be copied for it.
    found = hits.select("key", "item_id", "window", "place", F.inline(F.array(F.struct(let(same, best_stretch).alias("matched")))))
    allowed = F.when(F.col("window") < TOLERANT, F.lit(0)).otherwise(F.floor(F.col("window") / SHARE))
    found = found.where(F.col("matched") >= F.col("window") - allowed)
    return found.groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"), F.min("place").alias("first_word"))


def best_stretch(same: Column) -> Column:
    """The largest sum of `window` neighbours, by one fold over the agreements: (sum of the last ones, the best so far)."""

    def step(s: Column, i: Column) -> Column:
        total = F.get(same, i) + s["sum"] - F.coalesce(F.get(same, i - F.col("window")), F.lit(0))
        return let(total, lambda t: F.struct(t.alias("sum"), F.when(i >= F.col("window") - 1, F.greatest(s["best"], t)).otherwise(s["best"]).alias("best")))

    return F.aggregate(F.sequence(F.lit(0), F.size(same) - 1), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best")), step)["best"]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark passage, with their columns as they are. Rows with a null or a repeated key are judged each by its text."""
    rows, at = row_named(docs, key)
    found = materialize(overlaps(rows, benchmark, at, text).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return without(rows, found, at).select(*(F.col(f"`{c}`") for c in docs.columns))
