"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, without, words_of

# A passage counts as leaked if on one alignment a window of WINDOW words has at most
# SUBSTITUTIONS words that differ. The two masks below (places that are hashed, from the start
# of a seed) are lossless for these numbers: whatever two words of a window differ, one of the
# masks fits between them somewhere. tests/llm checks that over all such windows.
WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 3, 4, 6), (0, 1, 3, 8, 9, 10))
# Seeds of the benchmark are broadcast up to this many rows (40 bytes each), else shuffled.
BROADCAST_ROWS = 500_000


def _word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; an empty text has none."""
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask_no: int, mask: Sequence[int]) -> Column:
    """Hash of the masked words from place `at`; null where the mask reaches past the end."""
    fits = (at >= 0) & (at + mask[-1] < F.size(hashes))
    return F.when(fits, F.xxhash64(F.lit(mask_no), *[F.get(hashes, at + o) for o in mask]))


def _seeds(table: DataFrame, masks: Sequence[Sequence[int]], window: int) -> DataFrame:
    """One row per place and mask of every text of at least `window` words."""
    last = F.size("hashes") - min(m[-1] for m in masks) - 1
    placed = table.filter(F.size("hashes") >= window).select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    seeds = F.array(*[_seed(F.col("hashes"), F.col("at"), i, m) for i, m in enumerate(masks)])
    return placed.select("*", F.posexplode(seeds).alias("mask", "seed")).filter("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS,
          masks: Sequence[Sequence[int]] = MASKS) -> DataFrame:
    """Benchmark items found in documents: doc_id, text_hash, item_id, first_word, n_words, n_equal.

    One row per document (by id and text) and item with its best alignment: first_word is the
    document's word under the first overlapping word of the item (from 0), n_words the length
    of the overlap, n_equal how many words are equal in it. Words are compared in lower case.
    `docs(doc_id, text)`, `benchmark(item_id, text)`; null texts are empty; texts and items
    of fewer than `window` words match nothing; null ids stay null; repeated rows give one
    result; items with equal words are matched once and reported under each id; empty tables
    give an empty table; further columns are left out. Ties between alignments go to the
    longer overlap, then the earlier place.

    Documents are read once and never shuffled: their seeds meet the benchmark's in memory
    while those have at most BROADCAST_ROWS rows, and by a shuffled join beyond that. Hits next
    to one another on an alignment are one run, of which only the first is looked at.
    """
    items = benchmark.select("item_id", _word_hashes(text_or_empty()).alias("hashes"))
    items = stored(items.filter(F.size("hashes") >= window).groupBy("hashes").agg(
        F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless"))
        .withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    seeds = _seeds(items.select("item", "hashes"), masks, window).select(
        "item", F.col("at").alias("item_at"), F.col("mask").alias("item_mask"), F.col("seed").alias("item_seed"))
    whole = items.select(F.col("item").alias("whole_item"), F.col("hashes").alias("item_hashes"))
    places = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    if places * len(masks) <= BROADCAST_ROWS:
        seeds, whole = F.broadcast(seeds), F.broadcast(whole)

    text = text_or_empty()
    table = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _word_hashes(text).alias("hashes"))
    hits = _seeds(table, masks, window).join(
        seeds, (F.col("mask") == F.col("item_mask")) & (F.col("seed") == F.col("item_seed")))
    hits = hits.join(whole, F.col("item") == F.col("whole_item"))
    before = F.lit(False)
    for i, m in enumerate(masks):
        same = _seed(F.col("hashes"), F.col("at") - 1, i, m) == _seed(F.col("item_hashes"), F.col("item_at") - 1, i, m)
        before = before | ((F.col("mask") == i) & F.coalesce(same, F.lit(False)))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    length = F.least(F.size("item_hashes") + shift, F.size("hashes")) - first
    aligned = hits.filter(~before).select(
        "doc_id", "text_hash", "item", shift.alias("shift"), first.alias("first_word"), length.alias("n_words"),
        F.slice("hashes", first + 1, length).alias("ours"),
        F.slice("item_hashes", first - shift + 1, length).alias("theirs"))
    aligned = aligned.dropDuplicates(["doc_id", "text_hash", "item", "shift"]).filter(F.col("n_words") >= window)
    equal = aligned.withColumn("equal", F.zip_with("ours", "theirs", lambda a, b: (a == b).cast("int")))
    counts = F.transform(F.sequence(F.lit(1), F.col("n_words") - (window - 1)), lambda s: F.aggregate(
        F.slice("equal", s, F.lit(window)), F.lit(0), lambda x, y: x + y))
    found = equal.withColumn("most", F.array_max(counts)).filter(F.col("most") >= window - substitutions)
    n_equal = F.aggregate("equal", F.lit(0), lambda x, y: x + y)
    best = found.groupBy("doc_id", "text_hash", "item").agg(F.max(F.struct(
        n_equal.alias("n_equal"), "n_words", (-F.col("first_word")).alias("place"))).alias("best"))
    kind = benchmark.schema["item_id"].dataType
    names = items.select("item", F.explode(F.when(F.col("nameless"), F.concat("ids", F.array(F.lit(None).cast(kind))))
                                           .otherwise(F.col("ids"))).alias("item_id"))
    return best.join(names, "item").select("doc_id", "text_hash", "item_id", (-F.col("best.place")).alias("first_word"),
                                           "best.n_words", "best.n_equal")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item; columns as they were."""
    return without(docs, stored(leaks(docs, benchmark, **parameters).select("doc_id", "text_hash").distinct(), "leaking-rows"))
