"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

# Per-source running sums are built from this many slices of the shuffle key, so that a
# source with a third of all rows is summed by many tasks.
SLICE_DIGITS = 2
# The range of virtual time is cut into this many parts per unit; only the part in which the
# budget runs out is summed row by row.
PARTS = 4096
# Columns of the stored table beside those of the input.
ROW, SIZE = "__mix_row", "__mix_size"


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: int, share: float) -> DataFrame:
    """Target of every source: `sizes(source, source_size)` plus weight, target, budget.

    Sources in code point order (null last) take the weights in turn. Together they get
    `share` times all words; a target ends at `epochs` times its source's size and the
    excess goes to the others by weight. Ordered by the ratio of cap to weight, the
    sources that end at their cap come first, so that the common level is found with
    running sums. One row per source is all that this step handles.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    table = (sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
             .withColumn("cap", (epochs * F.col("source_size")).cast("double"))
             .withColumn("total", F.sum("source_size").over(W.partitionBy()))
             .withColumn("shared", F.lit(float(share)) * F.col("total")))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    behind = order.rowsBetween(0, W.unboundedFollowing)
    table = (table.withColumn("left", F.col("shared") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             .withColumn("open", F.sum("weight").over(behind))
             .withColumn("place", F.row_number().over(order)))
    fits = F.col("weight") * F.col("left") / F.col("open") <= F.col("cap")
    table = table.withColumn("first_open", F.min(F.when(fits, F.struct("place", "left", "open"))).over(W.partitionBy()))
    target = F.when(F.col("place") >= F.col("first_open.place"),
                    F.col("weight") * F.col("first_open.left") / F.col("first_open.open")).otherwise(F.col("cap"))
    budget = F.floor(F.least("shared", F.sum("cap").over(W.partitionBy()))).cast("long")
    return table.select("source", "source_size", "weight", target.alias("target"), budget.alias("budget"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), epochs: int = 2, share: float = 1.5,
        seed: str = "mix") -> DataFrame:
    """What a mix takes of each document: `docs` columns plus size, source_size, target, copies, taken.

    Every source is a queue of its documents in shuffled order (by MD5 of seed and id),
    repeated `epochs` times. The virtual finish time of a copy is the words of its queue up
    to and including it, divided by the source's target. All copies are ordered by finish
    time and taken while their words together stay within the budget (all targets, rounded
    down). Copies are whole: the first one past the budget ends the mix.

    Null texts have size 0; documents of size 0 are never taken; null sources form one
    source; null ids are shuffled as empty ids. Repeated rows stand in the queue one after
    the other. An empty table gives an empty table. Columns of `docs` whose names clash with
    the new ones are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    table = stored(docs.select(*kept, size.alias(SIZE), F.monotonically_increasing_id().alias(ROW)), "mix-documents")
    rows = table.select(F.col(ROW).alias("row"), "doc_id", "source", F.col(SIZE).alias("size"), key.alias("key"))
    rows = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, epochs,
                             share)
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    slices = slices.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("s"), F.col("slice").alias("k"), "ahead", "source_size", "target", "budget")

    running = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "row").rowsBetween(
        W.unboundedPreceding, 0)
    queue = rows.withColumn("within", F.sum("size").over(running)).join(
        slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    queue = stored(queue.select("row", "doc_id", "source", "key", "size", "source_size", "target", "budget",
                                (F.col("ahead") + F.col("within")).alias("upto")), "mix-queue")
    copies = queue.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    copies = copies.withColumn("part", F.least(F.floor(F.col("finish") * PARTS), F.lit(4 * PARTS)).cast("long"))

    # one number: the part of virtual time in which the budget runs out, and the words before it
    parts = copies.groupBy("part").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    upto = F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    last = parts.withColumn("upto", upto).filter("upto > budget").orderBy("part").first()
    if last is None:
        counted = copies.groupBy("row").agg(F.count("*").alias("copies"))
    else:
        order = W.partitionBy("part").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "epoch", "row")
        edge = copies.filter(F.col("part") == last["part"]).withColumn(
            "upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) + (last["upto"] - last["words"]))
        edge = edge.filter(F.col("upto") <= F.col("budget"))
        whole = copies.filter(F.col("part") < last["part"])
        counted = whole.select("row").unionByName(edge.select("row")).groupBy("row").agg(F.count("*").alias("copies"))
    taken = queue.select("row", "size", "source_size", "target").join(counted, "row", "left").select(
        "row", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    taken = taken.withColumn("taken", F.col("copies") * F.col("size"))
    taken = taken.select(F.col("row").alias(ROW), *new)
    return table.select(ROW, *kept).join(taken, ROW).select(*kept, *new)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every document as often as it was taken, with the columns of `docs`."""
    out = mix(docs, **parameters).filter("copies > 0")
    repeats = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return out.select("*", repeats).select(*[c for c in docs.columns if c in out.columns])
