"""Best match between names that are spelled slightly differently, within a block.

Candidates come from shared segments (Li, Deng, Feng: Pass-Join, 2011): when a name is
cut into t + 1 segments, t edits must leave one of them intact, near its place, in any
name within that distance. An equi join on segments therefore finds every pair that
can reach the wanted similarity, without comparing all names of a block.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _edit_budget(cutoff: float, score: str) -> Callable[[Column, Column], Column]:
    """Upper bound of edits between names of lengths a and b that score at least `cutoff`.

    'edits' is 1 - levenshtein / max(a, b); 'ratio' is 2·M / (a + b), whose unmatched
    letters number at most (1 - cutoff)(a + b).
    """
    size = F.greatest if score == "edits" else lambda a, b: a + b
    return lambda a, b: F.floor((1 - cutoff) * size(a, b) + 1e-9).cast("int")


def _segment_start(length: Column, parts: Column, i: Column) -> Column:
    """Start (from 0) of segment i when `length` letters are cut into `parts` almost equal parts."""
    return F.floor(i * length / parts).cast("int")


def candidates(left: DataFrame, right: DataFrame, cutoff: float, score: str = "ratio") -> DataFrame:
    """Pairs `(block, l_name, r_name)` that may score at least `cutoff`.

    Both inputs hold `(block, name)`; names are compared as distinct values.
    """
    budget = _edit_budget(cutoff, score)
    r = right.select("block", F.col("name").alias("r_name")).distinct().withColumn("rl", F.length("r_name"))
    l = left.select("block", F.col("name").alias("l_name")).distinct().withColumn("ll", F.length("l_name"))
    # lengths a partner may have
    low = cutoff if score == "edits" else cutoff / (2 - cutoff)
    high = 1 / low

    def partner_lengths(n: Column) -> Column:
        return F.explode(F.sequence(F.greatest(F.ceil(n * low - 1e-9), F.lit(1)).cast("int"),
                                    F.floor(n * high + 1e-9).cast("int")))

    # indexed side: cut once for every budget its partners' lengths can give
    indexed = (
        r.filter(F.col("rl") > 0).withColumn("ll", partner_lengths(F.col("rl")))
        .withColumn("t", budget(F.col("ll"), F.col("rl"))).select("block", "r_name", "rl", "t").distinct()
        .withColumn("parts", F.least(F.col("t") + 1, F.col("rl")))
        .withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    )
    start, stop = (_segment_start(F.col("rl"), F.col("parts"), F.col("i") + k) for k in (0, 1))
    indexed = indexed.select("block", "r_name", "rl", "t", "i",
                             F.col("r_name").substr(start + 1, stop - start).alias("seg"))
    # probing side: the same segments, at every shift the budget allows. Of t + 1 segments some intact one has at most as many
    # edits before it as segments, and likewise after it, so that only smaller shifts need to be looked at
    probes = (
        l.filter(F.col("ll") > 0).withColumn("rl", partner_lengths(F.col("ll")))
        .withColumn("t", budget(F.col("ll"), F.col("rl")))
        .withColumn("parts", F.least(F.col("t") + 1, F.col("rl")))
        .withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    )
    probes = probes.withColumn("p", _segment_start(F.col("rl"), F.col("parts"), F.col("i"))).withColumn(
        "n", _segment_start(F.col("rl"), F.col("parts"), F.col("i") + 1) - F.col("p"))
    probes = probes.withColumn("at", F.explode(F.expr("sequence(p - t, p + t)"))).filter(
        (F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("ll")) & (F.expr("parts <= t") | F.expr(
            "abs(at - p) <= i and abs(at - p - (ll - rl)) <= t - i")))
    probes = probes.select("block", "l_name", "rl", "t", "i",
                           F.col("l_name").substr(F.col("at") + 1, F.col("n")).alias("seg")).distinct()
    # segments are several times the names, which no estimate of their size sees: never broadcast
    pairs = probes.join(indexed.hint("merge"), ["block", "rl", "t", "i", "seg"])
    # the budget bounds the edits as well: cheap to check before pairs are shuffled or scored
    close = pairs.filter(F.expr("levenshtein(l_name, r_name, t) >= 0"))
    return close.select("block", "l_name", "r_name").distinct()


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2·M / (a + b) over the longest matching blocks, as `difflib` defines it."""
    import difflib

    matcher = difflib.SequenceMatcher()
    out = []
    for x, y in zip(a, b):
        # the second sequence is the one being looked up
        matcher.set_seq2(x)
        matcher.set_seq1(y)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def best_match(left: DataFrame, right: DataFrame, cutoff: float = 0.9, score: str = "ratio") -> DataFrame:
    """For each left `(block, name)` the best right name scoring at least `cutoff`: `(block, name, match, score)`.

    `score` is 'ratio' (difflib's) or 'edits' (Levenshtein, all in the JVM). Ties go to
    the name that is greater in order, as a heap of (score, name) pairs would have it.
    """
    names = left.select("block", "name").distinct()
    same = names.join(right.select("block", "name").distinct(), ["block", "name"], "left_semi")
    # only an equal name scores 1, so that names which have one need no other
    pairs = candidates(names.join(same, ["block", "name"], "left_anti"), right, cutoff, score)
    equal = same.filter(F.length("name") > 0).select(
        "block", F.col("name").alias("l_name"), F.col("name").alias("r_name"), F.lit(1.0).alias("score")).filter(F.lit(cutoff <= 1))
    measure = matching_ratio if score == "ratio" else edit_similarity
    if score == "ratio":
        # letters left over are at least the edits: pairs that cannot reach the best of those with the fewest edits go unscored
        edits, sizes = F.levenshtein("l_name", "r_name"), F.length("l_name") + F.length("r_name")
        pairs = cut_lineage(pairs.withColumn("most", 1 - edits / sizes))
        known = pairs.groupBy("block", "l_name").agg(F.max(F.struct("most", "r_name"))["r_name"].alias("first")).select(
            "block", "l_name", matching_ratio(F.col("l_name"), F.col("first")).alias("known"))
        pairs = pairs.join(known, ["block", "l_name"]).filter(F.col("most") >= F.greatest(F.col("known"), F.lit(cutoff)) - 1e-12)
    scored = pairs.withColumn("score", measure(F.col("l_name"), F.col("r_name"))).filter(
        F.col("score") >= cutoff - 1e-12).select("block", "l_name", "r_name", "score").unionByName(equal)
    best = scored.groupBy("block", "l_name").agg(F.max(F.struct("score", "r_name")).alias("b"))
    return best.select("block", F.col("l_name").alias("name"), F.col("b.r_name").alias("match"),
                       F.col("b.score").alias("score"))
