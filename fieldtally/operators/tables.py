"""Joins, de-duplication and reshaping used across the reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import TOTAL


def with_scale(reports: DataFrame, codes: DataFrame, scale: str, key: str = "version_uuid") -> DataFrame:
    """Reports with the name of the area they lie in; reports without a code keep a null name."""
    return reports.join(codes.select(key, scale), key, "left")


def within_entity(reports: DataFrame, codes: DataFrame, scale: str, entity: str,
                  key: str = "version_uuid") -> DataFrame:
    """Reports of one entity.

    `codes` holds one row per report, so the left join followed by an equality on its
    name is a semi join, and for 'Total' no join is needed at all.
    """
    if entity == TOTAL:
        return reports
    return reports.join(codes.filter(F.col(scale) == F.lit(entity)).select(key), key, "left_semi")


def entity_tags(scale: str, entities: Sequence[str]) -> Column:
    """The wanted entities a row counts for: its own and, if wanted, 'Total'."""
    own = [F.when(F.col(scale).isin([e for e in entities if e != TOTAL]), F.col(scale))]
    total = [F.lit(TOTAL)] if TOTAL in entities else []
    return F.array_compact(F.array(*own, *total))


def with_legend(codes: DataFrame, legend: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Attach names to codes. Whether the legend is broadcast is left to Spark, which knows its size."""
    return codes.join(legend, key, how)


def align(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer alignment of frames that share a key."""
    return reduce(lambda left, right: left.join(right, key, "full_outer"), frames)


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet known."""
    return new.join(known.select(key), key, "left_anti")


def append(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames with the same columns, whatever their order."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def overwrite_where_known(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Replace `column` by the update of the same key where that is not null."""
    new = updates.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]],
            keep: Sequence[str]) -> DataFrame:
    """The first row per key, by (column, descending) pairs and then by `keep`; nulls come last.

    A minimum over a struct instead of a numbered window: it combines before the
    shuffle and needs no sort, so a key with very many rows stays cheap. Ordering
    columns that are sorted downwards must be numeric.
    """
    parts: list[Column] = []
    for i, (name, descending) in enumerate(order):
        parts.append(F.col(name).isNull().alias(f"n{i}"))
        parts.append((-F.col(name) if descending else F.col(name)).alias(f"o{i}"))
    for i, name in enumerate(keep):
        parts.append(F.col(name).isNull().alias(f"m{i}"))
        parts.append(F.col(name).alias(f"k{i}"))
    best = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.k{i}").alias(name) for i, name in enumerate(keep)])


def counts_by(df: DataFrame, *keys: str, name: str = "ct") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def wide_counts(category: Column, values: Sequence[str], weight: Column | None = None) -> list[Column]:
    """One aggregate per category value; null where the group has none of it.

    With a fixed list of values a pivot is a set of conditional aggregates: one
    shuffle, and no job to discover the values.
    """
    amount = F.lit(1).cast("bigint") if weight is None else weight
    return [F.sum(F.when(category == v, amount)).alias(v) for v in values]


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts per key and category value, wide.

    Without `values` Spark looks them up first, and refuses more than
    ``spark.sql.pivotMaxValues``. The null category has no column.
    """
    if values is not None:
        return df.groupBy(key).agg(*wide_counts(F.col(column), values))
    long = counts_by(df.filter(F.col(column).isNotNull()), key, column)
    wide = long.groupBy(key).pivot(column).agg(F.first("ct"))
    # keep the keys that hold the null category only
    return df.select(key).distinct().join(wide, key, "left")


def row_total(columns: Sequence[str]) -> Column:
    """Sum across columns, nulls skipped."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def ordered(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sort by (column, descending) pairs, nulls last either way."""
    return df.orderBy(*[F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c, desc in keys])


def padded(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), fill: float | int | None = 0) -> DataFrame:
    """Exactly the given columns in their order, missing ones added, nulls filled."""
    have = set(df.columns)
    out = [F.col(c) for c in keep]
    for c in columns:
        value = F.col(c) if c in have else F.lit(None).cast("bigint")
        out.append((value if fill is None else F.coalesce(value, F.lit(fill))).alias(c))
    return df.select(*out)


def join_hot(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", share: float = 0.005,
             tracked: int = 10_000) -> DataFrame:
    """Join a table with very frequent keys to one with few rows per key (`how` keeps the first side: inner, left, semi, anti).

    A sketch of frequent items, merged over all tasks, finds the keys with more than about `share` of all rows; there are at
    most 1 / share of them, so that the table of them is broadcast. Their rows are dealt out by number, equal rows too, and
    the other side is repeated for those keys only; all other keys join plainly. Numbers follow a local order of whole
    rows, so that a task that runs again deals alike. A wrong guess of the sketch changes the spread, not the result.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti", "semi", "anti"):
        raise ValueError(f"no {how} join with frequent keys")

    def hashed(side: DataFrame) -> Column:
        return F.xxhash64(*[F.col(k).cast(many.schema[k].dataType) for k in keys])

    found = many.select(hashed(many).alias("_h")).agg(
        F.count("*").alias("_n"), F.expr(f"approx_top_k(_h, {int(1 / share)}, {tracked})").alias("_top"))
    parts = F.ceil(F.col("_item.count") / (F.col("_n") * share)).cast("int")
    hot = F.broadcast(found.select("_n", F.explode("_top").alias("_item")).select(
        F.col("_item.item").alias("_h"), parts.alias("_parts")).filter("_parts > 1"))
    marked = many.withColumn("_h", hashed(many))
    cold = marked.join(hot, "_h", "left_anti").select(*many.columns).join(one, list(keys), how)
    number = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")
    dealt = marked.join(hot, "_h").sortWithinPartitions(*many.columns).withColumn("_part", number).select(*many.columns, "_part")
    copies = one.withColumn("_h", hashed(one)).join(hot, "_h").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*one.columns, "_part")
    return cold.unionByName(dealt.join(copies, [*keys, "_part"], how).drop("_part"))
