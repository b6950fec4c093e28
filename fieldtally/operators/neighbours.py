"""Scaling of user features and the k nearest users under a mixed-type distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import join_hot

# Levels of cells that are counted at once, from the widest down; finer ones only where rows are still crowded.
_LEVELS = 12
# Distances are rounded to 12 decimals, and what is as near as the k-th one after that is a tie.
_TIE = 2e-12


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0…1 by their global range; a constant column becomes 0."""
    bounds = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns],
                             *[F.max(c).alias(f"hi_{c}") for c in columns])).scalar()
    return df.select(*[
        F.coalesce(F.try_divide(F.col(c) - bounds[f"lo_{c}"], bounds[f"hi_{c}"] - bounds[f"lo_{c}"]),
                   F.when(F.col(c).isNotNull(), 0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def l2_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows scaled to unit length over the columns; an all-zero row stays."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.select(*[
        F.when(norm == 0, 0.0).otherwise(F.col(c) / norm).alias(c) if c in columns else F.col(c) for c in df.columns])


def evenly_scaled(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Column]:
    """Columns moved to start at 0 and divided by the widest of their ranges, and that range (1 where it is 0)."""
    bounds = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns],
                             *[F.max(c).alias(f"hi_{c}") for c in columns])).scalar()
    ranges = [bounds[f"hi_{c}"] - bounds[f"lo_{c}"] for c in columns]
    widest = F.greatest(*ranges) if len(ranges) > 1 else ranges[0]
    widest = F.when(widest > 0, widest.cast("double")).otherwise(F.lit(1.0))
    return df.select(*[((F.col(c) - bounds[f"lo_{c}"]) / widest).alias(c) if c in columns else F.col(c)
                       for c in df.columns]), widest


def euclidean_distance(numeric: Sequence[tuple[Column, Column]]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in numeric), F.lit(0.0)))


def gower_distance(numeric: Sequence[tuple[Column, Column]], categories: Sequence[tuple[Column, Column]]) -> Column:
    """Mean of range-scaled differences and category mismatches."""
    total = F.lit(0.0)
    for a, b in numeric:
        total = total + F.abs(a - b)
    for a, b in categories:
        total = total + F.when(a == b, 0.0).otherwise(1.0)
    return total / (len(numeric) + len(categories))


def nearest_users(df: DataFrame, key: str, numeric: Sequence[str], categories: Sequence[str] = (), k: int = 5,
                  depth: int = 36, metric: str = "gower") -> DataFrame:
    """The k nearest other rows of each row: `(key, other, distance, rank)`.

    `metric` is "gower" or "euclidean"; the latter takes numeric columns only, as they are (scale them before
    with `min_max_scaled` or `l2_scaled` if they should count alike).

    Exact, without comparing all pairs. For Gower, numeric columns are scaled to 0…1, which makes
    the distance a sum of coordinate differences plus a constant per mismatch; for Euclid, all by the same number.

    1. Rows with equal features are one spot with its smallest keys; only the k + 1
       smallest can be anyone's neighbours, since ties go to the smaller key.
    2. Spots are placed in a pyramid of cells per category combination. The finest cell
       around a spot that holds k + 1 rows bounds the distance of the k-th neighbour. Only
       crowded cells are divided further, so that features which crowd at any scale (as
       rows of unit length do) meet few others: spots that ask at a level are few in each cell.
    3. Neighbours lie in cells next to the spot's own, at the level as wide as the
       bound; other category combinations only matter when the bound allows a mismatch.
    """
    if metric not in ("gower", "euclidean") or (metric == "euclidean" and categories):
        raise ValueError("metric must be gower, or euclidean without categories")
    n_features = len(numeric) + len(categories)
    plain = df.select(key, *numeric, *categories)
    if metric == "gower":
        scaled, unit, across, per = min_max_scaled(plain, numeric), F.lit(1.0), float(len(numeric)), n_features
        farthest = float(n_features)
    else:
        scaled, unit = evenly_scaled(plain, numeric)
        across, per, farthest = len(numeric) ** 0.5, 1, len(numeric) ** 0.5
    features = [*categories, *numeric]
    first_keys = F.slice(F.array_sort(F.collect_list(key)), 1, k + 1)
    # a limit on a row number is applied before the shuffle as well, so a spot shared by
    # very many rows arrives as k + 1 rows per task; salting spreads even those
    salted = scaled.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(64)))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*features, "_h").orderBy(key))).filter(
        F.col("_r") <= k + 1)
    spots = ranked.groupBy(*features).agg(first_keys.alias("keys"))
    sizes = scaled.groupBy(*features).agg(F.count("*").alias("n"))
    spots = spots.join(sizes, features)
    spots = cut_lineage(spots.withColumn("kept", F.least(F.col("n"), F.lit(k + 1))))

    top = 2 ** depth
    finest = [F.least(F.floor(F.col(c) * top), F.lit(top - 1)).cast("bigint").alias(f"_c{i}") for i, c in enumerate(numeric)]
    cells = [f"_c{i}" for i in range(len(numeric))]
    placed = spots.select(*features, "keys", "kept", *finest)

    def at_level(table: DataFrame, low: int, high: int) -> DataFrame:
        """One row per level; level 0 is the finest."""
        level = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level")
        return table.select(*table.columns, level).withColumns(
            {c: F.expr(f"shiftright({c}, level)") for c in cells})

    cats = list(categories)
    crowded, found = placed.select(*features, "kept", *cells), []
    for high in range(depth, -1, -_LEVELS):
        low = max(0, high - _LEVELS + 1)
        populated = at_level(crowded.select(*cats, "kept", *cells), low, high).groupBy(*cats, "level", *cells).agg(
            F.sum("kept").alias("there"))
        # coarse cells hold many spots each
        enough = join_hot(at_level(crowded.select(*features, *cells), low, high),
                          populated.filter(F.col("there") >= k + 1), [*cats, "level", *cells])
        finest_of = cut_lineage(enough.groupBy(*features).agg(F.min("level").alias("level")))
        found.append(finest_of)
        if low == 0 or finest_of.filter(F.col("level") == low).isEmpty():
            break
        crowded = crowded.join(finest_of.filter(F.col("level") == low).select(*features), features)
    enough = reduce(DataFrame.unionByName, found)
    # cell of side s: no two of its points differ by more than s per coordinate, which bounds their distance
    side = F.pow(F.lit(2.0), F.col("level") - depth)
    bound = enough.groupBy(*features).agg((F.min(side) * across).alias("reach"))
    # a category combination with too few rows of its own has to look everywhere
    asked = placed.join(bound, features, "left").withColumn("reach", F.coalesce("reach", F.lit(farthest)))
    asked = asked.withColumn("level", F.greatest(F.lit(0), F.least(
        F.lit(depth), F.ceil(F.log2(F.least(F.col("reach"), F.lit(1.0)) * top)))).cast("int"))
    offsets = [()]
    for _ in numeric:
        offsets = [(*o, d) for o in offsets for d in (-1, 0, 1)]
    around = F.array(*[F.array(*[F.lit(d) for d in o]) for o in offsets])
    asked = asked.select(
        *[F.col(c).alias(f"a_{c}") for c in features], F.col("keys").alias("a_keys"), "reach", "level",
        *cells, F.explode(around).alias("_o"))
    asked = asked.select(
        *[c for c in asked.columns if c not in cells and c != "_o"],
        *[(F.expr(f"shiftright({c}, level)") + F.col("_o")[i]).alias(c) for i, c in enumerate(cells)])

    span = asked.agg(F.min("level"), F.max("level")).first()
    listed = at_level(placed.select(*[F.col(c).alias(f"b_{c}") for c in features], F.col("keys").alias("b_keys"), *cells),
                      *(depth if v is None else v for v in span))
    same = F.lit(True)
    for c in cats:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    numbers = [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in numeric]
    distance = gower_distance(numbers, [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in cats]) if metric == "gower" \
        else euclidean_distance(numbers)
    met = asked.join(listed, ["level", *cells]).filter(same | (F.col("reach") >= 1.0))
    met = met.withColumn("distance", distance).filter(F.col("distance") * per <= F.col("reach") * (1 + 1e-12) + _TIE * per)
    spot = [f"a_{c}" for c in features]
    # per spot the k + 1 nearest rows are enough for all rows of the spot
    others = met.select(*spot, "a_keys", F.round("distance", 12).alias("distance"), F.explode("b_keys").alias("other"))
    best = others.withColumn("_r", F.row_number().over(Window.partitionBy(*spot).orderBy("distance", "other"))).filter(
        F.col("_r") <= k + 1).select(*spot, "distance", "other")
    rows = scaled.select(key, *[F.col(c).alias(f"a_{c}") for c in features])
    pairs = rows.join(best, spot).filter(F.col(key) != F.col("other"))
    order = Window.partitionBy(key).orderBy("distance", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        key, "other", (F.col("distance") * unit).alias("distance"), "rank")
