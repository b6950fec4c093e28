"""Density clustering (DBSCAN) of many independent groups of points, as joins on a grid.

A group may hold a large part of all rows, and a spot a large part of a group: no step
collects a group, and no step pairs all points of a crowded spot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import cell_key
from ..session import cut_lineage
from .components import components

# Boxes of a grid cell, and of a box: 8 per side.
_COARSE_BITS = 3


def _box_index(value: Column, side: float) -> Column:
    return F.floor(value / (side / 2 ** _COARSE_BITS)).cast("bigint")


def _box(fx: Column, fy: Column, drop_bits: int) -> Column:
    return cell_key(F.shiftright(fx, drop_bits), F.shiftright(fy, drop_bits))


def _neighbours(cell: str, reach: int = 2, half: bool = False) -> Column:
    """Cells around a cell, itself included unless only one half is asked for.

    The key holds both cell numbers, x in the upper 32 bits: moving is an addition.
    """
    around = [(i << 32) + j for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)
              if not half or (i, j) > (0, 0)]
    return F.expr(f"transform(array({', '.join(f'{o}L' for o in around)}), o -> {cell} + o)")


def _linked_cells(core: DataFrame, by: list[str], eps: float) -> DataFrame:
    """Pairs of neighbouring cells with core points at most `eps` apart.

    Boxes decide all pairs: boxes whose extents lie wholly within `eps` link
    their cells, boxes that lie wholly beyond it cannot. Box pairs in between are cut into
    finer boxes, round by round, down to single positions; points are never paired.
    """
    def extents(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*by, "cell", *keys).agg(
            F.min("x").alias("lox"), F.max("x").alias("hix"), F.min("y").alias("loy"), F.max("y").alias("hiy"))

    def side(boxes: DataFrame, s: str, columns: list[str]) -> DataFrame:
        return boxes.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in columns])

    def judged(pairs: DataFrame) -> DataFrame:
        gap = "greatest(lo{0}_b - hi{0}_a, lo{0}_a - hi{0}_b, 0D)"
        reach = "greatest(abs(hi{0}_b - lo{0}_a), abs(hi{0}_a - lo{0}_b))"
        near, far = (F.expr(f"sqrt(pow({e.format('x')}, 2) + pow({e.format('y')}, 2))") for e in (gap, reach))
        return pairs.withColumn("near", near).withColumn("far", far).filter(F.col("near") <= eps)

    ends = ["lox", "hix", "loy", "hiy"]
    cells = [*by, "cell_a", "cell_b"]

    coarse = extents(core, "coarse")
    a = side(coarse, "a", ["cell", "coarse", *ends]).withColumn("cell_b", F.explode(_neighbours("cell_a", half=True)))
    first = judged(a.join(side(coarse, "b", ["cell", "coarse", *ends]), [*by, "cell_b"]))
    first = cut_lineage(first.select(*cells, "coarse_a", "coarse_b", (F.col("far") <= eps).alias("sure")))
    linked = first.filter("sure").select(*cells).distinct()
    open_boxes = first.filter(~F.col("sure")).join(linked, cells, "left_anti")
    if open_boxes.isEmpty():
        return linked

    # boxes of open pairs are halved, three times a round, until every pair is decided: a box of one position always is
    found, bits, side_length = linked, _COARSE_BITS, eps / math.sqrt(2) * (1 - 1e-12)
    pairs = open_boxes.select(*cells, F.col("coarse_a").alias("box_a"), F.col("coarse_b").alias("box_b"))
    boxes = core.withColumnRenamed("coarse", "box")
    while True:
        bits += _COARSE_BITS
        wanted = pairs.select(*by, F.explode(F.array(F.struct(F.col("cell_a").alias("cell"), F.col("box_a").alias("box")), F.struct(
            F.col("cell_b").alias("cell"), F.col("box_b").alias("box")))).alias("e")).select(*by, "e.cell", "e.box").distinct()
        step = side_length / 2 ** bits
        inner = boxes.join(wanted, [*by, "cell", "box"]).withColumn("part", F.xxhash64(F.floor(F.col("x") / step), F.floor(F.col("y") / step)))
        boxes = cut_lineage(inner.select(*by, "cell", "box", "part", "x", "y"))
        extent = extents(boxes, "box", "part")
        both = (pairs.join(side(extent, "a", ["cell", "box", "part", *ends]), [*by, "cell_a", "box_a"])
                .join(side(extent, "b", ["cell", "box", "part", *ends]), [*by, "cell_b", "box_b"]))
        judged_now = cut_lineage(judged(both).select(*cells, "part_a", "part_b", (F.col("far") <= eps).alias("sure")))
        sure = judged_now.filter("sure").select(*cells).distinct()
        found = found.unionByName(sure)
        pairs = judged_now.filter(~F.col("sure")).join(sure, cells, "left_anti").select(
            *cells, F.col("part_a").alias("box_a"), F.col("part_b").alias("box_b"))
        if pairs.isEmpty():
            return found.distinct()
        boxes = boxes.drop("box").withColumnRenamed("part", "box")


def _apart(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.expr(f"sqrt(({x1} - {x2}) * ({x1} - {x2}) + ({y1} - {y2}) * ({y1} - {y2}))")


def density_clusters(points: DataFrame, by: Sequence[str], eps: float = 100.0, min_samples: int = 5,
                     weight: str | None = None) -> DataFrame:
    """Cluster of every distinct position: `(by…, x, y, n, cluster)`, cluster null for noise.

    A point is core when at least `min_samples` points (itself included) lie within
    `eps`. The cells of the grid have the diagonal `eps`, so all points of one cell are
    neighbours: a cell with `min_samples` points is core as a whole, and only points of
    thin cells, fewer than `min_samples` each, are compared with their surroundings.
    Points at one position are one row with a count throughout; with `weight`, rows are so many points already. `cluster` is the
    smallest cell of the cluster; a border point joins its smallest neighbouring one.
    """
    by = list(by)
    side = eps / math.sqrt(2) * (1 - 1e-12)
    here = points.groupBy(*by, "x", "y").agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    bx, by_ = _box_index(F.col("x"), side), _box_index(F.col("y"), side)
    placed = here.select(*by, "x", "y", "n", _box(bx, by_, _COARSE_BITS).alias("cell"), _box(bx, by_, 0).alias("coarse"),
                         cell_key(*[F.floor(F.col(c) / (eps * (1 + 1e-9))) for c in ("x", "y")]).alias("block"))
    # written down here, or the joins below would push their null checks on cells into
    # whatever the coordinates are computed from, and compute them once per branch
    placed = cut_lineage(placed)
    per_cell = placed.groupBy(*by, "cell").agg(F.sum("n").alias("cell_n"))
    placed = placed.join(per_cell, [*by, "cell"])

    def around(thin: DataFrame) -> DataFrame:
        """Probes into the blocks, `eps` wide, that hold everything within `eps`."""
        return thin.select(*by, F.col("x").alias("px"), F.col("y").alias("py"),
                           F.explode(_neighbours("block", 1)).alias("block"))

    thin = placed.filter(F.col("cell_n") < min_samples)
    counted = (
        around(thin).join(placed.select(*by, "block", "x", "y", "n"), [*by, "block"])
        .filter(_apart("px", "py", "x", "y") <= eps)
        .groupBy(*by, F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("n").alias("close"))
    )
    flagged = cut_lineage(
        placed.join(counted.filter(F.col("close") >= min_samples).select(*by, "x", "y", F.lit(True).alias("dense_spot")),
                    [*by, "x", "y"], "left")
        .withColumn("core", (F.col("cell_n") >= min_samples) | F.col("dense_spot").isNotNull())
        .select(*by, "x", "y", "n", "cell", "coarse", "block", "core"))
    core = flagged.filter("core")
    links = _linked_cells(core, by, eps).select(*by, F.col("cell_a").alias("a"), F.col("cell_b").alias("b"))
    labels = components(core.select(*by, F.col("cell").alias("v")).distinct(), links, by)
    in_core = core.join(labels.select(*by, F.col("v").alias("cell"), F.col("label").alias("cluster")), [*by, "cell"])
    outer = flagged.filter(~F.col("core"))
    border = (
        around(outer).join(in_core.select(*by, "block", "x", "y", "cluster"), [*by, "block"])
        .filter(_apart("px", "py", "x", "y") <= eps)
        .groupBy(*by, F.col("px").alias("x"), F.col("py").alias("y")).agg(F.min("cluster").alias("cluster"))
    )
    rest = outer.select(*by, "x", "y", "n").join(border, [*by, "x", "y"], "left")
    return in_core.select(*by, "x", "y", "n", "cluster").unionByName(rest.select(*by, "x", "y", "n", "cluster"))


def cluster_counts(clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Clusters and noise points per group."""
    per_cluster = clusters.groupBy(*by, "cluster").agg(F.sum("n").alias("n"))
    return per_cluster.groupBy(*by).agg(
        F.count("cluster").alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("n_random_points"),
    )
