"""Points against polygons: containment, nearest polygon, grid sampling.

Polygons are rows `(code, rings)`, rings being arrays of `(lon, lat)`; holes are rings
like any other (even-odd rule). Layers are taken apart into edges at once, so that no later row holds a whole polygon.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import cell_index
from ..session import cut_lineage

# Rounding at cell borders: an edge this close (as a share of its size) belongs to both cells, which does no harm.
_SLACK = 1e-9
# Cells a side of the containment grid, and edges that one row of it holds.
_LEAST_SIDE, _MOST_SIDE, _HELD = 16, 1024, 128
# The regular part of that grid covers this share of the corners; what lies beyond falls into its outer cells.
_TAIL = 0.005
# Where every covering polygon is wanted, polygons have so many cells for each of their edges, besides a few thousand.
_CELLS, _CELLS_FREE = 8, 1 << 16
# Repeated keys are broadcast up to this many.
_FEW = 100_000
# Most slabs (a power of 4) of the nearest search, and the edges a leaf should hold. Leaves are at most the square
# of the slabs, which bounds what is broadcast to 65,536 rows for the finest level of a layer.
_MOST_SLABS, _LEAF = 256, 4
# Distances closer than this many decimals are ties; the smallest code wins.
_DISTANCE_DECIMALS = 9
_EDGE = ("x1", "y1", "x2", "y2")


def edges_of(rings: str = "rings") -> Column:
    """All edges `(x1, y1, x2, y2)` of a polygon; open rings are closed."""
    return F.expr(f"""flatten(transform({rings}, ring -> zip_with(
        ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)),
        (a, b) -> struct(a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2))))""")


def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def edge_rows(polygons: DataFrame, code: str = "code") -> DataFrame:
    """Polygons as one row per edge."""
    return polygons.select(F.col(code).alias("code"), F.explode(edges_of()).alias("e")).select("code", "e.*")


class _Frame(NamedTuple):
    """A grid of `nx` by `ny` square cells; what lies outside is in cells -1 and n, which have no end."""

    x0: float
    y0: float
    size: float
    nx: int
    ny: int

    def column(self, x: str) -> str:
        return f"int(greatest(least(floor(({x} - {self.x0!r}D) / {self.size!r}D), {self.nx}L), -1L))"

    def row(self, y: str) -> str:
        return f"int(greatest(least(floor(({y} - {self.y0!r}D) / {self.size!r}D), {self.ny}L), -1L))"

    def left(self, ix: str) -> str:
        """The left border of a cell; null where it has none."""
        return f"if({ix} >= 0, {self.x0!r}D + ({ix}) * {self.size!r}D, null)"

    def bottom(self, iy: str) -> str:
        return f"if({iy} >= 0, {self.y0!r}D + ({iy}) * {self.size!r}D, null)"


def _layer_edges(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Edges of all layers: layer, code, shape (a hash that tells polygons of one code apart), x1, y1, x2, y2.

    Rows that repeat a polygon count once; edges with unknown or non-finite ends are left out.
    """
    out = None
    for name, polygons in layers.items():
        # hashed before the edges are listed, so once for each polygon
        whole = polygons.select(F.lit(name).alias("layer"), "code", F.xxhash64("code", "rings").alias("shape"), edges_of().alias("edges"))
        rows = whole.select("layer", "code", "shape", F.posexplode("edges").alias("place", "e")).select(
            "layer", "code", "shape", "place", "e.*")
        out = rows if out is None else out.unionByName(rows)
    fine = [_finite(F.col(c)) for c in _EDGE]
    return cut_lineage(out.filter(fine[0] & fine[1] & fine[2] & fine[3]).distinct().drop("place"))


def _frame(edges: DataFrame, size: float | None, cells: int | None = None) -> _Frame:
    """A grid over all but the outermost corners, with cells for about four times as many places as there are edges.

    Its lines are put off round numbers. Few far corners do not widen the cells. With `cells`, they are as wide as it takes for
    the boxes of all polygons to lie in about that many for each edge, however much polygons lie over one another.
    """
    tails = [_TAIL, 1 - _TAIL]
    n, xs, ys = edges.agg(F.count("*"), F.percentile_approx("x1", tails, 1000), F.percentile_approx("y1", tails, 1000)).first()
    if not n:
        return _Frame(0.0, 0.0, 1.0, 1, 1)
    widest = max(xs[1] - xs[0], ys[1] - ys[0])
    side = min(_MOST_SIDE, max(_LEAST_SIDE, math.ceil(2 * math.sqrt(n))))
    if size is None and cells is not None:
        def within(c: str, low: float, high: float) -> Column:
            return F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))

        boxes = edges.groupBy("layer", "code", "shape").agg(*[((F.max(within(c, *ends)) - F.min(within(c, *ends))) / (widest or 1.0)).alias(to)
                                                              for c, ends, to in (("x1", xs, "w"), ("y1", ys, "h"))])
        area, around = boxes.agg(F.sum(F.col("w") * F.col("h")), F.sum(F.col("w") + F.col("h"))).first()
        most = cells * n + _CELLS_FREE
        # as a share of the width, the larger root of area / size ** 2 + around / size = most
        size = widest * max(1 / side, (around + math.sqrt(around * around + 4 * area * most)) / (2 * most))
    size = max(widest / side if size is None else size, widest / _MOST_SIDE) or 1.0
    x0, y0 = xs[0] - 0.5618 * size, ys[0] - 0.5618 * size
    return _Frame(x0, y0, size, math.ceil((xs[1] - x0) / size) + 1, math.ceil((ys[1] - y0) / size) + 1)


def _positive(x: str, y: str, e: str = "") -> str:
    """On which side of an edge's line a place lies; one on the line counts as a little higher, then a little to the right."""
    side = f"(({e}x2 - {e}x1) * ({y} - {e}y1) - ({x} - {e}x1) * ({e}y2 - {e}y1))"
    return f"(case when {side} <> 0 then {side} > 0 when {e}x1 <> {e}x2 then {e}x2 > {e}x1 else {e}y2 < {e}y1 end)"


def flips(x: str, y: str, left: str, bottom: str) -> Column:
    """How often the `edges` of a cell are crossed on the way from its lower left corner to a place in it.

    The way goes up, then right. A null `left` or `bottom` is infinitely far, where it is outside.
    """
    turn, end = _positive(left, y, "e."), _positive(x, y, "e.")
    start = f"if({bottom} is null, e.x2 < e.x1, {_positive(left, bottom, 'e.')})"
    up = f"({left} is not null and (e.x1 <= {left}) <> (e.x2 <= {left}) and {start} <> {turn})"
    right = f"((e.y1 <= {y}) <> (e.y2 <= {y}) and if({left} is null, {end} <> (e.y2 > e.y1), {turn} <> {end}))"
    return F.expr(f"size(filter(edges, e -> {up} <> {right}))")


def touched(x: str, y: str) -> Column:
    """Whether a place lies on one of the `edges`."""
    return F.expr(f"""exists(edges, e -> (e.x2 - e.x1) * ({y} - e.y1) = ({x} - e.x1) * (e.y2 - e.y1)
        and {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2) and {y} between least(e.y1, e.y2) and greatest(e.y1, e.y2))""")


def polygon_cells(edges: DataFrame, frame: _Frame) -> DataFrame:
    """The cells of each polygon: layer, code, shape, ix, iy, chunk, inside, edges.

    A cell that edges pass has these edges, and those only, in chunks; `inside` says (in chunk 0) whether its lower left corner
    is inside. Cells wholly inside have no edges, cells wholly outside have no row. Corners are settled by
    counting, along the lower border of a row of cells, the edges that cross it.
    """
    shape = ["layer", "code", "shape"]
    rows = edges.selectExpr(
        *shape, *_EDGE, "least(y1, y2) as low", "greatest(y1, y2) as high",
        f"{_SLACK}D * (1 + greatest(abs(x1), abs(y1), abs(x2), abs(y2))) as room").selectExpr(
        "*", "high - low <= 1e-6D * (1 + greatest(abs(y1), abs(y2))) as flat",
        f"explode(sequence({frame.row('low - room')}, {frame.row('high + room')})) as iy")

    # the part of an edge within a row of cells, and the cells it reaches there
    bottom = f"greatest(least(coalesce({frame.bottom('iy')} - room, low), high), low)"
    top = f"greatest(least(if(iy < {frame.ny}, {frame.bottom('(iy + 1)')} + room, high), high), low)"
    at = [f"if(flat, {x}, x1 + ({y} - y1) * (x2 - x1) / if(flat, 1D, y2 - y1))" for x, y in (("x1", bottom), ("x2", top))]
    wide = "(room + 1e-5D * abs(x2 - x1))"
    reached = (frame.column(f"least({at[0]}, {at[1]}) - {wide}"), frame.column(f"greatest({at[0]}, {at[1]}) + {wide}"))
    passed = rows.selectExpr(*shape, "iy", *_EDGE, f"explode(sequence({reached[0]}, {reached[1]})) as ix")
    mixed = passed.selectExpr(*shape, "ix", "iy", "struct(x1, y1, x2, y2) as edge", "false as inside")

    # crossings of the lower border of each row, and the last corner to the left of each
    crossed = rows.withColumn("line", F.expr(frame.bottom("iy"))).filter("(y1 <= line) <> (y2 <= line)").withColumn(
        "guess", F.expr(frame.column("x1 + (line - y1) * (x2 - x1) / (y2 - y1)")))

    def to_the_right(ix: str) -> str:
        return f"({ix} < 0 or ({ix} <= {frame.nx} and {_positive(frame.left(ix), 'line')} = (y2 > y1)))"

    last = f"case when {to_the_right('(guess + 1)')} then guess + 1 when {to_the_right('guess')} then guess else guess - 1 end"
    odd = crossed.groupBy(*shape, "iy", F.expr(last).alias("last")).agg(F.expr("count(*) % 2 as odd")).filter("odd = 1")
    row = "over (partition by layer, code, shape, iy order by last desc)"
    runs = odd.selectExpr(*shape, "iy", "last", f"row_number() {row} as k", f"greatest(lead(last, 1, -1) {row}, -1) as next")
    corners = runs.filter("k % 2 = 1 and next < last").selectExpr(
        *shape, "explode(sequence(next + 1, last)) as ix", "iy", "cast(null as struct<x1:double,y1:double,x2:double,y2:double>) as edge",
        "true as inside")
    # a corner, which has no edge, comes first; one exchange serves the numbering and the grouping
    numbered = mixed.unionByName(corners).withColumn("chunk", F.expr(
        f"int((row_number() over (partition by layer, code, shape, ix, iy order by edge) - 1) div {_HELD})"))
    return numbered.groupBy(*shape, "ix", "iy", "chunk").agg(
        F.max("inside").alias("inside"), F.collect_list("edge").alias("edges"))


def _decisive(cells: DataFrame) -> DataFrame:
    """Cells that may decide the smallest covering code: not those of codes above one that covers the whole cell."""
    whole = F.when(F.col("inside") & (F.size("edges") == 0), F.col("code"))
    least = F.min(whole).over(Window.partitionBy("layer", "ix", "iy"))
    return cells.withColumn("least", least).filter("least is null or code <= least").drop("least")


def _placed(points: DataFrame, frame: _Frame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Points `(…, px, py)` beside the cells they lie in: adds layer, code, shape, changes and on_edge.

    Cells grow with the area of the polygons, which no estimate of their size sees: never broadcast.
    """
    met = points.selectExpr("*", f"{frame.column('px')} as ix", f"{frame.row('py')} as iy").join(cells.hint("merge"), ["ix", "iy"], how)
    changes = flips("px", "py", frame.left("ix"), frame.bottom("iy")) + F.expr("int(inside)")
    return met.select(*points.columns, "layer", "code", "shape", changes.alias("changes"), touched("px", "py").alias("on_edge"))


def _repeated(rows: DataFrame, name: str) -> DataFrame | None:
    """The values of a column (null is one) that several rows have, as `__again`, ready to be joined; None if there are none."""
    found = cut_lineage(rows.groupBy(F.col(name).alias("__again")).count().filter("count > 1").select("__again"))
    n = found.count()
    if not n:
        return None
    return F.broadcast(found) if n <= _FEW else found.hint("merge")


def _covered(border: bool) -> Column:
    """Over the chunks of a point and polygon: whether it is inside, or on the border if that counts."""
    on_edge = "coalesce(max(on_edge), false)"
    return F.expr(f"coalesce(sum(changes) % 2 = 1, false) {'or' if border else 'and not'} {on_edge} as covered")


def containing(points: DataFrame, polygons: DataFrame, key: str, size: float | None = None, border: bool = True,
               lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Every (point key, polygon code) where the polygon contains the point; with `border`, also on its edges.

    `size` is the width of the cells in coordinate units; by default it follows from the layer. Points without finite
    coordinates are in no polygon. Crowded cells are left to adaptive skew handling.

    A point whose key no other has is settled where it meets a cell: these pairs, which may be many times the
    points, are not shuffled. Only cells of very many edges, codes of several polygons, and keys that repeat are counted over all their rows.
    """
    edges = _layer_edges({"": polygons})
    frame = _frame(edges, size, _CELLS)
    placed = points.select(key, F.col(lon).alias("px"), F.col(lat).alias("py")).filter(_finite(F.col(lon)) & _finite(F.col(lat)))
    cells = polygon_cells(edges, frame)
    repeated = _repeated(placed, key)
    shared = _repeated(edges.select("code", "shape").distinct(), "code")
    once, again = placed, None
    if repeated is not None:
        once, again = (placed.join(repeated, F.col(key).eqNullSafe(F.col("__again")), how) for how in ("left_anti", "left_semi"))
    # less than full, also beside a corner: no other chunk
    settled = (F.col("chunk") == 0) & (F.size("edges") < _HELD - 1)
    whole, parts = cells.filter(settled), cells.filter(~settled)
    if shared is not None:
        own = F.col("code").eqNullSafe(F.col("__again"))
        whole, parts = whole.join(shared, own, "left_anti"), parts.unionByName(whole.join(shared, own, "left_semi"))
    found = _placed(once, frame, whole).filter(F.expr(f"changes % 2 = 1 {'or' if border else 'and not'} on_edge"))
    hits = _placed(once, frame, parts)
    if again is not None:
        hits = hits.unionByName(_placed(again, frame, cells))
    hits = hits.repartition(key, "code")  # serves both groupings
    rest = hits.groupBy(key, "code", "shape").agg(_covered(border)).filter("covered").select(key, "code").distinct()
    return found.select(key, "code").unionByName(rest)


def segment_distance(x: str, y: str) -> str:
    """Planar distance from a place to the segment x1, y1, x2, y2."""
    dx, dy = "(x2 - x1)", "(y2 - y1)"
    along = f"coalesce(try_divide(({x} - x1) * {dx} + ({y} - y1) * {dy}, {dx} * {dx} + {dy} * {dy}), 0D)"
    t = f"least(greatest({along}, 0D), 1D)"
    return f"sqrt(pow({x} - (x1 + {t} * {dx}), 2) + pow({y} - (y1 + {t} * {dy}), 2))"


class _Tree(NamedTuple):
    """Edges in slabs of equal numbers by x, cut into tiles by y, and the boxes of blocks of 4 x 4 tiles, and so on up."""

    leaves: DataFrame
    nodes: DataFrame
    levels: int


def _slab(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def _tree(edges: DataFrame) -> _Tree:
    """Built from quantiles of each layer: a few far edges widen the box of their own leaf and of nothing else below the top.

    An edge that several shapes share, as neighbours do their border, is one with the smallest of their codes, which wins the tie.
    """
    edges = cut_lineage(edges.groupBy("layer", *_EDGE).agg(F.min(F.struct("code"))["code"].alias("code")).select("layer", "code", *_EDGE))
    parts = [i / _MOST_SLABS for i in range(1, _MOST_SLABS)]
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    found = edges.groupBy("layer").agg(F.count("*").alias("n"), F.percentile_approx(x, parts, 10_000).alias("cuts")).collect()
    most = max((r.n for r in found), default=0)
    levels = next(k for k in range(5) if 2 * 4 ** k >= min(_MOST_SLABS, math.sqrt(most / _LEAF)))
    slabs = 4 ** levels
    step = _MOST_SLABS // slabs
    shares = F.array(*[F.lit(i / slabs) for i in range(1, slabs)]).cast("array<double>")
    if slabs == 1:
        leaves = edges.select("*", F.lit(0).alias("sx"), F.lit(0).alias("sy"))
    else:
        rows = [(r.layer, r.cuts[step - 1::step]) for r in found]
        cuts = F.broadcast(edges.sparkSession.createDataFrame(rows, "layer string, cuts array<double>"))
        slabbed = edges.join(cuts, "layer").withColumn("sx", _slab(F.col("cuts"), x)).drop("cuts")
        tiles = slabbed.groupBy("layer", "sx").agg(F.percentile_approx(y, shares, F.lit(10_000)).alias("cuts"))
        leaves = slabbed.join(F.broadcast(tiles), ["layer", "sx"]).withColumn("sy", _slab(F.col("cuts"), y)).drop("cuts")
    leaf_boxes = leaves.groupBy("layer", "sx", "sy").agg(
        F.min(F.least("x1", "x2")).alias("left"), F.max(F.greatest("x1", "x2")).alias("right"),
        F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"),
        F.min(F.struct("x1", "y1")).alias("corner"))
    level = F.explode(F.sequence(F.lit(0), F.lit(max(0, levels - 1)))).alias("level")
    up = leaf_boxes.select("*", level).withColumns({c: F.expr(f"shiftright({c}, 2 * level)") for c in ("sx", "sy")})
    nodes = up.groupBy("layer", "level", "sx", "sy").agg(
        *[f(c).alias(c) for c, f in (("left", F.min), ("right", F.max), ("low", F.min), ("high", F.max), ("corner", F.min))])
    return _Tree(leaves, cut_lineage(nodes), levels)


def _descended(rows: DataFrame, tree: _Tree, by: list[str], max_distance: float | None) -> DataFrame:
    """Leaves that may hold the nearest edge of each row `(…, layer, px, py, wanted)`: adds sx, sy.

    Level by level the nodes are kept whose box is within the least distance known, and that is tightened by a corner
    of each node looked at. Nodes are broadcast; rows stay where they are, partitioned by `by`. Rows not
    wanted pass through once, with null sx.
    """
    start = "double('infinity')" if max_distance is None else f"{float(max_distance)!r}D"
    kept = [c for c in rows.columns]
    rows = rows.selectExpr("*", f"{start} as bound", "if(wanted, 0, null) as sx", "if(wanted, 0, null) as sy")
    across, along = "greatest(left - px, px - right, 0D)", "greatest(low - py, py - high, 0D)"
    best = f"min(sqrt(pow(px - corner.x1, 2) + pow(py - corner.y1, 2))) over (partition by {', '.join(f'r.{c}' for c in by)})"
    for level in range(tree.levels - 1, -1, -1):
        kids = tree.nodes.filter(F.col("level") == level).selectExpr(
            "layer", "sx as kx", "sy as ky", "shiftright(sx, 2) as sx", "shiftright(sy, 2) as sy", "left", "right", "low", "high", "corner")
        gap = f"sqrt({across} * {across} + {along} * {along})"
        same = " and ".join(f"r.{c} = k.{c}" for c in ("layer", "sx", "sy"))
        within = F.expr(f"{same} and {gap} <= bound * (1 + 1e-12D) + 2e-9D")
        met = rows.alias("r").join(F.broadcast(kids.alias("k")), within, "left").selectExpr(
            *[f"r.{c}" for c in kept], f"least(bound, {best}) as bound", "kx as sx", "ky as sy", f"{gap} as gap")
        rows = met.filter("not wanted or (sx is not null and gap <= bound * (1 + 1e-12D) + 2e-9D)").drop("gap")
    return rows


def _closest(rows: DataFrame, tree: _Tree, by: list[str], max_distance: float | None) -> DataFrame:
    """Rows with distance and near_code of the edges in their leaves."""
    found = _descended(rows, tree, by, max_distance).drop("bound").join(
        tree.leaves.select("layer", "sx", "sy", F.col("code").alias("near_code"), *_EDGE), ["layer", "sx", "sy"], "left")
    found = found.selectExpr(*rows.columns, f"round({segment_distance('px', 'py')}, {_DISTANCE_DECIMALS}) as distance", "near_code")
    if max_distance is not None:
        found = found.withColumn("distance", F.expr(f"if(distance <= {float(max_distance)!r}D, distance, null)"))
    return found


def nearest(points: DataFrame, edges: DataFrame, key: str, max_distance: float | None = None,
            lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The closest shape of every point: `(key, code, distance)`, in coordinate units.

    `edges` has rows `(code, x1, y1, x2, y2)`. Any finite coordinates will do; points without, and points farther than
    `max_distance`, have no row. The search is exact: a tree of boxes over the edges is descended by all
    points at once, and only edges of the leaves that remain are met.
    """
    fine = [_finite(F.col(c)) for c in _EDGE]
    tree = _tree(edges.filter(fine[0] & fine[1] & fine[2] & fine[3]).select(F.lit("").alias("layer"), "code", *_EDGE))
    rows = points.filter(_finite(F.col(lon)) & _finite(F.col(lat))).select(
        key, F.lit("").alias("layer"), F.col(lon).alias("px"), F.col(lat).alias("py"), F.col(lon).isNotNull().alias("wanted")).repartition(key)
    found = _closest(rows, tree, [key], max_distance).filter("distance is not null")
    return found.groupBy(key).agg(F.min(F.struct("distance", F.col("near_code").alias("code"))).alias("b")).select(
        key, F.col("b.code").alias("code"), F.col("b.distance").alias("distance"))


def assign_layers(points: DataFrame, layers: Mapping[str, DataFrame], key: str, max_distance: float | None = None,
                  size: float | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One area per point and layer, as columns `code_<layer>`: one that covers it, else the nearest one.

    `max_distance` 0 turns the nearest search off, None leaves it unlimited. Several covering areas are settled by the smallest
    code. Points without finite coordinates, or farther than allowed, keep null codes.

    All layers are one table of edges, met in one join; each distinct position is looked up once and its codes are then
    joined to the points (so that a position of very many points is split by adaptive skew handling).
    """
    edges = _layer_edges(layers)
    frame = _frame(edges, size)
    fine = _finite(F.col(lon)) & _finite(F.col(lat))
    # the hash is what rows are partitioned by throughout: one exchange serves all groupings
    at = F.xxhash64(F.col(lon) + 0.0, F.col(lat) + 0.0).alias("at")
    positions = points.filter(fine).select(at, (F.col(lon) + 0.0).alias("px"), (F.col(lat) + 0.0).alias("py")).distinct()
    hits = _placed(positions, frame, _decisive(polygon_cells(edges, frame)), "left").repartition("at")
    covered = hits.groupBy("at", "px", "py", "layer", "code", "shape").agg(_covered(True))
    names = list(layers)
    codes = covered.groupBy("at", "px", "py").agg(*[
        F.min(F.when(F.col("covered") & (F.col("layer") == name), F.col("code"))).alias(f"code_{name}") for name in names])
    if max_distance != 0:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(f"code_{n}").alias("code")) for n in names]))
        rows = codes.select("at", "px", "py", each.alias("e")).select("at", "px", "py", "e.layer", "e.code", F.col("e.code").isNull().alias("wanted"))
        near = _closest(rows, _tree(edges), ["at", "px", "py", "layer"], max_distance)
        pick = F.struct("distance", "near_code")
        codes = near.groupBy("at", "px", "py").agg(*[F.coalesce(
            F.min(F.when(F.col("layer") == n, F.col("code"))),
            F.min(F.when((F.col("layer") == n) & F.col("distance").isNotNull(), pick))["near_code"]).alias(f"code_{n}") for n in names])
    placed = points.select(key, F.when(fine, at).alias("at"), (F.col(lon) + 0.0).alias("px"), (F.col(lat) + 0.0).alias("py"))
    return placed.join(codes, ["at", "px", "py"], "left").select(key, *[f"code_{n}" for n in names])


def assign_areas(points: DataFrame, polygons: DataFrame, key: str, max_distance: float | None = None,
                 size: float | None = None, attributes: tuple[str, ...] = (), lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One area of one layer per point, as :func:`assign_layers` finds it, with attributes of the area."""
    out = assign_layers(points, {"area": polygons}, key, max_distance, size, lon, lat).withColumnRenamed("code_area", "code")
    if attributes:
        out = out.join(polygons.select("code", *attributes), "code", "left").select(key, "code", *attributes)
    return out


def sample_pixels(points: DataFrame, pixels: DataFrame, x0: float, y0: float, size: float,
                  lon: Column, lat: Column) -> DataFrame:
    """Pixel values under each point of a north-up grid; points off the grid are dropped."""
    placed = points.withColumn("ix", cell_index(lon, x0, size)).withColumn(
        "iy", F.floor((F.lit(y0) - lat) / size).cast("bigint"))
    return placed.join(pixels, ["ix", "iy"]).drop("ix", "iy")
