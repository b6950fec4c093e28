import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import density, grids, spatial
from fieldtally.operators.components import components
from fieldtally.plans import behaviour
from fieldtally.sources import layers


def polygons(spark, shapes):
    return spark.createDataFrame([(c, [[(float(x), float(y)) for x, y in ring] for ring in rings])
                                  for c, rings in shapes], "code string, rings array<array<struct<lon:double,lat:double>>>")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
NEXT = [(4, 0), (8, 0), (8, 4), (4, 4)]  # shares a border, not closed


@pytest.mark.parametrize("size", [0.5, 1.0, 3.0, 50.0])
def test_containment_cases(spark, size):
    polys = polygons(spark, [("holed", [SQUARE, HOLE]), ("next", [NEXT])])
    pts = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 2.0), (4, 1.0, 2.0), (5, 9.0, 2.0), (6, 0.0, 0.0), (7, 8.0, 4.0)]
    got = sorted(tuple(r) for r in spatial.containing(
        spark.createDataFrame(pts, "id long, lon double, lat double"), polys, "id", size).collect())
    assert got == [(1, "holed"), (3, "holed"), (3, "next"), (4, "holed"), (6, "holed"), (7, "next")]


def _distance(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else min(1, max(0, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def test_nearest_against_all_pairs(spark):
    rnd = random.Random(3)
    edges = []
    for i in range(60):
        x, y, long = rnd.uniform(-179, 150), rnd.uniform(-89, 80), rnd.random() < 0.2
        edges.append((f"c{i:02d}", x, y, x + rnd.uniform(0, 28 if long else 1), y + rnd.uniform(0, 8 if long else 1)))
    pts = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    ed = spark.createDataFrame(edges, "code string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.code, r.distance) for r in spatial.nearest(df, ed, "id").collect()}
    for i, x, y in pts:
        d, code = min((round(_distance(x, y, *e[1:]), 9), e[0]) for e in edges)
        assert got[i][0] == code and math.isclose(got[i][1], d, abs_tol=2e-9)
    within = {r.id for r in spatial.nearest(df, ed, "id", 5.0).collect()}
    assert within == {i for i, (_, d) in got.items() if d <= 5.0}


def covered(rings, x, y, border=True):
    """Even-odd rule in whole numbers or fractions."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return border
            odd ^= (y1 <= y) != (y2 <= y) and (side > 0) == (y2 > y1)
    return odd


@pytest.mark.parametrize("size,border", [(None, True), (1.0, False), (0.7, True), (40.0, False)])
def test_containment_against_even_odd_rule(spark, size, border):
    """Corners, edges and points on whole numbers, where a cell border or a corner is met by chance all the time."""
    rnd = random.Random(11)
    shapes = [(f"s{i}", [[(rnd.randint(-8, 8), rnd.randint(-8, 8)) for _ in range(rnd.randint(3, 9))]
                         for _ in range(rnd.randint(1, 3))]) for i in range(25)]
    shapes.append(("far", [[(0, 0), (10 ** 6, 3), (5, 10 ** 6)]]))
    shapes += [shapes[0], ("s1", [[(-9, -9), (9, -9), (9, 9), (-9, 9)]]), ("line", [[(0, 0), (3, 3)]]), ("none", []), ("dot", [[(1, 1)]])]
    pts = [(i, rnd.randint(-18, 18) / 2, rnd.randint(-18, 18) / 2) for i in range(400)] + [(900, 5e5, 4e5), (901, -5e5, 0.0), (902, 1e300, -1e300)]
    got = {tuple(r) for r in spatial.containing(spark.createDataFrame(pts, "id long, lon double, lat double"),
                                                polygons(spark, shapes), "id", size, border).collect()}
    assert got == {(i, c) for i, x, y in pts for c, rings in shapes if covered(rings, x, y, border)}


def test_one_polygon_of_many_edges(spark):
    """No row of the cells holds the polygon, and cells inside hold nothing."""
    n = 100_000
    ring = [(100 * math.cos(2 * math.pi * i / n) * (1 + 0.001 * (i % 2)), 80 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    polys = polygons(spark, [("ring", [ring])])
    edges = spatial._layer_edges({"": polys})
    frame = spatial._frame(edges, None)
    cells = spatial.polygon_cells(edges, frame).select(F.size("edges").alias("n"), "inside")
    most, total, full = cells.agg(F.max("n"), F.sum("n"), F.sum(((F.col("n") == 0) & F.col("inside")).cast("int"))).first()
    assert most <= spatial._HELD and n <= total < 4 * n and full > 1000
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-120, 120), rnd.uniform(-90, 90)) for i in range(300)]
    got = {r.id for r in spatial.containing(spark.createDataFrame(pts, "id long, lon double, lat double"), polys, "id").collect()}
    sure = {i for i, x, y in pts if math.hypot(x / 100, y / 80) < 0.999}
    assert sure <= got and not got & {i for i, x, y in pts if math.hypot(x / 100, y / 80) > 1.002}
    assert got & set(range(20)) == {i for i, x, y in pts[:20] if covered([ring], x, y)}


def test_a_far_edge_leaves_the_candidates_alone(spark):
    rnd = random.Random(4)
    edges = [(f"c{i:04d}", x, y, x + 0.3, y + 0.2) for i in range(3000) for x, y in [(rnd.uniform(-170, 170), rnd.uniform(-80, 80))]]
    pts = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(2000)]
    counts = []
    for extra in ([], [("far", 1e6, 1e6, 1e6 + 5, 1e6)], [("long", 0.0, 0.0, 1e6, 1e6)]):
        e = spark.createDataFrame(edges + extra, "code string, x1 double, y1 double, x2 double, y2 double")
        tree = spatial._tree(e.withColumn("layer", F.lit("")))
        rows = spark.createDataFrame(pts, "id long, px double, py double").select(
            "id", F.lit("").alias("layer"), "px", "py", F.col("px").isNotNull().alias("wanted"))
        leaves = spatial._descended(rows.repartition("id"), tree, ["id"], None)
        counts.append(leaves.join(tree.leaves, ["layer", "sx", "sy"]).count())
    assert counts[0] < 60 * len(pts) and max(counts) < counts[0] + 20 * len(pts), counts


def test_shared_edges_are_searched_once(spark):
    """Edges that many shapes share: one edge of the tree, and the smallest code."""
    rows = [(f"c{i:02d}", float(x), 0.0, x + 1.0, 0.0) for x in range(6) for i in range(50 - x)]
    edges = spark.createDataFrame(rows, "code string, x1 double, y1 double, x2 double, y2 double")
    assert spatial._tree(edges.withColumn("layer", F.lit(""))).leaves.count() == 6
    pts = spark.createDataFrame([(1, 0.5, 1.0), (2, 5.5, -2.0), (3, 1.0, 3.0)], "id long, lon double, lat double")
    assert {tuple(r) for r in spatial.nearest(pts, edges, "id").collect()} == {(1, "c00", 1.0), (2, "c00", 2.0), (3, "c00", 3.0)}


def test_cells_are_not_broadcast_and_hold_no_covered_codes(spark):
    """Wide polygons over one another: only codes below one that covers a cell may matter there."""
    square = [(-50, -50), (50, -50), (50, 50), (-50, 50)]
    wide = [[(x + i / 7, y) for x, y in square] for i in range(40)]
    polys = polygons(spark, [(f"p{i:02d}", [ring]) for i, ring in enumerate(wide)])
    edges = spatial._layer_edges({"": polys})
    frame = spatial._frame(edges, None)
    cells = spatial.polygon_cells(edges, frame)
    assert 10 * spatial._decisive(cells).filter("abs(ix - 10) < 5 and abs(iy - 10) < 5").count() < cells.filter("abs(ix - 10) < 5 and abs(iy - 10) < 5").count()
    pts = spark.createDataFrame([(i, i * 1.1 - 60, (i % 11) * 11.0 - 55) for i in range(110)], "id long, lon double, lat double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spatial.containing(pts, polys, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" not in plan
    got = {r.id: r.code for r in spatial.assign_areas(pts, polys, "id", 0).collect()}
    every = {}
    for r in spatial.containing(pts, polys, "id").collect():
        every[r.id] = min(r.code, every.get(r.id, r.code))
    assert got == {i: every.get(i) for i in range(110)} and len(every) > 50


def shuffled(df):
    """Rows that an executed query put into its exchanges."""
    df.collect()
    found = {}

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found[node.id()] = node.metrics().get("shuffleRecordsWritten").get().value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found.values())


def test_points_in_many_polygons_are_not_shuffled_with_them(spark):
    """Polygons over one another: pairs are many times the points."""
    square = [(-50, -50), (50, -50), (50, 50), (-50, 50)]
    polys = polygons(spark, [(f"p{i:03d}", [[(x + i / 70, y) for x, y in square]]) for i in range(400)])
    pts = spark.range(3000).selectExpr("id", "id % 60 + 0.3 - 30 as lon", "id div 60 + 0.3 - 25 as lat")
    out = spatial.containing(pts, polys, "id")
    assert out.count() == 1_200_000
    assert shuffled(out.agg(F.count("*"))) < 300_000


def test_keys_that_repeat_count_over_all_their_rows(spark):
    """As the SQL twin groups them: a key in a polygon twice is not in it, on its border it is. Null is a key like any other."""
    polys = polygons(spark, [("a", [SQUARE]), ("b", [NEXT]), ("c", [SQUARE]), ("c", [NEXT]), (None, [SQUARE])])
    pts = [(1, 1.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (3, 5.0, 1.0), (4, 0.0, 1.0), (4, 0.0, 1.0), (5, 1.0, 1.0), (5, 99.0, 1.0)]
    want = {(1, "a"), (1, "c"), (1, None), (3, "a"), (3, "b"), (3, "c"), (3, None), (4, "a"), (4, "c"), (4, None), (5, "a"), (5, "c"), (5, None)}
    one = [(None, 1.0, 2.0)]
    for rows, more in ((pts, set()), (pts + one, {(None, "a"), (None, "c"), (None, None)}), (pts + one + one, set())):
        got = spatial.containing(spark.createDataFrame(rows, "id long, lon double, lat double"), polys, "id").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want | more


def test_layers_in_one_pass(spark):
    """Positions shared by many points, points outside, without coordinates, and beyond the distance."""
    one = polygons(spark, [("a", [SQUARE, HOLE]), ("b", [NEXT])])
    two = polygons(spark, [("z", [[(0, 0), (2, 0), (2, 2), (0, 2)]]), ("y", [[(0, 0), (2, 0), (2, 2), (0, 2)]])])
    pts = [(i, 1.5, 0.5) for i in range(500)] + [(500, 6.0, 1.0), (501, 2.0, 2.0), (502, 30.0, 1.0), (503, None, 1.0), (504, -0.0, 0.0)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {r.id: (r.code_one, r.code_two) for r in spatial.assign_layers(df, {"one": one, "two": two}, "id").collect()}
    assert got == {**{i: ("a", "y") for i in range(500)}, 500: ("b", "y"), 501: ("a", "y"), 502: ("b", "y"), 503: (None, None), 504: ("a", "y")}
    near = {r.id: (r.code_one, r.code_two) for r in spatial.assign_layers(df, {"one": one, "two": two}, "id", 5.0).collect()}
    assert near[502] == (None, None) and near[500] == ("b", "y")
    inside = {r.id: (r.code_one, r.code_two) for r in spatial.assign_layers(df, {"one": one, "two": two}, "id", 0).collect()}
    assert inside[500] == ("b", None) and inside[501] == (None, "y") and inside[502] == (None, None)
    assert spatial.assign_layers(df, {"one": one.limit(0), "two": two}, "id").filter("code_one is not null").count() == 0


def test_masked_grid_leaves_out_the_border(spark):
    got = grids.make_grid(spark, (0, 4), (0, 4), 1.0, polygons(spark, [("t", [[(0, 0), (4, 0), (4, 4)]])])).collect()
    assert {(r.lon, r.lat) for r in got} == {(i, j) for i in range(4) for j in range(i)}


def test_missing_coordinates_keep_a_row(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan")), (3, 20.0, 2.0)], "id long, lon double, lat double")
    got = {r.id: r.code for r in spatial.assign_areas(df, polygons(spark, [("a", [SQUARE])]), "id").collect()}
    assert got == {1: None, 2: None, 3: "a"}


def _dbscan(points, eps, m):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(v) >= m for v in near]
    label = [None] * n
    k = 0
    for i in range(n):
        if core[i] and label[i] is None:
            label[i], stack = k, [i]
            while stack:
                for j in near[stack.pop()]:
                    if label[j] is None:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
    return k, sum(v is None for v in label)


def _cluster(spark, groups, eps, m):
    rows = [(g, float(x), float(y)) for g, pts in groups.items() for x, y in pts]
    out = density.density_clusters(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], eps, m)
    return {r.g: (r.n_clusters, r.n_random_points) for r in density.cluster_counts(out, ["g"]).collect()}


def test_clusters_against_textbook(spark):
    rnd = random.Random(5)
    groups = {}
    groups["blobs"] = [(cx + rnd.gauss(0, s), cy + rnd.gauss(0, s)) for cx, cy, n, s in
                       ((0, 0, 30, 20), (900, 0, 20, 25), (0, 900, 10, 10)) for _ in range(n)]
    groups["uniform"] = [(rnd.uniform(-1500, 1500), rnd.uniform(-1500, 1500)) for _ in range(400)]
    groups["chain"] = [(i * 60.0, (i % 3) * 5.0) for i in range(300)]
    groups["one spot"] = [(5.0, 5.0)] * 9 + [(104.9, 5.0)]
    groups["crowd"] = [(rnd.uniform(0, 60), rnd.uniform(0, 60)) for _ in range(300)] + \
                      [(rnd.uniform(155, 200), rnd.uniform(0, 60)) for _ in range(300)]
    groups["few"] = [(0, 0), (1, 1), (2, 2)]
    # two tight crowds just within and just beyond reach of each other: decided point by point
    for name, gap in (("touching", 99.9999), ("apart", 100.0001)):
        groups[name] = [(rnd.uniform(-0.3, 0), rnd.uniform(0, 0.001)) for _ in range(40)] + [(0.0, 0.0), (gap, 0.0)] + \
                       [(gap + rnd.uniform(0, 0.3), rnd.uniform(0, 0.001)) for _ in range(40)]
    got = _cluster(spark, groups, 100.0, 5)
    for name, pts in groups.items():
        assert got[name] == _dbscan(pts, 100.0, 5), name


def test_frequent_positions_and_many_in_a_metre(spark):
    """A user of 200,000 rows at three positions, and one with 20,000 positions within a metre and 5 more near reach."""
    few = spark.range(200_000).select(F.lit("few").alias("g"), (F.col("id") % 3 * 80.0).alias("x"), F.lit(0.0).alias("y"))
    dense = spark.range(20_000).select(F.lit("dense").alias("g"), (F.col("id") % 200 / 200).alias("x"), (F.col("id") / 20_000).alias("y"))
    edge = spark.range(20).select(F.lit("dense").alias("g"), (100.99 + F.col("id") * 0.01).alias("x"), F.lit(0.5).alias("y"))
    out = density.density_clusters(few.unionByName(dense).unionByName(edge), ["g"], 100.0, 5)
    got = {r.g: (r.n_clusters, r.n_random_points) for r in density.cluster_counts(out, ["g"]).collect()}
    assert got == {"few": (1, 0), "dense": (1, 0)}
    weighted = out.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    assert {r.g: (r.n, r.rows) for r in weighted.collect()} == {"few": (200_000, 3), "dense": (20_020, 20_020)}


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    edges = [("a", ids[i], ids[i + 1]) for i in range(398) if i != 200]
    v = spark.createDataFrame([("a", i) for i in ids], "g string, v long")
    e = spark.createDataFrame(edges, "g string, a long, b long")
    labels = {r.v: r.label for r in components(v, e, ["g"]).collect()}
    first, second = ids[:201], ids[201:399]
    assert {labels[i] for i in first} == {min(first)} and {labels[i] for i in second} == {min(second)}
    assert labels[ids[399]] == ids[399]


def test_single_and_paired_reports(spark):
    # two points about 2 m apart on the central meridian of their zone
    df = spark.createDataFrame([(1, 3.0, 0.0), (2, 3.0, 0.0), (2, 3.0, 2 / 110574.3886)], "user_id long, lon double, lat double")
    got = {r.user_id: r for r in behaviour.user_features(df).collect()}
    assert (got[1].n_points, got[1].n_invalid_points, got[1].std_utm, got[1].n_clusters) == (1, 0, None, None)
    assert math.isclose(got[2].std_utm, 1.0, rel_tol=1e-3) and got[2].n_clusters is None


def test_grid_ids_and_counts(spark):
    g = grids.make_grid(spark, (0, 1), (0, 1), 0.5)
    assert [(r.id_cell, r.lon, r.lat) for r in g.orderBy("id_cell").collect()] == [
        (0, 0.0, 0.0), (1, 0.0, 0.5), (2, 0.5, 0.0), (3, 0.5, 0.5)]
    pts = spark.createDataFrame([(0.1, 0.6), (0.2, 0.7), (0.9, 0.1), (1.0, 0.1)], "lon double, lat double")
    assert {r.id_cell: r.point_ct for r in grids.counted_cells(pts, (0, 1), (0, 1), 0.5).collect()} == {1: 2, 2: 1}


def test_geojson_layer(spark, tmp_path):
    path = tmp_path / "layer.json"
    path.write_text(
        '{"type":"Feature","properties":{"UID":7},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}}\n'
        '{"type":"Feature","properties":{"UID":8},"geometry":{"type":"MultiPolygon","coordinates":'
        '[[[[5,0],[6,0],[6,1],[5,0]]],[[[7,0],[8,0],[8,1],[7,0]]]]}}\n'
        '{"type":"Feature","properties":{"UID":9},"geometry":null}\n')
    from pyspark.sql import types as T
    raw = layers.read_geojson(spark, str(path), T.StructType([T.StructField("UID", T.LongType())]))
    assert layers.missing_geometries(raw).first()[0] == 1
    layer = layers.polygon_layer(raw, "gadm")
    assert {r.code: r.n for r in layer.select("code", F.size("rings").alias("n")).collect()} == {"7": 1, "8": 2}
    pts = spark.createDataFrame([(1, 7.9, 0.1), (2, 3.0, 1.0)], "id long, lon double, lat double")
    assert {tuple(r) for r in spatial.containing(pts, layer, "id").collect()} == {(1, "8"), (2, "7")}
