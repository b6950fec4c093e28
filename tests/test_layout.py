import random

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import filters
from fieldtally.sources import layout, proxy

D = "/root/testdata/sf0.01"


def scanned(df):
    """Rows that the Parquet scan of an executed query put out."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "points")
    rows = proxy.points(spark, D).withColumns({
        "lon": F.when(F.col("point_id") % 97 != 0, F.col("lon")), "upload_date_utc": F.when(
            F.col("point_id") % 89 != 0, F.col("upload_date_utc"))})
    layout.write_clustered(rows, path, partitions=40, row_group=1 << 16, block_days=2)
    return rows, path


def test_nothing_is_lost(spark, written):
    rows, path = written
    back = layout.read_clustered(spark, path)
    assert back.columns == rows.columns and back.count() == rows.count() and back.exceptAll(rows).isEmpty()


@pytest.mark.parametrize("box", [(-10, 50, -30, 45), (0, 5, 0, 5), (100, 180, -90, 90), (-180, -179, 50, 60)])
def test_a_box_reads_a_part(spark, written, box):
    rows, path = written
    got = layout.read_clustered(spark, path, box=box)
    want = filters.in_box(rows, *box)
    assert sorted(r.point_id for r in got.collect()) == sorted(r.point_id for r in want.collect())


def test_scans_skip_row_groups(spark, written):
    rows, path = written
    n = rows.count()
    assert scanned(layout.read_clustered(spark, path)) == n
    first, last = rows.agg(F.min("upload_date_utc"), F.max("upload_date_utc")).first()
    during = (first, first + (last - first) / 10)
    some = layout.read_clustered(spark, path, during=during, block_days=2)
    assert some.count() == rows.filter(F.col("upload_date_utc").between(*[F.lit(t) for t in during])).count() > 0
    assert scanned(layout.read_clustered(spark, path, during=during, block_days=2)) < n / 2
    one = rows.filter("lon between -160 and 160 and lat between -50 and 50").orderBy("point_id").first()
    small = (one.lon - 8, one.lon + 8, one.lat - 8, one.lat + 8)
    both = layout.read_clustered(spark, path, box=small, during=(first, last), block_days=2)
    assert both.count() == filters.in_box(rows, *small).filter("upload_date_utc is not null").count()
    place_first = path + "-by-place"  # one block of time: places alone decide
    layout.write_clustered(rows, place_first, partitions=40, block_days=10_000)
    boxed = layout.read_clustered(spark, place_first, box=small, block_days=10_000)
    assert boxed.count() == filters.in_box(rows, *small).count() > 0 and scanned(boxed) < n / 4


def test_ranges_hold_their_box():
    rnd = random.Random(6)
    size = 1 << layout.PLACE_BITS
    for _ in range(60):
        x, y = sorted(rnd.uniform(-180, 180) for _ in range(2)), sorted(rnd.uniform(-90, 90) for _ in range(2))
        ranges = layout.place_ranges(*x, *y)
        assert 0 < len(ranges) <= layout.RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        for _ in range(40):
            lon, lat = rnd.uniform(*x), rnd.uniform(*y)
            number = layout._interleaved(min(int((lon + 180) / 360 * size), size - 1), min(int((lat + 90) / 180 * size), size - 1))
            assert any(a <= number <= b for a, b in ranges)
