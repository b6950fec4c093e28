import math

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import classify, geodesy, numeric, suitability, text
from fieldtally.plans import behaviour, climate, etl


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("clusters, spread, quality, want", [
    (0, 1000.0, 0.7, "HQ-sparse wide"), (1, 999.0, None, "LQ-clustered narrow"), (2, None, 0.9, "HQ-multi-clustered"),
    (None, None, None, "sporadic"), (1, None, 0.7, "HQ-clustered narrow")])
def test_archetype(spark, clusters, spread, quality, want):
    df = spark.createDataFrame([(clusters, spread, quality)], "n int, s double, q double")
    assert df.select(classify.archetype(F.col("n"), F.col("s"), F.col("q"), 1000, 2 / 3)).first()[0] == want


@pytest.mark.parametrize("people, want", [
    (-1.0, None), (0.0, "human_absence"), (49.9, "low_density"), (50.0, "medium_density"), (300.0, "high_density")])
def test_density_class(spark, people, want):
    assert value(spark, classify.density_class(F.lit(people))) == want


def test_empty_confidence_text_is_zero(spark):
    df = spark.createDataFrame([("",), ("none",), ("1",), ("2",), (None,)], "c string")
    assert [r[0] for r in df.select(classify.confidence_score(F.col("c"))).collect()] == [0.0, 0.0, 0.7, 1.0, 0.0]


def test_hidden_decides_the_label(spark):
    df = spark.createDataFrame([("site", 1, True), ("site", 1, False), ("site", 1, None), ("nosesabe", 0, False)],
                               "v string, e int, h boolean")
    got = [r[0] for r in df.select(classify.report_label(F.col("v"), F.col("e"), F.col("h"))).collect()]
    assert got == ["spam", "storm_drain", "site", "unvalidated"]


def test_ascii_and_paths(spark):
    assert value(spark, text.to_ascii(F.lit("Ñuñoa Łódź Straße Åre Œuvre"))) == "Nunoa Lodz Strasse Are OEuvre"
    for name, spelt in (("Αθήνα", "Athena"), ("Москва", "Moskva"), ("Щукино, Київ", "Shchukino, Kiyiv"),
                        ("თბილისი", "t'bilisi"), ("Երան", "Eran"), ("…–é", "...-e"), ("東京", "東京")):
        assert value(spark, text.to_ascii(F.lit(name))) == spelt, name
    df = spark.createDataFrame([("Spain", "", "Lugo")], "a string, b string, c string")
    row = df.select(text.path_name([F.col("b"), F.col("a")]), text.path_name([F.col("c"), F.col("b"), F.col("a")])).first()
    assert tuple(row) == (None, "Lugo |  | Spain")


def test_fixed_decimals_keep_zeros(spark):
    assert value(spark, text.fixed_decimals(F.lit(2.15))) == "2.150"


def _snyder(lon, lat, lon0):
    """Transverse Mercator by Snyder's power series (USGS Professional Paper 1395), another route than ours."""
    f = 1 / 298.257223563
    a, e2 = 6378137.0, f * (2 - f)
    p, ep2 = math.radians(lat), e2 / (1 - e2)
    n, t, c = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep2 * math.cos(p) ** 2
    d = math.radians(lon - lon0) * math.cos(p)
    steps = 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(p * (i + 0.5) / steps) ** 2) ** 1.5 for i in range(steps)) * p / steps
    x = 500000 + 0.9996 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * d**5 / 120)
    y = 0.9996 * (arc + n * math.tan(p) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24
                                           + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * d**6 / 720))
    return x, y


@pytest.mark.parametrize("lon, lat", [(3.0, 0.0), (3.0, 48.0), (2.294497, 48.858222), (5.9, 10.0), (0.2, 60.0)])
def test_utm(spark, lon, lat):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    row = geodesy.with_utm(df, F.lit(31), F.lit(False)).select("x", "y").first()
    x, y = _snyder(lon, lat, 3)
    assert abs(row[0] - x) < 0.01 and abs(row[1] - y) < 0.01


def test_utm_zone_numbers(spark):
    assert value(spark, geodesy.utm_epsg(F.lit(-75.0), F.lit(-10.0))) == 32718
    assert value(spark, geodesy.utm_epsg(F.lit(180.0), F.lit(10.0))) == 32601


def test_cell_area_sums_to_the_sphere(spark):
    size = 10.0
    total = spark.range(18).select((F.col("id") * 10.0 - 90).alias("lat")).select(
        F.sum(geodesy.spherical_cell_area(F.col("lat"), size)) * 36).first()[0]
    assert math.isclose(total, 4 * math.pi * geodesy.SPHERE_RADIUS ** 2, rel_tol=1e-9)


def test_cell_keys_hold_negative_numbers(spark):
    key = geodesy.cell_key(F.lit(-3), F.lit(-7))
    assert tuple(spark.range(1).select(geodesy.cell_key_x(key), geodesy.cell_key_y(key)).first()) == (-3, -7)


def test_division_by_zero_is_null(spark):
    assert value(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, numeric.share_or_zero(F.lit(0), F.lit(0))) == 0.0


def test_suitability_formula(spark):
    def briere(c, lo, hi, t):
        return max(0, t * c * (t - lo) * math.sqrt(max(0, hi - t)))

    def quad(c, lo, hi, t):
        return max(0, -c * (t - lo) * (t - hi))

    t, rain, people = 25.0, 10.0, 1000.0
    peak = math.exp(-0.05 * (rain - 8) ** 2)
    hatch = 0.5 * 2.5 * peak / (peak + 1.5) + 0.5 * 0.01 / (0.01 + math.exp(-0.01 * people))
    a, f = briere(0.000193, 10.25, 38.32, t), 0.5 * briere(0.0488, 8.02, 35.65, t)
    eggs = hatch * quad(0.00071, 1.73, 40.51, t)
    want = (f * a * quad(1.43, 13.41, 31.51, t) * quad(0.002663, 6.668, 38.92, t)
            * eggs / (eggs + 0.0019328 * t * t - 0.091868 * t + 1.3338874)) ** (1 / 3)
    got = value(spark, suitability.reproduction_number("albopictus", F.lit(t), F.lit(rain), F.lit(people)))
    assert math.isclose(got, want, rel_tol=1e-9)
    assert value(spark, suitability.reproduction_number("aegypti", F.lit(None).cast("double"), F.lit(rain), F.lit(people))) is None


def test_exceedance_is_null_with_a_missing_value(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (1, 0, 3.0), (1, 0, None)], "ix int, iy int, v double")
    got = {(r.ix, r.iy): r.n_above for r in climate.exceedance(df, "v", 2.0).collect()}
    assert got == {(0, 0): 1, (1, 0): None}


def test_chance_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "labels string, cs_labels string").withColumn(
        "coincidence", F.col("labels") == F.col("cs_labels"))
    assert tuple(behaviour.chance_agreement(df).first()) == (0.75, 0.5, 0.5)


def test_survey_tie_and_direct_answers(spark):
    df = spark.createDataFrame([(1, 711, 7), (1, 722, 7), (1, 732, 7), (2, 62, 6), (3, 64, 6), (4, 999, 7)],
                               "version_uuid long, answer_id int, question_id int")
    got = {r.version_uuid: (r.cs_labels, r.weight) for r in etl.survey_labels(df).collect()}
    assert got == {1: ("albopictus", 0.6), 2: ("culex", 1.0), 3: (None, None), 4: (None, 0.0)}
