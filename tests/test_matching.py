import difflib
import math
import random

from pyspark.sql import functions as F

from fieldtally.operators import fuzzy, neighbours


def _names(seed, n):
    rnd = random.Random(seed)
    base = ["san pedro de la sierra", "villanueva del campo", "a coruna", "el prat", "us", "sant boi de llobregat", "x"]
    out = []
    for _ in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(s) + 1)
            kind = rnd.random()
            if kind < 0.4:
                s.insert(i, rnd.choice("abcdexyz "))
            elif kind < 0.8 and len(s) > 1:
                s.pop(min(i, len(s) - 1))
            else:
                s[min(i, len(s) - 1)] = rnd.choice("abcde")
        out.append("".join(s))
    return out


def test_ratio_against_difflib(spark):
    left, right = sorted(set(_names(1, 120))), sorted(set(_names(2, 120)))
    l = spark.createDataFrame([("p", n) for n in left], "block string, name string")
    r = spark.createDataFrame([("p", n) for n in right], "block string, name string")
    got = {x.name: x.match for x in fuzzy.best_match(l, r, 0.9).collect()}
    want = {n: m[0] for n in left if (m := difflib.get_close_matches(n, right, n=1, cutoff=0.9))}
    assert got == want
    edits = {x.name for x in fuzzy.best_match(l, r, 0.9, "edits").collect()}
    assert edits <= set(left) and edits


def test_blocks_are_kept_apart(spark):
    l = spark.createDataFrame([("p", "alpha"), ("q", "alpha")], "block string, name string")
    r = spark.createDataFrame([("p", "alpha")], "block string, name string")
    assert [(x.block, x.match, x.score) for x in fuzzy.best_match(l, r).collect()] == [("p", "alpha", 1.0)]


def _check_knn(spark, rows, k):
    df = spark.createDataFrame(rows, "id long, a double, b double, c string")
    got = {}
    for r in neighbours.nearest_users(df, "id", ["a", "b"], ["c"], k).collect():
        got.setdefault(r.id, []).append((round(r.distance, 9), r.other))
    lo = [min(r[i] for r in rows) for i in (1, 2)]
    hi = [max(r[i] for r in rows) for i in (1, 2)]
    sc = [(r[0], *((r[i + 1] - lo[i]) / (hi[i] - lo[i]) if hi[i] > lo[i] else 0.0 for i in (0, 1)), r[3]) for r in rows]
    for p in sc:
        best = sorted((round((abs(p[1] - q[1]) + abs(p[2] - q[2]) + (p[3] != q[3])) / 3, 12), q[0]) for q in sc if q[0] != p[0])[:k]
        assert sorted(got.get(p[0], [])) == [(round(d, 9), i) for d, i in best], p


def test_nearest_users_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, round(rnd.random(), 3), round(rnd.gauss(0, 3), 2), rnd.choice("xyz")) for i in range(250)]
    rows += [(1000 + i, 0.5, 0.5, "x") for i in range(60)]  # one crowded spot
    rows += [(2000, 0.2, 0.2, "rare"), (2001, 0.9, 0.9, "rare")]  # fewer than k of a kind
    _check_knn(spark, rows, 4)


def test_nearest_users_of_equal_rows(spark):
    _check_knn(spark, [(i, 1.0, 1.0, "x") for i in range(6)], 3)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id long, a double, b double")
    got = [tuple(r) for r in neighbours.min_max_scaled(df, ["a", "b"]).orderBy("id").collect()]
    assert got == [(1, 0.0, 0.0), (2, 0.0, 1.0)]
    assert [tuple(r) for r in neighbours.l2_scaled(df.select("id", F.lit(3.0).alias("a"), F.lit(4.0).alias("b")), ["a", "b"]
                                                   ).limit(1).collect()] == [(1, 0.6, 0.8)]


def test_nearest_of_users_crowded_at_every_scale(spark, monkeypatch):
    """Unit vectors close to one another, as lengths of very different columns give: few pairs are met, none is lost."""
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        x, y = rnd.uniform(1, 2500), rnd.choice([0.0, 0.1, 0.5, 0.9])
        n = math.hypot(x, y)
        rows.append((i, x / n, y / n))
    seen = spark.sparkContext.accumulator(0)

    def counted(numeric):
        tick = F.udf(lambda d: (seen.add(1), d)[1], "double").asNondeterministic()
        return tick(neighbours_distance(numeric))

    neighbours_distance = neighbours.euclidean_distance
    monkeypatch.setattr(neighbours, "euclidean_distance", counted)
    out = neighbours.nearest_users(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], (), 3, metric="euclidean")
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(r.other)
    lo = [min(r[c] for r in rows) for c in (1, 2)]
    wide = max(max(r[c] for r in rows) - lo[c - 1] for c in (1, 2))
    even = [(i, (a - lo[0]) / wide, (b - lo[1]) / wide) for i, a, b in rows]
    for i, a, b in even[::50]:
        want = sorted((round(math.sqrt((a - c) ** 2 + (b - d) ** 2), 12), j) for j, c, d in even if j != i)[:3]
        assert sorted(got[i]) == sorted(j for _, j in want)
    assert seen.value < 300 * len(rows), seen.value


def test_equal_and_hopeless_names_are_not_scored(spark):
    r = [("p", n) for n in ("abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", "abcdefghijklmnopqrXY", "")]
    l = [("p", "abcdefghijklmnopqrst"), ("p", "abcdefghijklmnopqrst1"), ("p", ""), ("p", None)]
    make = lambda rows: spark.createDataFrame(rows, "block string, name string")
    plan = fuzzy.candidates
    met = []
    try:
        fuzzy.candidates = lambda left, *a: (met.append(left.count()), plan(left, *a))[1]
        got = {x.name: (x.match, x.score) for x in fuzzy.best_match(make(l), make(r)).collect()}
    finally:
        fuzzy.candidates = plan
    assert got == {"abcdefghijklmnopqrst": ("abcdefghijklmnopqrst", 1.0), "abcdefghijklmnopqrst1": ("abcdefghijklmnopqrst", 40 / 41)}
    assert met[0] < 4


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_segments_are_not_broadcast_and_lose_no_pair(spark, tmp_path):
    left, right = sorted(set(_names(3, 60))), sorted(set(_names(4, 60)))
    for side, names in (("l", left), ("r", right)):  # files, as their size is what Spark goes by
        spark.createDataFrame([("p", n) for n in names], "block string, name string").write.parquet(f"{tmp_path}/{side}")
    l, r = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    for cutoff, score in ((0.9, "ratio"), (0.75, "ratio"), (0.8, "edits"), (0.5, "edits")):
        found = fuzzy.candidates(l, r, cutoff, score)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        size = max if score == "edits" else lambda a, b: a + b
        low = cutoff if score == "edits" else cutoff / (2 - cutoff)
        want = {(a, b) for a in left for b in right if low - 1e-9 <= len(a) / len(b) <= 1 / low + 1e-9
                and _edits(a, b) <= int((1 - cutoff) * size(len(a), len(b)) + 1e-9)}
        assert {(x.l_name, x.r_name) for x in found.collect()} == want
