"""The searches and the whitening of vectors against brute force in numpy, with nulls, ties, repeats and odd lengths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import hard_negatives, queries, vantage_search, vector_tables, whitening

SF = "/root/testdata/sf0.1"
ROWS = "vec_id long, label int, embedding array<double>, score string, rank int, dims int, row string"
NAN, INF = float("nan"), float("inf")


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def table(seed=3, n=700, dims=6, integers=False):
    """Clusters, equal vectors in a big group, zero vectors, other lengths, unusable vectors, null ids and labels."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, dims)) * 2
    rows = []
    for i in range(n):
        v = centres[r.integers(8)] + r.standard_normal(dims) * r.choice([0.0, 0.01, 0.6])
        if i % 3 == 0:
            v = centres[0]
        if integers:
            v = np.round(v)
        rows.append((i, int(r.integers(4)), [float(x) for x in v]))
    rows += [(n + i, int(i % 4), [float(x) for x in r.standard_normal(3)]) for i in range(60)]
    rows += [(1000, 1, None), (1100, 1, []), (1200, None, [1.0] * dims), (None, 1, [3.0] * dims), (1300, 1, [NAN] * dims),
             (1400, 2, [1.0, None] + [0.0] * (dims - 2)), (1500, 2, [INF] * dims), (1600, 2, [0.0] * dims), (1700, 2, [-0.0] * dims),
             (1800, 3, [1e6] * dims)]
    return [(*row, "x", 7, 8, "y") for row in rows]


@pytest.fixture(params=[200, 1 << 13])
def small_shards(request, monkeypatch):
    monkeypatch.setattr(vector_tables, "LEAST", request.param)


def dot(v, w):
    total = 0.0  # `sum` would correct the rounding
    for x, y in zip(v, w):
        total += x * y
    return total


def best(scored, k):
    return sorted(scored, key=lambda s: (-s[0], s[1]))[:k]


def brute_nearest(rows, k):
    use = [(i, v) for i, _, v, *_ in rows if i is not None and fine(v) and any(v)]
    out = []
    for a, (i, v) in enumerate(use):
        if i % 20 == 0:
            scored = [(dot(v, w), j) for b, (j, w) in enumerate(use) if b != a and len(w) == len(v)]
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(best(scored, k))]
    return sorted(out)


@pytest.mark.parametrize("integers", [False, True])
def test_exact_search(spark, small_shards, integers):
    rows = table(integers=integers)
    got = vantage_search.nearest_vectors(spark.createDataFrame(rows, ROWS).repartition(5), F.col("vec_id") % 20 == 0, k=7, factor=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, 7)


def test_repeated_rows_of_a_query(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0])]
    got = vantage_search.nearest_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5)
    one = [(20, 1, 3, 1.0), (20, 2, 20, 1.0), (20, 3, 4, 0.5)]
    assert sorted(map(tuple, got.collect())) == sorted(one + one)


def test_default_search_misses_nothing(spark):
    """Norms far apart and few directions: least distances of branches are large shares of the true ones."""
    r = np.random.default_rng(5)
    basis = r.standard_normal((3, 16))
    rows = [(i, (basis.T @ r.standard_normal(3) * r.lognormal(0, 1)).tolist()) for i in range(3000)]
    got = vantage_search.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    vectors = np.array([v for _, v in rows])
    scores = vectors[::20] @ vectors.T
    scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    want = {(20 * q, int(j)) for q, near in enumerate(np.argsort(-scores, axis=1)[:, :20]) for j in near}
    assert {(x.query_id, x.vec_id) for x in got.collect()} == want


def test_huge_components_do_not_stop_the_search(spark):
    rows = [(20, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1e200, 1e200]), (3, [1.0, 1.0])]
    got = vantage_search.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20)
    assert [(r.rank, r.vec_id) for r in sorted(got.collect(), key=lambda r: r.rank)] == [(1, 2), (2, 3), (3, 1)]


def test_recall_of_the_registered_search(spark):
    got = queries.op12_vantage_trees(spark, SF).collect()
    held = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in held])
    vectors = np.array([r.embedding for r in held], dtype=float)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    at = {i: p for p, i in enumerate(ids)}
    shares = []
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[at[q]]
        scores[at[q]] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        assert len(found[q]) == 20 and all(abs(s - scores[at[i]]) < 1e-12 for i, s in found[q])
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        shares.append(len(set(want) & {i for i, _ in found[q]}) / 20)
    assert np.mean(shares) >= 0.95


def brute_negatives(rows, scale, anchors, positives, negatives, low, high):
    use = [(i, l, [max(-2 ** 63, min(2 ** 63 - 1, math.floor(scale * x))) for x in v]) for i, l, v, *_ in rows
           if i is not None and l is not None and fine(v)]
    out = []
    for a, (i, l, v) in enumerate(use):
        if i % anchors:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m == l) for b, (j, m, w) in enumerate(use) if b != a and len(w) == len(v)]
        for p, j, _ in best([s for s in scored if s[2]], positives):
            window = [s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p]
            out += [(i, j, rank + 1, s[1], p, s[0]) for rank, s in enumerate(best(window, negatives))]
    return sorted(out)


@pytest.mark.parametrize("scale,low,high,integers", [(256, 80, 100, False), (1, 50, 90, True), (256, 80, 100, True)])
def test_hard_negatives(spark, small_shards, scale, low, high, integers):
    rows = table(integers=integers)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, ROWS).repartition(5), F.col("vec_id") % 10 == 0, 4, 3, low, high, scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, scale, 10, 4, 3, low, high)
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_beyond_exact_doubles(spark):
    r = np.random.default_rng(8)
    rows = [(i, i % 2, [float(x) for x in r.standard_normal(4) * 3e5]) for i in range(120)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 256, 10, 5, 5, 80, 100)


def test_angles_bound_the_scores(spark):
    r = np.random.default_rng(1)
    vectors = np.rint(r.standard_normal((300, 8)) * r.choice([1, 40, 4000], (300, 1))).astype(np.int64)
    vectors[:40] = vectors[40:80] * 2  # the same direction
    base = spark.createDataFrame([(v.tolist(),) for v in vectors], "vector array<long>")
    held = hard_negatives._with_angles(base, hard_negatives._references(base)).collect()
    norm, angles = np.array([h.norm for h in held]), np.array([h.angles for h in held])
    vectors = np.array([h.vector for h in held])
    low, high = hard_negatives._interval(*hard_negatives._Shard._between(angles, angles, angles), *[norm[:, None] * norm] * 2)
    exact = vectors @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 1.5 * (norm[:, None] * norm).mean()  # they do tell something


def brute_whitening(rows, count, scale):
    use = [(i, np.floor(np.array(v) * scale).astype(np.int64) + 1_000_000) for i, _, v, *_ in rows if fine(v)]
    out = {}
    for dims in {len(x) for _, x in use}:
        own = [(i, x) for i, x in use if len(x) == dims]
        fit = np.unique(np.array([x for _, x in own]), axis=0)
        n, sums = len(fit), fit.sum(axis=0)
        z = (n * fit - sums) / n
        values, vectors = np.linalg.eigh(z.T @ z / n)
        values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
        for i, x in own:
            w = ((n * x - sums) / n) @ vectors / np.sqrt(values)
            out[i, dims] = (n, int(((n * x - sums).astype(object) ** 2).sum()), w, values / np.trace(z.T @ z / n))
    return out


def test_whitening(spark):
    rows = [r for r in table(n=300) if r[0] != 1800]
    got = whitening.whitened(spark.createDataFrame(rows + rows[:5], ROWS).repartition(5), 4, 64)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want = brute_whitening(rows, 4, 64)
    found = {}
    for r in got.collect():
        found.setdefault((r.vec_id, 3 if r.n == want[300, 3][0] else 6), []).append(r)
        assert r.identity_error < 1e-9
    assert found.keys() == want.keys()
    signs = {}
    for key, held in found.items():
        n, deviation, w, explained = want[key]
        held = sorted(held, key=lambda r: r.component)[:len(w)]  # a repeated row gives its components twice
        for r in held:
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained - explained[r.component - 1]) < 1e-10
            if abs(w[r.component - 1]) > 1e-6:
                sign = round(r.whitened / w[r.component - 1])
                assert signs.setdefault((key[1], r.component), sign) == sign and abs(sign) == 1
            assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-8


def test_whitening_of_few_and_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whitened(make([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [4.0, 5.0])])).collect()
    assert {r.component for r in flat} == {1} and {r.vec_id for r in flat} == {1, 2, None} and all(r.explained == 1 for r in flat)
    far = whitening.whitened(make([(1, [1e17, 0.0]), (2, [-1e17, 1.0]), (3, [0.0, 0.5])])).collect()
    assert any(r.deviation is None for r in far) and all(math.isfinite(r.whitened) for r in far)


@pytest.mark.parametrize("dims,values", [
    (20, np.linspace(1, 2, 20)), (20, np.ones(20)), (12, 10.0 ** -np.arange(12)), (30, np.repeat([3.0, 2.0, 1.0], 10)),
    (9, np.array([5.0] + [0.0] * 8)), (40, 1 + 1e-4 * np.arange(40))])
def test_contour_integration(dims, values):
    q = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for shift in (0.5, 1.5, 2.5):
        assert whitening._above(v, shift) == int((values > shift).sum())
    e, u = whitening.leading_components(v, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > 1e-11 * values.max()]
    assert np.abs(e[:len(want)] - want).max() < 1e-13 * values.max()
    assert np.abs(v @ u - u * e).max() < 1e-13 * values.max() and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert vantage_search.nearest_vectors(none, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0
    assert whitening.whitened(none).count() == 0
