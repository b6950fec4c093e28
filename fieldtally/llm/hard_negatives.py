"""Hard negatives by integer scores, filtered by angles to reference directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .vector_tables import Best, lists, matrix, points, runs, shards_and_queries, usable

# Reference directions of a length of vectors, and the rows they are picked from.
REFERENCES, SAMPLE = 12, 1000
# Points of a tile, and queries that a task looks at together.
TILE, TOGETHER = 256, 1024
# Rounding of an angle: an arc cosine near 1 loses half of the digits.
SLACK = 1e-7
# Largest whole number up to which sums of products in double precision are exact.
EXACT = 2.0 ** 53
# Scores of no point, and the ends of those of a point.
_NONE, _LEAST, _MOST = (np.iinfo(np.int64).min + 1, np.iinfo(np.int64).min + 2, np.iinfo(np.int64).max)


def _references(base: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors for each length: far from each other, out of a bounded sample by hash (a documented limit of the fit)."""
    rank = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("vector"), "vector"))
    every = base.select(F.size("vector").alias("dims"), "vector").filter(F.exists("vector", lambda x: x != 0))
    steps = every.groupBy("dims").agg(F.ceil(F.count("*") / (4 * SAMPLE)).alias("step"))
    few = every.join(F.broadcast(steps), "dims").filter(F.pmod(F.xxhash64("vector"), "step") == 0)
    sample: dict[int, list] = {}
    for row in few.withColumn("__rank", rank).filter(F.col("__rank") <= SAMPLE).collect():
        sample.setdefault(row.dims, []).append(row.vector)
    out = {}
    for dims, rows in sample.items():
        unit = np.array(rows, dtype=np.float64)
        unit /= np.abs(unit).max(axis=1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        chosen = [0]
        closest = unit @ unit[0]
        while len(chosen) < min(REFERENCES, len(unit)):
            chosen.append(int(closest.argmin()))
            closest = np.maximum(closest, unit @ unit[chosen[-1]])
        out[dims] = unit[chosen]
    return out


def _with_angles(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Adds the norm and the angles to the references of its length; a zero vector has angles of 0."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                vectors = matrix(own.column("vector"), int(dims))
                largest = np.maximum(np.abs(vectors).max(axis=1), 1.0)
                scaled = vectors / largest[:, None]
                norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
                unit = scaled / np.where(norm > 0, norm, 1.0)[:, None]
                to = references.get(int(dims), np.zeros((0, int(dims))))
                angles = np.arccos(np.clip(unit @ to.T, -1, 1))
                angles[norm == 0] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(norm * largest), pa.ListArray.from_arrays(
                        pa.array(np.arange(len(angles) + 1) * len(to), pa.int32()), pa.array(angles.ravel()))],
                    names=[*own.schema.names, "norm", "angles"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(measure, f"{kinds}, norm double, angles array<double>")


def _interval(least: np.ndarray, most: np.ndarray, low_norm: np.ndarray, high_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product at an angle of `least` to `most`, whole numbers on the safe side of rounding."""
    near = np.cos(np.clip(least - 2 * SLACK, 0, np.pi))
    far = np.cos(np.clip(most + 2 * SLACK, 0, np.pi))
    high = np.where(near > 0, high_norm, low_norm) * near
    low = np.where(far > 0, low_norm, high_norm) * far
    room = high_norm * 1e-9
    return np.floor(low - room) - 1, np.ceil(high + room) + 1


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows with all rows; those that leave the range of a long become its ends."""
    dims = max(1, left.shape[1])
    plain, other = left.astype(np.float64), right.astype(np.float64)
    if np.abs(plain).max(initial=0) * np.abs(other).max(initial=0) * dims < EXACT:
        return (plain @ other.T).astype(np.int64)
    table = left.astype(object) @ right.astype(object).T
    return np.clip(table, _LEAST, _MOST).astype(np.int64)


class _Shard:
    """Points of a shard in tiles of one label whose angles to the references are close together."""

    def __init__(self, held: list[pa.RecordBatch], dims: int):
        self.vectors = np.concatenate([matrix(b.column("vector"), dims, np.int64) for b in held])
        self.ids, self.starts = lists(held, "ids")
        self.first = self.ids[self.starts[:-1]]
        self.norm = np.concatenate([b.column("norm").to_numpy() for b in held])
        self.label = np.concatenate([b.column("label").to_numpy(zero_copy_only=False) for b in held])
        angles = [b.column("angles") for b in held]
        self.angles = np.concatenate([a.flatten().to_numpy(zero_copy_only=False) for a in angles]).reshape(len(self.norm), -1)
        if self.angles.shape[1]:
            nearest = self.angles.argmin(axis=1)
            order = np.lexsort((self.angles.min(axis=1), nearest, self.label))
        else:
            order = np.argsort(self.label, kind="stable")
        label = self.label[order]
        starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        self.tiles = [order[s:min(s + TILE, end)] for start, end in zip(starts, [*starts[1:], len(order)])
                      for s in range(start, end, TILE)]
        self.tile_label = np.array([self.label[t[0]] for t in self.tiles])
        self.low = np.array([self.angles[t].min(axis=0) for t in self.tiles])
        self.high = np.array([self.angles[t].max(axis=0) for t in self.tiles])
        self.norms = np.array([[self.norm[t].min(), self.norm[t].max()] for t in self.tiles])

    @staticmethod
    def _between(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest angle of queries to what lies within `low` and `high` of the references, one after the other."""
        least = np.zeros((len(angle), len(low)))
        most = np.full((len(angle), len(low)), np.pi)
        for r in range(angle.shape[1]):
            a, x, y = angle[:, r, None], low[None, :, r], high[None, :, r]
            np.maximum(least, np.maximum(x - a, a - y), out=least)
            np.minimum(most, np.minimum(a + y, 2 * np.pi - (a + x)), out=most)
        return least, np.maximum(least, most)

    def tile_bounds(self, angle: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each query in each tile."""
        low, high = self.norms.T
        return _interval(*self._between(angle, self.low, self.high), norm[:, None] * low, norm[:, None] * high)

    def row_bounds(self, tile: int, angle: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.tiles[tile]
        sizes = norm[:, None] * self.norm[own]
        return _interval(*self._between(angle, self.angles[own], self.angles[own]), sizes, sizes)

    def scores(self, tile: int, vectors: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, point and integer score of the wanted pairs: rows and columns without any are not multiplied."""
        rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        own = self.tiles[tile][columns]
        table = _products(vectors[rows], self.vectors[own])
        i, j = np.nonzero(wanted[np.ix_(rows, columns)])
        return rows[i], own[j], table[i, j]


def _best_positives(shard: _Shard, q: dict, k: int) -> Best:
    """The best `k` points of each query's label."""
    best = Best(len(q["own"]), k, shard.first, np.int64, _NONE)
    low, high = shard.tile_bounds(q["angles"], q["norm"])
    high[q["label"][:, None] != shard.tile_label[None, :]] = -np.inf
    first = high.argmax(axis=1)
    for begin in (True, False):
        for tile in range(len(shard.tiles)):
            may = (first == tile) if begin else (first != tile) & (high[:, tile] >= best.worst())
            who = np.flatnonzero(may & (high[:, tile] > -np.inf))
            if len(who):
                top = shard.row_bounds(tile, q["angles"][who], q["norm"][who])[1]
                i, j, score = shard.scores(tile, q["vector"][who], top >= best.worst()[who, None])
                best.offer(who[i], j, score)
    return best


def _best_negatives(shard: _Shard, q: dict, k: int) -> Best:
    """The best `k` points of other labels in each window of a query (`floor` to `ceiling`)."""
    best = Best(len(q["own"]), k, shard.first, np.int64, _NONE)
    asks, window = np.unique(q["row"], return_inverse=True)
    lead = np.zeros(len(asks), dtype=np.int64)
    lead[window] = np.arange(len(window))  # angles are the same for all windows of a query
    angles, norm, vector = q["angles"][lead], q["norm"][lead], q["vector"][lead]
    low, high = shard.tile_bounds(angles, norm)
    members = np.argsort(window, kind="stable")
    starts = np.searchsorted(window[members], np.arange(len(asks) + 1))
    for tile in np.argsort(-high.max(axis=0), kind="stable"):
        need = np.maximum(q["floor"], best.worst())
        open_windows = ((high[window, tile] >= need) & (low[window, tile] <= q["ceiling"])
                        & (q["label"] != shard.tile_label[tile]))
        if not open_windows.any():
            continue
        # the lowest need and the highest ceiling of a query's open windows: what lies between is scored
        least = np.full(len(asks), np.inf)
        most = np.full(len(asks), -np.inf)
        np.minimum.at(least, window[open_windows], need[open_windows])
        np.maximum.at(most, window[open_windows], q["ceiling"][open_windows])
        who = np.flatnonzero(most >= least)
        bottom, top = shard.row_bounds(tile, angles[who], norm[who])
        i, j, score = shard.scores(tile, vector[who], (top >= least[who, None]) & (bottom <= most[who, None]))
        i = who[i]
        count = (starts[i + 1] - starts[i])
        pair = np.repeat(np.arange(len(i)), count)
        at = members[np.repeat(starts[i], count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)]
        fits = open_windows[at] & (score[pair] >= need[at]) & (score[pair] <= q["ceiling"][at])
        best.offer(at[fits], j[pair[fits]], score[pair[fits]])
    return best


_COLUMNS = ["label", "vector", "norm", "angles", "ids", "row", "window", "floor", "ceiling"]


def _look(dealt: DataFrame, k: int, positives: bool) -> DataFrame:
    """For each query (a window each, for negatives) the `k` best rows of every shard."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for (dims, number, block, is_query), part in runs(batches, ["dims", "shard", "block", "is_query"]):
            if at != (dims, number, block):
                at, held, shard = (dims, number, block), [], None
            if not is_query:
                held.append(part)
                continue
            if not held:
                continue
            shard = shard or _Shard(held, dims)
            for s in range(0, part.num_rows, TOGETHER):
                own = part.slice(s, TOGETHER)
                q = {name: own.column(name).to_numpy(zero_copy_only=False) for name in (
                    "label", "norm", "row", "window", "floor", "ceiling")}
                q["vector"] = matrix(own.column("vector"), dims, np.int64)
                q["angles"] = own.column("angles").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                q["own"] = lists([own], "ids")[0]
                best = (_best_positives if positives else _best_negatives)(shard, q, k + positives)

                def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                    if not positives:
                        return np.zeros(len(i), dtype=bool)
                    return (q["label"][i] == shard.label[j]) & (q["vector"][i] == shard.vectors[j]).all(axis=1)

                query, found, score = best.rows(k, shard.ids, shard.starts, q["own"], same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["row"][query]), pa.array(q["own"][query]), pa.array(q["window"][query]), pa.array(found),
                     pa.array(score)], names=["row", "anchor_id", "window", "vec_id", "score"])

    return dealt.mapInArrow(look, "row long, anchor_id long, window long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Negatives nearly as close as a positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors(vec_id, label, embedding)`; anchors are the rows for which `is_anchor` holds. Components become
    floor(scale * x), and a score is the integer inner product with the anchor. An anchor's positives are its best `positives`
    other rows of the same label; for each of them the best `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned, ranked from 1. Higher scores come
    first, ties go to the smaller vec_id; fewer rows than asked for are all returned.

    The result is exact. Each point stores its angles to a few reference directions, picked from a bounded sample (they decide
    the work only); with those of the anchor they bound the angle between the two, with the norms the score. Only points whose
    bounds reach a window, and what is asked of it by then, are scored.

    Rows with a null label, vector or vec_id, without components, or with null or non-finite components take no part.
    Zero vectors score 0. Rows that repeat a vec_id or a whole row are rows of their own, each anchor among them is answered. Vectors
    meet those of their own length. Components beyond the range of a long are its ends; so are scores. An empty table
    gives an empty table; further columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          "embedding", is_anchor.alias("anchors"))
    rows = rows.filter(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select("vec_id", "label", whole.alias("vector"), "anchors")
    few = stored(points(rows, ["label", "vector"], max(positives + 1, negatives)), "negatives-points")
    references = _references(few)
    asked = rows.filter("anchors").select("label", "vector", F.array("vec_id").alias("ids"))
    blank = [F.lit(0).cast("long").alias(c) for c in ("window", "floor", "ceiling")]
    base = stored(_with_angles(few, references), "negatives-angles")
    discard(few)
    base = base.select("*", F.lit(0).cast("long").alias("row"), *blank).select(_COLUMNS)
    anchors = stored(_with_angles(asked, references).withColumn("row", F.monotonically_increasing_id()), "negatives-anchors")

    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    near = _look(shards_and_queries(base, anchors.select("*", *blank).select(_COLUMNS), "vector"), positives, True)
    near = stored(near.withColumn("place", place).filter(F.col("place") <= positives).select(
        "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # a window for each distinct score of an anchor's positives
    score = F.col("window").cast("decimal(20,0)")
    windows = near.select("row", F.col("positive_score").alias("window")).distinct().select(
        "row", "window", F.ceil(score * low / 100).alias("floor"), F.floor(score * high / 100).alias("ceiling"))
    windows = windows.filter("floor <= ceiling").select(
        "row", "window", *[F.col(c).try_cast("long").alias(c) for c in ("floor", "ceiling")]).dropna()
    windows = anchors.join(windows, "row").select(_COLUMNS)
    far = _look(shards_and_queries(base, windows, "vector"), negatives, False)
    place = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id"))
    far = far.withColumn("rank", place).filter(F.col("rank") <= negatives)
    return near.join(far, (near["row"] == far["row"]) & (near["positive_score"] == far["window"])).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
