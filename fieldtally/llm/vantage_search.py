"""Nearest vectors by inner product: a vantage-point tree for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vector_tables import Best, lists, matrix, points, runs, shards_and_queries, usable

# Points of a leaf, and queries that a task looks at together.
LEAF, TOGETHER = 128, 1024
# A branch is left out where FACTOR times its least distance is beyond the k-th distance found; 1 is the exact search. More
# loses rows on real data: with norms far apart the k-th distance stays large, and most branches would go unseen.
FACTOR = 1.0
# Rounding of distances, as a share of the norms.
SLACK = 1e-7


class _Tree:
    """Points in a space where nearer means a larger inner product, halved by the distance to a vantage point.

    Every point gets one coordinate more, which brings all to the same norm, that of the longest; queries have a zero
    there. Nodes are numbered with parents first; each has the range of distances from its parent's vantage point.
    """

    def __init__(self, vectors: np.ndarray):
        self.scale = float(np.abs(vectors).max()) or 1.0
        scaled = vectors / self.scale
        square = np.einsum("ij,ij->i", scaled, scaled)
        self.most = float(square.max())
        placed = np.column_stack([scaled, np.sqrt(np.maximum(self.most - square, 0.0))])
        self.order = np.arange(len(placed))
        vantages, self.parent, self.range, self.leaves = [], [-1], [(0.0, np.inf)], []
        self.vantage_of = [-1]
        open_nodes = [(0, 0, len(placed))]
        for node, start, end in open_nodes:
            if end - start <= LEAF:
                self.leaves.append((node, start, end))
                continue
            own = placed[self.order[start:end]]
            middle = own.mean(axis=0)
            vantage = own[((own - middle) ** 2).sum(axis=1).argmax()]  # a point at the rim tells most apart
            distance = np.sqrt(((own - vantage) ** 2).sum(axis=1))
            half = (end - start) // 2
            split = np.argpartition(distance, half)
            self.order[start:end] = self.order[start:end][split]
            self.vantage_of[node] = len(vantages)
            vantages.append(vantage)
            for a, b in ((start, start + half), (start + half, end)):
                inside = distance[split[a - start:b - start]]
                open_nodes.append((len(self.parent), a, b))
                self.parent.append(node)
                self.vantage_of.append(-1)
                self.range.append((float(inside.min()), float(inside.max())))
        self.vantages = np.array(vantages).reshape(len(vantages), placed.shape[1])

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Least distance of each query (of norm 1) to the points of each leaf, by the triangle inequality."""
        to = np.sqrt(np.maximum(0.0, 1 + self.most - 2 * (unit @ self.vantages[:, :-1].T)))
        least = np.zeros((len(self.parent), len(unit)))
        for node in range(1, len(self.parent)):
            parent, (low, high) = self.parent[node], self.range[node]
            d = to[:, self.vantage_of[parent]]
            least[node] = np.maximum(least[parent], np.maximum(low - d, d - high))
        return least[[leaf[0] for leaf in self.leaves]].T


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, one coordinate after the other: the same sum in every task."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return np.where(np.isnan(total), -np.inf, total)


def _search(tree: _Tree, vectors: np.ndarray, first: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Best:
    best = Best(len(queries), k, first)
    largest = np.abs(queries).max(axis=1)
    scaled = queries / largest[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    unit = scaled / norm[:, None]
    least = tree.bounds(unit)
    nearest = least.argmin(axis=1)
    size = norm * largest * tree.scale  # score over this is the inner product of the tree's space
    for begin in (True, False):
        for leaf, (_, start, end) in enumerate(tree.leaves):
            if begin:
                who = np.flatnonzero(nearest == leaf)
            else:
                reach = np.sqrt(np.maximum(0.0, 1 + tree.most - 2 * (best.worst() / size)))
                who = np.flatnonzero((nearest != leaf) & ~(factor * least[:, leaf] > reach + SLACK * (1 + tree.most)))
            if not len(who):
                continue
            own = tree.order[start:end]
            near = queries[who] @ vectors[own].T
            room = 1e-12 * size[who] * (1 + tree.most)
            i, j = np.nonzero(~(near < (best.worst()[who] - room)[:, None]))
            i, j = who[i], own[j]
            best.offer(i, j, _scores(queries[i], vectors[j]))
    return best


def _found(dealt: DataFrame, k: int, factor: float) -> DataFrame:
    """The `k` best rows of each query in each shard."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        with np.errstate(all="ignore"):
            for (dims, shard, block, is_query), part in runs(batches, ["dims", "shard", "block", "is_query"]):
                if at != (dims, shard, block):
                    at, held, index = (dims, shard, block), [], None
                if not is_query:
                    held.append(part)
                    continue
                if not held:
                    continue
                if index is None:
                    vectors = np.concatenate([matrix(b.column("embedding"), dims) for b in held])
                    ids, starts = lists(held, "ids")
                    index = _Tree(vectors)
                queries = matrix(part.column("embedding"), dims)
                row = part.column("row").to_numpy()
                own = lists([part], "ids")[0]
                for s in range(0, len(queries), TOGETHER):
                    q, mine = queries[s:s + TOGETHER], own[s:s + TOGETHER]
                    best = _search(index, vectors, ids[starts[:-1]], q, k + 1, factor)
                    query, found, score = best.rows(k, ids, starts, mine, lambda i, j: (q[i] == vectors[j]).all(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[s:s + TOGETHER][query]), pa.array(mine[query]), pa.array(found), pa.array(score)],
                        names=["row", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(look, "row long, query_id long, vec_id long, score double")


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """The `k` rows of largest inner product for each query: query_id, rank, vec_id, score.

    `vectors(vec_id, embedding)`; queries are the rows for which `is_query` holds. Candidates are all rows of the same
    length but the query's own; scores are inner products in double precision on the given vectors; ranks start at
    1, ties go to the smaller vec_id. With `factor` 1 the search is exact; a larger one leaves out more branches of the
    trees and may miss rows (each row is in a tree at any factor). Fewer candidates than `k` are all returned.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without a vec_id take no part.
    Rows that repeat a vec_id or a whole row are rows of their own: each is a candidate of the others, and each that
    is a query is answered. Equal vectors are one point with its k + 1 smallest ids. An inner product that overflows is infinite
    (last, where it is undefined). An empty table gives an empty table; further columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    rows = rows.filter(usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    base = stored(points(rows, ["embedding"], k + 1), "vantage-points").withColumn("row", F.lit(None).cast("long"))
    asked = stored(rows.filter("asks").select("embedding", F.array("vec_id").alias("ids")).withColumn(
        "row", F.monotonically_increasing_id()), "vantage-queries")
    found = _found(shards_and_queries(base, asked, "embedding"), k, factor)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
