"""Vectors for searches: equal rows as one point, shards met by blocks of queries, the best few of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A shard has a 64th of the points, within these bounds; so has a block of queries.
LEAST, MOST = 1 << 13, 1 << 18


def usable(name: str) -> Column:
    """Whether a vector has components, all of them known and finite."""
    fine = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(name) > 0), F.lit(False))


def points(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """Rows with equal `keys` as one point with its `keep` smallest vec_ids, ascending, in `ids`.

    The limit is applied before the shuffle as well, so that a group of any size sends `keep` rows from a task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    few = rows.select(*keys, "vec_id").withColumn("__place", place).filter(F.col("__place") <= keep)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _parts(table: DataFrame, key: str, alias: str) -> DataFrame:
    n = F.count("*")
    size = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(n / 64)))
    return table.groupBy(key).agg(F.ceil(n / size).cast("int").alias(alias))


def shards_and_queries(base: DataFrame, queries: DataFrame, vector: str) -> DataFrame:
    """Every shard of points beside every block of queries, dealt out and sorted so that the points come first.

    `base` and `queries` share all their columns; those added are dims, shard, block and is_query. Points are dealt by
    the hash of their vector, so that no value of another column fills a shard. Vectors meet those of their own length.
    """
    base = base.withColumn("dims", F.size(vector))
    queries = queries.withColumn("dims", F.size(vector))
    shards, blocks = _parts(base, "dims", "shards"), _parts(queries, "dims", "blocks")
    sizes = F.broadcast(shards.join(blocks, "dims"))  # a row for each length of vectors
    hashed = F.xxhash64(vector)
    left = base.join(sizes, "dims").select(
        *base.columns, F.pmod(hashed, "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("is_query"))
    right = queries.join(sizes, "dims").select(
        *base.columns, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(hashed, "blocks").cast("int").alias("block"), F.lit(True).alias("is_query"))
    return left.unionByName(right).repartition("dims", "shard", "block").sortWithinPartitions(
        "dims", "shard", "block", "is_query")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches in which the `keys` stay the same."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.ones(n, dtype=bool)
        change[1:] = False
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = [*np.flatnonzero(change), n]
        for start, end in zip(cuts, cuts[1:]):
            yield tuple(batch.column(key)[int(start)].as_py() for key in keys), batch.slice(start, end - start)


def matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def lists(batches: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and where each list starts (and the last ends)."""
    columns = [b.column(name) for b in batches]
    lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in columns])
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in columns])
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class Best:
    """The `k` best points of each query: higher scores first, ties to the smaller `first` (a point's smallest id)."""

    def __init__(self, queries: int, k: int, first: np.ndarray, kind: type = np.float64, least: float = -np.inf):
        self.k, self.least = k, least
        self.first = np.append(first, np.iinfo(np.int64).max)  # the last one stands for no point
        self.score = np.full((queries, k), least, dtype=kind)
        self.point = np.full((queries, k), -1, dtype=np.int64)

    def worst(self) -> np.ndarray:
        """The score that a new point must reach."""
        return self.score[:, -1]

    def offer(self, query: np.ndarray, point: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        old = np.unique(query)
        query = np.concatenate([np.repeat(old, self.k), query])
        point = np.concatenate([self.point[old].ravel(), point])
        score = np.concatenate([self.score[old].ravel(), score])
        order = np.lexsort((self.first[point], -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.score[query[kept], rank[kept]] = score[order][kept]
        self.point[query[kept], rank[kept]] = point[order][kept]

    def rows(self, k: int, ids: np.ndarray, starts: np.ndarray, own: np.ndarray, same) -> tuple[np.ndarray, ...]:
        """Query, id and score of the `k` best rows of each query, without its own row.

        `own` has the id of each query, and `same(query, point)` says whether a point is that of the query itself: one
        row with the query's id is left out of that point.
        """
        query, place = np.nonzero(self.point >= 0)
        point, score = self.point[query, place], self.score[query, place]
        lengths = starts[point + 1] - starts[point]
        twin = np.repeat(same(query, point), lengths)
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row = ids[np.repeat(starts[point], lengths) + within]
        query, score = np.repeat(query, lengths), np.repeat(score, lengths)
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        mine = np.flatnonzero(twin[order] & (row == own[query]))
        mine = mine[np.unique(query[mine], return_index=True)[1]]
        query, row, score = (np.delete(x, mine) for x in (query, row, score))
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[kept], row[kept], score[kept]
