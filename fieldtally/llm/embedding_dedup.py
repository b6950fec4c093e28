"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import maybe_among, stored

# Rotated vectors are split into blocks of this many coordinates.
BLOCK = 8
# A label of more vectors than this is cut into parts, which meet in squares; fewer where vectors have more than so many coordinates.
SIDE, SIDE_DIMS = 16384, 64
# Rounding of the single-precision coordinates and tables, with room to spare (squared distance).
SLACK = 1e-5
# Rows and columns of a distance table, and pairs, that a task looks at together.
ROWS, COLUMNS, PAIRS = 256, 1024, 1 << 15
# Most tasks of a round.
_TASKS = 4096

_FOUND = "node long, links long, other long"


@functools.lru_cache(maxsize=4)
def _rotation(dims: int) -> np.ndarray:
    """The same random rotation on every machine."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _budgets(dims: int, limit: float, block: int) -> list[tuple[int, int, float]]:
    """Start, end and squared-distance budget of each block.

    Unit vectors with a cosine of `limit` are sqrt(2 - 2 * limit) apart. The square of that is
    shared out in proportion to the coordinates, so that some block of a linked pair is within its share.
    """
    ends = [(s, min(dims, s + block)) for s in range(0, dims, block)]
    return [(s, e, max(0.0, 2 - 2 * limit) * (e - s) / dims + SLACK) for s, e in ends]


def _placed(points: DataFrame, big: DataFrame | None, apart: int) -> DataFrame:
    """The squares of one round, and which points meet in them: label, dims, a, b, home, partner, node, n, embedding.

    Points of a label in `big(label, dims, parts)` are dealt to its parts, others are one part. Square (a, b) pairs the
    points of part a, at home, with those of part b, `apart` parts further on in the ring of parts. Every
    two parts meet in one square of one round, and a round copies a point twice at most.
    """
    known = ["label", "dims"]
    if big is None:
        rows = points.withColumn("parts", F.lit(1).cast("long"))
    else:  # one row per SIDE points at most
        rows = points.join(F.broadcast(big), known, "left" if apart == 0 else "inner").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).filter(F.lit(2 * apart) <= F.col("parts"))
    if apart == 0:
        met = "array(struct(part as a, part as b, true as home, true as partner))"
    else:
        met = f"""filter(array(struct(part as a, pmod(part + {apart}, parts) as b, true as home, false as partner),
                               struct(pmod(part - {apart}, parts) as a, part as b, false as home, true as partner)),
                         x -> parts > {2 * apart} or x.a < {apart})"""
    return rows.withColumn("x", F.explode(F.expr(met))).select(*known, "x.*", "node", "n", "embedding")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of `n` places over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _near_pairs(turned: np.ndarray, home: np.ndarray, partner: np.ndarray | None, block: tuple[int, int, float]) -> Iterator[tuple]:
    """Pairs of a square that may be within the budget of a block; each pair of homes once where there are no partners.

    Along the block's first coordinate both sides are in order, and only what is in reach there is put into a table.
    """
    s, e, budget = block
    left = home[np.argsort(turned[home, s])]
    right = left if partner is None else partner[np.argsort(turned[partner, s])]
    x, y = turned[left, s:e], turned[right, s:e]
    one = np.ones((len(x), 1), np.float32), np.ones((len(y), 1), np.float32)
    # squared distances as one product
    x_all = np.hstack([-2 * x, (x * x).sum(axis=1)[:, None], one[0]])
    y_all = np.ascontiguousarray(np.hstack([y, one[1], (y * y).sum(axis=1)[:, None]]).T)
    reach, most = math.sqrt(budget) + 1e-6, np.float32(budget + SLACK)
    for at in range(0, len(left), ROWS):
        rows = x_all[at:at + ROWS]
        low = np.searchsorted(y[:, 0], x[at, 0] - reach)
        high = np.searchsorted(y[:, 0], x[at + len(rows) - 1, 0] + reach, side="right")
        for start in range(low if partner is not None else max(low, at), high, COLUMNS):
            table = rows @ y_all[:, start:min(high, start + COLUMNS)]
            hit = np.flatnonzero(table <= most)
            i, j = at + hit // table.shape[1], start + hit % table.shape[1]
            if partner is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield left[i], right[j]


def _square(node: np.ndarray, n: np.ndarray, home: np.ndarray, partner: np.ndarray, plain: np.ndarray, limit: float,
            block: int) -> tuple[list, list, list]:
    """Links between the homes and partners of one square, and a spanning forest of them.

    A pair counts in the first of its blocks that is within budget, so once in all.
    """
    size, dims = plain.shape
    norm = np.sqrt(np.einsum("ij,ij->i", plain, plain))
    turned = ((plain / np.linalg.norm(plain, axis=1)[:, None]) @ _rotation(dims)).astype(np.float32)
    budgets = _budgets(dims, limit, block)
    links = np.zeros(size, dtype=np.int64)
    root = np.arange(size)
    ties: list[tuple] = []
    rows, others = np.flatnonzero(home), None if (home & partner).all() else np.flatnonzero(partner)
    step = max(1, PAIRS * SIDE_DIMS // dims)

    def tied() -> np.ndarray:  # what was tied before stays tied
        return _roots(np.concatenate([np.arange(size), *[i for i, _ in ties]]), np.concatenate([root, *[j for _, j in ties]]), size)

    for b, own in enumerate(budgets):
        for i_all, j_all in _near_pairs(turned, rows, others, own):
            for p in range(0, len(i_all), step):
                i, j = i_all[p:p + step], j_all[p:p + step]
                for c, (cs, ce, most) in reversed([*enumerate(budgets[:b + 1])]):
                    distance = ((turned[i, cs:ce].astype(np.float64) - turned[j, cs:ce]) ** 2).sum(axis=1)
                    keep = distance <= most if c == b else distance > most
                    i, j = i[keep], j[keep]
                near = np.einsum("ij,ij->i", plain[i], plain[j]) / (norm[i] * norm[j]) >= limit
                i, j = i[near], j[near]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                if len(i):
                    ties.append((i, j))
                if sum(len(x) for x, _ in ties) > 8 * PAIRS:
                    root, ties = tied(), []
    root = tied()
    counted = np.flatnonzero(links)
    led = np.flatnonzero(root != np.arange(size))
    return ([*node[counted].tolist(), *node[led].tolist()], [*links[counted].tolist(), *[0] * len(led)],
            [*[None] * len(counted), *node[root[led]].tolist()])


def _links(placed: DataFrame, tasks: int, limit: float, block: int) -> DataFrame:
    """Numbers of links by node, and links enough to connect what is linked, of one round of squares."""
    key = ["label", "dims", "a", "b"]
    dealt = placed.repartition(tasks, *key).sortWithinPartitions(*key)

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, n, home, partner = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held])
                                  for c in ("node", "n", "home", "partner"))
        flat = np.concatenate([x.column("embedding").flatten().to_numpy(zero_copy_only=False) for x in held])
        with np.errstate(all="ignore"):
            out = _square(node, n, home, partner, flat.astype(np.float64).reshape(len(node), -1), limit, block)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "links", "other"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = [*zip(*[batch.column(c).to_pylist() for c in key])]
            starts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(at)]):
                if at[start] != last:
                    if sum(x.num_rows for x in held) > 1:
                        yield found(held)
                    last, held = at[start], []
                held.append(batch.slice(start, end - start))
        if sum(x.num_rows for x in held) > 1:
            yield found(held)

    return stored(dealt.mapInArrow(look, _FOUND), "vector-links")


def near_vectors(vectors: DataFrame, limit: float = 0.93, block: int = BLOCK) -> DataFrame:
    """Links between vectors of the same label: vec_id, n_links, component_id, kept.

    `vectors(vec_id, embedding, label)`. Two vectors link when their labels are equal and not null, their lengths are
    equal and their cosine is at least `limit` in double precision. n_links counts the
    other vectors linked directly, component_id is the smallest vec_id reachable, kept says that
    this is the vector itself. Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing and are kept. Equal vectors are one point with a count until the end; rows that repeat a vec_id
    are vectors of their own; a null vec_id is passed over for component_id while the group has another; an empty table
    gives an empty table; further columns are left out.

    Squares are looked at in rounds, each a job of its own whose shuffle files go as it ends: a round holds two copies of a point
    at most, however many squares a point has to go to. Vectors are shuffled in rounds and to find equal ones, and nowhere else.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    nonzero = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    links = fine & nonzero & F.col("label").isNotNull()
    kind = "float" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "double"
    # -0.0 equals 0.0: one form of a point
    point = F.when(links, F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind))))
    rows = rows.select("vec_id", "label", point.alias("embedding"))
    points = rows.filter("embedding is not null").groupBy("label", "embedding").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("low"))
    points = stored(points.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "points")

    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.lit(SIDE * SIDE_DIMS) / F.col("dims"))))
    sizes = points.groupBy("label", "dims").agg(F.count("*").alias("n")).select(
        "label", "dims", F.ceil(F.col("n") / side).cast("long").alias("parts"))
    labels, squares, most = sizes.agg(F.count("*"), F.sum("parts"), F.max("parts")).first()
    big = stored(sizes.filter("parts > 1"), "vector-parts") if (most or 0) > 1 else None
    tasks = min(_TASKS, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * (squares or 0)))
    found = None
    for apart in range((most or 1) // 2 + 1):
        round_found = _links(_placed(points, big, apart), tasks, limit, block)
        found = round_found if found is None else found.unionByName(round_found)

    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    groups = components(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), edges, [])
    known = points.select("node", "n", "low").join(counts, "node", "left").join(groups.select(F.col("v").alias("node"), "label").withColumnRenamed(
        "label", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    lowest = known.groupBy("group").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "group").select("node", "n", "low", "component_id", (
        F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # a point of one vector is that vector; the vectors of the others are found by their hashes, then by themselves
    single = known.filter("n = 1").select(F.col("low").alias("vec_id"), "component_id", "n_links")
    several = points.filter("n > 1").select("label", "embedding", "node")
    equal = maybe_among(rows.filter("embedding is not null"), F.xxhash64("label", "embedding"), several, F.xxhash64("label", "embedding"))
    repeated = equal.join(several, ["label", "embedding"]).select("vec_id", "node").join(known, "node").select(
        "vec_id", "component_id", "n_links")
    alone = rows.filter("embedding is null").select("vec_id", F.lit(None).cast(rows.schema["vec_id"].dataType).alias("component_id"),
                                                    F.lit(0).cast("long").alias("n_links"))
    out = single.unionByName(repeated).unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
