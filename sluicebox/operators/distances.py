"""Nearest neighbours between numeric vectors: distances to the closest record, and k nearest rows.

All are exact. `nearest` is blocked: one side is a stated query set that travels in blocks of bounded size, the other is
read where it lies. Products of matrices tell which pairs may be among the best k, to within their rounding; only those
are computed. A task keeps the best k of each query, so no product of the two sides is ever kept. `closest` needs the
least distance only and looks at pairs in equal cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import sluicebox
from sluicebox.operators.order import beside, quantiles
from sluicebox.session import stage

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sluicebox)

#: Numbers in a block of queries, of at least so many numbers each, and distances that are computed at once: 8 MB each.
BLOCK_NUMBERS, LEAST_WIDTH, WORK = 1 << 20, 64, 1 << 20
#: Queries that give a first bound of the least distance, directions of the cells, and pairs that cells may give for each row.
FIRST, DIRECTIONS, PAIRS = 4096, 4, 16
#: Values beyond which squares might overflow.
LARGE = 1e140


def vector(*columns: str) -> Column:
    """Numeric columns as a vector; what is missing or not a number is 0."""
    return F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rounding(width: int) -> float:
    """A bound of the relative error of sums of so many products, with room to spare."""
    return 4 * (width + 8) * float(np.finfo(np.float64).eps)


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by the last key, then the one before it and so on; and each place's number among equals in the last."""
    order = np.lexsort(keys)
    group = keys[-1][order]
    place = np.arange(len(order))
    begins = np.ones(len(order), bool)
    begins[1:] = group[1:] != group[:-1]
    return order, place - np.maximum.accumulate(np.where(begins, place, 0))


def _few_copies(names: np.ndarray, points: np.ndarray, k: int, others: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of equal points those with the smallest ids: as many as k queries' results can hold."""
    if not points.shape[1] or len(points) <= k:
        return names, points
    rows = np.ascontiguousarray(points).view(np.dtype((np.void, points.shape[1] * 8))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    if others:  # a query leaves out the rows of its own id
        k += int(np.unique(names, return_counts=True)[1].max())
    order, rank = _ranks(names, same.ravel())
    kept = np.sort(order[rank < k])
    return names[kept], points[kept]


def _nearest(ids: np.ndarray, queries: np.ndarray, k: int, others: bool):
    whole = np.isfinite(queries).all(axis=1)  # any other has no finite distance
    ids, queries = ids[whole], queries[whole]
    n, width = queries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        usual = n > 0 and (not width or np.abs(queries).max() < LARGE)
        centre = queries.mean(axis=0) if usual else np.zeros(width)
        centred = queries - centre
        norms = np.einsum("ij,ij->i", centred, centred) if usual else np.zeros(n)
        side, most = max(1, math.isqrt(WORK)), max(1, WORK // max(1, width))

        def compare(at: int, names: np.ndarray, points: np.ndarray) -> None:
            """The queries from `at` with some points."""
            mine = slice(at, at + side)
            worst, own = best[mine, -1], ids[mine]
            pairs = None
            if usual and (not width or np.abs(points).max() < LARGE):
                moved = points - centre
                lengths = np.einsum("ij,ij->i", moved, moved)
                near = centred[mine] @ (-2 * moved.T)
                near += lengths
                near += norms[mine, None]
                error = _rounding(width) * (np.sqrt(norms[mine]) + np.sqrt(lengths.max())) ** 2 + 1e-290
                if others:
                    order = np.argsort(names, kind="stable")
                    low, high = (np.searchsorted(names[order], own, s) for s in ("left", "right"))
                    for i in np.nonzero(high > low)[0]:
                        near[i, order[low[i] : high[i]]] = np.inf
                limit = worst + error
                if len(points) >= k and np.isinf(worst).any():
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error)
                pairs = np.nonzero(near <= limit[:, None])
            else:
                pairs = tuple(x.ravel() for x in np.indices((len(own), len(points))))
            for a in range(0, len(pairs[0]), most):
                q, p = pairs[0][a : a + most], pairs[1][a : a + most]
                # The sum goes by dimension: every way to compute a distance gives the same number.
                d = np.cumsum((queries[mine][q] - points[p]) ** 2, axis=1)[:, -1] if width else np.zeros(len(q))
                good = np.isfinite(d) & (d <= best[mine][q, -1])
                if others:
                    good &= own[q] != names[p]
                if not good.any():
                    continue
                q, d, name = q[good] + at, d[good], names[p[good]]
                touched, place = np.unique(q, return_inverse=True)
                place = np.concatenate([np.repeat(np.arange(len(touched)), k), place.ravel()])
                all_d, all_n = np.concatenate([best[touched].ravel(), d]), np.concatenate([who[touched].ravel(), name])
                order, rank = _ranks(all_n, all_d, place)
                kept = order[rank < k]
                best[touched], who[touched] = all_d[kept].reshape(-1, k), all_n[kept].reshape(-1, k)

        for batch in batches:
            if not batch.num_rows or not n:
                continue
            names, points = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)) + 0.0  # no negative zero
            whole = np.isfinite(points).all(axis=1)
            names, points = _few_copies(names[whole], points[whole], k, others)
            for a in range(0, len(points), side):
                for at in range(0, n, side):
                    compare(at, names[a : a + side], points[a : a + side])
        q, _ = found = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(who[found]), pa.array(best[found])], names=["query_id", "id", "squared"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 1, exclude_same_id: bool = False) -> DataFrame:
    """(query_id, id, rank, distance): the k closest rows of each query; of equal distances the smaller id.

    Both sides are (id long, vector array<double>). The queries are fetched block by block.
    """
    from pyspark.sql import Window as W

    # The work grows with both sides: it is dealt over all cores, however few files hold the rows.
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")
    out, block, width = None, [], 1
    for r in queries.select("id", "vector").toLocalIterator():
        block.append(r)
        width = max(1, len(r["vector"]))
        if len(block) * max(width, LEAST_WIDTH) >= BLOCK_NUMBERS:
            part = _search(block, rows, k, exclude_same_id)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = _search(block, rows, k, exclude_same_id)
        out = part if out is None else out.unionByName(part)
    order = W.partitionBy("query_id").orderBy("squared", "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "rank", F.sqrt("squared").alias("distance"))


def _search(block: list, rows: DataFrame, k: int, others: bool) -> DataFrame:
    schema = "query_id long, id long, squared double"
    if not block:
        return rows.sparkSession.createDataFrame([], schema)
    ids = np.array([r["id"] for r in block], np.int64)
    points = np.array([r["vector"] for r in block], np.float64).reshape(len(block), -1)
    return rows.mapInArrow(_nearest(ids, points, k, others), schema)


def _cells(directions: np.ndarray, size: float, reach: float):
    """Rows by the cells, of some size along the directions, that lie within reach of them: two or fewer along each."""
    factors = np.random.default_rng(1).integers(0, 1 << 63, len(directions), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            along = _matrix(batch.column(2)) @ directions.T
            low, high = (np.floor((along + x) / size).astype(np.int64) for x in (-reach, reach))
            for corner in np.ndindex(*[2] * len(directions)):
                up = np.array(corner, bool)
                at = np.nonzero((high > low)[:, up].all(axis=1))[0]
                if len(at):
                    # Cells that share a number only add pairs.
                    cell = (np.where(up, high[at], low[at]).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(at)) for c in batch.columns]], names=["cell", "id", "n", "vector"])

    return run


def closest(queries: DataFrame, rows: DataFrame, within: float) -> DataFrame:
    """One row (least, near): the least distance of a query to a row, and how many queries have a row within a distance.

    Both sides have a `vector`. The nearest rows of the first queries bound the least distance. Whatever is not farther
    apart than that lies in equal or neighbouring cells along a few directions, so only pairs in these are compared; the
    result is exact. Where cells hold too many pairs to be of use, all queries are searched in blocks.
    """
    def distinct(df: DataFrame, label: str) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        counted = df.select(v.alias("vector")).where(whole).groupBy("vector").agg(F.count("*").alias("n"))
        return stage(counted.select(F.monotonically_increasing_id().alias("id"), "n", "vector"), label)

    q, r = distinct(queries, "queries"), distinct(rows, "rows")
    bound = nearest(q.limit(FIRST), r).agg(F.min("distance")).first()[0]
    found = None
    if bound is not None:
        sides = [x.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first() for x in (q, r)]
        width, largest = sides[0][1], max(abs(float(x)) for s in sides for x in s[2:] if x is not None) if sides[0][1] else 0.0
        if width and largest < LARGE:
            # Along a unit vector two points are never farther apart than in space, but for rounding.
            error = _rounding(width) * largest * math.sqrt(width)
            reach = max(bound, within) * (1 + 1e-9) + error + 1e-140
            directions = np.eye(width) if width <= DIRECTIONS else np.random.default_rng(0).normal(size=(DIRECTIONS, width))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            schema = "cell long, id long, n long, vector array<double>"
            a, b = (x.mapInArrow(_cells(directions, 8 * reach, y), schema) for x, y in ((q, reach), (r, 0.0)))
            sizes = [x.groupBy("cell").agg(F.count("*").cast("double").alias(name)) for x, name in ((a, "a"), (b, "b"))]
            pairs = F.col("a") * F.col("b")
            total, most = sizes[0].join(sizes[1], "cell").agg(F.coalesce(F.sum(pairs), F.lit(0.0)), F.coalesce(F.max(pairs), F.lit(0.0))).first()
            if total <= PAIRS * (sides[0][0] + sides[1][0]) and most <= WORK:
                both = a.join(b.select("cell", F.col("vector").alias("other")), "cell")
                found = both.select("id", "n", distance(F.col("vector"), F.col("other")).alias("distance")).groupBy("id", "n").agg(F.min("distance").alias("distance"))
    if found is None:
        found = nearest(q, r).join(q.select(F.col("id").alias("query_id"), "n"), "query_id")
    d = F.col("distance")
    return found.agg(F.min(d).alias("least"), F.coalesce(F.sum(F.when(d <= within, F.col("n"))), F.lit(0)).alias("near"))


def closest_record_stats(synthetic: DataFrame, real: DataFrame, collision: float = 1e-9) -> DataFrame:
    """Least, mean and median distance of synthetic rows to their closest real row, and how many collide."""
    d = nearest(synthetic, real).select("distance")
    one = d.agg(
        F.count("*").alias("synthetic_count"), F.min("distance").alias("min_distance"), F.avg("distance").alias("mean_distance"),
        F.count_if(F.col("distance") <= collision).alias("collisions"),
    )
    median = quantiles(d, ["distance"], [0.5]).select(F.col("q")[0].alias("median_distance"))
    return beside(one, median).select(
        "synthetic_count", "min_distance", "mean_distance", "median_distance", "collisions"
    )
