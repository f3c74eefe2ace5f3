"""Nearest neighbours by inner product through low-dimensional stable projections.

Vectors go to ``dims`` Gaussian projections. For points at distance s, the
squared projected distance over s squared is chi-square with ``dims`` degrees of
freedom. So, going through a kd-tree of projections outwards from a query, the
search may stop once what is left lies so far out in the projection that a point
nearer than the k-th found would lie there only with a probability of at most
``1 - confidence``. Every point met before is verified on its original vector.

Inner product becomes distance by one more coordinate: sqrt(m^2 - |x|^2), with m
the largest norm; a query has 0 there.

The upper kd-tree is built on the driver from a bounded sample of projections
and deals all points to cells, each cell a shard. A query first searches its own
cell; its k-th distance there then decides, by the same test on the cells'
boxes, which others it still has to visit. Equal vectors are kept once in a
shard, with their k + 1 smallest ids, which is all that any query can return.

Defined results: vectors that are null, zero, of another length than the first
usual one (the commonest), or with null or non-finite components take no part;
a null id takes no part; with fewer candidates than k all are returned; ties go
to the smaller id. Equal ids are distinct candidates only if their vectors
differ; wholly repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideq.llm.common import checkpointed

#: Projections that the driver takes to lay out the cells.
SAMPLE = 20_000
#: Distinct vectors that a cell should get.
CELL = 8_192
#: Points of a leaf of the kd-tree within a cell, verified in one product.
LEAF = 1_024


def chi_square(x: float, dims: int) -> float:
    """Share of the chi-square distribution below ``x``, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    if dims == 1:
        return erf(sqrt(x / 2))
    a, half = dims / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * exp(-half + a * log(half) - lgamma(a)))


def chi_square_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 20.0 * dims + 200
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < share else (low, middle)
    return high


def kd_boxes(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of each leaf of a kd-tree that splits the widest dimension at its median."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        which = todo.pop()
        if len(which) > leaf:
            part = points[which]
            axis = int(np.argmax(np.ptp(part, axis=0)))
            cut = np.sort(part[:, axis])[(len(part) - 1) // 2]
            low = part[:, axis] <= cut
            if not low.all():
                todo += [which[low], which[~low]]
                continue
        done.append(which)
    return done


class Cells:
    """Upper kd-tree: cuts of space into boxes that together cover all of it."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        dims = sample.shape[1]
        self.tree = self._cut(sample, cells, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _cut(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> tuple | int:
        if cells > 1 and len(points) > 1:
            axis = int(np.argmax(np.ptp(points, axis=0)))
            cut = float(np.sort(points[:, axis])[(len(points) - 1) // 2])
            inside = points[:, axis] <= cut
            if not inside.all():
                left_high, right_low = high.copy(), low.copy()
                left_high[axis] = right_low[axis] = cut
                return (axis, cut, self._cut(points[inside], cells // 2, low, left_high), self._cut(points[~inside], cells - cells // 2, right_low, high))
        self.low.append(low)
        self.high.append(high)
        return len(self.low) - 1

    def home(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), dtype=np.int64), [(self.tree, np.arange(len(points)))]
        while todo:
            node, which = todo.pop()
            if isinstance(node, int):
                out[which] = node
                continue
            axis, cut, left, right = node
            inside = points[which, axis] <= cut
            todo += [(left, which[inside]), (right, which[~inside])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of ``point`` to each cell's box."""
        off = np.maximum(0, np.maximum(self.lows - point, point - self.highs))
        return (off * off).sum(axis=1)


def _project(batch: pd.Series, matrix: np.ndarray, largest: float, as_query: bool) -> np.ndarray:
    x = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), matrix.shape[0] - 1)
    more = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, largest**2 - (x * x).sum(axis=1)))
    return np.column_stack([x, more]) @ matrix


def _search(shard: pd.DataFrame, k: int, dims: int, bound: float, largest: float) -> pd.DataFrame:
    """Best ``k`` candidates of each query in a shard of points and queries."""
    is_query = shard["is_query"].to_numpy(dtype=bool)
    points, queries = shard[~is_query], shard[is_query].sort_values("id", kind="stable")
    out: list[pd.DataFrame] = []
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(points) or not len(queries):
        return empty
    vectors = np.array(points["vector"].tolist(), dtype=np.float64)
    low_dim = np.array(points["projected"].tolist(), dtype=np.float64)
    ids = [np.asarray(x, dtype=np.int64) for x in points["ids"]]
    leaves = kd_boxes(low_dim, LEAF)
    lows, highs = (np.array([f(low_dim[w], axis=0) for w in leaves]) for f in (np.min, np.max))
    for query_id, vector, start, reach in zip(queries["id"], queries["vector"], queries["projected"], queries["reach"]):
        q, at = np.asarray(vector, dtype=np.float64), np.asarray(start, dtype=np.float64)
        off = np.maximum(0, np.maximum(lows - at, at - highs))
        gaps = (off * off).sum(axis=1)
        base = float(q @ q) + largest**2
        kth = float(reach)
        floor = (base - kth) / 2 - 1e-9 * base  # what the home cell found is no worse, but for rounding
        found_ids, found_scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > bound * kth:
                break
            which = leaves[leaf]
            scores = vectors[which] @ q
            keep = scores >= (found_scores[-1] if len(found_scores) == k else floor)
            which, scores = which[keep], scores[keep]
            if len(which) > k + 1:  # one point may hold no id but the query's; ties stay
                keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                which, scores = which[keep], scores[keep]
            if not len(which):
                continue
            some = [ids[i][ids[i] != query_id][:k] for i in which]
            found_ids = np.concatenate([found_ids, *some])
            found_scores = np.concatenate([found_scores, np.repeat(scores, [len(x) for x in some])])
            order = np.lexsort((found_ids, -found_scores))[:k]
            found_ids, found_scores = found_ids[order], found_scores[order]
            if len(found_scores) == k:
                kth = min(kth, max(0.0, base - 2 * found_scores[-1]))
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": found_ids, "score": found_scores}))
    return pd.concat([empty, *out]) if out else empty


def nearest(
    rows: DataFrame, query_ids: DataFrame | None = None, every: int = 20, k: int = 20, dims: int = 8, confidence: float = 0.95,
    id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products found for each query.

    Queries are the rows whose id is in ``query_ids`` (one column of the id's
    name), or else is divisible by ``every``.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    usable = usable.where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    shape = (
        usable.groupBy(F.size("vector").alias("n"))
        .agg(F.count("*").alias("rows"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
        .orderBy(F.desc("rows"), "n")
        .first()
    )
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    width, largest = shape["n"], sqrt(shape["norm"]) * (1 + 1e-12)
    usable = usable.where(F.size("vector") == width)
    matrix = np.random.default_rng(seed).standard_normal((width + 1, dims))
    bound = chi_square_quantile(confidence, dims)

    def project(as_query: bool):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(projected=list(_project(batch["vector"], matrix, largest, as_query)))

        return run

    # of equal vectors the k + 1 smallest ids; the rank is limited before the shuffle too
    first = Window.partitionBy("vector").orderBy("id")
    kept = usable.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = kept.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = checkpointed(distinct.mapInPandas(project(False), "vector array<double>, ids array<long>, projected array<double>"))
    count = points.count()
    sample = points.select("projected").orderBy(F.xxhash64("ids")).limit(SAMPLE).toPandas()["projected"]
    cells = Cells(np.array(sample.tolist(), dtype=np.float64), max(1, min(-(-count // CELL), len(sample) // 8)))
    shared = spark.sparkContext.broadcast(cells)

    asked = usable.join(query_ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi") if query_ids is not None else usable.where(F.col("id") % every == 0)
    asked = checkpointed(asked.mapInPandas(project(True), "id long, vector array<double>, projected array<double>"))

    @F.pandas_udf("long")
    def home(projected: pd.Series) -> pd.Series:
        return pd.Series(shared.value.home(np.array(projected.tolist(), dtype=np.float64)))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = shared.value.home(np.array(batch["projected"].tolist(), dtype=np.float64)) if len(batch) else []
            for i, (own, start, reach) in enumerate(zip(at, batch["projected"], batch["reach"])):
                go = np.flatnonzero(shared.value.gaps(np.asarray(start)) <= bound * reach)
                go = go[go != own]
                if len(go):
                    yield pd.DataFrame({"cell": go, **{c: [batch[c].iloc[i]] * len(go) for c in ("id", "vector", "projected", "reach")}})

    none = F.lit(None).cast("array<long>")
    indexed = points.select(home("projected").alias("cell"), F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("id"), "vector", "projected", "ids", F.lit(0.0).alias("reach"))

    def search(queries: DataFrame) -> DataFrame:
        both = indexed.unionByName(queries.select("cell", F.lit(True).alias("is_query"), "id", "vector", "projected", none.alias("ids"), "reach"))
        return both.groupBy("cell").applyInPandas(lambda shard: _search(shard, k, dims, bound, largest), "query_id long, vec_id long, score double")

    near = checkpointed(search(asked.select(home("projected").alias("cell"), "id", "vector", "projected", F.lit(float("inf")).alias("reach"))))
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    reach = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), norm + largest**2 - 2 * F.col("least"))).otherwise(F.lit(float("inf")))
    ready = asked.join(kth, asked["id"] == kth["query_id"], "left").select("id", "vector", "projected", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
    far = search(ready.mapInPandas(others, "cell long, id long, vector array<double>, projected array<double>, reach double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(far)
        .distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
