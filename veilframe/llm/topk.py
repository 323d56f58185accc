"""Exact top-k inner products by ball trees with branch and bound.

Vectors become integers, floor(scale * x) in double arithmetic. Rows are dealt to shards
by a hash of their id; each task builds a ball tree over one shard at a time and answers
blocks of queries: a node can hold no score above q.c + |q| r, nodes are visited in
order of that bound, and a branch is dropped when its bound is below the current k-th
score. The k-th score is shared in two passes: every query first searches one home shard,
then takes the k-th score found there into all other shards.

A shard holds at most about ``shard_rows`` vectors and queries arrive in blocks, so memory
does not grow with the table. Queries are copied to every shard, vectors never.

Scores are exact: bounds carry a margin for rounding, and inner products are computed in
integers where doubles would not be exact. Equal scores go to the smaller id.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part; shorter vectors count as zero beyond their end; a query gets all candidates when
there are fewer than k; rows without an id take no part; rows repeating an id are
candidates each, but never for a query of their own id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

K = 10
SCALE = 1024
SHARD_ROWS = 16_384
LEAF = 128
QUERY_BLOCK = 256
_EXACT = 2.0**53


def quantised(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: str) -> Column:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad)


class BallTree:
    """Nodes in breadth order over rows sorted into leaves; ``first`` child is -1 for a leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        points = rows.astype(np.float64)
        spans, self.first = [(0, len(ids))], []
        centres, radii = [], []
        k = 0
        while k < len(spans):
            low, high = spans[k]
            inside = points[order[low:high]]
            centre = inside.mean(axis=0)
            far = np.sqrt(((inside - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(far.max(initial=0.0))
            if high - low > leaf and radii[-1] > 0:
                # split at the median along the line between two distant members
                one = inside[far.argmax()]
                two = inside[((inside - one) ** 2).sum(axis=1).argmax()]
                side = np.argpartition(inside @ (two - one), (high - low) // 2)
                order[low:high] = order[low:high][side]
                middle = low + (high - low) // 2
                self.first.append(len(spans))
                spans += [(low, middle), (middle, high)]
            else:
                self.first.append(-1)
            k += 1
        self.spans, self.centres, self.radii = spans, np.array(centres), np.array(radii)
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.largest = np.abs(rows).max(initial=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(place of the query, id, score) of each query's k best rows with a score of at least its floor."""
        n = len(query_ids)
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(axis=1))
        exact = float(self.largest) * float(np.abs(queries).max(initial=0)) * queries.shape[1] < _EXACT
        margin = 1e-9 * (norms * (np.abs(self.centres).max(initial=0) * np.sqrt(queries.shape[1]) + self.radii.max(initial=0)) + 1)
        upper = q @ self.centres.T + norms[:, None] * self.radii + margin[:, None]
        best_scores = [np.zeros(0, np.int64) for _ in range(n)]
        best_ids = [np.zeros(0, np.int64) for _ in range(n)]
        kth = floors.astype(np.float64)  # floors may be -inf
        # open branches of each query, the most promising last; a round visits one node of every open query
        waiting: list[list[tuple[float, int]]] = [[(upper[j, 0], 0)] for j in range(n)]
        active = list(range(n))
        while active:
            visits: dict[int, list[int]] = {}
            still = []
            for j in active:
                branches = waiting[j]
                while branches:
                    bound, node = branches.pop()
                    if bound < kth[j]:
                        branches.clear()  # the rest is no better
                        break
                    child = self.first[node]
                    if child < 0:
                        visits.setdefault(node, []).append(j)
                        still.append(j)
                        break
                    branches += [(upper[j, child], child), (upper[j, child + 1], child + 1)]
                    branches.sort()
            for node, those in visits.items():
                low, high = self.spans[node]
                if exact:
                    scores = np.rint(q[those] @ self.points[low:high].T).astype(np.int64)
                else:
                    scores = queries[those] @ self.rows[low:high].T
                for j, found in zip(those, scores):
                    take = np.flatnonzero((found >= kth[j]) & (self.ids[low:high] != query_ids[j]))
                    if not len(take):
                        continue
                    all_scores = np.concatenate([best_scores[j], found[take]])
                    all_ids = np.concatenate([best_ids[j], self.ids[low:high][take]])
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best_scores[j], best_ids[j] = all_scores[order], all_ids[order]
                    if len(order) == k:
                        kth[j] = max(kth[j], float(best_scores[j][-1]))
            active = still
        for j in range(n):
            for one, score in zip(best_ids[j].tolist(), best_scores[j].tolist()):
                yield j, one, score


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    rows = np.zeros((len(lists), width), np.int64)
    for k, values in enumerate(lists):
        rows[k, : len(values)] = values
    return rows


def _search_shards(vectors: DataFrame, queries: DataFrame, shards: int, k: int, leaf: int, block: int) -> DataFrame:
    """Each query's k best in the shards it is sent to.

    ``vectors``: shard, id, v. ``queries``: shard, id, v, floor (null: none). In each
    shard the vectors come first, then the queries.
    """
    rows = vectors.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("bigint").alias("floor"))
    asked = queries.select("shard", F.lit(1).alias("kind"), "id", "v", "floor")
    together = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        ids: list[int] = []
        held: list[list[int]] = []
        asked: list[tuple[int, list[int], int | None]] = []

        def answer():
            nonlocal tree
            if tree is None and held:
                tree = BallTree(np.array(ids, np.int64), _matrix(held, max(map(len, held))), leaf)
            found = []
            if tree is not None and asked:
                width = max(tree.rows.shape[1], max(len(v) for _, v, _ in asked))
                if tree.rows.shape[1] < width:
                    tree = BallTree(tree.ids, np.pad(tree.rows, ((0, 0), (0, width - tree.rows.shape[1]))), leaf)
                names = np.array([a[0] for a in asked], np.int64)
                floors = np.array([-np.inf if a[2] is None else a[2] for a in asked], np.float64)
                for j, one, score in tree.search(names, _matrix([a[1] for a in asked], width), floors, k):
                    found.append((int(names[j]), one, score))
            asked.clear()
            columns = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), columns)), schema=schema)

        for batch in batches:
            for one, kind, name, vector, floor in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if one != shard:
                    if asked:
                        yield answer()
                    shard, tree = one, None
                    ids.clear()
                    held.clear()
                if kind == 0:
                    ids.append(name)
                    held.append(vector)
                else:
                    asked.append((name, vector, floor))
                    if len(asked) >= block:
                        yield answer()
        if asked:
            yield answer()

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return together.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    leaf: int = LEAF,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and integer ``score`` of each query's k best vectors, its own id apart.

    Of several queries with one id the one with the least vector, component by component, is asked.
    """

    def ready(df: DataFrame) -> DataFrame:
        kept = df.where(F.col(key).isNotNull() & usable(vector))
        return kept.select(F.col(key).cast("bigint").alias("id"), quantised(vector, scale).alias("v"))

    rows = materialize(ready(vectors))
    shards = max(1, -(-rows.count() // shard_rows))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", home)
    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("shard", home)
    near = materialize(_search_shards(rows, asked.withColumn("floor", F.lit(None).cast("bigint")), shards, k, leaf, block))
    if shards == 1:
        return _ranked(near, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    floors = near.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.where(F.col("n") == k).select("id", "floor")
    elsewhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rest = asked.withColumnRenamed("shard", "home").join(floors, "id", "left")
    rest = rest.select("id", "v", "floor", "home", elsewhere.alias("shard")).where(F.col("shard") != F.col("home"))
    found = near.unionByName(_search_shards(rows, rest, shards, k, leaf, block))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


OP2_SQL = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""


@query("op2_top_k_inner_product", OP2_SQL)
def op2_top_k_inner_product(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
