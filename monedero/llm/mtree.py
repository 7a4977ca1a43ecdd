"""Exact top-k search by inner product with M-trees.

Candidates stay where Spark reads them: every task cuts its rows into chunks, bulk-
loads an M-tree over each (pages of metric nodes with a routing object, covering
radius and distance to the parent's routing object) and searches it best-first for
all queries of a block, carrying each query's bound from tree to tree. One extra
coordinate turns inner products into distances, so the triangle inequality of the
stored distances rules out nodes and entries without computing them. Tasks return
k rows per query; these are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monedero.llm.common import batch, tune

#: Rows of a page. Smaller ones avoid more scores, at more steps a score than they save.
PAGE = 256
FANOUT = 16
#: Vectors of one tree.
TREE_ROWS = 8192
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 16_384
_LONG = 1 << 63
#: Scores no long holds are ordered by their bytes above this base.
_BASE, _BYTES = 1 << 2303, 288


def quantised(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of every component, whole doubles; null where the vector takes no part.

    That holds for null and empty vectors and for null or non-finite components. A
    component whose product no double holds (10^305 and more) is an error.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * factor)
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    too_large = F.exists(scaled, lambda x: F.abs(x) == float("inf"))
    error = F.raise_error(F.lit("a component exceeds the largest double after scaling"))
    whole = F.transform(scaled, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))
    return F.when((F.size(vector) > 0) & fine, F.when(too_large, error).otherwise(whole))


class Tree:
    """A bulk-loaded M-tree; `ids` and `vectors` are reordered so that leaves are slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exact: np.ndarray, power: int):
        """`vectors` are `exact` divided by 2^power, which keeps squares in range."""
        self.square = 1 << 2 * power
        norms = (vectors * vectors).sum(axis=1)
        self.reach = float(norms.max())
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.reach - norms, 0.0))[:, None]])
        self.order: list[np.ndarray] = []
        self.done = 0
        everything = np.arange(len(ids))
        self.root = self._node(everything, 0)
        order = np.concatenate(self.order)
        self.ids, self.vectors, self.points = ids[order], exact[order], None

    def _from(self, router: int, members: np.ndarray) -> np.ndarray:
        delta = self.points[members] - self.points[router]
        return np.sqrt((delta * delta).sum(axis=1))

    def _node(self, members: np.ndarray, router: int) -> tuple:
        """A leaf ('leaf', first, last, distances) or ('node', routers, radii, distances, children)."""
        away = self._from(router, members)
        if len(members) <= PAGE or away.max() == 0:
            first, self.done = self.done, self.done + len(members)
            self.order.append(members)
            return ("leaf", first, self.done, away)
        routers = [members[int(away.argmax())]]
        nearest = self._from(routers[0], members)
        owner = np.zeros(len(members), int)
        while len(routers) < FANOUT and nearest.max() > 0:
            routers.append(members[int(nearest.argmax())])
            own = self._from(routers[-1], members)
            closer = own < nearest
            owner[closer], nearest[closer] = len(routers) - 1, own[closer]
        groups = [np.flatnonzero(owner == i) for i in range(len(routers))]
        own = np.array(routers)
        return (
            "node",
            self.points[own],
            np.array([nearest[g].max() for g in groups]),
            self._from(router, own),
            [self._node(members[g], r) for g, r in zip(groups, routers, strict=True)],
        )

    def search(self, query_id: int, q: np.ndarray, scaled: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Improve `best`, a heap of (score, -id) of at most k entries.

        Distances, of the `scaled` query, are floats and only rule out; the bound leaves
        room for their rounding. Scores are exact.
        """
        length = float(scaled @ scaled)
        ahead = length + self.reach
        point = np.append(scaled, 0.0)
        slack = 8.0 * np.sqrt(ahead * (len(q) + 16) * 2.0**-52)

        def bound() -> float:
            if len(best) < k:
                return np.inf
            return np.sqrt(max(0.0, ahead - 2.0 * (best[0][0] / self.square))) + slack

        queue, tie, far = [(0.0, 0, self.root, None)], 1, bound()
        while queue:
            least, _, node, away = heapq.heappop(queue)
            if least > far:
                return
            if node[0] == "leaf":
                _, first, last, stored = node
                at = slice(first, last)
                if away is not None and far < np.inf:
                    near = np.flatnonzero(np.abs(stored - away) <= far)
                    if not len(near):
                        continue
                    at = near + first if len(near) < last - first else at
                scores = self.vectors[at] @ q
                ids = self.ids[at]
                if len(best) == k:
                    good = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[good], ids[good]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i != query_id:
                        entry = (int(s), -i)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                far = bound()
                continue
            _, routers, radii, stored, children = node
            some = range(len(children))
            if away is not None and far < np.inf:
                some = np.flatnonzero(np.abs(stored - away) - radii <= far)
                if not len(some):
                    continue
                routers, radii = routers[some], radii[some]
            delta = routers - point
            dist = np.sqrt((delta * delta).sum(axis=1))
            for i, d, r in zip(some, dist.tolist(), radii.tolist(), strict=True):
                if d - r <= far:
                    heapq.heappush(queue, (max(0.0, d - r), tie, children[i], d))
                    tie += 1


_FOUND = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("side", pa.int32()), ("score", pa.int64()), ("beyond", pa.binary())]
)


def _found(query_id: int, vec_id: int, score: int) -> tuple:
    """A result row: scores no long holds go by the side they leave it on, and by their bytes."""
    if -_LONG <= score < _LONG:
        return query_id, vec_id, 0, score, None
    return query_id, vec_id, 1 if score > 0 else -1, None, (score + _BASE).to_bytes(_BYTES, "big")


def _numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _exact(m: np.ndarray) -> np.ndarray:
    """Floats where all inner products are exact in them, else Python integers."""
    top = int(np.abs(m).max(initial=0))
    if top * top * m.shape[1] < 1 << 52:
        return m.astype(float)
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


def _power(m: np.ndarray) -> int:
    """The power of two that brings all components to at most 1."""
    top = float(np.abs(m).max(initial=0))
    return int(np.ceil(np.log2(top))) if top > 1 else 0


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of every query.

    Both frames hold (vec_id long, vector array<double> of whole numbers of any size); all
    scores are exact. Rows with the query's own id are no candidates; equal scores go to
    the smaller id. Only vectors of the query's length compare. Rows with a null id or
    vector take no part; of repeated query ids the smallest vector is asked. A score no
    long holds is ranked by its value and returned as null. Empty tables give no rows.
    """
    spark = tune(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and vector is not null")
    asked = queries.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for no in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)) == no)
        parts.append(rows.mapInArrow(_task(spark, block, k), "query_id long, vec_id long, side int, score long, beyond binary"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(spark, block: DataFrame, k: int):
    got = block.toArrow()
    asked = []
    if got.num_rows:
        ids = got.column("vec_id").to_numpy()
        for d, at, m in _numbers(got.column("vector").combine_chunks()):
            asked.append((d, ids[at], m))
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [[] for _ in ids] for d, ids, _ in shared.value}
        waiting: dict[int, list] = {}

        def plant(d: int) -> None:
            ids, m = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            if d not in best:
                return
            _, query_ids, queries = next(x for x in shared.value if x[0] == d)
            both = np.vstack([m, queries])
            power, exact = _power(both), _exact(both)
            scaled = np.ldexp(both, -power)
            tree = Tree(ids, scaled[: len(m)], exact[: len(m)], power)
            for query_id, q, near, own in zip(query_ids.tolist(), exact[len(m) :], scaled[len(m) :], best[d], strict=True):
                tree.search(query_id, q, near, own, k)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for d, at, m in _numbers(b.column(1)):
                waiting.setdefault(d, []).append((ids[at], m))
                if sum(len(x[0]) for x in waiting[d]) >= TREE_ROWS:
                    plant(d)
        for d in list(waiting):
            plant(d)
        for d, query_ids, _ in shared.value:
            out = [_found(q, -i, s) for q, own in zip(query_ids.tolist(), best[d], strict=True) for s, i in own]
            if out:
                yield batch(_FOUND, *map(list, zip(*out, strict=True)))

    return run


def oracle_sql(k: int = 5) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
