"""Exact top-k by inner product: a KD-tree for each shard of vectors, searched best box first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a shard (one tree), of a leaf, and queries of a block.  They bound what a task holds.
SHARD_ROWS = 8_192
LEAF_ROWS = 128
QUERY_BLOCK = 2_048

_TREE = "shard int, dim int, exact boolean, ids binary, vectors binary, low binary, high binary, child binary, span binary"


def _matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def build_tree(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and for each node its tight box, first child (0: leaf) and rows ``[start, stop)``.

    A node is split at the median of its widest side, by count, so equal vectors split too.
    """
    order = np.arange(len(vectors))
    low, high, child, span = [], [], [], []
    todo = [(0, len(vectors))]
    for start, stop in todo:  # grows while it is read: children follow their parents
        own = vectors[order[start:stop]]
        low.append(own.min(0))
        high.append(own.max(0))
        span.append((start, stop))
        if stop - start <= leaf or own.shape[1] == 0:
            child.append(0)
            continue
        side = int(np.argmax(high[-1] - low[-1]))
        half = (stop - start) // 2
        order[start:stop] = order[start:stop][np.argpartition(own[:, side], half)]
        child.append(len(todo))
        todo += [(start, start + half), (start + half, stop)]
    return order, np.array(low), np.array(high), np.array(child), np.array(span)


def search_tree(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, child: np.ndarray, span: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
    """The best ``k`` ``(score, id)`` of one tree that can be among the best of all.

    ``bounds``: for each node the largest product of the query with any point of its box.  ``least`` is a
    ``k``-th score that other trees have reached; a box below it, or below the own ``k``-th score, is closed.
    A box equal to it is opened, as an equal score with a smaller id wins.
    """
    best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        reached = best[0][0] if len(best) == k else None
        floor = max((x for x in (least, reached) if x is not None), default=None)
        if floor is not None and -bound < floor:
            break
        if child[node]:
            for c in (int(child[node]), int(child[node]) + 1):
                heapq.heappush(queue, (-bounds[c], c))
            continue
        start, stop = span[node]
        scores = vectors[start:stop] @ query
        keep = np.flatnonzero(scores >= floor) if floor is not None else np.arange(stop - start)
        for i in keep:
            if ids[start + i] == own:
                continue
            item = (int(scores[i]), -int(ids[start + i]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(score, -i) for score, i in best]


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    dim = max(1, *map(len, rows["v"]))
    vectors = _matrix(list(rows["v"]), dim)
    ids = rows["id"].to_numpy(np.int64)
    order, low, high, child, span = build_tree(vectors)
    # products of numbers below 2**53 in total are exact in float64 and use BLAS
    exact = float(np.abs(vectors).max(initial=0)) < 2.0**20
    return pd.DataFrame([(int(rows["shard"].iloc[0]), dim, exact, ids[order].tobytes(), vectors[order].tobytes(), low.tobytes(), high.tobytes(), child.astype(np.int64).tobytes(), span.astype(np.int64).tobytes())], columns=[x.split()[0] for x in _TREE.split(", ")])


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                dim = row.dim
                unpack = lambda x, kind=np.int64: np.frombuffer(x, kind)
                queries = _matrix([q[:dim] for q in row.q_v], dim)
                parts = [unpack(x).reshape(-1, dim) for x in (row.vectors, row.low, row.high)]
                ids, child, span = unpack(row.ids), unpack(row.child), unpack(row.span).reshape(-1, 2)
                small = row.exact and float(np.abs(queries).max(initial=0)) < 2.0**20 and dim < 4096
                kind = np.float64 if small else object
                vectors, low, high = (x.astype(kind) for x in parts)
                queries = queries.astype(kind)
                up, down = np.maximum(queries, 0), np.minimum(queries, 0)
                bounds = up @ high.T + down @ low.T
                out = []
                for i, own in enumerate(row.q_id):
                    if row.q_done is not None and row.q_done[i] == row.shard:
                        continue
                    least = row.q_least[i] if row.q_least is not None else None
                    least = None if least is None or least != least else int(least)
                    for score, other in search_tree(queries[i], int(own), ids, vectors, bounds[i], child, span, k, least):
                        out.append((int(own), other, score))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", value: str = "embedding", scale: int = 256) -> DataFrame:
    """Best ``k`` rows of ``vectors`` for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Components x become ``floor(scale * x)``; the score is the integer inner product, ties go to the smaller
    id.  A query's own id is no candidate.  Each shard's tree is one row; every query first searches the
    shard its hash names, and the k-th score it reaches there goes with it to the other shards, where whole
    trees are closed by it.  Queries travel in blocks, so pairs of rows exist only inside a task.

    Null vectors, vectors with a null, NaN or infinite component and rows without id take no part.  Shorter
    vectors count as padded with zeros; an empty one scores 0.  Repeated ids: each row is a
    candidate; a repeated query id is answered once, for its smallest vector.  Components beyond 2**63 saturate and
    products beyond it raise an error.  Other columns are ignored.
    """
    usable = F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")

    def whole(df: DataFrame) -> DataFrame:
        slim = df.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v")).where("id is not null").where(usable)
        return slim.withColumn("v", F.expr(f"transform(v, x -> cast(floor(x * {scale}) as bigint))"))

    base = whole(vectors)
    # an upper bound of the rows is enough to choose the number of shards
    n = max(1, -(-vectors.count() // SHARD_ROWS))
    placed = base.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
    trees = stored(placed.groupBy("shard").applyInPandas(_grow, _TREE))
    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).cast("int"))
    asked = asked.withColumn("home", F.pmod(F.hash("id"), F.lit(n)).cast("int"))

    # dealt by number and never broadcast: Spark judges both by compressed bytes, and equal vectors compress to next to nothing
    parts = max(base.sparkSession.sparkContext.defaultParallelism, 2 * n)

    def met(blocks: DataFrame, to: str) -> DataFrame:
        own = trees.repartition(parts, "shard").hint("merge")
        return blocks.repartition(parts, to).join(own, F.col(to) == F.col("shard")).drop(to, "block")

    def packed(df: DataFrame, *by: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("id", "v", "least", "done")))
        p = df.groupBy(*by).agg(rows.alias("q"))
        return p.select(*by, F.col("q.id").alias("q_id"), F.col("q.v").alias("q_v"), F.col("q.least").alias("q_least"), F.col("q.done").alias("q_done"))

    found = "query_id long, vec_id long, score long"
    first = packed(asked.withColumns({"least": F.lit(None).cast("long"), "done": F.lit(-1)}), "home", "block")
    near = stored(met(first, "home").mapInPandas(_search(k), found))
    reached = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    if n > 1:
        rest = asked.join(reached.hint("merge"), F.col("id") == F.col("query_id"), "left").withColumn("done", F.col("home"))
        far = packed(rest, "block").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to"))
        near = near.unionByName(met(far, "to").mapInPandas(_search(k), found))
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))), 1, k).alias("b"))
    best = best.select("query_id", F.posexplode("b").alias("rank", "x"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.m")).alias("score"))
