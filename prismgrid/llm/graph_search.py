"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: Neighbours of a node in the graph.
NEIGHBOURS = 20
#: First neighbours come from this many orders of the vectors by random projections, cut into blocks.
ORDERS, ORDER_BITS, BLOCK_ROWS = 8, 6, 128
#: Members of a meeting from the reverse side; nodes with more reverse neighbours hold several meetings.
MEETING = 64
#: What a member takes from a meeting at most in one round; better ones lead to the others in later rounds.
OFFERS = 8
#: NN-descent ends when a round replaces less than this part of all neighbours, or after so many rounds.
SETTLED, ROUNDS = 0.05, 9
#: Nodes a search keeps open for each query, and how many of them it expands in a round.
BEAM, STEP = 512, 96
#: Queries whose vectors are broadcast; more meet their candidates by a shuffle.
BROADCAST_QUERIES = 20_000

_LINKS = "array<struct<d:float,id:bigint,fresh:boolean>>"
_LINK_TYPE = pa.list_(pa.struct([("d", pa.float32()), ("id", pa.int64()), ("fresh", pa.bool_())]))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of half floats as a float32 matrix."""
    if not len(column):
        return np.zeros((0, dim), np.float32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.float16, (at[-1] - at[0]) // 2, at[0]).reshape(-1, dim).astype(np.float32)


def _links(per_row: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x[0]) for x in per_row])]).astype(np.int32)
    d, ids, fresh = ([np.zeros(0, t), *(x[i] for x in per_row)] for i, t in enumerate((np.float32, np.int64, bool)))
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(d), pa.float32()), pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(fresh), pa.bool_())], ["d", "id", "fresh"])
    return pa.ListArray.from_arrays(pa.array(at), items)


def nearest_first(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest different ids, nearest first; equal distances by id."""
    order = np.lexsort((ids, d))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def _packed(rows: DataFrame, dim: int, scale: float) -> DataFrame:
    """``id, query, v16, keys``: scaled half floats, and the place of each vector in ``ORDERS`` orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(17).standard_normal((dim, ORDERS * (ORDER_BITS + 1)))
        for batch in batches:
            n, v = batch.num_rows, batch.column("v")
            each = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((n, dim))
            at = np.cumsum(each) - each
            flat = v.flatten().to_numpy()
            x[np.repeat(np.arange(n), each), np.arange(len(flat)) - np.repeat(at, each)] = flat
            half = (x / scale).astype(np.float16)
            side = (half.astype(np.float64) @ planes).reshape(n, ORDERS, ORDER_BITS + 1)
            code = ((side[:, :, :ORDER_BITS] > 0) << np.arange(ORDER_BITS)).sum(2)
            keys = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n)), pa.array(code.ravel().astype(np.int32)), pa.array(side[:, :, ORDER_BITS].ravel())], ["order", "code", "fine"])
            keys = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * ORDERS).astype(np.int32)), keys)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("query"), pa.array([r.tobytes() for r in half], pa.binary()), keys], ["id", "query", "v16", "keys"])

    return rows.mapInArrow(run, "id long, query boolean, v16 binary, keys array<struct<order:int,code:int,fine:double>>")


def _first_links(packed: DataFrame, dim: int, k: int) -> DataFrame:
    """``id, query, links``: nearest indexed vectors of the row's block in each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                block = whole.slice(start, BLOCK_ROWS)
                x = _vectors(block.column("v16"), dim)
                ids, query = block.column("id").to_numpy(), block.column("query").to_numpy(zero_copy_only=False)
                d = np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T)
                d[:, query] = np.inf
                d[(ids[:, None] == ids[None]) & ~query[:, None]] = np.inf
                near = np.argsort(d, 1, kind="stable")[:, :k]
                rows = []
                for i, own in enumerate(near):
                    own = own[np.isfinite(d[i, own])]
                    rows.append((d[i, own], ids[own], np.ones(len(own), bool)))
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("query"), _links(rows)], ["id", "query", "links"])

    rows = packed.select("id", "query", "v16", F.explode("keys").alias("k")).select("id", "query", "v16", "k.order", "k.code", "k.fine")
    rows = rows.repartitionByRange(shuffle_partitions(packed.sparkSession), "order", "code", "fine").sortWithinPartitions("order", "code", "fine")
    return rows.select("id", "query", "v16").mapInArrow(run, f"id long, query boolean, links {_LINKS}")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """``id, v16, kth, links, changed``: the nearest ``k`` of ``links`` (known) and ``offers`` (lists of new ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, kth, changed = [], [], []
            sides = []
            for name in ("links", "offers"):
                column = batch.column(name)
                items = column.flatten()
                each = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                sides.append((np.concatenate([[0], np.cumsum(each)]), items.field("d").to_numpy(), items.field("id").to_numpy()))
            (a0, d0, i0), (a1, d1, i1) = sides
            for r in range(batch.num_rows):
                old, new = slice(a0[r], a0[r + 1]), slice(a1[r], a1[r + 1])
                n = a0[r + 1] - a0[r]
                d, ids = np.concatenate([d0[old], d1[new]]), np.concatenate([i0[old], i1[new]])
                known = ids[:n]
                best = nearest_first(d, ids, k)
                fresh = ~np.isin(ids[best], known)
                kept.append((d[best], ids[best], fresh))
                kth.append(d[best[-1]] if len(best) == k else np.inf)
                changed.append(int(fresh.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v16"), pa.array(kth, pa.float32()), _links(kept), pa.array(changed, pa.int32())], ["id", "v16", "kth", "links", "changed"])

    return rows.mapInArrow(run, f"id long, v16 binary, kth float, links {_LINKS}, changed int")


def _meet(meetings: DataFrame, dim: int) -> DataFrame:
    """``id, d, other``: what members of a meeting find in each other, nearer than what they know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            items = column.flatten()
            x = _vectors(items.field("v16"), dim)
            ids, kth, fresh = (items.field(c).to_numpy(zero_copy_only=False) for c in ("id", "kth", "fresh"))
            norm = (x * x).sum(1)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                d = np.maximum(0, norm[a:b, None] + norm[None, a:b] - 2 * x[a:b] @ x[a:b].T)
                # two that were met before have nothing new to tell
                d[~(fresh[a:b, None] | fresh[None, a:b]) | (ids[a:b, None] == ids[None, a:b])] = np.inf
                d[d >= kth[a:b, None]] = np.inf
                take = np.argsort(d, 1)[:, :OFFERS]
                near = np.take_along_axis(d, take, 1)
                row, col = np.nonzero(np.isfinite(near))
                out.append((ids[a:b][row], near[row, col], ids[a:b][take[row, col]]))
            if out:
                own, d, other = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(d.astype(np.float32)), pa.array(other)], ["id", "d", "other"])

    return meetings.mapInArrow(run, "id long, d float, other long")


def neighbour_graph(packed: DataFrame, first: DataFrame, dim: int, k: int = NEIGHBOURS) -> DataFrame:
    """``id, links``: about the nearest ``k`` of every packed vector, by NN-descent from the ``first`` links.

    A neighbour of a neighbour is likely a neighbour: in each round every node is a meeting of its neighbours and of
    those it is a neighbour of, which compare with each other wherever one of the two is new in its list.  The
    joins carry ids and half floats.  A node's reverse neighbours are split into meetings of about
    ``MEETING``, each with all its own neighbours, so no node is a hot group and no link is left out.
    """
    empty = F.array().cast("array<struct<d:float,id:bigint>>")
    start = packed.select("id", "v16").join(first.groupBy("id").agg(F.flatten(F.collect_list("links")).alias("offers")), "id", "left")
    start = start.select("id", "v16", F.array().cast(_LINKS).alias("links"), F.coalesce(F.expr("transform(offers, x -> named_struct('d', x.d, 'id', x.id))"), empty).alias("offers"))
    graph = stored(_merged(start, k))
    for _ in range(ROUNDS):
        counts = graph.agg(F.sum("changed").alias("changed"), F.sum(F.size("links")).alias("links")).first()
        if not counts["changed"] or counts["changed"] < SETTLED * counts["links"]:
            break
        member = F.struct("id", "v16", "kth", "fresh").alias("member")
        edges = graph.select(F.col("id").alias("from"), F.explode("links").alias("x")).select("from", F.col("x.id").alias("to"), "x.fresh")
        hubs = edges.groupBy("to").count().where(F.col("count") > MEETING).select(F.col("to").alias("at"), F.ceil(F.col("count") / MEETING).cast("int").alias("parts"))
        behind = graph.select("id", "v16", "kth", F.explode("links").alias("x")).select(F.col("x.id").alias("at"), "id", "v16", "kth", "x.fresh")
        behind = behind.join(hubs, "at", "left").select("at", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), member)
        ahead = edges.join(graph.select(F.col("id").alias("to"), "v16", "kth"), "to").select(F.col("from").alias("at"), F.col("to").alias("id"), "v16", "kth", "fresh")
        ahead = ahead.join(hubs, "at", "left").select("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), member)
        # dealt out explicitly: the union of two inputs that are each dealt out by ``at`` must not count as dealt out
        both = behind.unionByName(ahead).repartition(shuffle_partitions(graph.sparkSession), "at", "part")
        meetings = both.groupBy("at", "part").agg(F.collect_list("member").alias("members")).where("exists(members, x -> x.fresh) and size(members) > 1")
        offers = _meet(meetings.select("members"), dim).groupBy("id").agg(F.collect_list(F.struct("d", F.col("other").alias("id"))).alias("offers"))
        known = graph.select("id", "v16", "links").join(offers, "id", "left")
        graph = stored(_merged(known.select("id", "v16", "links", F.coalesce("offers", empty).alias("offers")), k))
    return graph


def _distances(pairs: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _vectors(batch.column("q16"), dim) - _vectors(batch.column("v16"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(np.einsum("ij,ij->i", gap, gap).astype(np.float32)), pa.array(np.ones(len(gap), bool))], ["query", "id", "d", "open"])

    return pairs.select("query", "id", "q16", "v16").mapInArrow(run, "query long, id long, d float, open boolean")


def greedy_search(graph: DataFrame, queries: DataFrame, entries: DataFrame, dim: int, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """``query, id, d``: the ``beam`` nearest nodes that greedy steps from the ``entries(query, id)`` reach.

    All queries walk together.  In each round a query's nearest open nodes are expanded to the nodes they link
    to, in either direction; the nearest ``beam`` stay.  It ends when no query has an open node, i.e. when
    every node it keeps was expanded; a node is expanded once, so it ends.
    """
    nodes = graph.select("id", "v16")
    edges = graph.select("id", F.explode("links.id").alias("to"))
    both = edges.unionByName(edges.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct()
    roads = stored(both)
    if queries.count() <= BROADCAST_QUERIES:
        queries = F.broadcast(queries)

    def valued(pairs: DataFrame) -> DataFrame:
        return _distances(pairs.join(nodes, "id").join(queries, "query"), dim)

    nearest = Window.partitionBy("query").orderBy("d", "id")
    found = stored(valued(entries.distinct()).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= beam))
    while found.where("open").limit(1).count():
        turn = found.withColumn("turn", F.row_number().over(Window.partitionBy("query", "open").orderBy("d", "id"))).withColumn("now", F.col("open") & (F.col("turn") <= step))
        turn = turn.select("query", "id", "d", "open", "now")
        reached = turn.where("now").select("query", "id").join(roads, "id").select("query", F.col("to").alias("id")).distinct()
        reached = reached.join(found.select("query", "id"), ["query", "id"], "left_anti")
        kept = turn.select("query", "id", "d", (F.col("open") & ~F.col("now")).alias("open")).unionByName(valued(reached))
        found = stored(kept.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= beam))
    return found.select("query", "id", "d")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", value: str = "embedding", beam: int = BEAM) -> DataFrame:
    """About the nearest ``k`` rows of ``vectors`` (Euclidean) for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Every different vector is a node of a neighbour graph that NN-descent builds; queries search it greedily,
    all at once.  Equal vectors are one node and return together, each with its own id, so a vector in a third of all
    rows costs as much as any other.  Graph and search work on scaled half floats; the best of each query are then measured
    in double precision on the original vectors, which gives score and order.  A query's own id is no result.

    Null vectors, vectors without a component other than zero, with a null, NaN or infinite component, and rows
    without id take no part.  Shorter vectors count as padded with zeros.  Ties go to the smaller id; repeated rows
    (same id and vector) count once; an id with several vectors is one candidate with each of them, returned once at its
    nearest; a repeated query id is answered once, for its smallest vector.  Other columns are ignored.
    """
    usable = F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")

    def whole(df: DataFrame) -> DataFrame:
        slim = df.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v")).where("id is not null").where(usable)
        # trailing zeros and signs of zeros make no difference to distances
        last = F.expr("aggregate(v, named_struct('at', 0, 'last', 0), (s, x) -> named_struct('at', s.at + 1, 'last', if(x <> 0, s.at + 1, s.last)), s -> s.last)")
        return slim.select("id", F.transform(F.slice("v", 1, last), lambda x: x + F.lit(0.0)).alias("v"))

    base = whole(vectors)
    classes = stored(base.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"))
    # ids that stand for a node: a result needs the smallest k and one more, as the query may be among them
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    holders = base.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).join(classes, "v").select("node", F.col("id").alias("vec_id"))
    asked = stored(whole(queries).groupBy("id").agg(F.min("v").alias("v")))
    shape = classes.unionByName(asked.withColumnRenamed("id", "node")).agg(F.max(F.size("v")).alias("dim"), F.max(F.expr("array_max(transform(v, x -> abs(x)))")).alias("top")).first()
    dim, scale = shape["dim"] or 1, shape["top"] or 1.0
    rows = classes.select(F.col("node").alias("id"), F.lit(False).alias("query"), "v").unionByName(asked.select("id", F.lit(True).alias("query"), "v"))
    packed = stored(_packed(rows, dim, scale))
    first = stored(_first_links(packed, dim, NEIGHBOURS))
    graph = neighbour_graph(packed.where("not query"), first.where("not query"), dim)
    # each query starts from its blocks, and from a few nodes that are the same for all
    shared = [r["node"] for r in classes.select("node").orderBy(F.xxhash64("node")).limit(16).collect()]
    ways = first.where("query").select(F.col("id").alias("query"), F.explode("links.id").alias("id"))
    common = asked.select(F.col("id").alias("query"), F.explode(F.array(*map(F.lit, shared)).cast("array<long>")).alias("id"))
    found = greedy_search(graph, packed.where("query").select(F.col("id").alias("query"), F.col("v16").alias("q16")), ways.unionByName(common), dim, beam)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("place") <= 4 * k)
    best = best.join(classes.select(F.col("node").alias("id"), "v"), "id").join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    gap = F.expr("sqrt(aggregate(zip_with(q, v, (a, b) -> coalesce(a, 0D) - coalesce(b, 0D)), 0D, (s, x) -> s + x * x))")
    best = best.select("query", F.col("id").alias("node"), gap.alias("score")).join(holders, "node").where(F.col("query") != F.col("vec_id"))
    best = best.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
