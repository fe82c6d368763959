"""Ranked lexical search of many items at once: term sets that items share are added up once for each document."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

#: Items that are planned and evaluated together; more go in further rounds over the documents.
ITEM_BLOCK = 1_024
#: Documents whose accumulators a task holds at a time.
DOC_BLOCK = 2_048
#: Shared term classes of an item that take part in mining (the most shared ones).  Changes cost, not results.
MINED_CLASSES = 64
#: Part of the length norm, in hundredths.
LENGTH_PERCENT = 75

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of UTF-8 text: runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z."""
    return raw.translate(_TABLE).split()


@dataclass
class Plan:
    """Query-sharing DAG.  Nodes ``0 .. len(leaves)-1`` are a term times its count in an item; each later node adds up ``parts``."""

    terms: list[bytes]
    leaves: list[tuple[int, int]]
    parts: list[tuple[int, ...]]
    roots: list[int]


def shared_plan(items: list[bytes]) -> Plan:
    """Plan of the items: which sums of terms are made once, and from which sums each item is put together.

    Terms (with their count) that occur in the same items form a class, one node.  Then the two nodes that
    most items have together become a node of their own, again and again until no two are shared: a later
    pair may hold nodes made before, so items hang on a DAG of ever larger common term sets.  The nodes an
    item is left with are added up at its root.
    """
    numbers: dict[bytes, int] = {}
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, text in enumerate(items):
        for term, count in sorted(Counter(terms_of(text)).items()):
            holders[numbers.setdefault(term, len(numbers)), count].append(i)
    leaves = list(holders)
    parts: list[tuple[int, ...]] = []

    def node(of: tuple[int, ...]) -> int:
        if len(of) == 1:
            return of[0]
        parts.append(of)
        return len(leaves) + len(parts) - 1

    classes: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for k, leaf in enumerate(leaves):
        classes[tuple(holders[leaf])].append(k)
    own: list[set[int]] = [set() for _ in items]
    shared: list[list[tuple[int, int]]] = [[] for _ in items]
    for members, of in classes.items():
        made = node(tuple(of))
        for i in members:
            own[i].add(made)
            if len(members) > 1:
                shared[i].append((-len(members), made))
    mined = [{made for _, made in sorted(s)[:MINED_CLASSES]} for s in shared]

    together: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, nodes in enumerate(mined):
        for a in nodes:
            for b in nodes:
                if a < b:
                    together[a, b].add(i)
    queue = [(-len(v), k) for k, v in together.items() if len(v) > 1]
    heapq.heapify(queue)
    while queue:
        count, (a, b) = heapq.heappop(queue)
        users = together[a, b]
        if len(users) < 2:
            continue
        if -count != len(users):
            heapq.heappush(queue, (-len(users), (a, b)))
            continue
        made = node((a, b))
        for i in list(users):
            mined[i] -= {a, b}
            own[i] -= {a, b}
            for x in mined[i]:
                together[min(a, x), max(a, x)].discard(i)
                together[min(b, x), max(b, x)].discard(i)
                together[x, made].add(i)
            mined[i].add(made)
            own[i].add(made)
        users.clear()
        for x in {x for i in range(len(items)) if made in mined[i] for x in mined[i]} - {made}:
            if len(together[x, made]) > 1:
                heapq.heappush(queue, (-len(together[x, made]), (x, made)))
    roots = [node(tuple(sorted(nodes))) if nodes else -1 for nodes in own]
    return Plan(sorted(numbers, key=numbers.get), leaves, parts, roots)


def accumulate(plan: Plan, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray | None]:
    """Scores of ``n`` documents for each item: every node of the DAG is made once, and let go after its last use.

    ``values`` are the contributions of ``terms`` in documents ``rows``.  None stands for zeros.
    """
    order = np.argsort(terms, kind="stable")
    edges = np.searchsorted(terms[order], np.arange(len(plan.terms) + 1))
    rows, values = rows[order], values[order]
    uses = Counter(c for p in plan.parts for c in p) + Counter(r for r in plan.roots if r >= 0)
    made: dict[int, np.ndarray] = {}

    def taken(k: int) -> np.ndarray | None:
        uses[k] -= 1
        if k in made:
            return made[k] if uses[k] else made.pop(k)
        if k >= len(plan.leaves):
            return None
        term, count = plan.leaves[k]
        start, stop = edges[term], edges[term + 1]
        if start == stop:
            return None
        out = np.zeros(n, np.int64)
        out[rows[start:stop]] = values[start:stop] * count
        if uses[k]:
            made[k] = out
        return out

    for k, parts in enumerate(plan.parts, len(plan.leaves)):
        total = None
        for c in parts:
            x = taken(c)
            if x is not None:
                total = x.copy() if total is None else np.add(total, x, out=total)
        if total is not None:
            made[k] = total
    return [taken(r) if r >= 0 else None for r in plan.roots]


def best_rows(scores: np.ndarray, keys: list, k: int, floor: int) -> list[tuple[int, object]]:
    """Best ``k`` of ``(score, key)`` with score of ``floor`` or more, ties to the smaller key; null keys are left out."""
    where = np.flatnonzero(scores >= floor)
    if len(where) > 4 * k:
        least = np.partition(scores[where], len(where) - k)[len(where) - k]
        ties = where[scores[where] == least]
        # equal scores are settled by key, so all of them are looked at
        where = np.concatenate([where[scores[where] > least], ties])
    found = [(int(scores[i]), keys[i]) for i in where if keys[i] is not None]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``key, n, terms, tfs`` of every document: all its terms counted, those of the items listed."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in slices(batches):
            raw, at = text_bytes(batch.column("text"))
            whole = raw.tobytes()
            lengths, known, times = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = terms_of(whole[a:b])
                counts = Counter(map(number, words))
                counts.pop(None, None)
                lengths.append(len(words))
                known.append(list(counts.keys()))
                times.append(list(counts.values()))
            columns = [pa.array(lengths, pa.int64()), pa.array(known, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"key {kind}, n long, terms array<int>, tfs array<long>")


def _scored(postings: DataFrame, plan: Plan, weights: np.ndarray, count: int, length: int, k: int, percent: int) -> DataFrame:
    """``item, key, score``: the best ``k`` of each task for each item (its number in the plan)."""
    shared = postings.sparkSession.sparkContext.broadcast((plan, weights))
    kind = postings.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        best: list[list] = [[] for _ in plan.roots]
        kind = None
        for whole in batches:
            kind = whole.schema.field("key").type
            for start in range(0, whole.num_rows, DOC_BLOCK):
                batch = whole.slice(start, DOC_BLOCK)
                terms, tfs = (batch.column(c) for c in ("terms", "tfs"))
                each = terms.value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(batch.num_rows), each)
                number, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                m = (100 - percent) + percent * batch.column("n").to_numpy() * count // length
                values = weights[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m[rows]))
                keys = batch.column("key").to_pylist()
                for i, scores in enumerate(accumulate(plan, rows, number, values, batch.num_rows)):
                    if scores is not None:
                        own = best[i]
                        new = best_rows(scores, keys, k, own[-1][0] if len(own) == k else 1)
                        best[i] = sorted(own + new, key=lambda x: (-x[0], x[1]))[:k]
        found = [(i, key, score) for i, own in enumerate(best) for score, key in own]
        if found:
            item, key, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(key, kind), pa.array(score, pa.int64())], ["item", "key", "score"])

    return postings.mapInArrow(run, f"item int, key {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, percent: int = LENGTH_PERCENT, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Best ``k`` documents for each item: ``item_id, rank, doc_id, score`` (names of ``item`` and ``key``).

    A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))`` over the N documents with terms; a document
    gives each of an item's terms (repeats count again) weight times ``10^9 tf div (1000 tf + 8m)``, with
    ``m = 100 - percent + percent * n * N div L``.  One scan keeps the items' terms of each document with their
    counts (a small table); from it come document frequencies and, in a second scan, the scores.  There a task
    evaluates the items' plan (``shared_plan``) on blocks of documents and keeps k rows an item, so what is
    shuffled is k rows for each task and item.  Items are planned in blocks of about ``ITEM_BLOCK``: only one
    block's plan is held and broadcast at a time.

    Null and empty texts have no term: such documents and items are in no result.  Documents with a null key
    count in N, L and df, and are never returned.  Equal scores go to the smaller key; repeated documents are
    ranked each for itself.  A repeated item key is answered once, for its smallest text.  Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).groupBy("item").agg(F.min("text").alias("text"))
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    item_kind = asked.schema["item"].dataType
    schema = f"item {item_kind.simpleString()}, key {source.schema['key'].dataType.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    total = None
    for b in range(blocks):
        rows = asked.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) & F.col("text").isNotNull()).collect()
        plan = shared_plan([r["text"].encode() for r in rows])
        postings = stored(_postings(source, plan.terms))
        if total is None:
            total = postings.where("n > 0").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("length")).first()
        if not total["count"]:
            break
        frequency = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * total["count"] + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(plan.terms))], np.int64)
        scored = _scored(postings, plan, weights, total["count"], total["length"], k, percent)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"n int, item {item_kind.simpleString()}")
        found = found.unionByName(scored.withColumnRenamed("item", "n").join(F.broadcast(names), "n").select("item", "key", "score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
