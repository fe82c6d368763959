"""Mixing sources to target weights by temperature, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Halvings of the exponent's range, and how many of them one job decides.
HALVINGS, PER_JOB = 40, 5
#: Bits of a permutation key, and of its bucket for the cut of the last block.
KEY_BITS, BUCKET_BITS = 60, 16
#: Rows of a plan that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def tokens_of(text: Column) -> Column:
    """Words between blanks, tabs and line ends; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def permutation_key(key: Column, block: Column, tie: Column) -> Column:
    """Place of a row in the permutation of a block: 60 bits of an MD5 digest, of the row's hash where it has no key."""
    name = F.concat(F.coalesce(key.cast("string"), F.concat(F.lit("~"), tie.cast("string"))), F.lit("|"), block.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that can be hashed (maps cannot); it orders rows that share a key."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def _midpoints(low: float, high: float, levels: int) -> list[float]:
    if not levels:
        return []
    mid = (low + high) / 2
    return [mid, *_midpoints(low, mid, levels - 1), *_midpoints(mid, high, levels - 1)]


def exponent(sources: DataFrame, total: int, budget: int, evenness: float | None, max_repeats: float | None) -> float:
    """Smallest exponent in [0, 1] whose weights meet both limits (1, the natural shares, if none does).

    ``sources(n)``: tokens of each source.  Entropy and repetition both fall as the exponent grows.  The
    entropy to stay below lies ``evenness`` of the way from that of the natural shares to that of equal ones.  A job
    evaluates all midpoints that the next few halvings may ask for, as plain sums over the sources.
    """
    share = F.col("n") / F.lit(float(total))

    def values(exponents: list[float]) -> dict[float, tuple[float, float]]:
        sums = []
        for i, a in enumerate(exponents):
            powered = F.pow(share, F.lit(a))
            sums += [F.sum(powered).alias(f"z{i}"), F.sum(powered * F.log(share)).alias(f"l{i}"), F.max(F.pow(share, F.lit(a - 1.0))).alias(f"r{i}")]
        row = sources.agg(*sums).collect()[0]
        out = {}
        for i, a in enumerate(exponents):
            z = row[f"z{i}"]
            out[a] = (math.log(z) - a * row[f"l{i}"] / z, budget / total * row[f"r{i}"] / z)
        return out

    ends = values([0.0, 1.0])
    most = None if evenness is None else ends[1.0][0] + evenness * (ends[0.0][0] - ends[1.0][0])

    def meets(value: tuple[float, float]) -> bool:
        return (most is None or value[0] <= most) and (max_repeats is None or value[1] <= max_repeats)

    if meets(ends[0.0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // PER_JOB):
        known = values(_midpoints(low, high, PER_JOB))
        for _ in range(PER_JOB):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(known[mid]) else (mid, high)
    return high


def plan(docs: DataFrame, budget: int | None = None, evenness: float | None = 0.5, max_repeats: float | None = 4.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``source, n, weight, allotted, blocks, cut, cut_tie, copies``: what every source contributes to ``budget`` tokens (default: all).

    A source gives ``blocks`` whole permutations of its rows and of one more those before the row at ``(cut, cut_tie)``:
    rows in the order of their keys, rows that share a key in the order of their hashes, as long as the tokens left are
    enough.  Of equal rows that stand at the cut, ``copies`` belong to it.  The cut comes from sums over 65,536
    key ranges, then over the keys of one range and 65,536 ranges of hashes, then over hashes, so no source and
    no key is ordered in one task.  Rows without a key are placed by their hash.
    """
    slim = stored(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), tokens_of(F.col(text)).alias("tokens"), row_hash(docs).alias("tie")).where("tokens > 0"))
    sources = stored(slim.groupBy("source").agg(F.sum("tokens").alias("n")))
    total = sources.agg(F.sum("n")).collect()[0][0] or 0
    budget = total if budget is None else budget
    a = exponent(sources, total, budget, evenness, max_repeats) if total else 1.0
    powered = sources.withColumn("p", F.pow(F.col("n") / F.lit(float(total or 1)), F.lit(a)))
    z = powered.agg(F.sum("p")).collect()[0][0] or 1.0
    weights = powered.withColumn("weight", F.col("p") / F.lit(z)).withColumn("allotted", F.floor(F.col("weight") * budget + 0.5).cast("long"))
    weights = weights.withColumn("blocks", F.expr("cast(allotted div n as int)")).withColumn("rest", F.col("allotted") - F.col("blocks") * F.col("n"))
    weights = stored(weights.select("source", "n", "weight", "allotted", "blocks", "rest"))

    rows = _with_plan(slim, weights.select("source", "blocks", "rest"), F.col("source"))
    rows = rows.withColumn("at", permutation_key(F.col("key"), F.col("blocks"), F.col("tie"))).withColumn("bucket", F.shiftright("at", KEY_BITS - BUCKET_BITS))
    rows = rows.withColumn("lot", F.shiftright("tie", 64 - BUCKET_BITS)).withColumn("before", F.lit(0).cast("long"))
    first = _crossing(rows, ["bucket"])
    near = _with_plan(rows.drop("before"), first.select("source", F.col("bucket").alias("_bucket"), "before"), F.col("source")).where("bucket = _bucket")
    second = _crossing(near, ["at", "lot"])
    last = _with_plan(near.drop("before"), second.select("source", F.col("at").alias("_at"), F.col("lot").alias("_lot"), "before"), F.col("source"))
    third = _crossing(last.where("at = _at and lot = _lot"), ["at", "tie"])
    copies = F.expr("cast((rest - before) div (t div c) as int)")
    cuts = third.select(F.col("source").alias("s"), F.col("at").alias("cut"), F.col("tie").alias("cut_tie"), copies.alias("copies"))
    return stored(weights.join(cuts, weights["source"].eqNullSafe(cuts["s"])).select("source", "n", "weight", "allotted", "blocks", "cut", "cut_tie", "copies"))


def _crossing(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first cell of each source, in the order of ``by``, with which its tokens exceed ``rest``.

    ``rows(source, tokens, rest, before, *by)``; gives ``source, rest, *by``, the cell's tokens ``t`` and rows ``c``, and the
    tokens ``before`` it.
    """
    from pyspark.sql import Window

    cells = rows.groupBy("source", "rest", "before", *by).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    ordered = Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = cells.withColumn("through", F.col("before") + F.sum("t").over(ordered)).where("through > rest")
    best = through.groupBy("source", "rest").agg(F.min(F.struct(*by, "t", "c", (F.col("through") - F.col("t")).alias("before"))).alias("e"))
    return stored(best.select("source", "rest", *[F.col(f"e.{x}").alias(x) for x in (*by, "t", "c", "before")]))


def _with_plan(rows: DataFrame, per_source: DataFrame, source: Column) -> DataFrame:
    """Rows with the columns of their source; broadcast only after its rows are counted."""
    side = per_source.withColumnRenamed("source", "_of")
    side = F.broadcast(side) if per_source.count() <= BROADCAST_ROWS else side
    return rows.join(side, source.eqNullSafe(F.col("_of"))).drop("_of")


def mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row, block, at, n_tokens, weight``: each row of ``docs`` (as a struct) once for every block it is drawn in.

    ``at`` is its place in the mixture from 0 to 1; rows in that order hold the sources at their weights
    throughout.  Texts are not shuffled, except one row for each source whose cut falls among equal rows.  Rows without
    tokens are never drawn, a null source is a source like any other; rows that share a key, have none or are equal
    are drawn one by one, so every source keeps its tokens within its longest row; an empty table gives none.
    """
    rows = docs.select(F.struct("*").alias("row"), tokens_of(F.col(text)).alias("n_tokens"), row_hash(docs).alias("tie")).where("n_tokens > 0")
    met = _with_plan(rows, plan, F.col("row")[source].cast("string"))
    met = met.withColumn("last", permutation_key(F.col("row")[key], F.col("blocks"), F.col("tie")))
    inside = (F.col("last") < F.col("cut")) | ((F.col("last") == F.col("cut")) & (F.col("tie") < F.col("cut_tie")))
    drawn = met.withColumn("drawn", F.col("blocks") + inside.cast("int")).where("drawn > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)))
    if plan.where("copies > 0").limit(1).count():
        # equal rows at the cut: one stands for those that still belong to the last block
        edge = met.where("last = cut and tie = cut_tie and copies > 0").withColumn("_source", F.col("row")[source]).dropDuplicates(["_source"]).drop("_source")
        edge = edge.withColumn("drawn", F.col("blocks") + 1).withColumn("block", F.explode(F.array_repeat("blocks", F.col("copies"))))
        drawn = drawn.unionByName(edge.select(*drawn.columns))
    spread, part = permutation_key(F.col("row")[key], F.col("block"), F.col("tie")), F.col("allotted") / F.col("n")
    # the keys of the last block end at the cut and fill what is left of the source's part
    last = spread / (F.col("cut") + 1) * (part - F.col("blocks"))
    at = (F.col("block") + F.when(F.col("block") < F.col("blocks"), spread / F.lit(float(1 << KEY_BITS))).otherwise(last)) / part
    return drawn.select("row", "block", at.alias("at"), "n_tokens", "weight")
