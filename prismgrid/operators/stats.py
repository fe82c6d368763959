"""Distributed exact order statistics: running totals, quantiles, ranks, rank AUC, correlations.

None of these puts a whole key into one task.  Values are cut into buckets by approximate quantile
edges; the edges only balance the work, the results are exact whatever they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _bucket(value: Column, edges: Column, steps: int) -> Column:
    """Number of edges below ``value``, by binary search over ``2**steps - 1`` ascending edges."""
    strides = F.array(*[F.lit(2**k) for k in reversed(range(steps))])
    return F.aggregate(
        strides,
        F.lit(0),
        lambda pos, s: pos
        + F.when(value > F.element_at(edges, pos + s), s).otherwise(F.lit(0)),
    )


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one row per key; without keys ``per_key`` is a single row."""
    return df.join(per_key, keys, how) if keys else df.join(F.broadcast(per_key))


#: Rows of a grouped step that one task holds.
TASK_ROWS = 300_000


def dealt(df: DataFrame, rows: float, by: list[str]) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by ``by`` into tasks of about ``TASK_ROWS``.

    Left to itself Spark sizes the tasks of a shuffle by compressed bytes: rows that compress well, as equal lists do,
    stay in as few tasks as there are cores however many they become.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *by)


MAX_BROADCAST_ROWS = 20_000


def checked_small(df: DataFrame) -> DataFrame:
    """A per-key summary as a broadcast side, after its row count has been checked.

    Up to ``MAX_BROADCAST_ROWS`` rows are fetched and become a local table; a larger summary stays
    distributed and is joined by shuffle.  It is materialised: approximate edges depend on the order in which partial
    summaries meet, and every reader has to see the same ones.
    """
    rows = df.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        return cut(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def value_edges(df: DataFrame, keys: list[str], value: str, steps: int) -> DataFrame:
    """Approximate equi-depth edges per key: one array of ``2**steps - 1`` values.

    They depend on the order in which partial summaries meet, so they are materialised: every reader, and a task that
    is run again, sees the same edges.
    """
    n = 2**steps
    return cut(df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("_edges")
    ))


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: list[str],
    descending: bool = False,
    steps: int = 6,
) -> DataFrame:
    """Inclusive running sum of each column in ``sums`` along ``value`` within each key.

    Peers (equal ``value``) share one total.  Adds ``cum_<name>`` columns.  The input is read three times
    with different columns, which defeats exchange reuse, so it is materialised once.
    """
    df = cut(df)
    edges = value_edges(df, keys, value, steps)
    b = attach(df, edges, keys).withColumn(
        "_b", _bucket(F.col(value), F.col("_edges"), steps)
    ).drop("_edges")
    order = F.col("_b").desc() if descending else F.col("_b")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums]).select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    vorder = F.col(value).desc() if descending else F.col(value)
    inside = Window.partitionBy(*keys, "_b").orderBy(vorder).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return b.join(offsets, [*keys, "_b"]).select(
        *df.columns, *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    )


def suffix_minimum(df: DataFrame, keys: list[str], value: str, column: str, steps: int = 6) -> DataFrame:
    """Smallest ``column`` over the rows of the key with the same or a larger ``value``: adds ``min_<column>``.

    Values are cut into ranges; the minima of the ranges above are carried down, so no key is one task.
    """
    df = cut(df)
    b = attach(df, value_edges(df, keys, value, steps), keys).withColumn("_b", _bucket(F.col(value), F.col("_edges"), steps)).drop("_edges")
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = b.groupBy(*keys, "_b").agg(F.min(column).alias("_m")).select(*keys, "_b", F.min("_m").over(above).alias("_up"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = F.least(F.min(column).over(inside), F.col("_up"))
    return b.join(carried, [*keys, "_b"]).select(*df.columns, lowest.alias(f"min_{column}"))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    qs: dict[str, float],
    weight: str | None = None,
    spread: float = 0.002,
) -> DataFrame:
    """Linear-interpolated quantiles (rank ``q*(n-1)``) per key, exact, without gathering a key.

    With an integer ``weight`` a value counts that many times.  Three scans: approximate bracket edges,
    counts per bracket, then only the rows inside the brackets that hold a wanted rank.
    Returns ``keys, n, <one column per name in qs>``.
    """
    probes = sorted({min(1.0, max(0.0, q + d)) for q in qs.values() for d in (-spread, spread)})
    steps = max(1, math.ceil(math.log2(len(probes) + 1)))
    probes = probes + [1.0] * (2**steps - 1 - len(probes))
    w = F.col(weight) if weight else F.lit(1)
    present = df.where(F.col(value).isNotNull() & (w > 0)).select(
        *keys, F.col(value).cast("double").alias("_v"), w.cast("bigint").alias("_w")
    )
    edges = present.groupBy(*keys).agg(
        F.percentile_approx("_v", probes, 10000).alias("_edges"), F.sum("_w").alias("n")
    )
    # raw rows meet the edges without being shuffled by key, whatever share of them one key holds
    b = attach(present, checked_small(edges), keys).withColumn("_b", _bucket(F.col("_v"), F.col("_edges"), steps)).drop("_edges")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = b.groupBy(*keys, "n", "_b").agg(F.sum("_w").alias("_bw"))
    hist = hist.withColumn("_start", F.coalesce(F.sum("_bw").over(before), F.lit(0)))
    ranks = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in qs.items()}
    lows = {name: F.floor(r) for name, r in ranks.items()}
    highs = {name: F.ceil(r) for name, r in ranks.items()}

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for name in qs:
        for rank in (lows[name], highs[name]):
            wanted = wanted | holds(rank, F.col("_start"), F.col("_bw"))
    needed = checked_small(hist.where(wanted).select(*keys, "_b", "_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = (
        b.join(needed, [*keys, "_b"])
        .groupBy(*keys, "n", "_b", "_start", "_v")
        .agg(F.sum("_w").alias("_c"))
        .withColumn("_from", F.col("_start") + F.sum("_c").over(inside) - F.col("_c"))
    )
    out = []
    for name in qs:
        lo = F.max(F.when(holds(lows[name], F.col("_from"), F.col("_c")), F.col("_v")))
        hi = F.max(F.when(holds(highs[name], F.col("_from"), F.col("_c")), F.col("_v")))
        frac = F.first(ranks[name] - lows[name])
        out.append((lo + (hi - lo) * frac).alias(name))
    return rows.groupBy(*keys, "n").agg(*out)


def class_counts(df: DataFrame, keys: list[str], score: str, ref: str) -> DataFrame:
    """Positives and negatives per distinct score, over rows with both values present."""
    return (
        df.where(F.col(score).isNotNull() & F.col(ref).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count_if(F.col(ref) == 1).alias("pos"), F.count_if(F.col(ref) == 0).alias("neg"))
    )


def rank_auc(df: DataFrame, keys: list[str], score: str = "score", ref: str = "ref") -> DataFrame:
    """Mann-Whitney U and AUC per key, ties counting one half; NULL when a class is absent."""
    counts = class_counts(df, keys, score, ref)
    run = running_totals(counts, keys, "score", ["neg"])
    u = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * F.lit(0.5)))
    t = F.col("pos") + F.col("neg")
    agg = run.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        u.alias("u"),
        F.sum(t.cast("double") * t * t - t).alias("tie_sum"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(
        *keys,
        "n_pos",
        "n_neg",
        F.when(both, F.col("u")).alias("u"),
        F.when(both, F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
        "tie_sum",
    )


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average rank (ties share the mean rank) of each distinct value: ``keys, value, n_tied, avg_rank``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    return running_totals(counts, keys, value, ["n_tied"]).select(
        *keys, value, "n_tied", (F.col("cum_n_tied") - (F.col("n_tied") - 1) / 2.0).alias("avg_rank")
    )


def pearson(x: str, y: str, min_n: int = 3) -> Column:
    """Aggregate: correlation over joint non-missing pairs, NULL below ``min_n`` or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(both, F.col(x)), F.when(both, F.col(y))
    usable = (F.count_if(both) >= min_n) & (F.min(xx) < F.max(xx)) & (F.min(yy) < F.max(yy))
    return F.when(usable, F.corr(xx, yy))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rank correlation over joint rows; NULL below two rows or when a side is constant.

    Rows are first collapsed to distinct (x, y) pairs, so hot ties do not travel.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(w.alias("_w"))
    )

    def ranks(name: str) -> DataFrame:
        c = pairs.groupBy(*keys, name).agg(F.sum("_w").alias("_n"))
        return running_totals(c, keys, name, ["_n"]).select(
            *keys, name, (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(f"{name}_rank")
        )

    r = pairs.join(ranks("_x"), [*keys, "_x"]).join(ranks("_y"), [*keys, "_y"])
    a, b, n = F.col("_x_rank"), F.col("_y_rank"), F.col("_w")
    sums = r.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(n * a).alias("sa"),
        F.sum(n * b).alias("sb"),
        F.sum(n * a * a).alias("saa"),
        F.sum(n * b * b).alias("sbb"),
        F.sum(n * a * b).alias("sab"),
    )
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    return sums.select(
        *keys,
        "n",
        F.when((F.col("n") >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va) / F.sqrt(vb)).alias("rho"),
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], tie: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key with their ``rank``; ranked inside hash salts first, so no window sees a whole key."""
    salted = df.withColumn("_salt", F.pmod(F.hash(*tie), F.lit(64)))
    by = [*order, *[F.col(t) for t in tie]]
    first = Window.partitionBy(*keys, "_salt").orderBy(*by)
    kept = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)
