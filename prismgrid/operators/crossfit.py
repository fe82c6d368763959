"""Block-balanced thresholds and leave-one-block-out cross-fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .stats import _bucket as bucket_of
from .stats import attach, dealt, exact_quantiles, running_totals, value_edges

#: Score levels that a task holds as dense rows over blocks.
SLICE = 2048
#: Score counts of a bucket, and the most halvings that make buckets of a key.
BUCKET_ROWS, MAX_STEPS = 50_000, 4
#: Folds whose margins one task fits; the blocks of a scene travel once for each such part.
FOLDS_PER_TASK = 64


def block_score_counts(obs: DataFrame, keys: list[str], score: str = "score", ref: str = "ref", block: str = "block_id") -> DataFrame:
    """Positives and negatives per block and distinct score, with the block totals.

    The totals come from one per-block aggregate, so a hot score value collapses before it travels.
    """
    rows = obs.where(F.col(score).isNotNull() & F.col(ref).isNotNull())
    c = rows.groupBy(*keys, block, F.col(score).alias("score")).agg(
        F.count_if(F.col(ref) == 1).alias("pos"), F.count_if(F.col(ref) == 0).alias("neg")
    )
    t = rows.groupBy(*keys, block).agg(
        F.count_if(F.col(ref) == 1).alias("block_pos"), F.count_if(F.col(ref) == 0).alias("block_neg")
    )
    return c.join(t, [*keys, block])


def balanced_youden(rows: DataFrame, keys: list[str], steps: int = 4) -> DataFrame:
    """Threshold with the best block-balanced Youden J per key; the highest one on ties.

    ``rows``: ``keys, block_id, score, pos, neg, block_pos, block_neg, w`` where ``w`` is how often the
    block takes part.  Every class-bearing block weighs the same; keys without both classes drop out.
    """
    blocks = rows.groupBy(*keys, "block_id").agg(
        F.first("w").alias("w"), F.first("block_pos").alias("p"), F.first("block_neg").alias("n")
    )
    n = blocks.groupBy(*keys).agg(
        F.sum(F.when(F.col("p") > 0, F.col("w")).otherwise(0)).alias("_np"),
        F.sum(F.when(F.col("n") > 0, F.col("w")).otherwise(0)).alias("_nn"),
        F.sum("w").alias("n_training_blocks"),
    ).where("_np > 0 AND _nn > 0")
    # F.col division by a zero block count never happens: pos > 0 implies block_pos > 0
    wp = F.when(F.col("pos") > 0, F.col("w") * F.col("pos") / F.col("block_pos")).otherwise(F.lit(0.0))
    wn = F.when(F.col("neg") > 0, F.col("w") * F.col("neg") / F.col("block_neg")).otherwise(F.lit(0.0))
    per_score = rows.groupBy(*keys, "score").agg(F.sum(wp).alias("wp"), F.sum(wn).alias("wn"))
    run = attach(running_totals(per_score, keys, "score", ["wp", "wn"], descending=True, steps=steps), n, keys)
    j = F.round(F.col("cum_wp") / F.col("_np") - F.col("cum_wn") / F.col("_nn"), 12)
    return (
        run.withColumn("_j", j)
        .groupBy(*keys, "n_training_blocks")
        .agg(F.max_by("score", F.struct("_j", "score")).alias("threshold"), F.max("_j").alias("youden_j"))
    )


def fold_thresholds(obs: DataFrame, training: DataFrame, keys: list[str], steps: int | None = None) -> DataFrame:
    """Threshold per held-out block from its training blocks: ``keys, fold, n_training_blocks, threshold, youden_j``.

    ``training``: ``keys, fold, block_id`` and optionally ``w`` (multiplicity of a drawn block); further columns, as a
    replicate, tell lists of a fold apart.  Score counts are not copied to the folds that train on them: scores
    are cut into buckets, and a task multiplies one bucket's counts (score x block) by the weights (block x fold).
    Sums of the buckets above come with each fold, so a task returns the bucket's best threshold of every fold.
    The list of a fold travels once for each bucket, so their number follows the largest key (up to ``2**MAX_STEPS``) unless
    ``steps`` fixes it, and the number of tasks follows the lists.
    """
    t = training if "w" in training.columns else training.withColumn("w", F.lit(1))
    shared = [k for k in keys if k in t.columns]
    extra = [c for c in t.columns if c not in {*keys, "fold", "block_id", "w"}]
    counts = cut(block_score_counts(obs, keys))
    largest, n_rows = (x or 1 for x in counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).collect()[0])
    if steps is None:
        steps = min(MAX_STEPS, max(1, math.ceil(math.log2(max(2.0, largest / BUCKET_ROWS)))))
    rows = attach(counts, value_edges(counts, keys, "score", steps), keys)
    rows = rows.select(
        *keys, "block_id", F.col("score").cast("double").alias("score"), bucket_of(F.col("score"), F.col("_edges"), steps).alias("_b"),
        F.when(F.col("pos") > 0, F.col("pos") / F.col("block_pos")).otherwise(0.0).alias("wp"),
        F.when(F.col("neg") > 0, F.col("neg") / F.col("block_neg")).otherwise(0.0).alias("wn"),
    )
    fold = [*keys, *extra, "fold"]
    blocks = cut(counts.groupBy(*keys, "block_id").agg(F.first("block_pos").alias("p"), F.first("block_neg").alias("n")))
    lists = cut(blocks.join(t, [*shared, "block_id"]).groupBy(*fold).agg(
        F.sum(F.when(F.col("p") > 0, F.col("w")).otherwise(0)).alias("_np"),
        F.sum(F.when(F.col("n") > 0, F.col("w")).otherwise(0)).alias("_nn"),
        F.sum("w").alias("n_training_blocks"),
        F.collect_list(F.struct("block_id", F.col("w").cast("double").alias("w"))).alias("_l"),
    ).where("_np > 0 AND _nn > 0"))
    listed = lists.agg(F.sum(F.size("_l"))).collect()[0][0] or 1
    sums = rows.groupBy(*keys, "_b", "block_id").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn")).join(t, [*shared, "block_id"])
    sums = sums.groupBy(*fold, "_b").agg(F.sum(F.col("wp") * F.col("w")).alias("wp"), F.sum(F.col("wn") * F.col("w")).alias("wn"))
    above = Window.partitionBy(*fold).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*fold, "_b", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"_{c}") for c in ("wp", "wn")])
    sides = sums.join(lists, fold).select(*fold, "_b", "_wp", "_wn", "_np", "_nn", "n_training_blocks", F.col("_l.block_id").alias("_blocks"), F.col("_l.w").alias("_w"))
    names = sides.columns
    out = T.StructType([sides.schema[c] for c in (*fold, "n_training_blocks")] + [T.StructField(c, T.DoubleType()) for c in ("score", "_j")])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=out.names)
        right.columns = names
        block, ids = pd.factorize(left["block_id"])
        level, scores = pd.factorize(-left["score"], sort=True)
        place = {b: i for i, b in enumerate(ids)}
        weight = np.zeros((len(ids), len(right)))
        for f, (own, w) in enumerate(zip(right["_blocks"], right["_w"], strict=True)):
            for b, x in zip(own, w, strict=True):
                if b in place:
                    weight[place[b], f] += x
        carry = [right[c].to_numpy(float) for c in ("_wp", "_wn")]
        size = [right[c].to_numpy(float) for c in ("_np", "_nn")]
        values = [left[c].to_numpy(float) for c in ("wp", "wn")]
        order = np.argsort(level, kind="stable")
        top, score = np.full(len(right), -np.inf), np.full(len(right), np.nan)
        for start in range(0, len(scores), SLICE):
            lo, hi = np.searchsorted(level[order], [start, start + SLICE])
            at, n = order[lo:hi], min(SLICE, len(scores) - start)
            cell = (level[at] - start) * len(ids) + block[at]
            run = []
            for c in (0, 1):
                dense = np.bincount(cell, values[c][at], n * len(ids)).reshape(n, -1)
                run.append(carry[c] + np.cumsum(dense @ weight, 0))
                carry[c] = run[c][-1]
            j = np.round(run[0] / size[0] - run[1] / size[1], 12)
            # a score is a threshold of the folds that have it in a training block
            seen = np.bincount(cell, minlength=n * len(ids)).reshape(n, -1) @ (weight > 0)
            j[seen == 0] = -np.inf
            first = np.argmax(j, 0)
            value = j[first, np.arange(len(right))]
            better = value > top
            top[better], score[better] = value[better], -np.asarray(scores)[start + first[better]]
        made = right[[*fold, "n_training_blocks"]].assign(score=score, _j=top)
        return made[np.isfinite(top)]

    # other names: both sides of the cogroup come from the same rows
    sides = sides.toDF(*[f"r_{c}" for c in names])
    left, right, size = [*keys, "_b"], [*[f"r_{k}" for k in keys], "r__b"], n_rows + listed * 2**steps
    found = dealt(rows, size, left).groupBy(*left).cogroup(dealt(sides, size, right).groupBy(*right)).applyInPandas(best, out)
    return found.groupBy(*fold, "n_training_blocks").agg(F.max_by("score", F.struct("_j", "score")).alias("threshold"), F.max("_j").alias("youden_j"))


def cross_fit(obs: DataFrame, training: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out predictions: every paired cell once, ``pred`` NULL where its fold had no threshold.

    Rank metrics use all rows, threshold metrics those with ``pred``.  ``keys`` may include a replicate.
    """
    thr = fold_thresholds(obs, training, keys)
    rows = obs.where(F.col("score").isNotNull() & F.col("ref").isNotNull())
    t = thr.select(*[c for c in thr.columns if c not in ("youden_j", "fold")], F.col("fold").alias("block_id"))
    return rows.join(t, [*keys, "block_id"], "left").withColumn(
        "pred", (F.col("score") >= F.col("threshold")).cast("int")
    )


def robust_margin(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Median and interquartile range of two scores over rows with both; ``reason`` when unusable."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    qs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    qa = exact_quantiles(rows, keys, a, {f"a_{k}": v for k, v in qs.items()})
    qb = exact_quantiles(rows, keys, b, {f"b_{k}": v for k, v in qs.items()}).drop("n")
    j = attach(qa, qb, keys)
    ia, ib = F.col("a_q3") - F.col("a_q1"), F.col("b_q3") - F.col("b_q1")
    return j.select(
        *keys,
        F.col("n").alias("n_scale"),
        "a_med",
        ia.alias("a_iqr"),
        "b_med",
        ib.alias("b_iqr"),
        F.when(ia == 0, "zero_first_iqr").when(ib == 0, "zero_second_iqr").alias("reason"),
    )


def _quantile(ordered: np.ndarray, q: float) -> float:
    """Linear-interpolated quantile of sorted values, as ``stats.exact_quantiles`` states it."""
    rank = q * (len(ordered) - 1)
    low = int(np.floor(rank))
    lo, hi = ordered[low], ordered[int(np.ceil(rank))]
    return float(lo + (hi - lo) * (rank - low))


def _balanced_threshold(score: np.ndarray, ref: np.ndarray, block: np.ndarray) -> tuple[float, float]:
    """Highest score with the best block-balanced Youden J, and that J; NaN without both classes."""
    size = int(block.max()) + 1
    gain = []
    for one in (ref == 1, ref == 0):
        per = np.bincount(block[one], minlength=size)
        if not one.any():
            return np.nan, np.nan
        gain.append((one, 1.0 / np.maximum(per, 1)[block], float((per > 0).sum())))
    distinct, level = np.unique(-score, return_inverse=True)
    run = [np.cumsum(np.bincount(level[one], share[one], len(distinct))) / n for one, share, n in gain]
    j = np.round(run[0] - run[1], 12)
    best = int(np.argmax(j))
    return float(-distinct[best]), float(j[best])


def fold_margins(obs: DataFrame, training: DataFrame, keys: list[str], a: str, b: str, ref: str | None = None) -> DataFrame:
    """Median and interquartile range of two scores over the training blocks of each fold; ``reason`` when unusable.

    With ``ref`` also ``threshold`` and ``youden_j`` of the scaled margins, as ``balanced_youden`` defines them.
    A margin differs from fold to fold, but its rows are not copied to the folds that train on them: blocks travel as
    arrays, once for each ``FOLDS_PER_TASK`` folds, and a task takes each fold's training cells from its scene.
    """
    shared = [k for k in keys if k in training.columns]
    use = F.col(a).isNotNull() & F.col(b).isNotNull()
    if ref:
        use = use & F.col(ref).isNotNull()
    cells = obs.where(use).select(
        *keys, "block_id", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), (F.col(ref) if ref else F.lit(0)).cast("double").alias("r")
    )
    blocks = cells.groupBy(*keys, "block_id").agg(F.collect_list(F.struct("a", "b", "r")).alias("_c"))
    blocks = cut(blocks.select(*keys, "block_id", *[F.col(f"_c.{c}").alias(c) for c in ("a", "b", "r")]))
    lists = training.groupBy(*shared, "fold").agg(F.collect_list("block_id").alias("_blocks"))
    place = F.row_number().over(Window.partitionBy(*shared).orderBy("fold")) - 1
    lists = cut(lists.withColumn("_part", F.floor(place / FOLDS_PER_TASK)))
    parts = lists.select(*shared, "_part").distinct()
    blocks = blocks.join(parts, shared)
    lists = lists.join(blocks.select(*keys).distinct(), shared)
    names = lists.columns
    lists = lists.toDF(*[f"r_{c}" for c in names])
    doubles = ["a_med", "a_iqr", "b_med", "b_iqr", *(["threshold", "youden_j"] if ref else [])]
    out = T.StructType(
        [blocks.schema[k] for k in keys]
        + [training.schema["fold"], T.StructField("n_scale", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in doubles]
    )

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if not left.empty and not right.empty:
            right.columns = names
            place = {x: i for i, x in enumerate(left["block_id"])}
            block = np.repeat(np.arange(len(left)), left["a"].map(len).to_numpy())
            x, y, r = (np.concatenate([np.asarray(v, float) for v in left[c]]) for c in ("a", "b", "r"))
            by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
            for fold, own in zip(right["fold"], right["_blocks"], strict=True):
                member = np.zeros(len(left), bool)
                member[[place[o] for o in own if o in place]] = True
                use = member[block]
                if not use.any():
                    continue
                sx, sy = x[by_x][use[by_x]], y[by_y][use[by_y]]
                mx, my = _quantile(sx, 0.5), _quantile(sy, 0.5)
                ix, iy = (_quantile(s, 0.75) - _quantile(s, 0.25) for s in (sx, sy))
                row = [fold, int(use.sum()), mx, ix, my, iy]
                if ref:
                    fitted = (np.nan, np.nan)
                    if ix != 0 and iy != 0:
                        fitted = _balanced_threshold((x[use] - mx) / ix - (y[use] - my) / iy, r[use], block[use])
                    row += fitted
                made.append(row)
        frame = pd.DataFrame(made, columns=["fold", "n_scale", *doubles])
        for k in keys:
            frame[k] = left[k].iloc[0] if len(frame) else None
        return frame[out.names]

    fits = blocks.groupBy(*keys, "_part").cogroup(lists.groupBy(*[f"r_{k}" for k in keys], "r__part")).applyInPandas(fit, out)
    reason = F.when(F.col("a_iqr") == 0, "zero_first_iqr").when(F.col("b_iqr") == 0, "zero_second_iqr").alias("reason")
    fitted = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in doubles[4:]]
    return fits.select(*keys, "fold", "n_scale", *doubles[:4], reason, *fitted)


def apply_margin(df: DataFrame, scale: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Scaled first score minus scaled second score; NULL where the scale is unavailable."""
    m = (F.col(a) - F.col("a_med")) / F.col("a_iqr") - (F.col(b) - F.col("b_med")) / F.col("b_iqr")
    return attach(df, scale, keys, "left").withColumn("margin", F.when(F.col("reason").isNull(), m))
