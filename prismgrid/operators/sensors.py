"""Paired sensor evaluation, strict held-out scoring and product concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import block_weights, draw_index, weighted_rows, with_replicates
from ..functions.rules import confusion, confusion_metrics, ratio
from ..session import cut
from .agree import pooled_metrics
from .blocks import halo_cells
from .crossfit import apply_margin, cross_fit, fold_margins
from .inference import governed_interval
from .moments import background_moments, matched_filter_by_key, merge_moments
from .resample import block_class_counts, drawn_spearman, pair_numerators, weighted_auc
from .stats import rank_auc


def branches(obs: DataFrame, keys: list[str], native: str, degraded: str) -> DataFrame:
    """Joint-support rows once per sensor branch: ``keys, branch, block_id, score, ref``."""
    rows = obs.where(F.col(native).isNotNull() & F.col(degraded).isNotNull() & F.col("ref").isNotNull())
    pair = F.array(
        F.struct(F.lit("native").alias("branch"), F.col(native).cast("double").alias("score")),
        F.struct(F.lit("degraded").alias("branch"), F.col(degraded).cast("double").alias("score")),
    )
    return rows.select(*keys, "block_id", "ref", F.explode(pair).alias("x")).select(*keys, "x.branch", "block_id", "x.score", "ref")


def _both_branches(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out rows of the folds in which both branches were calibrated."""
    ok = oof.where(F.col("pred").isNotNull()).select(*keys, "block_id", "branch").distinct()
    ok = ok.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
    return oof.join(ok, [*keys, "block_id"], "left_semi")


def evaluate_score_pair(obs: DataFrame, training: DataFrame, keys: list[str], native: str, degraded: str) -> DataFrame:
    """Cross-fitted held-out rows of both sensors on identical support; unavailable folds drop for both."""
    rows = cut(branches(obs, keys, native, degraded))
    return _both_branches(cut(cross_fit(rows, training, [*keys, "branch"])), keys)


def unavailable_folds(oof: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks without an evaluated fold."""
    return obs.select(*keys, "block_id").distinct().join(oof.select(*keys, "block_id").distinct(), [*keys, "block_id"], "left_anti")


def evaluate_margin_pair(
    obs: DataFrame, training: DataFrame, keys: list[str], sensors: dict[str, tuple[str, str]]
) -> DataFrame:
    """Margin endpoint: scale fitted on each fold's training pixels, threshold on training margins.

    ``sensors`` maps a branch to its two score columns.  Both fits are made by ``fold_margins``, without a copy of
    the training rows for each fold.
    """
    rows = obs.where(F.col("ref").isNotNull())
    for a, b in sensors.values():
        rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pair = F.array(*[F.struct(F.lit(n).alias("branch"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (a, b) in sensors.items()])
    long = rows.select(*keys, "block_id", "ref", F.explode(pair).alias("x")).select(*keys, "x.branch", "block_id", "x.a", "x.b", "ref")
    by = [*keys, "branch", "fold"]
    fits = fold_margins(long, training, [*keys, "branch"], "a", "b", "ref")
    test = apply_margin(long.withColumn("fold", F.col("block_id")), fits, by, "a", "b")
    out = test.select(*keys, "branch", "block_id", F.col("margin").alias("score"), "ref", "threshold", (F.col("margin") >= F.col("threshold")).cast("int").alias("pred"))
    return _both_branches(cut(out), keys)


def paired_bootstrap(oof: DataFrame, keys: list[str], replicates: int, seed) -> DataFrame:
    """Both branches under one block draw per replicate: metrics per branch and their difference."""
    by = [*keys, "branch"]
    oof = cut(oof.select(*by, "block_id", "score", "ref", "pred"))
    blocks = oof.select(*keys, "block_id").distinct()
    w = block_weights(blocks, keys, replicates, seed)
    wb = w.join(oof.select(*by, "block_id").distinct(), [*keys, "block_id"])
    auc = weighted_auc(pair_numerators(oof, by), block_class_counts(oof, by), wb, by, ["rep"]).select(*by, "rep", "auc", "prevalence")
    conf = weighted_rows(oof.groupBy(*by, "block_id").agg(*confusion("pred", "ref")), w, [*keys, "block_id"])
    sums = conf.groupBy(*by, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "tn", "fn")])
    m = confusion_metrics(zero=None, need_both=False)
    names = ["balanced_accuracy", "macro_f1", "tpr", "fpr"]
    per = auc.join(sums.select(*by, "rep", *[m[n].alias(n) for n in names]), [*by, "rep"])
    every = ["auc", *names, "prevalence"]
    pick = lambda b, n: F.max(F.when(F.col("branch") == b, F.col(n)))
    wide = per.groupBy(*keys, "rep").agg(*[pick(b, n).alias(f"{b}_{n}") for b in ("native", "degraded") for n in every])
    return wide.select("*", *[(F.col(f"native_{n}") - F.col(f"degraded_{n}")).alias(f"delta_{n}") for n in every])


def metric_rows(oof: DataFrame, reps: DataFrame, support: DataFrame, keys: list[str], names: list[str], replicates: int) -> DataFrame:
    """Native, degraded and difference rows with intervals, masked by the support tier.

    ``support(keys, positive_blocks, negative_blocks, tier)``.
    """
    point = pooled_metrics(oof, [*keys, "branch"])
    pick = lambda b, n: F.max(F.when(F.col("branch") == b, F.col(n)))
    wide = point.groupBy(*keys).agg(*[pick(b, n).alias(f"{b}_{n}") for b in ("native", "degraded") for n in names])
    wide = wide.select("*", *[(F.col(f"native_{n}") - F.col(f"degraded_{n}")).alias(f"delta_{n}") for n in names])
    cols = [f"{b}_{n}" for b in ("native", "degraded", "delta") for n in names]
    values = wide.unpivot(keys, cols, "name", "value")
    ci = governed_interval(reps.unpivot([*keys, "rep"], cols, "name", "v"), [*keys, "name"], "v", replicates).select(*keys, "name", "lower", "upper")
    j = values.join(ci, [*keys, "name"], "left").join(support.select(*keys, "tier"), keys)
    shown = F.col("tier") != "counts_and_maps_only"
    return j.select(
        *keys, F.substring_index("name", "_", 1).alias("sensor"), F.expr("substring(name, instr(name, '_') + 1)").alias("metric"),
        F.when(shown, F.col("value")).alias("value"), F.when(shown, F.col("lower")).alias("lower"), F.when(shown, F.col("upper")).alias("upper"), F.col("tier").alias("inference_status"),
    )


# ---- strict held-out scoring ---------------------------------------------------------------------


def fold_backgrounds(
    pixels: DataFrame, blocks: DataFrame, keys: list[str], side: int, halo: int, bands: list[int], width: int, refl: str = "refl"
) -> DataFrame:
    """Background state per held-out block from all pixels outside the block and its halo.

    Pixels fall into classes by the set of folds they must not feed.  Each class is scanned once and a
    fold merges the classes that do not exclude it, so held-out pixels never enter and nothing is subtracted.
    """
    ids = [*keys, "row_i", "col_i"]
    near = halo_cells(pixels.select(*ids), blocks, keys, side, halo)
    out = near.groupBy(*ids).agg(F.array_sort(F.collect_set("fold")).alias("_ex"))
    tagged = pixels.join(out, ids, "left").withColumn("ex", F.concat_ws(",", F.coalesce("_ex", F.array().cast("array<string>"))))
    classes = background_moments(tagged, [*keys, "ex"], bands, width, refl)
    folds = blocks.select(*keys, F.col("block_id").alias("fold"))
    j = classes.join(folds, keys).where(~F.array_contains(F.split("ex", ","), F.col("fold")))
    return merge_moments(j.select(*keys, "fold", "n", "mean", "m2"), [*keys, "fold"])


def strict_fold_scores(
    pixels: DataFrame, blocks: DataFrame, keys: list[str], side: int, halo: int, library, bands: list[int], width: int, ridge: float, pass_through: list[str]
) -> DataFrame:
    """Scores of each block's pixels against the background that never saw it, with status per row."""
    fits = fold_backgrounds(pixels, blocks, keys, side, halo, bands, width)
    b = blocks.select(*keys, "block_row", "block_col", F.col("block_id").alias("fold"))
    held = pixels.withColumn("block_row", F.floor(F.col("row_i") / side).cast("int")).withColumn("block_col", F.floor(F.col("col_i") / side).cast("int"))
    held = held.join(b, [*keys, "block_row", "block_col"])
    return matched_filter_by_key(held, fits, [*keys, "fold"], library, bands, width, ridge, pass_through, F.floor(F.col("row_i") / 64))


def strict_against_full(df: DataFrame, keys: list[str], strict: str, full: str, ref: str = "ref") -> DataFrame:
    """AUC of both scores on their common support and whether the direction against chance is kept."""
    rows = df.where(F.col(strict).isNotNull() & F.col(full).isNotNull() & F.col(ref).isNotNull())
    a = rank_auc(rows, keys, strict, ref).select(*keys, "n_pos", "n_neg", F.col("auc").alias("strict_auc"))
    b = rank_auc(rows, keys, full, ref).select(*keys, F.col("auc").alias("full_auc"))
    j = a.join(b, keys)
    kept = F.signum(F.col("strict_auc") - 0.5) == F.signum(F.col("full_auc") - 0.5)
    return j.select("*", (F.col("strict_auc") - F.col("full_auc")).alias("delta"), kept.alias("direction_preserved"))


# ---- resampled training and product concordance -------------------------------------------------------


def drawn_training(training: DataFrame, keys: list[str], replicates: int, seed) -> DataFrame:
    """Per held-out block and replicate, its training blocks drawn with replacement: adds ``rep, w``."""
    w = Window.partitionBy(*keys, "fold")
    t = training.select(*keys, "fold", "block_id", (F.row_number().over(w.orderBy("block_id")) - 1).alias("idx"), F.count(F.lit(1)).over(w).alias("_n"))
    slots = with_replicates(t.select(*keys, "fold", F.col("idx").alias("slot"), "_n"), replicates)
    d = slots.select(*keys, "fold", "rep", draw_index(F.col("_n"), seed, F.col("fold"), F.col("rep"), F.col("slot")).alias("idx"))
    return d.join(t.select(*keys, "fold", F.col("idx").cast("bigint").alias("idx"), "block_id"), [*keys, "fold", "idx"]).groupBy(*keys, "fold", "rep", "block_id").agg(
        F.count(F.lit(1)).alias("w")
    )


def packet_mismatches(df: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Blocks whose relative footprint differs from the first block's: they cannot be exchanged.

    Footprints compare as (size, order-free digest of offsets).
    """
    at = F.xxhash64(F.col("row_i") % side, F.col("col_i") % side)
    f = df.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(at).alias("_x"), F.sum(at.cast("decimal(38,0)")).alias("_s"))
    first = f.groupBy(*keys).agg(F.min_by(F.struct("n", "_x", "_s"), "block_id").alias("_f"))
    return f.join(first, keys).where(F.struct("n", "_x", "_s") != F.col("_f")).select(*keys, "block_id", "n")


def concordance_bootstrap(df: DataFrame, keys: list[str], depth: str, replicates: int, seed) -> DataFrame:
    """AUC, prevalence and target-only rank correlation per replicate of drawn blocks; slots count as blocks.

    ``df(keys, block_id, score, ref, depth)`` on joint support.
    """
    df = cut(df)
    counts = block_class_counts(df, keys)
    w = block_weights(counts, keys, replicates, seed)
    auc = weighted_auc(pair_numerators(df, keys), counts, w, keys, ["rep"])
    bearing = weighted_rows(counts, w, [*keys, "block_id"]).groupBy(*keys, "rep").agg(
        F.sum(F.when(F.col("n_pos") > 0, F.col("w")).otherwise(0)).alias("positive_blocks"),
        F.sum(F.when(F.col("n_neg") > 0, F.col("w")).otherwise(0)).alias("negative_blocks"),
    )
    t = df.where((F.col("ref") == 1) & F.col("score").isNotNull() & F.col(depth).isNotNull())
    rho = drawn_spearman(t, w, keys, "score", depth)
    return auc.select(*keys, "rep", "auc", "prevalence").join(bearing, [*keys, "rep"]).join(rho.select(*keys, "rep", F.col("rho").alias("spearman")), [*keys, "rep"], "left")


def fixed_threshold_bootstrap(obs: DataFrame, keys: list[str], threshold: float, replicates: int, seed) -> DataFrame:
    """AUC, balanced accuracy and macro F1 at a transferred threshold per replicate of drawn blocks."""
    rows = cut(obs.where(F.col("score").isNotNull() & F.col("ref").isNotNull()).withColumn("pred", (F.col("score") >= threshold).cast("int")))
    counts = block_class_counts(rows, keys)
    w = block_weights(counts, keys, replicates, seed)
    auc = weighted_auc(pair_numerators(rows, keys), counts, w, keys, ["rep"]).select(*keys, "rep", "auc")
    conf = weighted_rows(rows.groupBy(*keys, "block_id").agg(*confusion("pred", "ref")), w, [*keys, "block_id"])
    sums = conf.groupBy(*keys, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "tn", "fn")])
    m = confusion_metrics(zero=None, need_both=True)
    return auc.join(sums.select(*keys, "rep", *[m[n].alias(n) for n in ("balanced_accuracy", "macro_f1")]), [*keys, "rep"])
