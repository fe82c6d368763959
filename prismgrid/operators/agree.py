"""Agreement between a score and a reference, between two maps and between result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import confusion, confusion_metrics, low_positive_note, ratio, support_tier
from . import stats


def _upper_normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution.

    Up to 3 a power series, beyond it a continued fraction read from the inside; 80 terms of either reach the
    precision of doubles.
    """
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    terms = F.sequence(F.lit(1), F.lit(80))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * x * x * 2.0 / (k * 2 + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(terms, start, step)["total"]
    inner = F.aggregate(F.reverse(terms), x, lambda f, k: x + k / 2.0 / f)
    bell = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    upper = F.when(x < 3, 0.5 - series * bell).otherwise(0.5 * bell / inner)
    return F.when(z < 0, 1.0 - upper).otherwise(upper)


def u_test_greater(auc_rows: DataFrame) -> DataFrame:
    """One-sided asymptotic p-value of U ("positives score higher"), tie and continuity corrected.

    Takes the rows of ``stats.rank_auc`` (one per layer).
    """
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1.0) - F.col("tie_sum") / F.nullif(n * (n - 1.0), F.lit(0.0)))
    z = (F.col("u") - n1 * n2 / 2.0 - 0.5) / F.sqrt(var)
    return auc_rows.withColumn("p_value", _upper_normal_tail(F.when(var > 0, z)))


def grid_youden(
    df: DataFrame, keys: list[str], score: str = "score", ref: str = "ref", n_thresholds: int = 512
) -> DataFrame:
    """Best Youden J of ``score >= t`` on an even grid from minimum to maximum; lowest threshold on ties.

    A histogram over grid cells replaces the sort, so only ``n_thresholds`` rows per key meet in a window.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(ref).isNotNull()).select(*keys, F.col(score).alias("_s"), F.col(ref).alias("_r"))
    lim = rows.groupBy(*keys).agg(
        F.min("_s").alias("_lo"),
        F.max("_s").alias("_hi"),
        F.count_if(F.col("_r") == 1).alias("_p"),
        F.count_if(F.col("_r") == 0).alias("_n"),
    ).where("_p > 0 AND _n > 0")
    last = n_thresholds - 1
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(last))

    def at(k: Column) -> Column:
        return F.when(k >= last, F.col("_hi")).otherwise(F.col("_lo") + k * step)

    guess = F.least(F.lit(last), F.floor((F.col("_s") - F.col("_lo")) / step))
    cell = (
        F.when(at(guess) > F.col("_s"), guess - 1)
        .when((guess < last) & (at(guess + 1) <= F.col("_s")), guess + 1)
        .otherwise(guess)
    )
    hist = (
        stats.attach(rows, lim.where("_hi > _lo"), keys)
        .groupBy(*keys, "_lo", "_hi", "_p", "_n", cell.cast("int").alias("_k"))
        .agg(F.count_if(F.col("_r") == 1).alias("_cp"), F.count_if(F.col("_r") == 0).alias("_cn"))
    )
    # a threshold between two filled cells keeps the counts of the next filled cell; the lowest one wins
    up = Window.partitionBy(*keys).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    prev = Window.partitionBy(*keys).orderBy("_k")
    h = hist.withColumn("_tp", F.sum("_cp").over(up)).withColumn("_fp", F.sum("_cn").over(up))
    k_low = F.coalesce(F.lag("_k").over(prev) + 1, F.lit(0))
    h = h.withColumn("tpr", F.col("_tp") / F.col("_p")).withColumn("fpr", F.col("_fp") / F.col("_n"))
    h = h.withColumn("_t", at(k_low)).withColumn("_j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = F.max_by(F.struct("_t", "tpr", "fpr", "_j"), F.struct(F.col("_j"), -F.col("_t")))
    found = h.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b._t").alias("threshold"), "b.tpr", "b.fpr", F.col("b._j").alias("youden_j")
    )
    flat = lim.where("_hi <= _lo").select(
        *keys, F.col("_lo").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("youden_j")
    )
    return found.unionByName(flat)


def discrimination(df: DataFrame, keys: list[str], score: str = "score", ref: str = "ref") -> DataFrame:
    """One row per layer with both classes: counts, AUC, U, p-value, group medians, Youden operating point."""
    auc = u_test_greater(stats.rank_auc(df, keys, score, ref).where("n_pos > 0 AND n_neg > 0"))
    med = stats.exact_quantiles(
        df.where(F.col(ref).isNotNull()), [*keys, ref], score, {"median": 0.5}
    ).groupBy(*keys).agg(
        F.max(F.when(F.col(ref) == 1, F.col("median"))).alias("median_in"),
        F.max(F.when(F.col(ref) == 0, F.col("median"))).alias("median_out"),
    )
    return stats.attach(stats.attach(auc.drop("tie_sum"), med, keys), grid_youden(df, keys, score, ref), keys)


def pooled_metrics(
    df: DataFrame, keys: list[str], score: str = "score", ref: str = "ref", pred: str = "pred"
) -> DataFrame:
    """AUC over all paired rows; threshold metrics over rows that have a prediction and both classes."""
    auc = stats.rank_auc(df, keys, score, ref).drop("u", "tie_sum")
    conf = df.where(F.col(pred).isNotNull() & F.col(ref).isNotNull()).groupBy(*keys).agg(*confusion(pred, ref))
    j = stats.attach(auc, conf, keys, "left")
    return j.select(
        *auc.columns,
        ratio("n_pos", F.col("n_pos") + F.col("n_neg"), 0.0).alias("prevalence"),
        *["tp", "fp", "tn", "fn"],
        *[v.alias(k) for k, v in confusion_metrics().items()],
    )


def overlap_counts(a: str, b: str) -> list[Column]:
    """Sufficient counts of two 0/1 maps over jointly present cells."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    return [
        F.count_if(both & (x == 1) & (y == 1)).alias("n_both"),
        F.count_if(both & ((x == 1) | (y == 1))).alias("n_either"),
        F.count_if(both & (x == 1)).alias("n_anchor"),
        F.count_if(both & (y == 1)).alias("n_repeat"),
    ]


def overlap_ratios(df: DataFrame) -> DataFrame:
    """IoU, Dice and prevalence ratio from the counts; empty against empty is undefined."""
    return (
        df.withColumn("iou", ratio("n_both", "n_either"))
        .withColumn("dice", ratio(2 * F.col("n_both"), F.col("n_anchor") + F.col("n_repeat")))
        .withColumn("prevalence_ratio", ratio("n_repeat", "n_anchor"))
    )


def binary_overlap(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return overlap_ratios(df.groupBy(*keys).agg(*overlap_counts(a, b)))


def endpoint_metrics(
    df: DataFrame, keys: list[str], score: str, ident: str, depth: str, block: str, support: Column, targets: list[int]
) -> DataFrame:
    """AUC, prevalence, bearing blocks and target-only rank correlation on one joint support."""
    s = df.where(support).withColumn("_ref", F.col(ident).isin(targets).cast("int"))
    auc = stats.rank_auc(s, keys, score, "_ref")
    blocks = s.groupBy(*keys, block).agg(F.max("_ref").alias("_p"), (1 - F.min("_ref")).alias("_n")).groupBy(*keys).agg(
        F.sum("_p").alias("positive_blocks"), F.sum("_n").alias("negative_blocks")
    )
    target = s.where(F.col("_ref") == 1)
    rho = stats.spearman(target, keys, score, depth).select(*keys, F.col("n").alias("spearman_n"), "rho")
    j = stats.attach(stats.attach(auc, blocks, keys), rho, keys, "left")
    n = F.coalesce("spearman_n", F.lit(0))
    return j.select(
        *keys,
        (F.col("n_pos") + F.col("n_neg")).alias("joint_support_n"),
        "n_pos",
        "n_neg",
        "auc",
        ratio("n_pos", F.col("n_pos") + F.col("n_neg")).alias("prevalence"),
        "positive_blocks",
        "negative_blocks",
        support_tier("positive_blocks", "negative_blocks").alias("tier"),
        F.when(F.col("auc").isNull(), "auc_requires_both_classes").alias("auc_reason"),
        F.col("rho").alias("spearman"),
        n.alias("spearman_n"),
        F.when(n < 2, "spearman_requires_two_target_cells")
        .when(F.col("rho").isNull(), "spearman_undefined_for_constant_input")
        .alias("spearman_reason"),
    )


def compare_rasters(
    a: DataFrame, b: DataFrame, cell: list[str], keys: list[str], value: str, categorical: bool = False
) -> DataFrame:
    """Validity overlap of two rasters on one grid, with error metrics or categorical agreement."""
    j = a.select(*cell, F.col(value).alias("_a")).join(b.select(*cell, F.col(value).alias("_b")), cell, "full")
    va, vb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    diff = F.col("_b") - F.col("_a")
    aggs = [
        F.count_if(va).alias("legacy_valid"),
        F.count_if(vb).alias("corrected_valid"),
        F.count_if(va & vb).alias("overlap"),
        F.count_if(va & ~vb).alias("newly_excluded"),
        F.count_if(~va & vb).alias("newly_included"),
        F.count_if(va | vb).alias("_union"),
    ]
    if categorical:
        aggs.append(F.count_if(F.col("_a") == F.col("_b")).alias("agreement"))
    else:
        aggs += [
            stats.pearson("_a", "_b", 2).alias("pearson_r"),
            F.avg(F.abs(diff)).alias("mae"),
            F.sqrt(F.avg(diff * diff)).alias("rmse"),
        ]
    out = (
        j.groupBy(*keys)
        .agg(*aggs)
        .withColumn("retained_fraction", ratio("overlap", "legacy_valid"))
        .withColumn("jaccard", ratio("overlap", "_union"))
        .drop("_union")
    )
    return out.withColumn("agreement_fraction", ratio("agreement", "overlap")) if categorical else out


def distribution_rows(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per category and field: present and missing counts, minimum, median, maximum."""
    long = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")
    ).select(*keys, "x.field", "x.value")
    by = [*keys, "field"]
    counts = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("category_count"),
        F.count("value").alias("finite_count"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    med = stats.exact_quantiles(long, by, "value", {"median": 0.5}).drop("n")
    return (
        counts.join(med, by, "left")
        .withColumn("missing_count", F.col("category_count") - F.col("finite_count"))
        .withColumn("missing_fraction", ratio("missing_count", "category_count"))
    )


def compare_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Same-key comparison of two validation tables: deltas, class-set match and low-count note."""
    names = ["positive_classes", "auc", "threshold", "n_pos", "n_neg"]
    j = old.select(*keys, *[F.col(c).alias(f"legacy_{c}") for c in names]).join(
        new.select(*keys, *[F.col(c).alias(f"corrected_{c}") for c in names]), keys
    )
    deltas = [(F.col(f"corrected_{c}") - F.col(f"legacy_{c}")).alias(f"{c}_delta") for c in names[1:]]
    return j.select(
        "*",
        *deltas,
        (F.col("legacy_positive_classes") == F.col("corrected_positive_classes")).alias("positive_classes_match"),
        low_positive_note("legacy_n_pos", "corrected_n_pos").alias("n_pos_note"),
    )


def key_inventory(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only or in both: ``keys, presence``."""
    a = old.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_b").isNull(), "legacy_only").when(F.col("_a").isNull(), "corrected_only").otherwise("shared")
    return a.join(b, keys, "full").select(*keys, where.alias("presence"))


def extreme_row(df: DataFrame, keys: list[str], field: str, name: str, largest: bool = True, absolute: bool = False) -> DataFrame:
    """The row with the extreme populated metric; the smaller name wins ties."""
    v = F.abs(F.col(field)) if absolute else F.col(field)
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    order = F.struct(-v if largest else v, F.col(name))
    best = df.where(F.col(field).isNotNull()).groupBy(*keys).agg(F.min_by(row, order).alias("_r"))
    return best.select(*keys, "_r.*")


def validity_patterns(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Result rows with identical keys and counts collapsed, with the number and list of layers."""
    counts = ["legacy_valid", "corrected_valid", "newly_excluded", "newly_included", "overlap"]
    return rows.groupBy(*keys, *counts).agg(
        F.count(F.lit(1)).alias("n_layers"), F.array_join(F.array_sort(F.collect_set(name)), ";").alias("layers")
    )
