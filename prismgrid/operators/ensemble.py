"""Analytical ensembles: designs, member maps, frequencies, nested bootstraps, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import block_weights, hash_int, weighted_rows
from ..functions.rules import confidence_class, confusion, confusion_metrics, ratio, support_tier
from ..session import cut
from .inference import governed_interval
from .resample import block_class_counts, bootstrap_metrics, drawn_spearman, long_metrics
from .stats import rank_auc, top_rows

# fixed values: the frozen design axes
RIDGES = [0.001, 0.01, 0.1]
QUANTILES = [0.85, 0.90, 0.95]
GATES = [1.0, None]
REPLICATES = 16
BASE_RIDGE, BASE_QUANTILE, BASE_GATE = 0.01, 0.90, 1.0
MIN_INTERVAL_BLOCKS = 2
EXTERNAL_METRICS = ["auc", "balanced_accuracy", "positive_f1", "negative_f1", "macro_f1", "tpr", "fpr", "prevalence"]


def balanced_schedule(library: DataFrame, replicates: int, seed, key: str = "mineral", sample: str = "sample") -> DataFrame:
    """One sample per mineral and replicate: equal base counts, the remainder and the order by hash.

    Use frequencies of two samples of a mineral differ by at most one.
    """
    lib = library.select(key, sample).distinct()
    size = lib.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    lot = hash_int(seed, F.col(key), F.col(sample))
    # never more than ``replicates`` extras, so the ranking is a bounded top-k
    extra = top_rows(lib.withColumn("_lot", lot), [key], [F.col("_lot")], [sample], replicates).join(size, key)
    extra = extra.where(F.col("rank") <= replicates % F.col("_n")).select(key, sample, F.lit(-1).alias("_copy"))
    base = lib.join(size, key).where(F.col("_n") <= replicates)
    base = base.select(key, sample, F.explode(F.sequence(F.lit(1), F.floor(F.lit(replicates) / F.col("_n")).cast("int"))).alias("_copy"))
    items = base.unionByName(extra)
    w = Window.partitionBy(key).orderBy(hash_int(seed, F.lit("o"), F.col(key), F.col(sample), F.col("_copy")), sample, "_copy")
    return items.select((F.row_number().over(w) - 1).alias("replicate"), key, sample)


def build_design(sites: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """All members per site: baseline, three single axes, the analytical grid, and axes times grid.

    Members that score alike share a ``fit_id``; the gate ``none`` means ungated.
    """
    grid = F.array(*[
        F.struct(F.lit(r).alias("ridge"), F.lit(q).alias("quantile"), F.lit(g).cast("double").alias("gate"))
        for r in RIDGES for q in QUANTILES for g in GATES
    ])
    base = F.array(F.struct(F.lit(BASE_RIDGE).alias("ridge"), F.lit(BASE_QUANTILE).alias("quantile"), F.lit(BASE_GATE).alias("gate")))
    reps = F.sequence(F.lit(0), F.lit(replicates - 1))
    none = F.array(F.lit(None).cast("int"))
    kinds = F.array(*[
        F.struct(F.lit(n).alias("member_class"), r.alias("reps"), g.alias("cells"), F.lit(cov).alias("covariance_mode"), F.lit(cal).alias("calibration_mode"), F.lit(em).alias("endmember_mode"))
        for n, r, g, cov, cal, em in (
            ("baseline", none, base, "full_scene", "full_scene", "medoid"),
            ("endmember_only", reps, base, "full_scene", "full_scene", "drawn"),
            ("covariance_only", reps, base, "bootstrap_blocks", "full_scene", "medoid"),
            ("calibration_only", reps, base, "full_scene", "bootstrap_blocks", "medoid"),
            ("analytical_grid", none, grid, "full_scene", "full_scene", "medoid"),
            ("joint", reps, grid, "bootstrap_blocks", "bootstrap_blocks", "drawn"),
        )
    ])
    m = sites.select("site", F.explode(kinds).alias("k")).select("site", "k.*")
    m = m.select("*", F.explode("reps").alias("replicate")).select("*", F.explode("cells").alias("c"))
    num = lambda c: F.format_string("%.3f", c)
    gate = F.coalesce(num(F.col("c.gate")), F.lit("none"))
    tag = F.concat_ws(":", "site", "member_class", F.coalesce(F.format_string("r%02d", "replicate"), F.lit("-")), num(F.col("c.ridge")), num(F.col("c.quantile")), gate)
    # the fit depends on covariance draw, endmembers and ridge only
    drawn = (F.col("covariance_mode") != "full_scene") | (F.col("endmember_mode") != "medoid")
    fit = F.when(
        drawn, F.concat_ws(":", "site", "covariance_mode", "endmember_mode", F.format_string("r%02d", "replicate"), num(F.col("c.ridge")))
    ).otherwise(F.concat_ws(":", "site", F.lit("full"), num(F.col("c.ridge"))))
    return m.select(
        "site", tag.alias("member_id"), "member_class", "replicate", fit.alias("fit_id"), F.col("c.ridge").alias("ridge"),
        F.col("c.quantile").alias("quantile"), F.col("c.gate").alias("gate"), "covariance_mode", "calibration_mode", "endmember_mode",
    )


def member_frequency(members: DataFrame, pixel: list[str]) -> DataFrame:
    """Detections over valid members per pixel; failed or missing members are never negatives."""
    out = members.groupBy(*pixel).agg(
        F.sum(F.when(F.col("valid") & F.col("detected"), 1).otherwise(0)).alias("n_detected"), F.count_if("valid").alias("n_valid")
    )
    f = out.withColumn("frequency", ratio("n_detected", "n_valid"))
    return f.withColumn("confidence", confidence_class("frequency"))


def dominant_summary(members: DataFrame, pixel: list[str], n_classes: int, baseline: Column) -> DataFrame:
    """Modal class, its frequency, normalised entropy and switch frequency over members.

    ``code`` is a class index, -1 for none and -2 for no support; ``baseline`` marks the baseline rows.
    """
    valid = F.col("code") >= -1
    base = F.max(F.when(baseline, F.col("code")))
    h = members.where(valid & ~baseline).groupBy(*pixel, "code").agg(F.count(F.lit(1)).alias("c"))
    b = members.groupBy(*pixel).agg(base.alias("_base"))
    tot = h.groupBy(*pixel).agg(
        F.sum("c").alias("n_valid"),
        F.max_by("code", F.struct(F.col("c"), -F.col("code"))).alias("modal_class"),
        F.max("c").alias("_top"),
        F.sum(F.col("c") * F.log("c")).alias("_clogc"),
        F.collect_list(F.struct("code", "c")).alias("_h"),
    )
    j = b.join(tot, pixel, "left")
    n = F.col("n_valid")
    same = F.aggregate(F.filter("_h", lambda e: e["code"] == F.col("_base")), F.lit(0).cast("bigint"), lambda s, e: s + e["c"])
    return j.select(
        *pixel,
        F.coalesce("modal_class", F.lit(-2)).alias("modal_class"),
        ratio("_top", n).alias("modal_frequency"),
        ((F.log(n) - F.col("_clogc") / n) / F.log(F.lit(float(n_classes + 1)))).alias("entropy"),
        F.when((F.col("_base") >= -1) & (n > 0), (n - same) / n).alias("switch_frequency"),
        F.coalesce(n, F.lit(0)).alias("n_valid"),
    )


def area_fractions(freq: DataFrame, keys: list[str], baseline_detected: Column) -> DataFrame:
    """Numerators and denominators per block: stable positive, stable negative, core retention."""
    on = F.col("n_valid") > 0
    pos, neg = F.col("confidence") == "stable_positive", F.col("confidence") == "stable_negative"
    return freq.groupBy(*keys).agg(
        F.count_if(on).alias("n_valid_pixels"),
        F.count_if(on & pos).alias("n_stable_positive"),
        F.count_if(on & neg).alias("n_stable_negative"),
        F.count_if(on & baseline_detected).alias("n_core"),
        F.count_if(on & baseline_detected & pos).alias("n_core_retained"),
    )


def member_block_metrics(members: DataFrame, baseline: DataFrame, pixel: list[str], by: list[str], block: str = "block_id") -> DataFrame:
    """Support, support loss, prevalence, rank correlation and class switch per member and block.

    ``members(pixel, by.., block, score, valid, detected)``, ``baseline(pixel, score0, valid0, detected0)``.  Ranks are
    taken by windows inside one member's block, which its side bounds, so counts and correlation come from one pass.
    """
    keys = [*by, block]
    both = F.col("valid") & F.col("valid0")
    ranked = both & F.col("score").isNotNull() & F.col("score0").isNotNull()
    j = members.join(baseline, pixel).select(
        *keys, "valid", "valid0", "detected", "detected0", F.when(ranked, F.col("score")).alias("_x"), F.when(ranked, F.col("score0")).alias("_y")
    )

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(c)
        upto = F.count(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tied = F.count(c).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return F.when(F.col(c).isNotNull(), upto - (tied - 1) / 2.0)

    r = j.withColumn("_a", rank("_x")).withColumn("_b", rank("_y"))
    a, b = F.col("_a"), F.col("_b")
    m = r.groupBy(*keys).agg(
        F.count_if("valid").alias("n_valid"),
        F.count_if("valid0").alias("n_base"),
        F.count_if(both).alias("n_joint"),
        F.count_if(F.col("valid") & F.col("detected")).alias("n_detected"),
        F.count_if(both & (F.col("detected") != F.col("detected0"))).alias("n_switched"),
        F.count(a).alias("_n"), F.sum(a).alias("_sa"), F.sum(b).alias("_sb"), F.sum(a * a).alias("_saa"), F.sum(b * b).alias("_sbb"), F.sum(a * b).alias("_sab"),
    )
    n = F.col("_n")
    va, vb = (F.col(f"_s{c}{c}") - F.col(f"_s{c}") * F.col(f"_s{c}") / n for c in "ab")
    cov = F.col("_sab") - F.col("_sa") * F.col("_sb") / n
    rho = F.when((n >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va) / F.sqrt(vb))
    return m.select(
        *keys, "n_valid", "n_base", "n_joint", "n_detected", "n_switched",
        (F.lit(1.0) - ratio("n_joint", "n_base")).alias("support_loss"), ratio("n_detected", "n_valid").alias("prevalence"),
        rho.alias("rank_correlation"), ratio("n_switched", "n_joint").alias("switch_fraction"),
    )


def nested_interval(values: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """Median over members within each replicate, then the governed interval; needs two blocks.

    ``values(keys, rep, member, n_blocks, value)``; members are the rows of a finite design.
    """
    per = cut(values.groupBy(*keys, "rep").agg(F.percentile("value", 0.5).alias("summary"), F.max("n_blocks").alias("_nb")))
    ci = governed_interval(per, keys, "summary", replicates)
    nb = per.groupBy(*keys).agg(F.max("_nb").alias("n_blocks"))
    few = F.col("n_blocks") < MIN_INTERVAL_BLOCKS
    return ci.join(nb, keys).select(
        *keys, "n_blocks", "valid_replicates",
        *[F.when(~few, F.col(c)).alias(c) for c in ("lower", "upper")],
        F.when(few, "fewer_than_2_complete_blocks").otherwise(F.col("reason")).alias("reason"),
    )


def nested_ratio(counts: DataFrame, keys: list[str], replicates: int, seed, member: str = "member", block: str = "block_id") -> DataFrame:
    """Pooled ratio of every member under one shared block draw per replicate.

    ``counts(keys, member, block, num, den)``; members of a key share their blocks.  Counts are read several times and
    mostly come from all pixels of the members, so they are materialised.
    """
    counts = cut(counts.select(*keys, member, block, "num", "den"))
    blocks = counts.select(*keys, block).distinct()
    w = block_weights(blocks, keys, replicates, seed, block)
    nb = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    sums = weighted_rows(counts, w, [*keys, block]).groupBy(*keys, "rep", member).agg(
        F.sum(F.col("num") * F.col("w")).alias("_a"), F.sum(F.col("den") * F.col("w")).alias("_b")
    )
    return sums.join(nb, keys).select(*keys, "rep", member, "n_blocks", ratio("_a", "_b").alias("value"))


def nested_mean(values: DataFrame, keys: list[str], replicates: int, seed, member: str = "member", block: str = "block_id") -> DataFrame:
    """Mean of every member's block values under one shared block draw per replicate; missing blocks do not count.

    ``values(keys, member, block, value)``.
    """
    present = F.col("value").isNotNull().cast("int")
    return nested_ratio(values.withColumn("num", F.coalesce("value", F.lit(0.0))).withColumn("den", present), keys, replicates, seed, member, block)


def nested_external_intervals(oof: DataFrame, keys: list[str], replicates: int, seed, member: str = "member") -> DataFrame:
    """Eight metrics of an ensemble against a reference: median over members, with a nested block interval and its support.

    ``oof(keys, member, block_id, score, ref, pred)`` of a cross-fit.  Members share their blocks, and draws are functions
    of block numbers, so one draw serves all members; the median over members is taken inside each replicate.  The
    point estimate is the median of the members' own metrics.  Support is that of the member with the fewest bearing blocks.
    """
    by = [*keys, member]
    oof = cut(oof.select(*by, "block_id", "score", "ref", "pred"))
    reps = long_metrics(bootstrap_metrics(oof, by, replicates, seed), [*by, "rep"], EXTERNAL_METRICS)
    per = reps.groupBy(*keys, "metric", "rep").agg(F.percentile("value", 0.5).alias("summary"))
    ci = governed_interval(per, [*keys, "metric"], "summary", replicates)

    auc = rank_auc(oof, by).select(*by, "auc", ratio("n_pos", F.col("n_pos") + F.col("n_neg")).alias("prevalence"))
    conf = oof.where(F.col("pred").isNotNull()).groupBy(*by).agg(*confusion("pred", "ref"))
    own = auc.join(conf.select(*by, *[v.alias(k) for k, v in confusion_metrics(zero=None, need_both=False).items()]), by, "left")
    point = long_metrics(own, by, EXTERNAL_METRICS).groupBy(*keys, "metric").agg(F.percentile("value", 0.5).alias("point_estimate"))

    blocks = block_class_counts(oof, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_pos") > 0).alias("p"), F.count_if(F.col("n_neg") > 0).alias("q")
    )
    support = blocks.groupBy(*keys).agg(
        F.min("n").alias("complete_blocks"), F.min("p").alias("positive_blocks"), F.min("q").alias("negative_blocks")
    ).withColumn("support_tier", support_tier("positive_blocks", "negative_blocks"))
    few = F.col("complete_blocks") < MIN_INTERVAL_BLOCKS
    return ci.join(point, [*keys, "metric"], "left").join(support, keys).select(
        *keys, "metric", "point_estimate", *[F.when(~few, F.col(c)).alias(c) for c in ("lower", "upper")], "valid_replicates",
        "complete_blocks", "positive_blocks", "negative_blocks", "support_tier",
        F.when(few, "fewer_than_2_complete_blocks").otherwise(F.col("reason")).alias("reason"),
    )


def nested_spearman(pairs: DataFrame, keys: list[str], x: str, y: str, replicates: int, seed, member: str = "member", block: str = "block_id") -> DataFrame:
    """Rank correlation of every member under one shared block draw per replicate."""
    blocks = pairs.select(*keys, block).distinct()
    w = block_weights(blocks, keys, replicates, seed, block)
    nb = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    p = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # the members of a key share its draws
    own = w.join(p.select(*keys, member).distinct(), keys)
    rho = drawn_spearman(p, own, [*keys, member], x, y, block)
    return rho.join(nb, keys).select(*keys, "rep", member, "n_blocks", F.col("rho").alias("value"))


def calibration_table(df: DataFrame, keys: list[str], freq: str, ref: str, replicates: int, seed, block: str = "block_id") -> DataFrame:
    """Ten fixed bins (last one closed): positive rate, Brier score and calibration error with block intervals.

    Everything follows from sums per (block, bin).
    """
    rows = df.where(F.col(freq).isNotNull() & F.col(ref).isNotNull())
    b = F.least(F.lit(9), F.floor(F.col(freq) * 10.0)).cast("int")
    err = (F.col(freq) - F.col(ref)) * (F.col(freq) - F.col(ref))
    suff = rows.groupBy(*keys, block, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ref).alias("obs"), F.sum(freq).alias("pred"), F.sum(err).alias("err")
    )
    blocks = suff.select(*keys, block).distinct()
    w = block_weights(blocks, keys, replicates, seed, block)
    nb = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))

    def tally(rows: DataFrame, by: list[str], mult: Column) -> DataFrame:
        per_bin = rows.groupBy(*by, "bin").agg(*[F.sum(F.col(c) * mult).alias(c) for c in ("n", "obs", "pred", "err")])
        return per_bin.withColumn("rate", F.col("obs") / F.col("n"))

    def overall(per_bin: DataFrame, by: list[str]) -> DataFrame:
        n = F.sum("n")
        gap = F.sum(F.col("n") * F.abs(F.col("obs") / F.col("n") - F.col("pred") / F.col("n")))
        return per_bin.groupBy(*by).agg((F.sum("err") / n).alias("brier"), (gap / n).alias("ece"))

    boot = tally(weighted_rows(suff, w, [*keys, block]), [*keys, "rep"], F.col("w"))
    point = tally(suff, keys, F.lit(1)).join(suff.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("support_blocks")), [*keys, "bin"])
    total, boot_total = overall(point, keys), overall(boot, [*keys, "rep"])

    def ci(reps: DataFrame, by: list[str], v: str) -> DataFrame:
        g = governed_interval(reps, by, v, replicates).join(nb, keys)
        ok = F.col("n_blocks") >= MIN_INTERVAL_BLOCKS
        return g.select(*by, *[F.when(ok, F.col(s)).alias(f"{v}_{s}") for s in ("lower", "upper")])

    bins = nb.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    out = bins.join(point.select(*keys, "bin", F.col("n").alias("support_pixels"), "support_blocks", "rate"), [*keys, "bin"], "left")
    out = out.join(ci(boot, [*keys, "bin"], "rate"), [*keys, "bin"], "left")
    out = out.join(total, keys).join(ci(boot_total, keys, "brier"), keys).join(ci(boot_total, keys, "ece"), keys)
    return out.withColumn("status", F.when(F.col("support_pixels").isNull(), "empty_fixed_bin").otherwise("complete")).na.fill(0, ["support_pixels", "support_blocks"])


def factor_contrasts(rows: DataFrame, keys: list[str], factors: dict[str, float], value: str = "value") -> DataFrame:
    """Each row against the row at the reference level of one factor, all other factors equal.

    ``rows(keys, <factors>, value)``; exactly one counterpart is required, others drop out.  Returns
    ``keys, factor, <factors>, reference_value, value, effect``.
    """
    out = None
    names = list(factors)
    for f, ref in factors.items():
        others = [n for n in names if n != f]
        base = rows.where(F.col(f) == ref).groupBy(*keys, *others).agg(F.count(F.lit(1)).alias("_k"), F.first(value).alias("reference_value")).where("_k = 1").drop("_k")
        part = rows.where(F.col(f) != ref).join(base, [*keys, *others]).select(
            *keys, F.lit(f).alias("factor"), *names, "reference_value", value, (F.col(value) - F.col("reference_value")).alias("effect")
        )
        out = part if out is None else out.unionByName(part)
    return out
