"""Decision rules as expressions: ratios, confusion metrics, support tiers, gates, claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import col

# fixed values: support floors and gate limits
EXPLORATORY_BLOCKS = 5
CONFIRMATORY_BLOCKS = 10
STABLE_NEGATIVE = 0.20
STABLE_POSITIVE = 0.80
LOW_POSITIVE_COUNT = 20
RETENTION_FLOOR = 0.80
MEDIAN_RANK_CORRELATION_FLOOR = 0.80
FIFTH_PERCENTILE_FLOOR = 0.50
SWITCH_CEILING = 0.20
CHANCE = 0.5


def ratio(num: Column | str, den: Column | str, zero: float | None = None) -> Column:
    """Quotient in DOUBLE; a zero denominator gives NULL, or ``zero`` when stated."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > 0, n / d).when(d.isNotNull(), F.lit(zero).cast("double"))


def confusion(pred: Column | str, ref: Column | str) -> list[Column]:
    """Aggregates tp, fp, tn, fn over rows with both values."""
    p, r = col(pred), col(ref)
    return [
        F.count_if((p == 1) & (r == 1)).alias("tp"),
        F.count_if((p == 1) & (r == 0)).alias("fp"),
        F.count_if((p == 0) & (r == 0)).alias("tn"),
        F.count_if((p == 0) & (r == 1)).alias("fn"),
    ]


def confusion_metrics(zero: float | None = 0.0, need_both: bool = True) -> dict[str, Column]:
    """Threshold metrics from tp, fp, tn, fn.

    Point estimates use 0 for an empty denominator and need both classes; replicates pass ``zero=None,
    need_both=False`` so an empty denominator stays missing.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ok = ((tp + fn) > 0) & ((fp + tn) > 0) if need_both else F.lit(True)
    tpr, fpr = ratio(tp, tp + fn, zero), ratio(fp, fp + tn, zero)
    pf1 = ratio(2 * tp, 2 * tp + fp + fn, zero)
    nf1 = ratio(2 * tn, 2 * tn + fp + fn, zero)
    out = {
        "balanced_accuracy": F.lit(0.5) * (tpr + F.lit(1.0) - fpr),
        "positive_f1": pf1,
        "negative_f1": nf1,
        "macro_f1": F.lit(0.5) * (pf1 + nf1),
        "tpr": tpr,
        "fpr": fpr,
    }
    return {k: F.when(ok, v) for k, v in out.items()}


def support_tier(positive_blocks: Column | str, negative_blocks: Column | str) -> Column:
    """Tier by the limiting block count."""
    limit = F.least(col(positive_blocks), col(negative_blocks))
    return (
        F.when(limit < EXPLORATORY_BLOCKS, "counts_and_maps_only")
        .when(limit < CONFIRMATORY_BLOCKS, "exploratory_only")
        .otherwise("confirmatory_eligible")
    )


def permits(tier: Column | str) -> dict[str, Column]:
    """What a tier allows: point metrics, intervals, p-values."""
    t = col(tier)
    return {
        "metrics_allowed": t != "counts_and_maps_only",
        "intervals_allowed": t != "counts_and_maps_only",
        "p_values_allowed": t == "confirmatory_eligible",
    }


def confidence_class(frequency: Column | str) -> Column:
    f = col(frequency)
    return (
        F.when(f.isNull(), "nodata")
        .when(f <= STABLE_NEGATIVE, "stable_negative")
        .when(f >= STABLE_POSITIVE, "stable_positive")
        .otherwise("sensitive")
    )


def low_positive_note(old: Column | str, new: Column | str, floor: int = LOW_POSITIVE_COUNT) -> Column:
    a, b = col(old) < floor, col(new) < floor
    return F.when(a & b, "both_low").when(a, "legacy_low").when(b, "corrected_low").otherwise("")


def external_gate(
    positive_blocks: Column, negative_blocks: Column, auc_lower: Column, balanced_lower: Column, auc_double: Column
) -> Column:
    """pass / ranking_only / fail / unavailable from support, interval bounds and the double-scale AUC."""
    supported = F.least(positive_blocks, negative_blocks) >= CONFIRMATORY_BLOCKS
    known = auc_lower.isNotNull() & auc_double.isNotNull()
    ranking = (auc_lower > CHANCE) & (auc_double > CHANCE)
    return (
        F.when(~F.coalesce(supported, F.lit(False)) | ~known, "unavailable")
        .when(~ranking, "fail")
        .when(F.coalesce(balanced_lower > CHANCE, F.lit(False)), "pass")
        .otherwise("ranking_only")
    )


def claim_gate(
    retention: Column, median_rank: Column, fifth_rank: Column, switch_upper: Column, external: list[Column]
) -> Column:
    """All conditions hold; NULL while any required input is missing, whatever the others say."""
    out = (
        (retention >= RETENTION_FLOOR)
        & (median_rank >= MEDIAN_RANK_CORRELATION_FLOOR)
        & (fifth_rank > FIFTH_PERCENTILE_FLOOR)
        & (switch_upper <= SWITCH_CEILING)
    )
    known = retention.isNotNull() & median_rank.isNotNull() & fifth_rank.isNotNull() & switch_upper.isNotNull()
    for e in external:
        out, known = out & (e > CHANCE), known & e.isNotNull()
    return F.when(known, out)


def external_component(auc_lower: Column, balanced_lower: Column, auc_double: Column, confirmatory: Column) -> Column:
    """Both lower bounds at the block scale and the AUC at twice that scale are above chance.

    NULL unless all three intervals exist with confirmatory support.
    """
    known = F.coalesce(confirmatory, F.lit(False)) & auc_lower.isNotNull() & balanced_lower.isNotNull() & auc_double.isNotNull()
    return F.when(known, (auc_lower > CHANCE) & (balanced_lower > CHANCE) & (auc_double > CHANCE))


def pair_gate(spearman_lower: Column, balanced_lower: Column, iou: Column, iou_null_upper: Column) -> dict[str, Column]:
    """Three-part gate of one date pair: ``evaluable`` and ``passed``."""
    known = spearman_lower.isNotNull() & balanced_lower.isNotNull() & iou.isNotNull() & iou_null_upper.isNotNull()
    good = (spearman_lower > 0) & (balanced_lower > CHANCE) & (iou > iou_null_upper)
    return {"evaluable": known, "passed": known & F.coalesce(good, F.lit(False))}


def repeatability_class(n_passed: Column, all_evaluable: Column, n_pairs: Column, expected: int = 4) -> Column:
    """strong / date-dependent / unsupported / unavailable from the gates of the primary pairs."""
    return (
        F.when(n_pairs != expected, F.lit(None))
        .when(n_passed == expected, "strong")
        .when(n_passed >= 1, "date-dependent")
        .when(all_evaluable, "unsupported")
        .otherwise("unavailable")
    )


def public_gate(external_status: Column, repeatability: Column) -> Column:
    """Combined decision of the external-reference gate and the repeatability class."""
    strong, passed = repeatability == "strong", external_status == "pass"
    return (
        F.when((external_status == "unavailable") | (repeatability == "unavailable") | repeatability.isNull(), "unavailable")
        .when(passed & strong, "validated_and_repeatable")
        .when(strong, "stable_only")
        .when(passed, "acquisition_specific")
        .otherwise("failed")
    )


def permitted_claim(stable: Column, external: Column, strict: Column) -> Column:
    """Public-claim category; any missing evidence makes it unavailable."""
    return (
        F.when(stable.isNull() | external.isNull() | strict.isNull(), "unavailable_required_evidence")
        .when(stable & external & strict, "validated_analytically_robust_alteration_zone_discrimination")
        .when(stable & ~external, "analytically_stable_spatial_pattern_only")
        .when(external & ~strict, "operational_discrimination_not_strictly_held_out")
        .when(external & ~stable, "discriminative_but_analytically_sensitive")
        .otherwise("negative_or_unstable_result")
    )


def endpoint_status(
    metric: Column, tier: Column, mapping: Column, interval_ok: Column, null_ok: Column, value: Column, q: Column,
    lower: Column, upper: Column, null_direction: Column,
) -> dict[str, Column]:
    """Inference and claim status of one concordance endpoint."""
    prevalence, counts, explore, broad = metric == "prevalence", tier == "counts_and_maps_only", tier == "exploratory_only", mapping == "broader"
    ready = interval_ok & null_ok & value.isNotNull()
    inference = (
        F.when(prevalence, "descriptive_only").when(counts, "counts_and_maps_only").when(explore, "exploratory_estimate_only")
        .when(broad & ready & q.isNotNull(), "secondary_inference_available").when(broad, "secondary_inference_unavailable")
        .when(~ready, "inference_unavailable").otherwise("confirmatory_eligible")
    )
    claim = (
        F.when(prevalence, "descriptive_prevalence").when(counts, "no_inferential_claim").when(explore, "no_confirmatory_claim")
        .when(broad, "secondary_endpoint_no_confirmatory_claim").when(~ready, "no_confirmatory_claim")
        .when(F.coalesce(lower > null_direction, F.lit(False)), "confirmatory_concordance_supported")
        .when(F.coalesce(upper < null_direction, F.lit(False)), "confirmatory_reversed_result")
        .otherwise("confirmatory_concordance_not_supported")
    )
    return {"inference_status": inference, "claim_status": claim}


def global_status(inference: Column, claim: Column) -> dict[str, Column]:
    """Aggregates: the strongest result over all endpoints."""
    has = F.bool_or
    supported, reversed_ = has(claim == "confirmatory_concordance_supported"), has(claim == "confirmatory_reversed_result")
    eligible, second = has(inference == "confirmatory_eligible"), has(inference == "secondary_inference_available")
    explore, counts = has(inference == "exploratory_estimate_only"), has(inference == "counts_and_maps_only")
    status = (
        F.when(supported | reversed_ | eligible, "confirmatory_result_available").when(second, "secondary_only")
        .when(explore, "exploratory_only").when(counts, "counts_and_maps_only").otherwise("unavailable")
    )
    claims = (
        F.when(supported, "confirmatory_concordance_supported").when(reversed_, "confirmatory_reversed_result")
        .when(eligible, "confirmatory_concordance_not_supported").when(second | explore, "no_confirmatory_claim")
        .otherwise("no_inferential_claim")
    )
    return {"status": status, "claim": claims}


# fixed values: endpoint roles by (site, family, layer)
ENDPOINT_ROLES = [
    ("goldfield", "feature", "al_oh_doublet", "primary"),
    ("goldfield", "feature", "gypsum_carbonate", "key_secondary"),
    ("goldfield", "mtmf", "alunite", "key_secondary"),
    ("goldfield", "mtmf", "muscovite", "key_secondary"),
    ("bingham", "feature", "gypsum_carbonate", "key_secondary"),
]
DESCRIPTIVE_LAYER = "jarosite"


def endpoint_role(site: Column, family: Column, layer: Column) -> Column:
    out = F.when(layer == DESCRIPTIVE_LAYER, "descriptive").otherwise("exploratory")
    for s, f, n, role in reversed(ENDPOINT_ROLES):
        out = F.when((site == s) & (family == f) & (layer == n), role).otherwise(out)
    return out


def decision_checks(tier: Column, interval_lower: Column, direction: Column) -> dict[str, Column]:
    """Aggregates over the comparison rows of a decision: support, intervals above zero, a positive direction."""
    support = F.bool_and(tier == "confirmatory_eligible")
    interval = F.bool_and(F.coalesce(interval_lower > 0, F.lit(False)))
    positive = F.bool_or(F.coalesce(direction > 0, F.lit(False)))
    return {"support_ok": support, "interval_ok": interval, "direction_ok": positive, "gate_passed": support & interval & positive}
