"""Detection floors, dominant classes, ordinal tiers and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import col
from ..session import cut
from .drawn import counted_above, drawn_quantile, packed_values
from .stats import exact_quantiles, top_rows

# fixed values: indicator minerals of the ordinal tier, most acidic first
TIER_HIGH = ["jarosite"]
TIER_MODERATE = ["goethite", "hematite"]
TIER_LOW = ["gypsum"]
TIER_NAMES = {0: "background", 1: "low", 2: "moderate", 3: "high"}


def detection_floors(scores: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Quantile ``q`` of the positive values per key (``floor``); NULL where there is no usable floor."""
    floors = exact_quantiles(scores.where(F.col(value) > 0), keys, value, {"floor": q})
    return floors.select(*keys, "n", F.when(F.col("floor") > 0, F.col("floor")).alias("floor"))


def detections(scores: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Every row with its floor, ``present`` (value at or above the floor) and ``strength``."""
    j = scores.join(detection_floors(scores, keys, value, q).drop("n"), keys, "left")
    present = F.coalesce(F.col(value) >= F.col("floor"), F.lit(False))
    return j.withColumn("present", present).withColumn("strength", F.when(present, F.col(value) / F.col("floor")))


def dominant_class(strengths: Column | str) -> Column:
    """Index of the largest strength of an array (first on tie), -1 when none is present."""
    s = col(strengths)
    best = F.array_max(s)
    return F.when(best.isNotNull(), F.array_position(s, best).cast("int") - 1).otherwise(F.lit(-1))


def dominant_rows(
    detected: DataFrame, pixel: list[str], order: str, strength: str = "strength", nodata: Column | None = None
) -> DataFrame:
    """Dominant layer per pixel from long rows; ``order`` is the integer layer position.

    ``code`` is -1 without detection; with ``nodata`` (a condition on rows) it is -2 if any layer lacks support.
    """
    best = F.max_by(F.col(order), F.when(F.col(strength).isNotNull(), F.struct(F.col(strength), -F.col(order))))
    out = detected.groupBy(*pixel).agg(
        best.alias("_best"),
        F.max(strength).alias("strength"),
        F.bool_or(nodata if nodata is not None else F.lit(False)).alias("_gap"),
    )
    code = F.when(F.col("_gap"), F.lit(-2)).otherwise(F.coalesce(F.col("_best"), F.lit(-1)))
    return out.select(*pixel, code.cast("int").alias("code"), "strength")


def ordinal_tier(present: DataFrame, pixel: list[str], layer: str, domain: Column) -> DataFrame:
    """Tier 3 / 2 / 1 / 0 from presence rows per pixel; NULL where the domain condition never holds."""
    def any_of(names: list[str]) -> Column:
        return F.bool_or(F.col("present") & F.col(layer).isin(names))

    flags = present.groupBy(*pixel).agg(
        F.bool_or(domain).alias("_dom"),
        any_of(TIER_HIGH).alias("_3"),
        any_of(TIER_MODERATE).alias("_2"),
        any_of(TIER_LOW).alias("_1"),
    )
    tier = F.when(F.col("_3"), 3).when(F.col("_2"), 2).when(F.col("_1"), 1).otherwise(0)
    return flags.select(*pixel, F.when(F.col("_dom"), tier).alias("tier"))


def counts_for(df: DataFrame, keys: list[str], code: str, codes: list[int]) -> DataFrame:
    """Pixels per code for every listed code, zero included, with the share of the in-domain total."""
    wide = df.where(F.col(code).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col(code) == c).alias(f"_c{i}") for i, c in enumerate(codes)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"_c{i}").alias("n")) for i, c in enumerate(codes)]))
    return wide.select(*keys, "n_total", rows.alias("x")).select(
        *keys, "x.code", "x.n", "n_total", (F.col("x.n") / F.col("n_total")).alias("fraction")
    )


def calibrated_detection(
    scores: DataFrame,
    weights: DataFrame,
    keys: list[str],
    q: float,
    max_infeas: float | None,
    score: str = "score",
    infeas: str = "infeas",
    block: str = "block_id",
) -> DataFrame:
    """Threshold per (keys, rep): quantile of the gated positive scores in the drawn blocks, by multiplicity.

    ``weights(keys, block, draws)``, an array by replicate as ``block_weights`` makes it.  Returns thresholds with
    ``n_calibration`` pixels, each counted as often as its block was drawn, and ``n_detected``, the gated scores of the key at or
    above the threshold, drawn or not.  Draws whose blocks hold no positive score have no threshold, a reason, and no detections.
    """
    ok = F.col(score).isNotNull() & F.col(infeas).isNotNull() & (F.col(score) > 0)
    if max_infeas is not None:
        ok = ok & (F.col(infeas) < max_infeas)
    weights = cut(weights.select(*keys, block, "draws"))
    packed = packed_values(scores.where(ok), weights, keys, block, score)
    thr = cut(drawn_quantile(packed, keys, q, "threshold"))
    # thresholds are positive, so the packed scores hold all detections
    found = counted_above(packed, thr, keys, "threshold", "n_detected")
    last = weights.groupBy(*keys).agg(F.first(F.size("draws") - 1).alias("_last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("rep")).hint("merge")
    out = every.join(thr, [*keys, "rep"], "left").join(found, [*keys, "rep"], "left")
    reason = F.when(F.col("n").isNull(), "no_positive_calibration_scores")
    counts = {c: F.coalesce(n, F.lit(0)) for c, n in (("n_calibration", F.col("n")), ("n_detected", F.col("n_detected")))}
    return out.withColumns({"reason": reason, **counts}).drop("n")


def opacity(strength: Column, vmax: Column) -> Column:
    """0.4 plus up to 0.6 by strength between 1 and ``vmax``."""
    scaled = (strength - 1.0) / F.greatest(vmax - 1.0, F.lit(1e-9))
    return F.lit(0.4) + F.lit(0.6) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def strongest(scores: DataFrame, keys: list[str], value: str, q: float, top_n: int, tie: list[str]) -> DataFrame:
    """The ``top_n`` strongest rows per key among those at or above the ``q`` quantile of positive values."""
    positive = scores.where(F.col(value) > 0)
    floors = exact_quantiles(positive, keys, value, {"_floor": q}).drop("n")
    kept = positive.join(floors, keys).where(F.col(value) >= F.col("_floor")).drop("_floor")
    return top_rows(kept, keys, [F.col(value).desc()], tie, top_n)
