"""Empirical semivariogram and its exponential fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# fixed values: pixel lags and the four directions
LAGS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128]
DIRECTIONS = [(0, 1), (1, 0), (1, 1), (1, -1)]


def empirical_semivariogram(
    field: DataFrame, keys: list[str], value: str, pixel_size: float, lags: list[int] = LAGS, max_pairs: int | None = None
) -> DataFrame:
    """Half the mean squared difference per lag, four directions pooled.

    Raster rows travel as arrays: a lag and direction pairs row ``r`` with row ``r + dr`` once, and the
    column offset is applied inside the arrays.  All pairs count, as partial sums.  With ``max_pairs`` an even
    choice over the direction, row, column order replaces them above that number; positions come from
    running counts per raster row.
    """
    shape = field.groupBy(*keys).agg((F.max("row_i") + 1).alias("_h"), (F.max("col_i") + 1).alias("_w"))
    entries = F.map_from_entries(F.collect_list(F.struct("col_i", F.col(value).cast("double").alias("v"))))
    rows = field.groupBy(*keys, "row_i").agg(entries.alias("_m")).join(shape, keys)
    dense = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda c: F.try_element_at("_m", c))
    rows = rows.select(*keys, "row_i", "_h", "_w", dense.alias("_a"))
    steps = F.array(*[
        F.struct(F.lit(lag).alias("lag"), F.lit(i).alias("dir"), F.lit(dr * lag).alias("dr"), F.lit(dc * lag).alias("dc"))
        for lag in lags for i, (dr, dc) in enumerate(DIRECTIONS)
    ])
    first = rows.select(*keys, "row_i", "_h", "_w", "_a", F.explode(steps).alias("s")).where(
        (F.col("s.lag") <= F.floor(F.least("_h", "_w") / 4)) & (F.col("row_i") + F.col("s.dr") < F.col("_h"))
    )
    first = first.withColumn("_to", F.col("row_i") + F.col("s.dr"))
    second = rows.select(*keys, F.col("row_i").alias("_to"), F.col("_a").alias("_b"))
    j = first.join(second, [*keys, "_to"])
    dc = F.col("s.dc")
    columns = F.sequence(F.greatest(F.lit(0), -dc), F.least(F.col("_w"), F.col("_w") - dc) - 1)
    diff = F.transform(columns, lambda c: F.get("_a", c) - F.get("_b", c + dc))
    sq = F.transform(F.filter(diff, lambda x: x.isNotNull()), lambda x: x * x)
    per_row = j.select(*keys, F.col("s.lag").alias("lag"), F.col("s.dir").alias("dir"), "row_i", sq.alias("_q")).withColumn("_n", F.size("_q")).where("_n > 0")
    by = [*keys, "lag"]
    if max_pairs is None:
        whole = per_row.groupBy(*by).agg(F.sum("_n").alias("available_pairs"), F.sum(F.aggregate("_q", F.lit(0.0), lambda s, v: s + v)).alias("_t"))
        return whole.select(
            *keys, F.col("lag").alias("lag_pixels"), (F.col("lag") * F.lit(float(pixel_size))).alias("distance"),
            (F.lit(0.5) * F.col("_t") / F.col("available_pairs")).alias("semivariance"), "available_pairs", F.col("available_pairs").alias("used_pairs"),
        )
    before = Window.partitionBy(*by).orderBy("dir", "row_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_row.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(*by))
    )
    stride = (F.col("_all") - 1.0) / F.lit(float(max_pairs - 1)) if max_pairs > 1 else F.lit(1.0)

    def chosen(o):
        i = F.floor(o / stride)
        hit = [(i + k >= 0) & (i + k < max_pairs - 1) & (F.floor((i + k) * stride) == o) for k in (0, 1)]
        return hit[0] | hit[1] | (o == F.col("_all") - 1)

    thin = F.filter(F.transform("_q", lambda v, i: F.when(chosen(F.col("_off") + i), v)), lambda v: v.isNotNull())
    used = F.when(F.col("_all") > max_pairs, thin).otherwise(F.col("_q"))
    sums = placed.withColumn("_u", used).groupBy(*by).agg(
        F.first("_all").alias("available_pairs"),
        F.sum(F.size("_u")).alias("used_pairs"),
        F.sum(F.aggregate("_u", F.lit(0.0), lambda s, v: s + v)).alias("_t"),
    )
    return sums.select(
        *keys, F.col("lag").alias("lag_pixels"), (F.col("lag") * F.lit(float(pixel_size))).alias("distance"),
        (F.lit(0.5) * F.col("_t") / F.col("used_pairs")).alias("semivariance"), "available_pairs", "used_pairs",
    )


#: Candidates of the first search and of each closer one, and how often it is repeated.
FIRST_SCALES, ZOOM_SCALES, ZOOMS = 800, 33, 6


def _best_scales(rows: DataFrame, keys: list[str], candidates: int) -> DataFrame:
    """The best of evenly spaced log scales in ``[lo, hi]`` of each key: ``keys, q, lo, hi, best(s, nugget, sill)``.

    One row per key and candidate; for a scale the two amounts have a closed form from five sums over the lags.
    """
    c = F.col
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn("s", c("lo") + (c("hi") - c("lo")) * c("i") / F.lit(float(candidates - 1)))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("g", "y", "gg", "gy", "yy", "gc", "cc")])

    def add(t, p):
        g = 1.0 - F.exp(-p["d"] / F.exp("s"))
        return F.struct((t["g"] + g).alias("g"), (t["y"] + p["y"]).alias("y"), (t["gg"] + g * g).alias("gg"), (t["gy"] + g * p["y"]).alias("gy"), (t["yy"] + p["y"] * p["y"]).alias("yy"), (t["gc"] + g * p["c"]).alias("gc"), (t["cc"] + p["c"] * p["c"]).alias("cc"))

    each = each.withColumn("t", F.aggregate("q", zero, add)).withColumn("n", F.size("q").cast("double"))
    t = {k: c(f"t.{k}") for k in ("g", "y", "gg", "gy", "yy", "gc", "cc")}
    # the free fit by values less their mean, as a large nugget would hide small errors
    spread = t["gg"] - t["g"] * t["g"] / c("n")
    each = each.withColumn("b", F.when(spread > 0, t["gc"] / spread).otherwise(0.0)).withColumn("a", (t["y"] - c("b") * t["g"]) / c("n"))
    # neither amount may be negative: else the better of no nugget and no sill
    slope = F.when(t["gg"] > 0, F.greatest(t["gy"] / t["gg"], F.lit(0.0))).otherwise(0.0)
    flat = F.greatest(t["y"] / c("n"), F.lit(0.0))

    def error(a, b):
        return t["yy"] + c("n") * a * a + b * b * t["gg"] - a * t["y"] * 2.0 - b * t["gy"] * 2.0 + a * b * t["g"] * 2.0

    def option(a, b):
        return F.struct(error(a, b).alias("e"), a.alias("nugget"), b.alias("sill"))

    free = (c("a") >= 0) & (c("b") >= 0)
    edge = F.least(option(F.lit(0.0), slope), option(flat, F.lit(0.0)))
    each = each.withColumn("o", F.when(free, F.struct((t["cc"] - c("b") * t["gc"]).alias("e"), c("a").alias("nugget"), c("b").alias("sill"))).otherwise(edge))
    best = F.min_by(F.struct("s", c("o.nugget").alias("nugget"), c("o.sill").alias("sill")), F.struct(c("o.e"), "i"))
    return each.groupBy(*keys).agg(*[F.first(x).alias(x) for x in ("q", "lo", "hi", "field_variance")], best.alias("best"))


def fit_exponential(points: DataFrame, variances: DataFrame, keys: list[str]) -> DataFrame:
    """Exponential fit per field with the stated fallbacks: few lags, no sill, range past the last lag.

    Least squares of ``nugget + sill * (1 - exp(-d / scale))`` with both amounts non-negative.  The scale is searched
    over candidate rows of all fields at once, each round closer around the best.  ``points`` from
    ``empirical_semivariogram`` (at most 14 per field), ``variances(keys, field_variance)``.
    The practical range is ``-scale * ln(0.05)``; a fallback takes the first lag at 95 percent of the
    field variance, else the largest lag.
    """
    c = F.col
    finite = c("semivariance").isNotNull() & ~F.isnan("semivariance")
    lags = F.array_sort(F.collect_list(F.when(finite, F.struct(c("distance").alias("d"), c("semivariance").alias("y")))))
    fields = cut(points.groupBy(*keys).agg(lags.alias("q")).join(variances, keys).where(F.size("q") > 0))
    mean = F.aggregate("q", F.lit(0.0), lambda m, p: m + p["y"]) / F.size("q")
    fields = fields.withColumn("_mean", mean).withColumn("q", F.transform("q", lambda p: F.struct(p["d"].alias("d"), p["y"].alias("y"), (p["y"] - F.col("_mean")).alias("c")))).drop("_mean")
    positive = F.transform(F.filter("q", lambda p: p["d"] > 0), lambda p: p["d"])
    search = fields.where(F.size("q") >= 3).withColumn("lo", F.log(F.array_min(positive) / 50.0)).withColumn("hi", F.log(F.array_max(positive) * 200.0))
    search = search.withColumn("floor", c("lo")).withColumn("top", c("hi"))
    bounds = search.select(*keys, "floor", "top")
    found = _best_scales(search.drop("floor", "top"), keys, FIRST_SCALES)
    for k in range(ZOOMS):
        step = (c("hi") - c("lo")) / F.lit(float((FIRST_SCALES if k == 0 else ZOOM_SCALES) - 1))
        near = found.join(bounds, keys).withColumn("_lo", F.greatest("floor", c("best.s") - step)).withColumn("hi", F.least("top", c("best.s") + step))
        found = _best_scales(near.select(*keys, "q", "field_variance", c("_lo").alias("lo"), "hi"), keys, ZOOM_SCALES)
    fitted = found.select(*keys, F.exp("best.s").alias("_scale"), c("best.nugget").alias("_nugget"), c("best.sill").alias("_sill"))
    j = fields.join(fitted, keys, "left").withColumn("_reach", c("_scale") * F.lit(-math.log(0.05)))
    last = F.element_at("q", -1)["d"]
    reached = F.filter("q", lambda p: p["y"] >= c("field_variance") * 0.95)
    reason = (
        F.when(F.size("q") < 3, "fewer_than_three_lags")
        .when(c("_sill").isNull() | F.isnan("_sill") | (c("_sill") <= 0) | F.isnan("_reach"), "nonfinite_or_nonpositive_sill")
        .when(c("_reach") > last, "fitted_practical_range_beyond_largest_evaluated_lag")
    )
    good = reason.isNull()
    hit = F.size(reached) > 0
    fallback = F.when(hit, "empirical_fallback_first_lag_at_95pct_variance").otherwise("empirical_fallback_largest_evaluated_lag")
    return j.select(
        *keys, *[F.when(good, c(f"_{n}")).alias(n) for n in ("nugget", "sill", "scale")],
        F.when(good, c("_reach")).when(hit, F.get(reached, 0)["d"]).otherwise(last).alias("practical_range"),
        F.when(good, "exponential_bounded_least_squares").otherwise(fallback).alias("method"), reason.alias("reason"),
    )
