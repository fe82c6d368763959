"""Multiple testing, rank tables and governed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .stats import running_totals, suffix_minimum

# fixed values
INTERVAL = (0.025, 0.975)
FINITE_SHARE = 0.95


def adjust_p_values(df: DataFrame, family: list[str], p: str = "p_value", eligible: Column | None = None) -> DataFrame:
    """Benjamini-Hochberg within each family; missing or ineligible rows stay NULL (``q_value``).

    Equal p-values share the rank of the last of them and so the adjusted value: counts of distinct p-values
    are enough.  Ranks are running totals and the running minimum from the top is carried over value ranges, so a
    family of any size is spread over tasks.  Rows meet their rank by the p-value itself: they are materialised, as a mean
    that is computed again may end in another last bit and would miss it.
    """
    use = F.col(p).isNotNull() if eligible is None else F.col(p).isNotNull() & F.coalesce(eligible, F.lit(False))
    rows = df.withColumn("_p", F.when(use, F.col(p).cast("double")))
    # a struct as key keeps families with missing names apart and together
    rows = cut(rows.withColumn("_f", F.to_json(F.struct(*family)) if family else F.lit("")))
    counts = rows.where(F.col("_p").isNotNull()).groupBy("_f", "_p").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, ["_f"], "_p", ["_n"])
    size = counts.groupBy("_f").agg(F.sum("_n").alias("_m"))
    raw = ranked.join(size, "_f").select("_f", "_p", (F.col("_p") * F.col("_m") / F.col("cum__n")).alias("_raw"))
    low = suffix_minimum(raw, ["_f"], "_p", "_raw").select("_f", "_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("min__raw"))).alias("q_value"))
    return rows.join(low, ["_f", "_p"], "left").select(*df.columns, "q_value")


def adjust_complete_families(df: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    """As above, but one missing p-value makes the whole family unavailable."""
    named = df.withColumn("_g", F.to_json(F.struct(*family)) if family else F.lit(""))
    complete = named.groupBy("_g").agg(F.bool_and(F.col(p).isNotNull()).alias("_complete"))
    return adjust_p_values(named.join(complete, "_g").drop("_g"), family, p, F.col("_complete")).drop("_complete")


def governed_interval(reps: DataFrame, keys: list[str], value: str, scheduled: int) -> DataFrame:
    """2.5 / 97.5 percent of the present replicates, only when at least 95 percent are present.

    One key holds at most ``scheduled`` replicates, which bounds the percentile buffer.
    """
    p = F.percentile(value, F.array(*[F.lit(q) for q in INTERVAL]))
    need = F.ceil(F.lit(FINITE_SHARE * scheduled) - F.lit(1e-9))
    out = reps.groupBy(*keys).agg(F.count(value).alias("valid_replicates"), p.alias("_p"))
    ok = F.col("valid_replicates") >= need
    return out.select(
        *keys,
        F.when(ok, F.col("_p")[0]).alias("lower"),
        F.when(ok, F.col("_p")[1]).alias("upper"),
        "valid_replicates",
        (F.col("valid_replicates") / F.lit(float(scheduled))).alias("finite_fraction"),
        F.when(~ok, "fewer_than_95_percent_finite_replicates").alias("reason"),
    )


def null_tails(reps: DataFrame, keys: list[str], value: str, scheduled: int) -> DataFrame:
    """5 and 95 percent of a null distribution, only when at least 95 percent of its replicates are present."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    out = reps.groupBy(*keys).agg(F.count(value).alias("valid_replicates"), p.alias("_p"))
    ok = F.col("valid_replicates") >= F.ceil(F.lit(FINITE_SHARE * scheduled) - F.lit(1e-9))
    return out.select(*keys, "valid_replicates", F.when(ok, F.col("_p")[0]).alias("null_05"), F.when(ok, F.col("_p")[1]).alias("null_95"))


def null_summary(reps: DataFrame, observed: DataFrame, keys: list[str], value: str, scheduled: int) -> DataFrame:
    """Null quantiles, plus-one p-value of ``observed`` (greater or equal) and the finite gate."""
    j = reps.join(observed.select(*keys, F.col(value).alias("_obs")), keys)
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = j.groupBy(*keys).agg(
        F.first("_obs").alias("observed"),
        F.count(value).alias("valid_replicates"),
        F.count_if(F.col(value) >= F.col("_obs")).alias("n_exceed"),
        p.alias("_p"),
    )
    ok = F.col("valid_replicates") >= F.ceil(F.lit(FINITE_SHARE * scheduled) - F.lit(1e-9))
    plus_one = (F.col("n_exceed") + 1.0) / (F.col("valid_replicates") + 1.0)
    return out.select(
        *keys,
        "observed",
        "valid_replicates",
        *[F.when(ok, F.col("_p")[i]).alias(n) for i, n in enumerate(["null_lower", "null_median", "null_upper"])],
        F.when(ok & F.col("observed").isNotNull(), plus_one).alias("p_value"),
        F.when(~ok, "fewer_than_95_percent_finite_replicates").alias("reason"),
    )
