"""Masks, gates, quality reports and exclusion ledgers over pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import col, has_missing

# fixed values: documented quality codes, and class codes outside the analysis domain
QA_DOMAIN = [0, 1, 255]
EXCLUDED_CLASSES = [0, 14, 45, 46, 47, 48, 49, 50]

QA_FIELDS = ["cloud", "cirrus", "nodata"]


def qa_invalid(refl: Column | str = "refl", fields: list[str] = QA_FIELDS) -> Column:
    """True where any quality field is not 0 or any band is missing."""
    bad = has_missing(col(refl)) | col(refl).isNull()
    for f in fields:
        bad = bad | (F.coalesce(F.col(f), F.lit(255)) != 0)
    return bad


def mask_pixels(df: DataFrame, refl: str = "refl") -> DataFrame:
    """Drop invalid pixels through all bands (spectrum NULL); values are not clamped."""
    return df.withColumn(refl, F.when(~qa_invalid(refl), F.col(refl)))


def retained_bands(bands: DataFrame, windows: DataFrame) -> DataFrame:
    """Bands with a good flag and outside every inclusive ``[lo_nm, hi_nm]`` window.

    ``windows`` is a configuration table of a few rows; its ranges become one condition per band row.
    """
    spans = [(r["lo_nm"], r["hi_nm"]) for r in bounded_rows(windows, 1000)]
    hit = F.lit(False)
    for lo, hi in spans:
        hit = hit | F.col("wavelength_nm").between(float(lo), float(hi))
    return bands.withColumn("in_window", hit).withColumn("retained", F.col("good") & ~hit)


def mask_bands(refl: Column | str, retained: list[bool]) -> Column:
    """NULL out the bands that are not retained."""
    keep = F.array(*[F.lit(bool(k)) for k in retained])
    return F.zip_with(col(refl), keep, lambda v, k: F.when(k, v))


def bounded_rows(df: DataFrame, limit: int) -> list:
    """Rows of a small dimension table; fails instead of pulling a table that has outgrown ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"dimension table has more than {limit} rows")
    return rows


def null_fill(refl: Column | str, good: list[bool] | None = None, fill: float = -9999.0) -> Column:
    """Fill value and flagged bands to NULL."""
    out = F.transform(col(refl), lambda v: F.when(v != fill, v))
    return mask_bands(out, good) if good is not None else out


def qa_domain_violations(df: DataFrame, fields: list[str] = QA_FIELDS) -> DataFrame:
    """Counts of quality values outside the documented domain, per field and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return (
        df.select(pairs.alias("p"))
        .select("p.field", "p.value")
        .where(~F.col("value").isin(QA_DOMAIN) | F.col("value").isNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def axis_mismatches(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Bands whose wavelengths differ by more than ``tolerance`` or exist on one axis only."""
    j = a.select("band_index", F.col("wavelength_nm").alias("a_nm")).join(
        b.select("band_index", F.col("wavelength_nm").alias("b_nm")), "band_index", "full"
    )
    bad = F.col("a_nm").isNull() | F.col("b_nm").isNull() | (F.abs(F.col("a_nm") - F.col("b_nm")) > tolerance)
    return j.where(bad)


def quality_report(pixels: DataFrame, keys: list[str], bands: DataFrame) -> DataFrame:
    """One row per scene: pixel, mask and band counts and the invalid fraction (NULL without pixels).

    ``bands`` carries ``good``, ``in_window`` and ``retained`` (see ``retained_bands``).
    """
    inv = qa_invalid()
    per_scene = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("nodata") != 0).alias("n_nodata"),
        F.count_if(F.col("cloud") != 0).alias("n_cloud"),
        F.count_if(F.col("cirrus") != 0).alias("n_cirrus"),
        F.count_if(inv).alias("n_invalid"),
    )
    per_band = bands.agg(
        F.count_if(~F.col("good")).alias("n_bad_bands"),
        F.count_if(F.col("in_window")).alias("n_window_bands"),
        F.count_if(F.col("retained")).alias("n_retained_bands"),
    )
    return per_scene.join(F.broadcast(per_band)).withColumn(
        "invalid_fraction", F.col("n_invalid") / F.nullif(F.col("n_total"), F.lit(0))
    )


def quality_value_counts(df: DataFrame, keys: list[str], fields: list[str] = QA_FIELDS) -> DataFrame:
    """Pixels per quality field and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return df.select(*keys, pairs.alias("p")).groupBy(*keys, "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def _audited(df: DataFrame, bands: DataFrame, refl: str) -> DataFrame:
    """``_v``: values of the retained bands (missing ones stay NULL), ``_bad``, ``_fill``: any quality field is 1, is 255."""
    axis = bands.agg(F.transform(F.array_sort(F.collect_list(F.struct("band_index", "retained"))), lambda b: b["retained"]).alias("_use"))
    met = df.join(F.broadcast(axis))  # one row
    bad, fill = F.lit(False), F.lit(False)
    for f in QA_FIELDS:
        bad, fill = bad | F.coalesce(F.col(f) == 1, F.lit(False)), fill | F.coalesce(F.col(f) == 255, F.lit(False))
    return met.withColumns({"_v": F.filter(F.col(refl), lambda v, i: F.get("_use", i)), "_bad": bad, "_fill": fill}).drop("_use")


def clear_values(df: DataFrame, keys: list[str], bands: DataFrame, refl: str = "refl") -> DataFrame:
    """``keys, value``: every present value of the retained bands of clear pixels."""
    v = _audited(df, bands, refl).where(~F.col("_bad")).select(*keys, F.explode("_v").alias("value"))
    return v.where(F.col("value").isNotNull())


def quality_audit(df: DataFrame, keys: list[str], bands: DataFrame, refl: str = "refl") -> DataFrame:
    """Clear pixels with any value below 0, above 1, above 1.5; their range; agreement of fill and no data.

    Only bands that ``bands(band_index, retained)`` retains count.  A pixel is invalid where a quality field
    is 1; fields at their fill value (255) are counted apart; a pixel is filled if any band is missing.
    """
    inv, clear = F.col("_bad"), ~F.col("_bad")

    def any_band(test) -> Column:
        return F.exists(F.col("_v"), test)

    filled = any_band(lambda v: v.isNull())
    out = _audited(df, bands, refl).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(inv).alias("n_invalid"),
        F.count_if(clear).alias("n_clear"),
        F.count_if(clear & any_band(lambda v: v < 0.0)).alias("n_below_0"),
        F.count_if(clear & any_band(lambda v: v > 1.0)).alias("n_above_1"),
        F.count_if(clear & any_band(lambda v: v > 1.5)).alias("n_above_1_5"),
        F.min(F.when(clear, F.array_min("_v"))).alias("min_value"),
        F.max(F.when(clear, F.array_max("_v"))).alias("max_value"),
        F.count_if(F.col("_fill")).alias("n_qa_fill"),
        F.count_if(filled != F.coalesce(F.col("nodata") == 1, F.lit(False))).alias("n_fill_mismatch"),
    )
    n = F.nullif(F.col("n_clear"), F.lit(0))
    return (
        out.withColumn("invalid_fraction", F.col("n_invalid") / F.nullif(F.col("n_total"), F.lit(0)))
        .withColumn("below_0_fraction", F.col("n_below_0") / n)
        .withColumn("above_1_fraction", F.col("n_above_1") / n)
        .withColumn("above_1_5_fraction", F.col("n_above_1_5") / n)
    )


def systematic_sample(df: DataFrame, every: int = 20) -> DataFrame:
    """The regular grid sample the audit takes its quantiles from: every n-th row and column."""
    return df.where((F.col("row_i") % every == 0) & (F.col("col_i") % every == 0))


def in_domain(code: Column | str, excluded: list[int] = EXCLUDED_CLASSES) -> Column:
    """Reference present and not an excluded class."""
    c = col(code)
    return c.isNotNull() & ~c.isin(excluded)


def binary_reference(df: DataFrame, layers: DataFrame, code: str = "code") -> DataFrame:
    """One row per cell and layer with ``ref`` 1/0, NULL off the domain.

    ``layers(layer, code)`` lists the positive classes, a bridge of a few dozen rows that becomes a literal.
    """
    positive: dict[str, list[int]] = {}
    for r in bounded_rows(layers.select("layer", "code"), 10_000):
        positive.setdefault(r["layer"], []).append(r["code"])
    sets = F.array(*[
        F.struct(F.lit(name).alias("layer"), F.array(*[F.lit(c) for c in sorted(set(codes))]).alias("codes"))
        for name, codes in sorted(positive.items())
    ])
    hit = F.array_contains("_s.codes", F.col(code))
    return df.select("*", F.explode(sets).alias("_s")).select(
        *df.columns, F.col("_s.layer").alias("layer"), F.when(in_domain(code), hit.cast("int")).alias("ref")
    )


def gate_infeasible(mf: Column | str, infeas: Column | str, max_infeas: float) -> Column:
    """Keep abundances with infeasibility strictly below the gate (array or scalar columns)."""
    return F.zip_with(col(mf), col(infeas), lambda m, i: F.when(i < max_infeas, m))


def threshold_mask(score: Column | str, qa_valid: Column, threshold: Column | float) -> Column:
    """1/0 where quality is valid and the score present; missing otherwise or for a missing threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(qa_valid & col(score).isNotNull() & t.isNotNull(), (col(score) >= t).cast("int"))


def joint_support(conditions: list[Column]) -> Column:
    """All conditions hold; a missing condition does not."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def bad_ids(df: DataFrame, name: str) -> DataFrame:
    """Rows whose id is present but not a non-negative whole number."""
    v = F.col(name).cast("double")
    return df.where(v.isNotNull() & ((v < 0) | (v != F.floor(v))))


def exclusion_ledger(df: DataFrame, keys: list[str], reasons: list[tuple[str, Column]]) -> DataFrame:
    """Charge each pixel to the first reason that applies; counts with denominator and fraction.

    Every reason is reported, also with count 0, and the counts sum to the total.
    """
    first = F.lit("included")
    for name, cond in reversed(reasons):
        first = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(first)
    tagged = df.select(*keys, first.alias("_r"))
    names = [n for n, _ in reasons] + ["included"]
    wide = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("denominator"),
        *[F.count_if(F.col("_r") == n).alias(f"_c{i}") for i, n in enumerate(names)],
    )
    ledger = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(n).alias("reason"), F.col(f"_c{i}").alias("n"))
                for i, n in enumerate(names)
            ]
        )
    )
    return wide.select(*keys, "denominator", ledger.alias("x")).select(
        *keys, "x.position", "x.reason", "x.n", "denominator", (F.col("x.n") / F.col("denominator")).alias("fraction")
    )


def site_search_box(points: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """Bounding box of the site centroids grown by ``buffer``."""
    return points.groupBy(*keys).agg(
        (F.min("lon") - buffer).alias("lon_min"),
        (F.min("lat") - buffer).alias("lat_min"),
        (F.max("lon") + buffer).alias("lon_max"),
        (F.max("lat") + buffer).alias("lat_max"),
    )


def confirm_deposits(
    df: DataFrame, keys: list[str], keyword: str, commodity: str, developed: list[str]
) -> DataFrame:
    """Count deposits matching name keyword, commodity token and development status; verdict per key."""
    match = (
        F.contains(F.lower("name"), F.lit(keyword.lower()))
        & F.array_contains(F.split("commodities", " "), commodity)
        & F.col("status").isin(developed)
    )
    return df.groupBy(*keys).agg(F.count_if(match).alias("n_match")).withColumn("confirmed", F.col("n_match") > 0)


def class_color(df: DataFrame, palette: DataFrame, code: str = "code") -> DataFrame:
    """Colour of a class; codes outside the palette or transparent get alpha 0.

    ``palette(code, red, green, blue, transparent)`` is a colour table.
    """
    p = palette.select(F.col("code").alias("_code"), "red", "green", "blue", "transparent")
    j = df.join(F.broadcast(p), F.col(code) == F.col("_code"), "left")
    visible = F.col("_code").isNotNull() & ~F.col("transparent")
    return j.withColumn("alpha", F.when(visible, F.lit(255)).otherwise(F.lit(0))).drop("_code", "transparent")


def valid_display(rgb: Column | str, lo: float = 0.0, hi: float = 1.5) -> Column:
    """True where every display band is present and inside the range."""
    return ~F.exists(col(rgb), lambda v: v.isNull() | (v < lo) | (v > hi))


def versus_chance(value: Column | str) -> Column:
    v = col(value)
    return (
        F.when(v.isNull(), "unavailable").when(v > 0.5, "above").when(v < 0.5, "below").otherwise("at_chance")
    )
