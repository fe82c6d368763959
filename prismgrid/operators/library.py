"""Spectral library operators: resampling, medoids, features, sensor response, scene means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import to_matrix
from ..functions.spectral import spectral_angle
from .mask import bounded_rows
from .stats import exact_quantiles, pearson

MAX_LIBRARY = 20_000


def long_spectra(df: DataFrame, keys: list[str], refl: str = "refl") -> DataFrame:
    """One row per band: ``keys, band_index, value``."""
    return df.select(*keys, F.posexplode(refl).alias("band_index", "value"))


def resample(source: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Linear interpolation of each spectrum onto target wavelengths from its present samples only.

    ``source(keys, wavelength_nm, value)``; ``targets(target_index, target_nm)`` is a sensor axis.
    Outside the sampled range the value is NULL.  Each spectrum's bracketing pairs come from ``lead``
    and the sorted target axis rides along as one array (a broadcast row), so no range join is needed.
    """
    pairs = F.struct(F.col("target_nm").cast("double").alias("nm"), F.col("target_index").cast("int").alias("i"))
    axis = F.broadcast(targets.agg(F.array_sort(F.collect_list(pairs)).alias("_axis")))
    grid = F.col("_axis")
    w = Window.partitionBy(*keys).orderBy("wavelength_nm")
    seg = source.where(F.col("value").isNotNull()).select(
        *keys,
        F.col("wavelength_nm").alias("w0"),
        F.col("value").alias("v0"),
        F.lead("wavelength_nm").over(w).alias("w1"),
        F.lead("value").over(w).alias("v1"),
        F.row_number().over(w).alias("_first"),
    ).join(axis)
    # the first sample also answers a target exactly at the lower end of the range
    inside = F.filter(
        grid,
        lambda t: ((t["nm"] > F.col("w0")) & (t["nm"] <= F.col("w1")))
        | ((F.col("_first") == 1) & (t["nm"] == F.col("w0"))),
    )
    hit = seg.select(*keys, "w0", "v0", "w1", "v1", F.explode(inside).alias("t"))
    frac = F.when(F.col("t.nm") == F.col("w0"), F.lit(0.0)).otherwise(
        (F.col("t.nm") - F.col("w0")) / (F.col("w1") - F.col("w0"))
    )
    value = F.when(frac == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * frac)
    got = hit.select(*keys, F.col("t.i").alias("target_index"), value.alias("value"))
    every = source.select(*keys).distinct().join(axis).select(*keys, F.explode(grid).alias("t")).select(
        *keys, F.col("t.i").alias("target_index"), F.col("t.nm").alias("target_nm")
    )
    return every.join(got, [*keys, "target_index"], "left")


def median_spectra(library: DataFrame, key: str = "mineral") -> DataFrame:
    """Missing-aware median spectrum per mineral as an array."""
    med = exact_quantiles(long_spectra(library, [key]), [key, "band_index"], "value", {"median": 0.5})
    bands = long_spectra(library, [key]).select(key, "band_index").distinct()
    full = bands.join(med, [key, "band_index"], "left")
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct("band_index", "median"))), lambda s: s["median"]
    )
    return full.groupBy(key).agg(packed.alias("median_refl"))


def medoids(library: DataFrame, key: str = "mineral", sample: str = "sample") -> DataFrame:
    """Per mineral the sample with the smallest angle to the median spectrum (first sample on tie)."""
    j = library.join(median_spectra(library, key), key)
    scored = j.withColumn("angle", spectral_angle("refl", "median_refl"))
    best = F.min_by(
        F.struct(F.col(sample).alias("sample"), F.col("angle").alias("angle"), F.col("refl").alias("refl")),
        F.struct("angle", sample),
    )
    return scored.where(F.col("angle").isNotNull()).groupBy(key).agg(best.alias("m")).select(
        key, F.col("m.sample").alias(sample), F.col("m.angle").alias("angle"), F.col("m.refl").alias("refl")
    )


def library_matrix(library: DataFrame, order: str, refl: str = "refl") -> tuple[list, np.ndarray]:
    """Names and (endmembers, bands) matrix of a size-checked library, in ``order``."""
    rows = sorted(bounded_rows(library.select(order, refl), MAX_LIBRARY), key=lambda r: r[0])
    names = [r[0] for r in rows]
    return names, np.array([[np.nan if v is None else v for v in r[1]] for r in rows], dtype=float)


def bands_with_data(pixels: DataFrame, width: int, refl: str = "refl") -> DataFrame:
    """Bands that are present in at least one pixel: one row for each partition and band, then distinct."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, bool)
        for batch in batches:
            seen |= np.isfinite(to_matrix(batch.column(0), width)).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], ["band_index"])

    return pixels.where(F.col(refl).isNotNull()).select(refl).mapInArrow(scan, "band_index int").distinct()


def valid_bands(library: DataFrame, training: DataFrame, width: int, refl: str = "refl") -> DataFrame:
    """Bands a fit may use: present in every endmember, and in at least one of its training pixels."""
    gaps = long_spectra(library, [], refl).groupBy("band_index").agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("gaps"))
    return gaps.where("gaps = 0").select("band_index").join(bands_with_data(training, width, refl), "band_index")


def valid_bands_by(library: DataFrame, training: DataFrame, keys: list[str], width: int, refl: str = "refl") -> DataFrame:
    """Bands of every fit at once: ``keys, band_index`` present in every endmember and in a training pixel of the key.

    Which bands a pixel has is an array of flags, so pixels are aggregated as arrays and never laid out by band.
    """
    gaps = long_spectra(library, [], refl).groupBy("band_index").agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("gaps"))
    counts = [F.count_if(F.get(refl, i).isNotNull() & ~F.isnan(F.get(refl, i))).alias(f"_{i}") for i in range(width)]
    seen = training.groupBy(*keys).agg(*counts).select(*keys, F.posexplode(F.array(*[F.col(f"_{i}") for i in range(width)])).alias("band_index", "_n"))
    return seen.where("_n > 0").join(gaps.where("gaps = 0").select("band_index"), "band_index").select(*keys, "band_index")


def shoulders(spectra: DataFrame, keys: list[str], lo_nm: Column, hi_nm: Column, center: Column | None = None) -> DataFrame:
    """Absorption and both shoulders of a long spectrum ``(keys, wavelength_nm, value)`` in a window.

    The minimum (first on tie) is the absorption, the maximum on each side a shoulder.  ``center`` is the
    nominal centre that must be bracketed; without it the located minimum is used.  Rows with fewer than
    three present bands or without bracketing carry ``ok = false``.
    """
    win = spectra.where((F.col("wavelength_nm") >= lo_nm) & (F.col("wavelength_nm") <= hi_nm) & F.col("value").isNotNull())
    low = win.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bands"),
        F.min_by("wavelength_nm", F.struct("value", "wavelength_nm")).alias("min_nm"),
    )
    j = win.join(low, keys)
    top = F.struct(F.col("value"), -F.col("wavelength_nm"))
    out = j.groupBy(*keys, "n_bands", "min_nm").agg(
        F.max_by(F.col("wavelength_nm"), F.when(F.col("wavelength_nm") <= F.col("min_nm"), top)).alias("lo_shoulder_nm"),
        F.max_by(F.col("wavelength_nm"), F.when(F.col("wavelength_nm") >= F.col("min_nm"), top)).alias("hi_shoulder_nm"),
        *([F.first(center).alias("_nominal")] if center is not None else []),
    )
    c = F.col("_nominal") if center is not None else F.col("min_nm")
    ok = (F.col("n_bands") >= 3) & (F.col("lo_shoulder_nm") < c) & (c < F.col("hi_shoulder_nm"))
    return out.select(*keys, "n_bands", c.alias("center_nm"), "lo_shoulder_nm", "hi_shoulder_nm", ok.alias("ok"))


def mean_spectrum(pixels: DataFrame, keys: list[str], refl: str = "refl") -> DataFrame:
    """Per-band mean ignoring missing values."""
    return long_spectra(pixels, keys, refl).groupBy(*keys, "band_index").agg(F.avg("value").alias("value"))


def spectral_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation, angle in degrees and band count of two long mean spectra on one axis (``band_index, value``)."""
    j = a.select("band_index", F.col("value").alias("x")).join(
        b.select("band_index", F.col("value").alias("y")), "band_index"
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    cos = F.sum(F.col("x") * F.col("y")) / F.nullif(norm, F.lit(0.0))
    angle = F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return j.agg(
        pearson("x", "y").alias("r"),
        F.when(F.count(F.lit(1)) >= 2, angle).alias("angle_deg"),
        F.count(F.lit(1)).alias("n_bands"),
    )


def response_stats(response: DataFrame, keys: list[str] = ["band_name"]) -> DataFrame:
    """Response-weighted centre and full width at half maximum per band of a long response table."""
    w = Window.partitionBy(*keys)
    r = response.withColumn("_peak", F.max("response").over(w))
    half = F.when(F.col("response") >= F.col("_peak") * 0.5, F.col("wavelength_nm"))
    return r.groupBy(*keys).agg(
        (F.sum(F.col("response") * F.col("wavelength_nm")) / F.nullif(F.sum("response"), F.lit(0.0))).alias("center_nm"),
        (F.max(half) - F.min(half)).alias("fwhm_nm"),
    )


def separability(full: DataFrame, degraded: DataFrame, pairs: DataFrame, key: str = "mineral") -> DataFrame:
    """Angle of endmember pairs in two band spaces and the loss in percent.

    ``full`` and ``degraded`` are ``(key, refl)`` libraries, ``pairs(a, b)`` the pair list.
    """
    def angles(lib: DataFrame, name: str) -> DataFrame:
        left = lib.select(F.col(key).alias("a"), F.col("refl").alias("ra"))
        right = lib.select(F.col(key).alias("b"), F.col("refl").alias("rb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", spectral_angle("ra", "rb", degrees=True).alias(name))

    j = angles(full, "full_deg").join(angles(degraded, "degraded_deg"), ["a", "b"])
    return j.withColumn(
        "loss_pct", (F.col("full_deg") - F.col("degraded_deg")) / F.nullif(F.col("full_deg"), F.lit(0.0)) * 100.0
    )


def lookup_endmembers(frozen: DataFrame, library: DataFrame) -> DataFrame:
    """Frozen (mineral, sample) choices with their spectrum in a scene's library; ``found`` marks gaps."""
    lib = library.select("mineral", "sample", "refl", F.lit(True).alias("_hit"))
    return frozen.join(lib, ["mineral", "sample"], "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")
