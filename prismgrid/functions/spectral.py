"""Spectrum expressions: angles, continuum, band depth, stretches, response simulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import array_total, col, dot, from_matrix, has_missing, shared_count, to_matrix


def spectral_angle(a: Column | str, b: Column | str, degrees: bool = False) -> Column:
    """Angle between two spectra over their shared bands; NULL below two shared bands."""
    a, b = col(a), col(b)
    na = array_total(F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), x * x)))
    nb = array_total(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull(), y * y)))
    cos = dot(a, b) / F.sqrt(na * nb)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    angle = F.degrees(angle) if degrees else angle
    return F.when((shared_count(a, b) >= 2) & (na > 0) & (nb > 0), angle)


def sam_angles(refl: Column | str, library: np.ndarray, band_used: np.ndarray | None = None) -> Column:
    """Angle in radians of each spectrum to every library row, as ARRAY<DOUBLE>.

    ``library`` is (endmembers, bands) and bounded by the spectral library.  A band is used when the
    endmember has it and ``band_used`` (bands with data anywhere) says so; a pixel missing any used band
    has no angle.  One matrix product per Arrow batch.
    """
    lib = np.asarray(library, dtype=float)
    width = lib.shape[1]
    used = np.isfinite(lib) & (True if band_used is None else np.asarray(band_used, dtype=bool))
    target = np.where(used, lib, 0.0)
    norms = np.sqrt((target**2).sum(axis=1))
    mask = used.astype(float)

    @F.arrow_udf("array<double>")
    def angles(spectra: pa.Array) -> pa.Array:
        x = to_matrix(spectra, width)
        gap = ~np.isfinite(x)
        filled = np.where(gap, 0.0, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = filled @ target.T / (np.sqrt((filled**2) @ mask.T) * norms)
        out = np.arccos(np.clip(cos, -1.0, 1.0))
        out[gap.astype(float) @ mask.T > 0] = np.nan
        return from_matrix(out)

    return angles(col(refl))


def sam_class(angles: Column | str, max_angle: float) -> Column:
    """Index of the smallest angle (first on tie); -1 when none is within ``max_angle``."""
    a = col(angles)
    best = F.array_min(a)
    return F.when(best <= max_angle, F.array_position(a, best).cast("int") - 1).otherwise(F.lit(-1))


def band_depth(r_lo: Column, r_center: Column, r_hi: Column, frac: float | Column) -> Column:
    """Depth below the straight continuum between two shoulders; NULL where the continuum is not positive."""
    frac = F.lit(float(frac)) if not isinstance(frac, Column) else frac
    cont = r_lo + (r_hi - r_lo) * frac
    return F.when(cont > 0, F.lit(1.0) - r_center / cont)


def feature_depth(refl: Column | str, wavelengths: list[float], lo_nm: float, center_nm: float, hi_nm: float) -> Column:
    """Band depth with each wavelength snapped to its nearest band; the three bands must differ."""
    wl = np.asarray(wavelengths, dtype=float)
    lo, c, hi = (int(np.argmin(np.abs(wl - t))) for t in (lo_nm, center_nm, hi_nm))
    if len({lo, c, hi}) < 3:
        raise ValueError("shoulders and centre fall on fewer than three distinct bands")
    refl = col(refl)
    frac = (wl[c] - wl[lo]) / (wl[hi] - wl[lo])
    return band_depth(refl[lo], refl[c], refl[hi], float(frac))


def continuum_removed(refl: Column | str, wavelengths: Column) -> Column:
    """Spectrum divided by the line through its two end bands."""
    s = col(refl)
    n = F.size(s)
    s0, sn = F.element_at(s, 1), F.element_at(s, n)
    w0, wn = F.element_at(wavelengths, 1), F.element_at(wavelengths, n)
    return F.zip_with(s, wavelengths, lambda v, w: F.try_divide(v, s0 + (sn - s0) * (w - w0) / (wn - w0)))


def unit_stretch(value: Column, lo: Column, hi: Column) -> Column:
    """Clip ``(value - lo) / (hi - lo)`` to [0, 1]; the denominator is kept off zero."""
    scaled = (value - lo) / (hi - lo + F.lit(1e-9))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def stretch_to_byte(value: Column, lo: Column, hi: Column, invalid: Column) -> Column:
    """0..255 code (round half to even); missing is 0 unless the pixel is invalid, which is 255."""
    scaled = unit_stretch(value, lo, hi)
    return F.when(invalid, F.lit(255)).otherwise(F.coalesce(F.bround(scaled * 255.0).cast("int"), F.lit(0)))


def simulate_bands(refl: Column | str, weights: np.ndarray, min_coverage: float = 0.5) -> Column:
    """Response-weighted mean per target band; missing below ``min_coverage`` of the response.

    ``weights`` is (target bands, source bands).
    """
    w = np.asarray(weights, dtype=float)
    total = w.sum(axis=1)

    @F.arrow_udf("array<double>")
    def simulated(spectra: pa.Array) -> pa.Array:
        x = to_matrix(spectra, w.shape[1])
        finite = np.isfinite(x)
        num = np.where(finite, x, 0.0) @ w.T
        den = finite.astype(float) @ w.T
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where((den > 0) & (den >= min_coverage * total), num / den, np.nan)
        return from_matrix(out)

    return simulated(col(refl))


def drop_gapped(refl: Column | str) -> Column:
    """NULL for a spectrum with any missing band."""
    return F.when(~has_missing(col(refl)), col(refl))
