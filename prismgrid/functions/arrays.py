"""Array-column helpers.  All treat NULL elements as missing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c: Column | str) -> Column:
    """Numeric array as ARRAY<DOUBLE> with NaN turned into NULL."""
    return F.transform(
        col(c), lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))
    )


def array_total(c: Column) -> Column:
    """Sum of the non-missing elements."""
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product over positions present in both arrays."""
    return array_total(F.zip_with(a, b, lambda x, y: x * y))


def shared_count(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x + y), lambda v: v.isNotNull()))


def has_missing(a: Column) -> Column:
    return F.exists(a, lambda v: v.isNull())


def literal_array(values) -> Column:
    """Doubles as an array literal; None and NaN become NULL."""
    return F.array(
        *[F.lit(None if v is None or v != v else float(v)).cast("double") for v in values]
    )


def to_matrix(arr: pa.Array, width: int) -> np.ndarray:
    """Arrow list column to an (n, width) float matrix; missing rows and elements become NaN."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if arr.null_count == 0:
        flat = arr.flatten()
        if len(flat) != n * width:
            raise ValueError("spectra do not all have the expected number of bands")
        return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, width)
    out = np.full((n, width), np.nan)
    keep = np.flatnonzero(arr.is_valid().to_numpy(zero_copy_only=False))
    if keep.size:
        out[keep] = to_matrix(arr.drop_null(), width)
    return out


def from_matrix(m: np.ndarray) -> pa.Array:
    """(n, k) float matrix to an Arrow list column; NaN becomes NULL."""
    n, k = m.shape
    flat = np.ascontiguousarray(m, dtype=float).reshape(-1)
    values = pa.array(flat, mask=~np.isfinite(flat))
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)) if k else pa.array(
        np.zeros(n + 1, dtype=np.int32)
    )
    return pa.ListArray.from_arrays(offsets, values)
