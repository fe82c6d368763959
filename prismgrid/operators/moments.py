"""Background moments and matched-filter scoring.

Partial (count, mean, centred cross-product) states are built inside the scan, then merged in rounds of
bounded fan-in keyed by scene, so neither the driver nor one task receives all partials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import col, from_matrix, to_matrix
from ..session import cut
from .stats import dealt

FAN_IN = 32
STATE_BYTES = 256 * 2**20
#: Bytes and states that a task merges at once, what an open state costs beside its numbers, and the row that ``TASK_ROWS`` stands for.
BIN_BYTES, MAX_BIN, OPEN_BYTES, STATE_ROW_BYTES = 16 * 2**20, 50_000, 1024, 256


def merge_states(a: tuple, b: tuple) -> tuple:
    """Pairwise merge of two (n, mean, centred cross-product) states."""
    if a[0] == 0:
        return b
    if b[0] == 0:
        return a
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def batch_state(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    c = x - mean
    return x.shape[0], mean, c.T @ c


def _schema(df: DataFrame, keys: list[str], extra: list[tuple[str, T.DataType]]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(
        fields
        + [T.StructField(n, t) for n, t in extra]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("m2", T.ArrayType(T.DoubleType())),
        ]
    )


def partial_moments(df: DataFrame, keys: list[str], bands: list[int], width: int, refl: str = "refl") -> DataFrame:
    """One state per (partition, key) over pixels present in all ``bands``; ``part`` is the partition."""
    schema = _schema(df, keys, [("part", T.LongType())])
    index = list(bands)
    max_open = max(4, STATE_BYTES // (8 * len(index) ** 2 + OPEN_BYTES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        states: dict[tuple, tuple] = {}

        def flush() -> pa.RecordBatch:
            rows = [
                {**dict(zip(keys, k)), "part": part, "n": s[0], "mean": s[1].tolist(), "m2": s[2].ravel().tolist()}
                for k, s in states.items()
            ]
            states.clear()
            return pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

        for batch in batches:
            x = to_matrix(batch.column(batch.num_columns - 1), width)[:, index]
            ok = np.isfinite(x).all(axis=1)
            if not ok.any():
                continue
            kf = pd.DataFrame({k: batch.column(i).to_pylist() for i, k in enumerate(keys)}, index=range(len(x)))
            groups = kf[ok].groupby(keys, sort=False, dropna=False).indices if keys else {(): np.arange(int(ok.sum()))}
            xs = x[ok]
            for k, rows in groups.items():
                k = k if isinstance(k, tuple) else (k,)
                k = tuple(v.item() if hasattr(v, "item") else v for v in k)
                s = batch_state(xs[rows])
                states[k] = merge_states(states[k], s) if k in states else s
            if len(states) > max_open:
                yield flush()
        if states:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    return df.select(*keys, refl).mapInArrow(scan, schema)


def _merged_groups(table: pa.Table, by: list[str], names: list[str]) -> pa.Table:
    """One state per distinct ``by`` among the rows of ``table``: all groups in one pass over arrays."""
    code = np.zeros(table.num_rows, np.int64)
    for c in by:
        encoded = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    width = max(table.column("mean").combine_chunks().value_lengths().drop_null().to_numpy(zero_copy_only=False), default=0)
    n = table.column("n").to_numpy()
    # a state of no pixels says nothing
    mean, m2 = (np.where((n > 0)[:, None], to_matrix(table.column(c), w), 0.0) for c, w in (("mean", width), ("m2", width * width)))
    # ordered by value, so that the same states give the same last digits however they arrive
    order = np.lexsort((*mean.T[::-1], n, code))
    code, n, mean, m2 = code[order], n[order], mean[order], m2[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.add.reduceat(n, starts)
    centre = np.add.reduceat(mean * n[:, None], starts) / np.maximum(total, 1)[:, None]
    d = mean - centre[code]
    m2 = m2 + ((d * n[:, None])[:, :, None] * d[:, None, :]).reshape(len(n), -1)
    head = [table.column(c).take(pa.array(order[starts])) for c in names[:-3]]
    return pa.table([*head, pa.array(total, pa.int64()), from_matrix(centre), from_matrix(np.add.reduceat(m2, starts))], names=names)


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merge states to one per key, in rounds of about ``FAN_IN`` states of a key, as many as the key with most of them asks for.

    States are materialised and numbered densely (row of a partition times partitions, plus partition), and a round deals
    those of a key by the hash of that number.  A task merges many keys at once: groups are put together into bins of
    ``BIN_BYTES``, so neither many keys with few states nor few keys with many are handled one by one.
    """
    schema = _schema(states, keys, [])
    states = cut(states.select(*keys, "n", "mean", "m2"))
    width = states.rdd.getNumPartitions()
    row = F.monotonically_increasing_id()
    states = states.withColumn("part", row.bitwiseAND(F.lit((1 << 33) - 1)) * width + F.shiftright(row, 33))
    per_key = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("mean")).alias("b"))
    most, total, n_keys, b = (x or 1 for x in per_key.agg(F.max("n"), F.sum("n"), F.count(F.lit(1)), F.max("b")).collect()[0])
    size = 8 * (b * b + b + 4)
    salted = T.StructType([*schema.fields[: len(keys)], T.StructField("part", T.LongType()), *schema.fields[len(keys) :]])

    def round_of(states: DataFrame, rows: int, salt: Column, out: T.StructType) -> DataFrame:
        bins = math.ceil(rows / min(MAX_BIN, max(FAN_IN, BIN_BYTES // size)))
        by = [*keys, "part"]
        rows = rows * size / STATE_ROW_BYTES
        names = out.names
        binned = states.withColumn("part", salt).withColumn("_bin", F.pmod(F.xxhash64(*by), F.lit(bins)))
        return dealt(binned, rows, ["_bin"]).groupBy("_bin").applyInArrow(lambda t: _merged_groups(t, by, names), out)

    while most > FAN_IN:
        most = math.ceil(most / FAN_IN)
        states = round_of(states, total, F.pmod(F.xxhash64("part"), F.lit(most)), salted)
        total = min(total, n_keys * most)
    return round_of(states, total, F.lit(0).cast("bigint"), schema)


def background_moments(df: DataFrame, keys: list[str], bands: list[int], width: int, refl: str = "refl") -> DataFrame:
    """Count, mean and centred cross-product per key over pixels present in all ``bands``."""
    return merge_moments(partial_moments(df, keys, bands, width, refl), keys)


def weighted_moments(block_states: DataFrame, weights: DataFrame, keys: list[str], block: str, member: list[str]) -> DataFrame:
    """Moments of each member from block states by multiplicity, without another pixel scan.

    A block drawn ``w`` times contributes count ``w*n`` and cross-product ``w*m2``.  ``weights`` has
    ``keys, member, block, w``; held-out blocks are simply not listed.
    """
    j = block_states.join(weights, [*keys, block]).where("w > 0").select(
        *keys,
        *member,
        (F.col("n") * F.col("w")).cast("bigint").alias("n"),
        "mean",
        F.transform("m2", lambda v: v * F.col("w")).alias("m2"),
    )
    return merge_moments(j, [*keys, *member])


def loaded_inverse(n: int, m2: np.ndarray, ridge: float) -> np.ndarray:
    """Inverse of the sample covariance with ``ridge * mean variance`` on its diagonal."""
    if n < 2:
        raise ValueError("background needs at least two complete pixels")
    cov = m2 / (n - 1)
    load = np.trace(cov) / cov.shape[0]
    if not np.isfinite(load) or load <= 0:
        raise ValueError("background variance is not positive")
    loaded = cov + ridge * load * np.eye(cov.shape[0])
    try:
        return np.linalg.inv(loaded)
    except np.linalg.LinAlgError as e:
        raise ValueError("loaded covariance is singular") from e


def state_of(row) -> tuple:
    """Collected moment row as numpy state (bands x bands, so bounded by the sensor)."""
    b = len(row["mean"])
    return int(row["n"]), np.asarray(row["mean"], float), np.asarray(row["m2"], float).reshape(b, b)


def filters(mean: np.ndarray, inverse: np.ndarray, library: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter weights (endmembers, bands) and their normalisers."""
    d = library - mean
    w = d @ inverse
    eta = np.einsum("ij,ij->i", d, w)
    if not np.all(np.isfinite(eta)) or np.any(eta <= 0):
        raise ValueError("an endmember has no direction against the background")
    return w, eta


def _abundance(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray, w: np.ndarray, eta: np.ndarray) -> np.ndarray:
    c = x - mean
    alpha = c @ w.T / eta
    rx = np.einsum("ij,ij->i", c @ inverse, c)
    resid = np.clip(rx[:, None] - alpha**2 * eta, 0.0, None)
    return np.hstack([alpha, np.sqrt(resid) / np.sqrt(max(len(mean) - 1, 1))])


def matched_filter(refl: Column | str, mean, inverse, library, bands: list[int], width: int) -> Column:
    """Abundance and infeasibility of every endmember: one array, first all ``mf`` then all ``infeas``.

    A pixel missing any used band scores NULL throughout.  One pair of matrix products per Arrow batch.
    """
    mean, inverse = np.asarray(mean, float), np.asarray(inverse, float)
    w, eta = filters(mean, inverse, np.asarray(library, float))
    index = list(bands)

    @F.arrow_udf("array<double>")
    def scores(spectra: pa.Array) -> pa.Array:
        return from_matrix(_abundance(to_matrix(spectra, width)[:, index], mean, inverse, w, eta))

    return scores(col(refl))


def matched_filter_by_key(
    pixels: DataFrame,
    backgrounds: DataFrame,
    keys: list[str],
    library: np.ndarray,
    bands: list[int],
    width: int,
    ridge: float,
    pass_through: list[str],
    chunk: Column,
    refl: str = "refl",
) -> DataFrame:
    """Matched filter with a background per key (scene, fold or member), failures kept as a status.

    ``chunk`` cuts a key's pixels into pieces of bounded size (tile rows, say); each piece meets its
    background once in a cogroup, so a matrix is never repeated per pixel nor sent to the driver.
    """
    lib = np.asarray(library, float)
    k, b = lib.shape
    index = list(bands)
    px = pixels.select(*keys, *pass_through, F.col(refl).alias("_refl"), chunk.alias("_chunk"))
    pieces = px.select(*keys, "_chunk").distinct()
    fits = pieces.join(backgrounds.select(*keys, "n", "mean", "m2"), keys, "left")
    fits = fits.select(*[F.col(k).alias(f"_fit_{k}") for k in [*keys, "_chunk"]], "n", "mean", "m2")
    out_schema = T.StructType(
        [pixels.schema[c] for c in [*keys, *pass_through]]
        + [
            T.StructField("n_fit", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x = to_matrix(left.column("_refl"), width)[:, index]
        n_fit, status = right.column("n")[0].as_py(), "ok"
        out = np.full((len(x), 2 * k), np.nan)
        try:
            if n_fit is None:
                raise ValueError("no background")
            mean = np.asarray(right.column("mean")[0].as_py(), float)
            inv = loaded_inverse(n_fit, np.asarray(right.column("m2")[0].as_py(), float).reshape(b, b), ridge)
            out = _abundance(x, mean, inv, *filters(mean, inv, lib))
        except ValueError as e:
            status = str(e)
        cols = [left.column(c) for c in [*keys, *pass_through]]
        cols += [pa.array([n_fit] * len(x), pa.int64()), pa.array([status] * len(x)), from_matrix(out)]
        return pa.table(cols, names=[*keys, *pass_through, "n_fit", "status", "scores"])

    by = [*keys, "_chunk"]
    return px.groupBy(*by).cogroup(fits.groupBy(*[f"_fit_{k}" for k in by])).applyInArrow(score, out_schema)
