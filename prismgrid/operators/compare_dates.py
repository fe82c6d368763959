"""Two dates of one layer: registration shifts, boundary resampling, overlap accounting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import block_weights, weighted_rows
from ..functions.rules import ratio
from ..session import cut
from . import edges
from .agree import overlap_ratios
from .knn import boundary_distance
from .packets import moved_boundaries, permuted, rank_correlation
from .regrid import boundary_cells
from .resample import ordering_lists


def registration_sensitivity(
    df: DataFrame, keys: list[str], a: str, b: str, mask_a: str, mask_b: str, res_x: float, res_y: float
) -> DataFrame:
    """Overlap, rank correlation and boundary distance at the nine unit shifts of the repeat.

    A scene's cells travel once; its task lays the repeat over the anchor at each shift, as ``shifted_pairs`` does in rows.
    """
    values = {"a": a, "b": b, "ma": mask_a, "mb": mask_b}
    rows = df.select(*keys, "row_i", "col_i", *[F.col(c).cast("double").alias(n) for n, c in values.items()])
    counts = ["n_joint", "n_both", "n_either", "n_anchor", "n_repeat"]
    schema = T.StructType(
        [df.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("dy", "dx")]
        + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.DoubleType()) for c in ("rho", "boundary_m")]
    )

    def shifts(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["row_i", "col_i", *values], na_position="first").drop_duplicates(["row_i", "col_i"], keep="last")
        row, col = p["row_i"].to_numpy(np.int64), p["col_i"].to_numpy(np.int64)
        x, y, m, n = (p[c].to_numpy() for c in values)
        place, width = edges.places(row, col)
        made = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                at, there = edges.look_up(place, place - dy * width - dx)
                sy, sn = (np.where(there, v[at], np.nan) for v in (y, n))
                pair, joint = ~np.isnan(x) & ~np.isnan(sy), ~np.isnan(m) & ~np.isnan(sn)
                one, two = joint & (m == 1), joint & (sn == 1)
                rho = rank_correlation(*(np.unique(v[pair], return_inverse=True)[1] for v in (x, sy)))
                far = np.nan
                if joint.any():
                    r, c = row[joint], col[joint]
                    far = edges.symmetric_distance(r, c, *edges.boundary(r, c, [m[joint], sn[joint]]), res_x, res_y)
                made.append((dy, dx, pair.sum(), (one & two).sum(), (one | two).sum(), one.sum(), two.sum(), rho, far))
        out = pd.DataFrame(made, columns=schema.names[len(keys):])
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[schema.names]

    s = rows.groupBy(*keys).applyInPandas(shifts, schema)
    missing = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("rho", "boundary_m")]
    return overlap_ratios(s).select(*keys, "dy", "dx", "n_joint", "iou", "dice", "prevalence_ratio", *missing)


def shift_ranges(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Smallest and largest value over the shifts next to the unshifted one."""
    still = (F.col("dy") == 0) & (F.col("dx") == 0)
    aggs = []
    for n in names:
        aggs += [F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), F.max(F.when(still, F.col(n))).alias(f"{n}_unshifted")]
    return metrics.groupBy(*keys).agg(*aggs)


def boundary_bootstrap(
    sampled: DataFrame, keys: list[str], a: str, b: str, res_x: float, res_y: float, replicates: int, seed
) -> DataFrame:
    """Boundary distance per replicate of drawn blocks; boundaries never cross block seams.

    A block drawn twice puts its boundary cells in twice, as weights.
    """
    cells = cut(boundary_cells(sampled, [*keys, "block_id"], a, b))
    w = block_weights(sampled.select(*keys, "block_id").distinct(), keys, replicates, seed)
    rows = weighted_rows(cells, w, [*keys, "block_id"]).drop("block_id")
    return boundary_distance(rows, [*keys, "rep"], res_x, res_y, weight="w")


def boundary_null(
    sampled: DataFrame, keys: list[str], a: str, b: str, res_x: float, res_y: float, side: int, replicates: int, seed
) -> DataFrame:
    """Boundary distance per ordering of the repeat blocks laid over the anchor blocks; blocks are packed, no cell is copied to orderings."""
    orders = ordering_lists(sampled.select(*keys, "block_id").distinct(), keys, replicates, seed)
    fields = [a, b, "row_i", "col_i"]
    return permuted(sampled, orders, keys, fields, side, moved_boundaries(a, b, side, res_x, res_y), ["boundary_m"]).where("boundary_m IS NOT NULL")


def overlap_accounting(df: DataFrame, keys: list[str], anchor_valid: Column, repeat_valid: Column) -> DataFrame:
    """Cells valid on either side and jointly, with the joint share of grid, anchor and repeat."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(anchor_valid).alias("anchor_valid"),
        F.count_if(repeat_valid).alias("repeat_valid"),
        F.count_if(anchor_valid & repeat_valid).alias("joint"),
    )
    return (
        out.withColumn("joint_of_grid", ratio("joint", "n_cells"))
        .withColumn("joint_of_anchor", ratio("joint", "anchor_valid"))
        .withColumn("joint_of_repeat", ratio("joint", "repeat_valid"))
    )
