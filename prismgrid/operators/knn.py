"""Nearest-neighbour joins between point sets by grid buckets of growing size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import ratio
from ..session import cut
from . import edges
from .stats import attach


def _bucket(v: Column | str, size: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(size))


def nearest(
    targets: DataFrame, sources: DataFrame, keys: list[str], ids: list[str], source_id: str, cell: float, max_rounds: int = 40
) -> DataFrame:
    """Nearest source of every target: ``keys, ids, source_id, distance``; lowest source id on exact ties.

    Points carry ``x, y``.  Round k looks at the 3 x 3 buckets of size ``cell * 2**k`` around a target and
    settles it when the best distance is at most one bucket, which proves no nearer point lies outside.
    From the second round on, sources are first met as fine sub-buckets with bounding boxes; only
    sub-buckets that can hold the nearest point are opened, so a dense spot does not meet all far targets.
    Sources at one position collapse to the lowest id beforehand.
    """
    pts = sources.groupBy(*keys, "x", "y").agg(F.min(source_id).alias("_sid"))
    pts = cut(pts.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), "_sid"))
    open_t = targets.select(*keys, *ids, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if keys:
        open_t = open_t.join(pts.select(*keys).distinct(), keys, "left_semi")
    span = pts.agg(F.max("_sx").alias("a"), F.min("_sx").alias("b"), F.max("_sy").alias("c"), F.min("_sy").alias("d")).collect()[0]
    if span["a"] is None:
        return open_t.select(*keys, *ids, F.lit(None).cast("bigint").alias(source_id), F.lit(None).cast("double").alias("distance")).limit(0)
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    done = None
    size = float(cell)
    for step in range(max_rounds):
        around = open_t.withColumn("_o", F.explode(ring)).withColumn("_bx", _bucket("x", size) + F.col("_o.i")).withColumn(
            "_by", _bucket("y", size) + F.col("_o.j")
        ).drop("_o")
        by = [*keys, "_bx", "_by"]
        dx, dy = F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy")
        if step == 0:
            near = around.join(pts.withColumn("_bx", _bucket("_sx", size)).withColumn("_by", _bucket("_sy", size)), by)
        else:
            fine = size / 8.0
            p = pts.withColumn("_fx", _bucket("_sx", fine)).withColumn("_fy", _bucket("_sy", fine))
            boxes = p.groupBy(*keys, "_fx", "_fy").agg(
                F.min("_sx").alias("_x0"), F.max("_sx").alias("_x1"), F.min("_sy").alias("_y0"), F.max("_sy").alias("_y1")
            ).withColumn("_bx", F.floor(F.col("_fx") / 8)).withColumn("_by", F.floor(F.col("_fy") / 8))
            gx = F.greatest(F.col("_x0") - F.col("x"), F.col("x") - F.col("_x1"), F.lit(0.0))
            gy = F.greatest(F.col("_y0") - F.col("y"), F.col("y") - F.col("_y1"), F.lit(0.0))
            hx = F.greatest(F.abs(F.col("x") - F.col("_x0")), F.abs(F.col("x") - F.col("_x1")))
            hy = F.greatest(F.abs(F.col("y") - F.col("_y0")), F.abs(F.col("y") - F.col("_y1")))
            met = around.join(boxes, by).withColumn("_low", gx * gx + gy * gy).withColumn("_up", hx * hx + hy * hy)
            best = met.groupBy(*keys, *ids).agg(F.min("_up").alias("_best"))
            keep = met.join(best, [*keys, *ids]).where(F.col("_low") <= F.col("_best") * (1 + 1e-12) + 1e-12)
            near = keep.select(*keys, *ids, "x", "y", "_fx", "_fy").join(p, [*keys, "_fx", "_fy"])
        found = near.withColumn("_d2", dx * dx + dy * dy).groupBy(*keys, *ids).agg(
            F.min_by("_sid", F.struct("_d2", "_sid")).alias(source_id), F.sqrt(F.min("_d2")).alias("distance")
        )
        widest = max(span["a"] - span["b"], span["c"] - span["d"], 0.0)
        settled = cut(found.where(F.col("distance") <= size))
        done = settled if done is None else done.unionByName(settled)
        open_t = cut(open_t.join(settled.select(*keys, *ids), [*keys, *ids], "left_anti"))
        if open_t.isEmpty():
            return done
        # far targets need a bucket as wide as their distance; jump once the source extent is covered
        size = size * 2.0 if size < widest else size * 8.0
    raise ValueError("targets lie too far from any source for the given cell size")


# fixed values: target statuses of the native-to-ortho mapping
ORTHO_QA_INVALID, NO_SOURCE, SOURCE_QA_INVALID, MAPPED = "ortho_qa_invalid", "no_geolocated_source", "source_qa_no_call", "mapped"


def map_native(targets: DataFrame, sources: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Status and source of every ortho cell.

    ``targets(keys, target_id, x, y, qa_valid)``; ``sources(keys, source_id, x, y, geo_valid, qa_valid)``.
    The nearest geolocated source is chosen before its quality is looked at; ``multiplicity`` is how many
    cells share the source.
    """
    near = nearest(targets.where("qa_valid"), sources.where("geo_valid"), keys, ["target_id"], "source_id", cell)
    reuse = near.groupBy(*keys, "source_id").agg(F.count(F.lit(1)).alias("multiplicity"))
    src = sources.select(*keys, "source_id", F.col("qa_valid").alias("_sq"))
    j = (
        targets.select(*keys, "target_id", "qa_valid")
        .join(near, [*keys, "target_id"], "left")
        .join(src.join(reuse, [*keys, "source_id"]), [*keys, "source_id"], "left")
    )
    status = (
        F.when(~F.col("qa_valid"), ORTHO_QA_INVALID)
        .when(F.col("source_id").isNull(), NO_SOURCE)
        .when(F.col("_sq"), MAPPED)
        .otherwise(SOURCE_QA_INVALID)
    )
    return j.select(*keys, "target_id", "source_id", "distance", F.coalesce("multiplicity", F.lit(0)).alias("multiplicity"), status.alias("status"))


def mapping_counts(mapping: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """The thirteen accounting counts of a mapping per key; target categories sum to the total."""
    st = F.col("status")
    t = mapping.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_target"),
        F.count_if(st == ORTHO_QA_INVALID).alias("invalid_qa_target"),
        F.count_if(st == SOURCE_QA_INVALID).alias("source_no_call_target"),
        F.count_if(st == NO_SOURCE).alias("no_source_target"),
        F.count_if(st == MAPPED).alias("mapped_target"),
        F.count_if(st != MAPPED).alias("unmapped_target"),
    )
    used = mapping.where(F.col("source_id").isNotNull()).groupBy(*keys, "source_id").agg(F.count(F.lit(1)).alias("_m"))
    u = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used_source"),
        F.count_if(F.col("_m") > 1).alias("shared_source"),
        F.sum(F.col("_m") - 1).alias("duplicate_assignments"),
    )
    s = sources.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_source"),
        F.count_if(~F.col("qa_valid")).alias("invalid_qa_source"),
        F.count_if(~F.col("geo_valid")).alias("invalid_geo_source"),
    )
    out = attach(attach(t, s, keys), u, keys, "left")
    return out.withColumn("unused_source", F.col("total_source") - F.coalesce("used_source", F.lit(0)))


def project_field(mapping: DataFrame, field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A source field carried to the mapped target cells; missing elsewhere."""
    m = mapping.withColumn("_s", F.when(F.col("status") == MAPPED, F.col("source_id")))
    f = field.select(*keys, F.col("source_id").alias("_s"), value)
    hit = m.where(F.col("_s").isNotNull()).join(f, [*keys, "_s"], "left").select(*keys, "target_id", value)
    gap = m.where(F.col("_s").isNull()).select(*keys, "target_id", F.lit(None).cast(field.schema[value].dataType).alias(value))
    return hit.unionByName(gap)


def copy_audit(ortho: DataFrame, native: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Ortho spectra identical to any native spectrum and to the selected one.

    Spectra meet by digest and then by value; native copies collapse first, so repeated fill spectra do
    not multiply.  ``ortho(keys, target_id, refl)``, ``native(keys, source_id, refl)`` hold valid spectra.
    """
    def tag(df: DataFrame) -> DataFrame:
        text = F.array_join(F.transform("refl", lambda v: v.cast("string")), ",")
        return df.withColumn("_h", F.sha2(text, 256))

    o = tag(ortho)
    lib = tag(native).groupBy(*keys, "_h", "refl").agg(F.lit(1).alias("_1"))
    any_match = o.join(lib.select(*keys, "_h", "refl"), [*keys, "_h", "refl"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("match_any"))
    sel = o.join(mapping.where(F.col("status") == MAPPED).select(*keys, "target_id", "source_id"), [*keys, "target_id"])
    sel = sel.join(native.select(*keys, "source_id", F.col("refl").alias("_n")), [*keys, "source_id"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mapped_ortho"), F.count_if(F.col("refl") == F.col("_n")).alias("match_selected")
    )
    total = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_ortho"))
    out = attach(attach(total, any_match, keys, "left"), sel, keys, "left").na.fill(0)
    return out.withColumn("match_any_fraction", ratio("match_any", "valid_ortho")).withColumn(
        "match_selected_fraction", ratio("match_selected", "mapped_ortho")
    )


def boundary_distance(
    cells: DataFrame, keys: list[str], res_x: float, res_y: float, weight: str | None = None
) -> DataFrame:
    """Larger of the two directed 95th percentiles of nearest-boundary distance; missing without boundary.

    ``cells(keys, row_i, col_i, on_a, on_b)`` from ``boundary_cells``; ``weight`` counts a cell repeatedly.  A task holds
    the boundary cells of one key (a scene, at a shift or in a replicate) as arrays.
    """
    rows = cells.where("on_a OR on_b").select(*keys, "row_i", "col_i", "on_a", "on_b", (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))

    def distance(p: pd.DataFrame) -> float:
        a, b = p["on_a"].to_numpy(bool), p["on_b"].to_numpy(bool)
        return edges.symmetric_distance(p["row_i"].to_numpy(), p["col_i"].to_numpy(), a, b, res_x, res_y, p["_w"].to_numpy())

    return _per_key(rows, keys, distance)


def symmetric_boundary_distance(df: DataFrame, keys: list[str], a: str, b: str, res_x: float, res_y: float) -> DataFrame:
    """``boundary_distance`` of two 0/1 maps over jointly present cells, each key's cells moved once."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, "row_i", "col_i", F.col(a).cast("int").alias("_a"), F.col(b).cast("int").alias("_b"))

    def distance(p: pd.DataFrame) -> float:
        row, col = p["row_i"].to_numpy(np.int64), p["col_i"].to_numpy(np.int64)
        on_a, on_b = edges.boundary(row, col, [p["_a"].to_numpy(), p["_b"].to_numpy()])
        return edges.symmetric_distance(row, col, on_a, on_b, res_x, res_y)

    return _per_key(rows, keys, distance)


def _per_key(rows: DataFrame, keys: list[str], distance: Callable[[pd.DataFrame], float]) -> DataFrame:
    """``keys, boundary_m`` of the keys that have one."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("boundary_m", T.DoubleType())])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p[keys].head(1).assign(boundary_m=distance(p))

    return rows.groupBy(*keys).applyInPandas(run, schema).where(F.col("boundary_m").isNotNull() & ~F.isnan("boundary_m"))
