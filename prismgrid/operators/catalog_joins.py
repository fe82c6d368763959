"""Joins over catalogue and result tables: granules, repeat pairs, crosswalks, scene inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import attach, top_rows

# fixed values: footprint share and cloud limit of a usable granule
MIN_OVERLAP = 0.99
MAX_CLOUD = 10.0


def granule_overlap(granules: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the site box that each granule footprint covers.

    ``granules(..., lon_min, lat_min, lon_max, lat_max)``, ``boxes(keys, s_lon_min, ...)``.
    """
    j = attach(granules, boxes, keys)

    def side(a: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(f"{a}_max", f"s_{a}_max") - F.greatest(f"{a}_min", f"s_{a}_min"))

    area = (F.col("s_lon_max") - F.col("s_lon_min")) * (F.col("s_lat_max") - F.col("s_lat_min"))
    return j.withColumn("overlap", side("lon") * side("lat") / F.nullif(area, F.lit(0.0)))


def rank_granules(granules: DataFrame, boxes: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """The first ``top_n`` granules per site: full overlap, clear before cloudy, then cloud and date.

    When a site has no clear granule all its granules are ranked instead; ``fallback`` says so.  Unknown
    cloud cover is not clear and comes after every known one.
    """
    ok = granule_overlap(granules, boxes, keys).where(F.col("overlap") >= MIN_OVERLAP)
    clear = F.coalesce(F.col("cloud") <= MAX_CLOUD, F.lit(False))
    some = ok.groupBy(*keys).agg(F.bool_or(clear).alias("_any"))
    j = attach(ok, some, keys).where(clear | ~F.col("_any")).withColumn("fallback", ~F.col("_any")).drop("_any")
    return top_rows(j, keys, [F.col("cloud").asc_nulls_last(), F.col("date")], ["granule"], top_n)


def repeat_pairs(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Anchor with every repeat (primary) and repeats among themselves (secondary), per site.

    ``scenes(keys, scene, role)`` with role ``anchor`` or ``repeat``; a site has a handful of scenes.
    """
    a = scenes.select(*keys, F.col("scene").alias("first"), F.col("role").alias("_ra"))
    b = scenes.select(*keys, F.col("scene").alias("second"), F.col("role").alias("_rb"))
    j = a.join(b, keys)
    primary = (F.col("_ra") == "anchor") & (F.col("_rb") == "repeat")
    secondary = (F.col("_ra") == "repeat") & (F.col("_rb") == "repeat") & (F.col("first") < F.col("second"))
    kind = F.when(primary, "primary").when(secondary, "secondary")
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "first", "second", "kind")


def crosswalk_violations(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Exact-set and completeness checks of a crosswalk: ``violation, grp, idx``.

    ``records(grp, idx)``; ``mapping(grp, idx, status, target, reason)``.
    """
    by = ["grp", "idx"]
    m = mapping.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    j = records.select(*by, F.lit(1).alias("_r")).join(m, by, "full")
    base = j.select(
        *by,
        F.array_compact(F.array(
            F.when(F.col("_n").isNull(), F.lit("record_without_mapping")),
            F.when(F.col("_r").isNull(), F.lit("mapping_without_record")),
            F.when(F.col("_n") > 1, F.lit("duplicate_mapping")),
        )).alias("v"),
    ).select(F.explode("v").alias("violation"), *by)
    mapped = F.col("status") == "mapped"
    empty = mapping.select(
        *by,
        F.when(mapped & F.col("target").isNull(), "mapped_without_target")
        .when(~mapped & F.col("reason").isNull(), "unmapped_without_reason").alias("violation"),
    ).where(F.col("violation").isNotNull())
    return base.unionByName(empty.select("violation", *by))


def endpoint_groups(mapping: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Mapped targets grouped into endpoints with the sorted list of their indices."""
    m = mapping.where(F.col("status") == "mapped")
    return m.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(index)).cast("array<string>"), ";").alias("targets"))


def scene_inventory(rows: DataFrame, box: tuple[float, float, float, float], asset: str) -> DataFrame:
    """Catalogue rows cross-listed by category, collapsed to scenes that meet the box.

    ``rows(scene, category, lon, lat, width, asset)``.
    """
    meets = (
        (F.col("lon") < box[2]) & (F.col("lon") + F.col("width") > box[0])
        & (F.col("lat") < box[3]) & (F.col("lat") + F.col("width") > box[1])
    )
    return rows.where(meets).groupBy("scene").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ";").alias("categories"),
        F.array_contains(F.collect_set("asset"), asset).alias("has_asset"),
        F.count(F.lit(1)).alias("n_rows"),
    )
