"""Writers: layers, result tables, patch chips and their round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import col


def write_layers(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Score rows as one Parquet folder per scene and layer."""
    df.repartition("scene_id", "layer", F.pmod(F.hash("row_i"), F.lit(16))).write.mode(mode).partitionBy("scene_id", "layer").parquet(path)


def formatted(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Result columns in stable order, doubles in fixed notation, undefined as blank."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        v = F.col(c)
        s = F.format_string(f"%.{digits}f", v) if types[c] in ("double", "float") else v.cast("string")
        return F.when(v.isNotNull(), s).otherwise("").alias(c)

    return df.select(*[text(c) for c in columns])


def write_results(df: DataFrame, path: str, columns: list[str], digits: int = 6, mode: str = "errorifexists") -> None:
    formatted(df, columns, digits).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def chips(pixels: DataFrame, patches: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Full-band pixels of each patch, with its id and centre cell.

    ``patches(keys, patch_row, patch_col, patch_id)``.
    """
    p = pixels.withColumn("patch_row", F.floor(F.col("row_i") / size).cast("int")).withColumn("patch_col", F.floor(F.col("col_i") / size).cast("int"))
    half = size // 2
    return p.join(patches.select(*keys, "patch_row", "patch_col", "patch_id"), [*keys, "patch_row", "patch_col"]).withColumn(
        "center_row", F.col("patch_row") * size + half
    ).withColumn("center_col", F.col("patch_col") * size + half)


def write_chips(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per patch; a patch has a fixed number of pixels, so it is one file."""
    df.repartition("patch_id").write.mode(mode).partitionBy("patch_id").parquet(path)


def round_trip_differences(written: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pixels that differ between an export and its source window, missing equal to missing."""
    a = written.select(*keys, col(value).alias("_a"), F.lit(1).alias("_wa"))
    b = source.select(*keys, col(value).alias("_b"), F.lit(1).alias("_wb"))
    j = a.join(b, keys, "full")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_wa").isNull() | F.col("_wb").isNull()).select(*keys)
