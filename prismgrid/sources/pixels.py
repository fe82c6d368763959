"""Readers: pixel tables, library text files, file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import as_doubles

# fixed values: deleted-channel sentinel of library files, spectrometer tokens in their names
DELETED = -1e30
SPECTROMETERS = {"ASDFR": "ASD", "BECK": "BECK"}

PIXEL_SCHEMA = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("tile_row", T.IntegerType()),
    T.StructField("tile_col", T.IntegerType()),
    T.StructField("row_i", T.IntegerType()),
    T.StructField("col_i", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("cloud", T.ShortType()),
    T.StructField("cirrus", T.ShortType()),
    T.StructField("nodata", T.ShortType()),
    T.StructField("refl", T.ArrayType(T.FloatType())),
])


def read_pixels(
    spark: SparkSession, path: str, schema: T.StructType = PIXEL_SCHEMA, where: Column | None = None, refl: str = "refl"
) -> DataFrame:
    """Pixel table with a fixed schema; ``where`` on partition or tile columns reaches the scan.

    NaN becomes NULL and spectra become DOUBLE.
    """
    df = spark.read.schema(schema).parquet(path)
    df = df.where(where) if where is not None else df
    floats = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in floats})
    return df.withColumn(refl, as_doubles(refl))


def read_library_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per library file: ``file_name, value`` (whole text)."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), "value"
    )


def _spectrometer() -> Column:
    """Spectrometer whose token the file name holds."""
    name = F.lit(None).cast("string")
    for token, known in reversed(list(SPECTROMETERS.items())):
        name = F.when(F.contains("file_name", F.lit(token)), F.lit(known)).otherwise(name)
    return name


def parse_library(files: DataFrame, minerals: list[str], grids: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Spectra and rejects from library texts (header line, then one value per line).

    ``grids(spectrometer, n_bands)``.  A file belongs to every mineral whose name stands between the
    collection token and an underscore at the start of its name, in any case; the spectrometer is found by its
    token.  Deleted channels are missing; a wrong length or unknown name is rejected.
    """
    lower = F.lower("file_name")
    names = F.array(*[F.lit(m) for m in sorted(minerals)])
    mineral = F.explode_outer(F.filter(names, lambda m: F.startswith(lower, F.concat(F.lit(f"{collection.lower()}_"), F.lower(m), F.lit("_")))))
    spectrometer = _spectrometer()
    lines = F.filter(F.expr(r"slice(split(value, '\r?\n'), 2, size(split(value, '\r?\n')))"), lambda s: F.trim(s) != "")
    values = F.transform(F.transform(lines, lambda s: s.try_cast("double")), lambda v: F.when(v > DELETED, v))
    rows = files.select(
        mineral.alias("mineral"), F.regexp_replace("file_name", r"\.[^.]*$", "").alias("sample"), spectrometer.alias("spectrometer"), values.alias("refl")
    )
    j = rows.join(F.broadcast(grids), "spectrometer", "left")
    reason = (
        F.when(F.col("mineral").isNull(), "unknown_mineral").when(F.col("n_bands").isNull(), "unknown_spectrometer")
        .when(F.size("refl") != F.col("n_bands"), "length_mismatch")
    )
    j = j.withColumn("reason", reason)
    good = j.where(F.col("reason").isNull()).select("mineral", "sample", "spectrometer", "refl")
    return good, j.where(F.col("reason").isNotNull()).select("mineral", "sample", "spectrometer", "reason")


def parse_axes(files: DataFrame) -> DataFrame:
    """``spectrometer, n_bands, axis_nm`` from wavelength texts (header line, then one value in micrometres per line).

    A file is known as an axis by a spectrometer token and the word "wavelength" in its name, in any case; of
    several of one spectrometer the first by name counts.  Deleted channels have no wavelength.
    """
    kind = _spectrometer()
    lines = F.filter(F.expr(r"slice(split(value, '\r?\n'), 2, size(split(value, '\r?\n')))"), lambda s: F.trim(s) != "")
    axis = F.transform(F.transform(lines, lambda s: s.try_cast("double")), lambda v: F.when(v > DELETED, v * 1000.0))
    rows = files.where(F.contains(F.lower("file_name"), F.lit("wavelength")) & kind.isNotNull()).select(kind.alias("spectrometer"), "file_name", axis.alias("axis_nm"))
    return rows.groupBy("spectrometer").agg(F.min_by("axis_nm", "file_name").alias("axis_nm")).select("spectrometer", F.size("axis_nm").alias("n_bands"), "axis_nm")


def library_on_axis(files: DataFrame, minerals: list[str], collection: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library spectra resampled to a sensor, and the rejected files.

    Value files meet the wavelength file of their spectrometer among ``files``.  ``targets(target_index, target_nm)``
    is the sensor's axis; returns ``mineral, sample, spectrometer, target_index, target_nm, value`` (missing outside the
    sampled range) and ``mineral, sample, spectrometer, reason``.
    """
    from ..operators.library import resample

    axes = parse_axes(files)
    spectra = files.where(~F.contains(F.lower("file_name"), F.lit("wavelength")))
    good, rejects = parse_library(spectra, minerals, axes.select("spectrometer", "n_bands"), collection)
    pairs = F.explode(F.arrays_zip(F.col("axis_nm").alias("wavelength_nm"), F.col("refl").alias("value"))).alias("p")
    long = good.join(F.broadcast(axes.select("spectrometer", "axis_nm")), "spectrometer").select("mineral", "sample", "spectrometer", pairs)
    long = long.select("mineral", "sample", "spectrometer", F.col("p.wavelength_nm").alias("wavelength_nm"), F.col("p.value").alias("value")).where("wavelength_nm IS NOT NULL")
    return resample(long, ["mineral", "sample", "spectrometer"], targets), rejects


def checksum_manifest(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, bytes, sha256`` of every file below ``path``, by name relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*" + path.rstrip("/").replace(".", r"\.") + "/", "")
    out = files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return out.where(F.endswith("path", F.lit(suffix))) if suffix else out


def manifest_differences(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Files missing from, extra in or changed against a declared manifest; none when the set is exact."""
    j = declared.select("path", F.col("sha256").alias("_d")).join(observed.select("path", F.col("sha256").alias("_o")), "path", "full")
    status = F.when(F.col("_o").isNull(), "missing").when(F.col("_d").isNull(), "extra").when(F.col("_d") != F.col("_o"), "changed")
    return j.select("path", status.alias("status")).where(F.col("status").isNotNull())
