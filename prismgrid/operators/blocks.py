"""Square spatial blocks: construction, sampling, halos, support counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import block_name
from ..functions.rules import support_tier
from .stats import attach


def block_dimensions(ranges: DataFrame, keys: list[str], pixel_size: float, value: str = "practical_range") -> DataFrame:
    """Block side and halo in whole pixels from the largest practical range."""
    r = F.max(value) / F.lit(float(pixel_size))
    return ranges.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(r * 2.0)).cast("int").alias("side"),
        F.greatest(F.lit(1), F.ceil(r)).cast("int").alias("halo"),
    )


def grid_shape(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg((F.max("row_i") + 1).alias("n_rows"), (F.max("col_i") + 1).alias("n_cols"))


def complete_blocks(grids: DataFrame, keys: list[str], side: int) -> DataFrame:
    """All complete blocks from the upper-left corner; the edge remainder is left out.

    ``grids(keys, n_rows, n_cols)``; half-open bounds and row-major numeric ids from 1.
    """
    rows, cols = F.floor(F.col("n_rows") / side), F.floor(F.col("n_cols") / side)
    usable = grids.withColumn("_nr", rows).withColumn("_nc", cols).where("_nr > 0 AND _nc > 0")
    b = usable.select(
        *keys, "_nc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nr") - 1)).alias("block_row")
    ).select(*keys, "_nc", "block_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nc") - 1)).alias("block_col"))
    r, c = F.col("block_row").cast("int"), F.col("block_col").cast("int")
    return b.select(
        *keys,
        block_name(r, c).alias("block_id"),
        (F.col("block_row") * F.col("_nc") + F.col("block_col") + 1).cast("int").alias("numeric_block_id"),
        r.alias("block_row"),
        c.alias("block_col"),
        (r * side).alias("row_start"),
        ((r + 1) * side).alias("row_stop"),
        (c * side).alias("col_start"),
        ((c + 1) * side).alias("col_stop"),
    )


def in_complete_blocks(cells: DataFrame, grids: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Cells of complete blocks with their ``block_id``; missing values stay in place.

    An outer join, from which cells without a grid are then filtered: Spark judges cells by their file size and may
    broadcast them, but it never broadcasts the side that an outer join keeps.
    """
    g = grids.select(*keys, F.floor(F.col("n_rows") / side).alias("_nr"), F.floor(F.col("n_cols") / side).alias("_nc"))
    br, bc = F.floor(F.col("row_i") / side), F.floor(F.col("col_i") / side)
    return (
        attach(cells, g, keys, "left")
        .where((br < F.coalesce("_nr", F.lit(0))) & (bc < F.coalesce("_nc", F.lit(0))))
        .withColumn("block_id", block_name(br, bc))
        .drop("_nr", "_nc")
    )


def broken_blocks(sampled: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Blocks that are not one full rectangle of distinct cells (contract violations)."""
    return (
        sampled.groupBy(*keys, "block_id")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            (F.max("row_i") - F.min("row_i") + 1).alias("height"),
            (F.max("col_i") - F.min("col_i") + 1).alias("width"),
        )
        .where((F.col("n_cells") != side * side) | (F.col("height") != side) | (F.col("width") != side))
    )


def boxes_meet(a: dict[str, Column], b: dict[str, Column], halo: Column | int) -> Column:
    """True where box ``a`` overlaps box ``b`` grown by ``halo`` (strict inequalities)."""
    return (
        (a["row_start"] < b["row_stop"] + halo)
        & (a["row_stop"] > b["row_start"] - halo)
        & (a["col_start"] < b["col_stop"] + halo)
        & (a["col_stop"] > b["col_start"] - halo)
    )


BOUNDS = ["row_start", "row_stop", "col_start", "col_stop"]


def training_pairs(blocks: DataFrame, keys: list[str], halo: int) -> DataFrame:
    """Per held-out block (``fold``) the blocks whose box does not meet its box grown by the halo.

    Block-grain join inside one site (``keys`` name it); the blocks of a site are fixed by its grid.
    """
    held = blocks.select(*keys, F.col("block_id").alias("fold"), *[F.col(b).alias(f"_h_{b}") for b in BOUNDS])
    a = {b: F.col(b) for b in BOUNDS}
    h = {b: F.col(f"_h_{b}") for b in BOUNDS}
    j = attach(held, blocks.select(*keys, "block_id", *BOUNDS), keys)
    return j.where((F.col("block_id") != F.col("fold")) & ~boxes_meet(a, h, halo)).select(*keys, "fold", "block_id")


def halo_cells(cells: DataFrame, blocks: DataFrame, keys: list[str], side: int, halo: int) -> DataFrame:
    """Cells a fold must not train on: inside the held block or its halo, as ``fold`` per cell.

    Each cell lists the grid blocks whose halo holds it (mostly its own alone) and meets them by equality.  Rows that an
    explode makes are not in Spark's size estimate, so the join is a shuffle whatever the cells seem to weigh.
    """
    def within(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / side).cast("int"), F.floor((F.col(c) + halo) / side).cast("int"))

    c = cells.withColumn("block_row", F.explode(within("row_i"))).withColumn("block_col", F.explode(within("col_i")))
    near = (
        (F.col("row_i") >= F.col("row_start") - halo)
        & (F.col("row_i") < F.col("row_stop") + halo)
        & (F.col("col_i") >= F.col("col_start") - halo)
        & (F.col("col_i") < F.col("col_stop") + halo)
    )
    b = blocks.select(*keys, "block_row", "block_col", F.col("block_id").alias("fold"), *BOUNDS)
    return c.hint("merge").join(b, [*keys, "block_row", "block_col"]).where(near).select(*cells.columns, "fold")


def fold_checks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Contract violations of a block table: bad bounds, duplicate ids, overlapping boxes.

    Overlap is looked for among boxes that share a corner cell of a coarse grid.
    """
    size = blocks.agg(F.max(F.greatest(F.col("row_stop") - F.col("row_start"), F.col("col_stop") - F.col("col_start"))).alias("_side"))
    b = blocks.join(F.broadcast(size))
    bad = b.where((F.col("row_start") >= F.col("row_stop")) | (F.col("col_start") >= F.col("col_stop")) | (F.col("row_start") < 0) | (F.col("col_start") < 0))
    bad = bad.select(*keys, "block_id", F.lit("bad_bounds").alias("violation"))
    dup = blocks.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dup = dup.select(*keys, "block_id", F.lit("duplicate_id").alias("violation"))
    tiles = b.select(
        *keys, "block_id", *BOUNDS,
        F.explode(F.sequence(F.floor(F.col("row_start") / F.col("_side")), F.floor((F.col("row_stop") - 1) / F.col("_side")))).alias("_tr"),
        F.floor(F.col("col_start") / F.col("_side")).alias("_tc0"), F.floor((F.col("col_stop") - 1) / F.col("_side")).alias("_tc1"),
    ).select(*keys, "block_id", *BOUNDS, "_tr", F.explode(F.sequence("_tc0", "_tc1")).alias("_tc"))
    left = tiles.select(*keys, "_tr", "_tc", F.col("block_id").alias("_id"), *[F.col(c).alias(f"_h_{c}") for c in BOUNDS])
    meet = boxes_meet({c: F.col(c) for c in BOUNDS}, {c: F.col(f"_h_{c}") for c in BOUNDS}, 0)
    over = tiles.join(left, [*keys, "_tr", "_tc"]).where((F.col("block_id") != F.col("_id")) & meet)
    over = over.select(*keys, "block_id", F.lit("overlap").alias("violation")).distinct()
    return bad.unionByName(dup).unionByName(over)


def bearing_blocks(sampled: DataFrame, keys: list[str], score: str = "score", ref: str = "ref") -> DataFrame:
    """Blocks with at least one usable positive / negative, and the support tier."""
    both = F.col(score).isNotNull()
    per = sampled.groupBy(*keys, "block_id").agg(
        F.count_if(both & (F.col(ref) == 1)).alias("_p"), F.count_if(both & (F.col(ref) == 0)).alias("_n")
    )
    out = per.groupBy(*keys).agg(
        F.count_if(F.col("_p") > 0).alias("positive_blocks"),
        F.count_if(F.col("_n") > 0).alias("negative_blocks"),
        F.sum("_p").alias("n_pos"),
        F.sum("_n").alias("n_neg"),
    )
    return out.withColumn("tier", support_tier("positive_blocks", "negative_blocks"))


def overlap_blocks(sampled: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Blocks with at least one cell present on both dates."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return sampled.groupBy(*keys, "block_id").agg(F.bool_or(both).alias("_k")).where("_k").drop("_k")
