"""Index, coordinate and id arithmetic of affine grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_center(index: Column, origin: float, step: float) -> Column:
    """Coordinate of a cell centre."""
    return F.lit(float(origin)) + (index + F.lit(0.5)) * F.lit(float(step))


def flat_index(row: Column, col: Column, n_cols: int) -> Column:
    return row.cast("bigint") * n_cols + col


def row_of(flat: Column, n_cols: int) -> Column:
    return F.floor(flat / n_cols).cast("int")


def col_of(flat: Column, n_cols: int) -> Column:
    return (flat % n_cols).cast("int")


def block_name(block_row: Column, block_col: Column) -> Column:
    return F.format_string("r%04d_c%04d", block_row.cast("int"), block_col.cast("int"))


def patch_name(site: Column, patch_row: Column, patch_col: Column) -> Column:
    return F.format_string("%s_r%d_c%d", site.cast("string"), patch_row.cast("int"), patch_col.cast("int"))


def class_list(classes: Column) -> Column:
    return F.array_join(F.array_sort(classes).cast("array<string>"), ";")
