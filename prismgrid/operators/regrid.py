"""Moving values between grids: lookup tables, nearest, bilinear and area averages, shifts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import attach


@dataclass(frozen=True)
class Grid:
    """Affine grid: origin of the upper-left corner, signed steps and shape."""

    x0: float
    dx: float
    y0: float
    dy: float
    n_rows: int
    n_cols: int


def glt_gather(glt: DataFrame, swath: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Swath values at the 1-based pointers of a lookup table; pointer 0 is fill and stays missing."""
    src = swath.select(*keys, (F.col("src_row") + 1).alias("src_y"), (F.col("src_col") + 1).alias("src_x"), *values)
    filled = (F.col("src_x") > 0) & (F.col("src_y") > 0)
    # fill cells would all meet on one key: they skip the join
    hit = glt.where(filled).join(src, [*keys, "src_y", "src_x"], "left")
    cols = [*glt.columns, *values]
    gaps = glt.where(~filled).select(*glt.columns, *[F.lit(None).cast(swath.schema[v].dataType).alias(v) for v in values])
    return hit.select(*cols).unionByName(gaps.select(*cols))


def swath_window(glt: DataFrame, swath: DataFrame) -> DataFrame:
    """The part of the swath that a (windowed) lookup table points into.

    The range of its pointers (one row) becomes constants on ``src_row`` and ``src_col`` that reach the scan
    of the swath; a window that is all fill needs nothing of it.
    """
    filled = (F.col("src_x") > 0) & (F.col("src_y") > 0)
    r = glt.where(filled).agg(F.min("src_y"), F.max("src_y"), F.min("src_x"), F.max("src_x")).collect()[0]
    if r[0] is None:
        return swath.limit(0)
    return swath.where(F.col("src_row").between(r[0] - 1, r[1] - 1) & F.col("src_col").between(r[2] - 1, r[3] - 1))


def glt_violations(glt: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Cells whose pointers disagree about fill or leave the swath."""
    x, y = F.col("src_x"), F.col("src_y")
    reason = F.when((x == 0) != (y == 0), "fill_disagrees").when(
        (x < 0) | (y < 0) | (x > n_cols) | (y > n_rows), "out_of_bounds"
    )
    return glt.withColumn("violation", reason).where(F.col("violation").isNotNull())


def window_rows(lo: float, hi: float, origin: float, step: float, n: int) -> tuple[int, int]:
    """Half-open index window of a coordinate interval, floor / ceil + 1 and clamped."""
    import math

    a, b = sorted(((lo - origin) / step, (hi - origin) / step))
    return max(0, math.floor(a)), min(n, math.ceil(b) + 1)


def in_window(df: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of the lookup table inside ``(x_min, y_min, x_max, y_max)``; the ranges reach the file scan."""
    r0, r1 = window_rows(box[1], box[3], grid.y0, grid.dy, grid.n_rows)
    c0, c1 = window_rows(box[0], box[2], grid.x0, grid.dx, grid.n_cols)
    return df.where((F.col("row_i") >= r0) & (F.col("row_i") < r1) & (F.col("col_i") >= c0) & (F.col("col_i") < c1))


def _inside(row: Column, col: Column, g: Grid) -> Column:
    return (row >= 0) & (row < g.n_rows) & (col >= 0) & (col < g.n_cols)


def nearest_regrid(
    targets: DataFrame, source: DataFrame, grid: Grid, keys: list[str], values: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Value of the source cell that contains each target centre; missing outside the source."""
    r = F.floor((F.col(y) - grid.y0) / grid.dy).cast("int")
    c = F.floor((F.col(x) - grid.x0) / grid.dx).cast("int")
    src = source.select(*keys, F.col("row_i").alias("_r"), F.col("col_i").alias("_c"), *values)
    t = targets.withColumn("_r", r).withColumn("_c", c)
    return t.join(src, [*keys, "_r", "_c"], "left").select(*targets.columns, *values)


def bilinear_regrid(
    targets: DataFrame, source: DataFrame, grid: Grid, keys: list[str], value: str, ids: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Bilinear value at target centres, weights renormalised over the present neighbours.

    ``ids`` identify a target row.  Targets outside the source extent are missing.
    """
    u = (F.col(x) - grid.x0) / grid.dx - 0.5
    v = (F.col(y) - grid.y0) / grid.dy - 0.5
    t = targets.withColumn("_u", u).withColumn("_v", v)
    c0, r0 = F.floor("_u"), F.floor("_v")
    fx, fy = F.col("_u") - c0, F.col("_v") - r0
    corners = F.array(*[
        F.struct((r0 + i).cast("int").alias("r"), (c0 + j).cast("int").alias("c"), ((fy if i else 1.0 - fy) * (fx if j else 1.0 - fx)).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ])
    inside = (F.col("_u") >= -0.5) & (F.col("_u") < grid.n_cols - 0.5) & (F.col("_v") >= -0.5) & (F.col("_v") < grid.n_rows - 0.5)
    near = t.where(inside).select(*ids, F.explode(corners).alias("k")).select(
        *ids, F.col("k.r").alias("_r"), F.col("k.c").alias("_c"), F.col("k.w").alias("_w")
    ).where("_w > 0")
    src = source.where(F.col(value).isNotNull()).select(*keys, F.col("row_i").alias("_r"), F.col("col_i").alias("_c"), F.col(value).alias("_val"))
    got = near.join(src, [*keys, "_r", "_c"]).groupBy(*ids).agg(
        (F.sum(F.col("_w") * F.col("_val")) / F.sum("_w")).alias(value)
    )
    return targets.join(got, ids, "left")


def _overlaps(source: DataFrame, grid: Grid, target: Grid, keys: list[str], values: list[str]) -> DataFrame:
    """Target cells that each source cell reaches (mostly one) with the overlap area as share of the target: ``keys, row_i, col_i, values, _w``.

    Sums over a target are then taken where the source is scanned: no list of source cells is made for a target, and
    no join has to bring the two together.
    """
    def span(index: Column, s0: float, ss: float, t0: float, ts: float) -> Column:
        a = (F.lit(s0) + index * ss - t0) / ts
        b = (F.lit(s0) + (index + 1) * ss - t0) / ts
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.transform(
            F.sequence(F.floor(lo), F.ceil(hi) - 1), lambda t: F.struct(t.cast("int").alias("i"), (F.least(hi, t + 1.0) - F.greatest(lo, t.cast("double"))).alias("w"))
        )

    rows = span(F.col("row_i"), grid.y0, grid.dy, target.y0, target.dy)
    cols = span(F.col("col_i"), grid.x0, grid.dx, target.x0, target.dx)
    cells = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r["i"].alias("row_i"), c["i"].alias("col_i"), (r["w"] * c["w"]).alias("_w")))))
    # outer: an inner explode would be computed a second time, as a filter before it
    met = source.where(_inside(F.col("row_i"), F.col("col_i"), grid)).select(*keys, *values, F.explode_outer(cells).alias("_t"))
    return met.select(*keys, *values, "_t.*").where("_w > 1e-12")


def area_average(targets: DataFrame, source: DataFrame, target: Grid, grid: Grid, keys: list[str], value: str) -> DataFrame:
    """Area-weighted mean of the present source values under each target cell."""
    ids = [*keys, "row_i", "col_i"]
    src = source.where(F.col(value).isNotNull())
    got = _overlaps(src, grid, target, keys, [value]).groupBy(*ids).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))
    return targets.join(got, ids, "left")


def block_footprint(targets: DataFrame, blocks_of_cells: DataFrame, target: Grid, grid: Grid, keys: list[str]) -> DataFrame:
    """Block of each target cell when it lies fully inside one complete block; flags otherwise.

    ``blocks_of_cells(keys, row_i, col_i, block_id)`` lists the source cells of complete blocks.  Cells are first summed for
    each target and block, by hash: least and greatest of names need sorted rows, and then have few to sort.
    """
    ids = [*keys, "row_i", "col_i"]
    per_block = _overlaps(blocks_of_cells, grid, target, keys, ["block_id"]).groupBy(*ids, "block_id").agg(F.sum("_w").alias("_w"))
    got = per_block.groupBy(*ids).agg(F.sum("_w").alias("_cov"), F.min("block_id").alias("_lo"), F.max("block_id").alias("_hi"))
    full = F.coalesce(F.col("_cov") > 1 - 1e-9, F.lit(False))
    one = full & (F.col("_lo") == F.col("_hi"))
    return targets.join(got, ids, "left").select(
        *targets.columns,
        F.when(one, F.col("_lo")).alias("block_id"),
        (full & ~one).alias("crosses_boundary"),
        (~full).alias("incomplete_support"),
    )


def neighbourhood(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each cell with the values of its 3 x 3 surroundings: ``nb ARRAY<STRUCT<dr, dc, values...>>``.

    A cell goes to its own row and the two next to it, which stacks columns of three; a window along the
    row then picks up the stacks left and right.  Three copies travel instead of nine, and surroundings
    that do not exist are absent from the array.
    """
    lines = F.array(*[F.struct(F.lit(i).alias("dr"), (F.col("row_i") - i).alias("row")) for i in (-1, 0, 1)])
    e = df.select(*keys, F.explode(lines).alias("_k"), "col_i", *values)
    entry = F.struct(F.col("_k.dr").alias("dr"), *[F.col(v) for v in values])
    own = F.max(F.when(F.col("_k.dr") == 0, F.struct(*[F.col(v) for v in values], F.lit(True).alias("_is"))))
    stack = e.groupBy(*keys, F.col("_k.row").alias("row_i"), "col_i").agg(F.collect_list(entry).alias("_s"), own.alias("_own"))
    along = Window.partitionBy(*keys, "row_i").orderBy("col_i")
    cell = F.struct(F.col("col_i").alias("c"), F.col("_s").alias("s"))
    w = stack.withColumn("_l", F.lag(cell).over(along)).withColumn("_r", F.lead(cell).over(along)).withColumn("_m", cell)

    def column(side: str, dc: int) -> Column:
        tag = F.transform(F.col(f"{side}.s"), lambda x: F.struct(x["dr"].alias("dr"), F.lit(dc).alias("dc"), *[x[v].alias(v) for v in values]))
        return F.when(F.col(f"{side}.c") == F.col("col_i") + dc, tag)

    mid = column("_m", 0)
    none = F.filter(mid, lambda x: F.lit(False))
    nb = F.concat(F.coalesce(column("_l", -1), none), mid, F.coalesce(column("_r", 1), none))
    return w.where(F.col("_own._is")).select(*keys, "row_i", "col_i", *[F.col(f"_own.{v}").alias(v) for v in values], nb.alias("nb"))


def shifted_pairs(df: DataFrame, keys: list[str], anchor: list[str], repeat: list[str]) -> DataFrame:
    """Anchor values against the repeat raster moved by each of the nine unit shifts.

    A repeat moved by (dy, dx) shows at (row, col) what stood at (row - dy, col - dx); no wraparound.
    Nothing is shuffled beyond ``neighbourhood``.  A cell without a counterpart has NULL repeat values.
    """
    n = neighbourhood(df, keys, list(dict.fromkeys([*anchor, *repeat])))
    offsets = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    e = n.select(*keys, "row_i", "col_i", *anchor, "nb", F.explode(offsets).alias("o"))
    hit = F.filter("nb", lambda x: (x["dr"] == -F.col("o.dy")) & (x["dc"] == -F.col("o.dx")))
    return e.withColumn("_h", F.get(hit, 0)).select(
        *keys, "row_i", "col_i", F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx"),
        *anchor, *[F.col(f"_h.{v}").alias(f"shifted_{v}") for v in repeat],
    )


def boundary_cells(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Boundary cells of two 0/1 maps over jointly present cells: ``keys, row_i, col_i, on_a, on_b``.

    A cell is on a boundary when its value is 1 and one of its eight neighbours is 0; raster edges and
    missing cells do not count.  ``keys`` may include the block, which keeps the test inside blocks.
    """
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = neighbourhood(joint, keys, [a, b])

    def on(v: str) -> Column:
        return (F.col(v) == 1) & F.exists("nb", lambda e: e[v] == 0)

    return n.select(*keys, "row_i", "col_i", on(a).alias("on_a"), on(b).alias("on_b")).where("on_a OR on_b")
