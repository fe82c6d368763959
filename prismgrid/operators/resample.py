"""Block bootstraps, whole-block nulls and paired randomisation from block-grain statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import block_weights, coin, indexed_blocks, ordering_rows, over_blocks, shuffled_orders, weighted_rows, with_replicates
from ..functions.rules import confusion, confusion_metrics, ratio
from ..session import cut
from .agree import overlap_counts, overlap_ratios
from .stats import _bucket, attach, dealt, value_edges

# fixed value: largest number of orderings that is enumerated instead of drawn
MAX_ORDERINGS = 9999
SLICE = 2048
BUCKET_ROWS = 50_000
#: Blocks of a side of a tile of the numerator matrix.
TILE_BLOCKS = 256


def pair_numerators(
    obs: DataFrame, keys: list[str], block: str = "block_id", score: str = "score", ref: str = "ref", steps: int | None = None
) -> DataFrame:
    """AUC numerator for every (positive block, negative block) of a key: ``p_block, n_block, u``.

    Scores are cut into buckets.  Pairs in different buckets follow from block-by-bucket counts, pairs in
    one bucket from that bucket's distinct scores.  Blocks are cut into groups of about ``TILE_BLOCKS``, and a task
    multiplies one group's positives by one group's negatives, so no task sees a whole key and no pixel pair is formed.
    The number of buckets follows the largest key unless ``steps`` fixes it at ``2**steps``.
    """
    counts = cut(
        obs.where(F.col(score).isNotNull() & F.col(ref).isNotNull())
        .groupBy(*keys, F.col(block).alias("_blk"), F.col(score).cast("double").alias("_s"))
        .agg(F.count_if(F.col(ref) == 1).alias("_p"), F.count_if(F.col(ref) == 0).alias("_n"))
    )
    sizes = cut(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("_blk").alias("_blocks")).withColumn(
        "_g", F.ceil(F.col("_blocks") / F.lit(float(TILE_BLOCKS))).cast("int")
    ))
    largest, near_rows, far_rows = (x or 1 for x in sizes.agg(F.max("_rows"), F.sum(F.col("_rows") * F.col("_g")), F.sum(F.col("_blocks") * F.col("_g"))).collect()[0])
    if steps is None:
        steps = max(1, math.ceil(math.log2(max(2.0, largest / BUCKET_ROWS))))
    # both ways of pairing read the rows with their bucket and their group of blocks
    per_key = attach(value_edges(counts, keys, "_s", steps), sizes.select(*keys, "_g"), keys)
    b = cut(attach(counts, per_key, keys).select(
        *counts.columns, _bucket(F.col("_s"), F.col("_edges"), steps).alias("_b"), "_g", F.pmod(F.hash("_blk"), F.col("_g")).alias("_own")
    ))
    out = T.StructType(
        [counts.schema[k] for k in keys]
        + [T.StructField("p_block", counts.schema["_blk"].dataType), T.StructField("n_block", counts.schema["_blk"].dataType), T.StructField("u", T.DoubleType())]
    )

    def product(pdf: pd.DataFrame, axis: str, ties: float) -> pd.DataFrame:
        is_pos = pdf["_side"].to_numpy() == 0
        # blocks of either side have their own numbers: a tile holds some blocks as positives, some as negatives
        sides = [pd.factorize(pdf["_blk"][m], sort=True) for m in (is_pos, ~is_pos)]
        val, levels = pd.factorize(pdf[axis], sort=True)
        weights = (pdf["_p"].to_numpy(float)[is_pos], pdf["_n"].to_numpy(float)[~is_pos])
        cells = []
        for (blk, _), w, m in zip(sides, weights, (is_pos, ~is_pos), strict=True):
            order = np.argsort(val[m], kind="stable")
            cells.append((val[m][order], blk[order], w[order]))
        p_names, n_names = (np.asarray(names) for _, names in sides)
        u, carried = np.zeros((len(p_names), len(n_names))), np.zeros(len(n_names))
        # slices of the sorted levels keep the dense part small; negatives below carry over
        for start in range(0, len(levels), SLICE):
            size = min(SLICE, len(levels) - start)
            dense = []
            for (v, blk, w), names in zip(cells, (p_names, n_names), strict=True):
                lo, hi = np.searchsorted(v, [start, start + SLICE])
                dense.append(np.bincount((v[lo:hi] - start) * len(names) + blk[lo:hi], w[lo:hi], size * len(names)).reshape(size, -1))
            pos, neg = dense
            u += pos.T @ (carried + np.cumsum(neg, axis=0) - neg + ties * neg)
            carried += neg.sum(axis=0)
        i, j = np.nonzero(u)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "p_block": p_names[i], "n_block": n_names[j], "u": u[i, j]})[[f.name for f in out.fields]]

    def tiled(df: DataFrame, rows: int, by: list[str], axis: str, ties: float) -> DataFrame:
        cols = [*dict.fromkeys([*by, axis]), "_blk", "_p", "_n"]
        others = F.sequence(F.lit(0), F.col("_g") - 1)

        def side(n: int, held: Column, i, j) -> Column:
            made = F.transform(others, lambda x: F.struct(F.lit(n).alias("_side"), i(x).alias("_i"), j(x).alias("_j")))
            return F.when(held, made).otherwise(F.array().cast("array<struct<_side:int,_i:int,_j:int>>"))

        mine = F.col("_own")
        # one explode for both sides: a union of the two would count as grouped already
        places = F.concat(side(0, F.col("_p") > 0, lambda x: mine, lambda x: x), side(1, F.col("_n") > 0, lambda x: x, lambda x: mine))
        both = df.withColumn("_t", F.explode(places)).select(*cols, "_t.*")
        tile = [*by, "_i", "_j"]
        return dealt(both, 2 * rows, tile).groupBy(*tile).applyInPandas(lambda pdf: product(pdf, axis, ties), out)

    across = b.groupBy(*keys, "_b", "_blk", "_g", "_own").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    far = tiled(across, min(near_rows, far_rows * 2**steps), keys, "_b", 0.0)
    near = tiled(b, near_rows, [*keys, "_b"], "_s", 0.5)
    return far.unionByName(near).groupBy(*keys, "p_block", "n_block").agg(F.sum("u").alias("u"))


def block_class_counts(obs: DataFrame, keys: list[str], block: str = "block_id") -> DataFrame:
    """Usable positives and negatives per block."""
    both = F.col("score").isNotNull() & F.col("ref").isNotNull()
    return obs.where(both).groupBy(*keys, block).agg(
        F.count_if(F.col("ref") == 1).alias("n_pos"), F.count_if(F.col("ref") == 0).alias("n_neg")
    )


def weighted_auc(numerators: DataFrame, counts: DataFrame, weights: DataFrame, keys: list[str], unit: list[str]) -> DataFrame:
    """AUC per ``unit`` (replicate) from block weights: quadratic form over the numerator matrix.

    A tile of the matrix (``TILE_BLOCKS`` groups of blocks) meets the weight arrays of its blocks in a task, which returns
    one number for each replicate: neither numerators nor weights are repeated by replicate.
    """
    (rep,) = unit
    weights = cut(weights)
    # a block meets every block of its key at most, its draws every group of blocks
    cells, arrays = (x or 1 for x in weights.agg(F.sum("n_blocks"), F.sum(2 * F.ceil(F.col("n_blocks") / F.lit(float(TILE_BLOCKS))))).collect()[0])
    groups = F.ceil(F.col("n_blocks") / F.lit(float(TILE_BLOCKS))).cast("int")
    sizes = weights.groupBy(*keys).agg(F.max(groups).alias("_g"))
    place = lambda c: F.pmod(F.hash(c), F.col("_g"))
    tiles = attach(numerators, sizes, keys).select(*keys, place("p_block").alias("_i"), place("n_block").alias("_j"), "p_block", "n_block", "u")
    others = F.sequence(F.lit(0), F.col("_g") - 1)
    mine = weights.select(*keys, "block_id", "draws", groups.alias("_g")).withColumn("_own", place("block_id"))
    ends = F.array_distinct(F.concat(
        F.transform(others, lambda x: F.struct(F.col("_own").alias("_i"), x.alias("_j"))), F.transform(others, lambda x: F.struct(x.alias("_i"), F.col("_own").alias("_j")))
    ))
    drawn = mine.select(*[F.col(k).alias(f"r_{k}") for k in keys], "block_id", "draws", F.explode(ends).alias("_t")).select("*", F.col("_t._i").alias("r__i"), F.col("_t._j").alias("r__j")).drop("_t")
    out = T.StructType([numerators.schema[k] for k in keys] + [T.StructField(rep, T.IntegerType()), T.StructField("_part", T.DoubleType())])

    def form(cells: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or blocks.empty:
            return pd.DataFrame(columns=out.names)
        at = pd.Index(blocks["block_id"])
        w = np.stack(blocks["draws"].to_list()).astype(float)
        i, j = at.get_indexer(cells["p_block"]), at.get_indexer(cells["n_block"])
        known = (i >= 0) & (j >= 0)
        rows, i = np.unique(i[known], return_inverse=True)
        cols, j = np.unique(j[known], return_inverse=True)
        u = np.zeros((len(rows), len(cols)))
        np.add.at(u, (i, j), cells["u"].to_numpy(float)[known])
        part = (w[rows] * (u @ w[cols])).sum(0)
        return pd.DataFrame({**{k: cells[k].iloc[0] for k in keys}, rep: np.arange(w.shape[1], dtype=np.int32), "_part": part})[out.names]

    # a key that no task keeps whole: tiles of a key are added up
    left, right = [*keys, "_i", "_j"], [*[f"r_{k}" for k in keys], "r__i", "r__j"]
    rows = cells + 16 * arrays
    parts = dealt(tiles, rows, left).groupBy(*left).cogroup(dealt(drawn, rows, right).groupBy(*right)).applyInPandas(form, out)
    num = parts.groupBy(*keys, rep).agg(F.sum("_part").alias("_num"))
    den = weighted_rows(counts, weights, [*keys, "block_id"]).groupBy(*keys, rep).agg(
        F.sum(F.col("n_pos") * F.col("w")).alias("boot_pos"), F.sum(F.col("n_neg") * F.col("w")).alias("boot_neg")
    )
    j = den.join(num, [*keys, *unit], "left")
    product = F.col("boot_pos").cast("double") * F.col("boot_neg")
    return j.select(
        *keys, *unit, "boot_pos", "boot_neg",
        F.when(product > 0, F.coalesce("_num", F.lit(0.0)) / product).alias("auc"),
        ratio("boot_pos", F.col("boot_pos") + F.col("boot_neg")).alias("prevalence"),
    )


def bootstrap_metrics(oof: DataFrame, keys: list[str], replicates: int, seed, second_seed=None) -> DataFrame:
    """Complete-block bootstrap of the eight metrics of a cross-fit: one row per (keys, rep).

    Blocks without a threshold take part in the rank metric only; if there are any, the threshold metrics
    get their own draw over their own blocks.
    """
    oof = cut(oof.select(*keys, "block_id", "score", "ref", "pred"))
    # block-grain tables that several steps read: a task then holds the buffers of one step, not of all before it
    counts = cut(block_class_counts(oof, keys))
    conf = cut(oof.where(F.col("pred").isNotNull()).groupBy(*keys, "block_id").agg(*confusion("pred", "ref")))
    weights = cut(block_weights(counts, keys, replicates, seed))
    size = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    same = size(counts, "_a").join(size(conf, "_t"), keys, "left").select(*keys, (F.col("_a") == F.coalesce("_t", F.lit(0))).alias("_same"))
    same = cut(same)
    other = conf.join(same.where("NOT _same"), keys, "left_semi")
    own = block_weights(other, keys, replicates, second_seed if second_seed is not None else f"{seed}t")
    tw = cut(weights.join(same.where("_same"), keys, "left_semi").unionByName(own))
    auc = weighted_auc(pair_numerators(oof, keys), counts, weights, keys, ["rep"])
    sums = cut(weighted_rows(conf, tw, [*keys, "block_id"]).groupBy(*keys, "rep").agg(
        *[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "tn", "fn")]
    ))
    m = confusion_metrics(zero=None, need_both=False)
    return cut(auc).join(sums.select(*keys, "rep", *[v.alias(k) for k, v in m.items()]), [*keys, "rep"], "left").drop("boot_pos", "boot_neg")


def long_metrics(reps: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return reps.unpivot(keys, names, "metric", "value")


def with_offsets(sampled: DataFrame, side: int) -> DataFrame:
    """Cell position inside its block, so blocks can be laid over each other."""
    return sampled.withColumn("cell", (F.col("row_i") % side) * side + F.col("col_i") % side)


def block_orderings(blocks: DataFrame, keys: list[str], replicates: int, seed) -> DataFrame:
    """Permutations of the blocks of a key: every ordering when there are few, else unique hash draws.

    Returns ``keys, rep, target, source``.
    """
    return ordering_rows(ordering_lists(blocks, keys, replicates, seed), keys)


def ordering_lists(blocks: DataFrame, keys: list[str], replicates: int, seed) -> DataFrame:
    """The same as two arrays of each ordering: ``keys, rep, targets, sources``.

    Orderings depend on the number of blocks, not on the key: they are enumerated or drawn once for each number.
    """
    few = max(n for n in range(1, 13) if math.factorial(n) <= MAX_ORDERINGS)
    sizes = cut(blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks")).select("n_blocks").distinct())
    orders = sizes.where(F.col("n_blocks") <= few).select("n_blocks", F.array().cast("array<int>").alias("o"))
    for _ in range(few):
        rest = F.array_except(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")), F.col("o"))
        grown = F.transform(rest, lambda x: F.array_append("o", x))
        step = F.when(F.size("o") < F.col("n_blocks"), grown).otherwise(F.array("o"))
        orders = orders.select("n_blocks", F.explode(step).alias("o"))
    w = Window.partitionBy("n_blocks").orderBy("o")
    full = orders.select("n_blocks", (F.row_number().over(w) - 1).alias("rep"), "o")
    drawn = _unique_draws(sizes.where(F.col("n_blocks") > few), replicates, math.factorial(few + 1), seed)
    return over_blocks(blocks, keys, full.unionByName(drawn))


def _unique_draws(sizes: DataFrame, replicates: int, orderings: int, seed) -> DataFrame:
    """The first ``replicates`` different orderings of each number of blocks in the sequence of draws: ``n_blocks, rep, o``.

    ``orderings``: how many the smallest number of blocks has; as many draws as are expected to hold enough
    different ones are made, and more while one is short.
    """
    share = min(replicates, orderings - 1) / orderings
    total = math.ceil(-orderings * math.log(1 - share)) + 6 * math.isqrt(replicates) + 20
    place = Window.partitionBy("n_blocks").orderBy("rep")
    while True:
        first = shuffled_orders(sizes, total, seed).groupBy("n_blocks", "o").agg(F.min("rep").alias("rep"))
        kept = cut(first.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= replicates).select("n_blocks", "rep", "o"))
        if kept.groupBy("n_blocks").count().where(F.col("count") < replicates).isEmpty():
            return kept
        total *= 2


def drawn_spearman(rows: DataFrame, weights: DataFrame, keys: list[str], x: str, y: str, block: str = "block_id") -> DataFrame:
    """Rank correlation under every replicate of drawn blocks: ``keys, rep, n, rho``.

    ``rows(keys, block, x, y)`` without missing values, ``weights(keys, block, draws)``.  A task holds the distinct rows of
    one key (a scene, 32 bytes a row) and its weight arrays and reads every replicate from them, so no cell is
    repeated by replicate.  NULL below two cells or when a side is constant; replicates without cells have no row.
    """
    pairs = rows.groupBy(*keys, block, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    right = weights.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(block).alias("_blk"), "draws")
    out = T.StructType([rows.schema[k] for k in keys] + [T.StructField("rep", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("rho", T.DoubleType())])

    def correlate(cells: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or blocks.empty:
            return pd.DataFrame(columns=out.names)
        at = pd.Index(blocks["_blk"]).get_indexer(cells[block])
        cells, at = cells[at >= 0], at[at >= 0]
        draws = np.stack(blocks["draws"].to_list()).astype(np.int64)
        codes = [np.unique(cells[c].to_numpy(), return_inverse=True)[1] for c in ("_x", "_y")]
        count = cells["_c"].to_numpy(np.int64)
        made = []
        for r in range(draws.shape[1]):
            w = (draws[at, r] * count).astype(float)
            n = w.sum()
            if n == 0:
                continue
            centred = []
            for code in codes:
                held = np.bincount(code, w)
                rank = (np.cumsum(held) - (held - 1) / 2)[code]
                centred.append(rank - (w * rank).sum() / n)
            (a, b) = centred
            used = w > 0
            varied = all(c[used].min() < c[used].max() for c in codes)
            made.append((r, int(n), (w * a * b).sum() / np.sqrt((w * a * a).sum()) / np.sqrt((w * b * b).sum()) if varied else np.nan))
        got = pd.DataFrame(made, columns=["rep", "n", "rho"])
        return got.assign(**{k: cells[k].iloc[0] for k in keys})[out.names] if made else pd.DataFrame(columns=out.names)

    got = pairs.groupBy(*keys).cogroup(right.groupBy(*[f"r_{k}" for k in keys])).applyInPandas(correlate, out)
    return got.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def paired_spearman_bootstrap(sampled: DataFrame, keys: list[str], a: str, b: str, replicates: int, seed) -> DataFrame:
    """Rank correlation of two maps per replicate of drawn blocks (a block drawn twice counts twice)."""
    w = block_weights(sampled.select(*keys, "block_id").distinct(), keys, replicates, seed)
    return drawn_spearman(sampled.where(F.col(a).isNotNull() & F.col(b).isNotNull()), w, keys, a, b)


def overlap_bootstrap(sampled: DataFrame, keys: list[str], a: str, b: str, replicates: int, seed) -> DataFrame:
    """IoU, Dice and prevalence ratio per replicate from four counts per block."""
    per_block = sampled.groupBy(*keys, "block_id").agg(*overlap_counts(a, b))
    w = block_weights(per_block, keys, replicates, seed)
    names = ["n_both", "n_either", "n_anchor", "n_repeat"]
    sums = weighted_rows(per_block, w, [*keys, "block_id"]).groupBy(*keys, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in names])
    return overlap_ratios(sums)


def overlap_null(sampled: DataFrame, keys: list[str], a: str, b: str, side: int, replicates: int, seed) -> DataFrame:
    """The same ratios with repeat blocks permuted, from block-by-block cross counts.

    Cross counts come from the three sums that involve only present cells, packed per block as arrays over
    the block's cells; a block pair is one row.
    """
    cells = with_offsets(sampled, side)

    def packed(v: str, name: str, blk: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("cell", v))), lambda s: s[v])
        return cells.groupBy(*keys, F.col("block_id").alias(blk)).agg(ordered.alias(name))

    orders = block_orderings(sampled.select(*keys, "block_id").distinct(), keys, replicates, seed)
    need = orders.select(*keys, "target", "source").distinct()
    pairs = need.join(packed(a, "_x", "target"), [*keys, "target"]).join(packed(b, "_y", "source"), [*keys, "source"])
    code = F.zip_with("_x", "_y", lambda x, y: x * 2 + y)  # 3 both, 2 anchor only, 1 repeat only

    def n_of(*codes: int):
        return F.size(F.filter("_z", lambda v: v.isin(list(codes))))

    cross = pairs.withColumn("_z", code).select(
        *keys, "target", "source", n_of(3).alias("n_both"), n_of(1, 2, 3).alias("n_either"), n_of(2, 3).alias("n_anchor"), n_of(1, 3).alias("n_repeat")
    )
    names = ["n_both", "n_either", "n_anchor", "n_repeat"]
    sums = orders.join(cross, [*keys, "target", "source"]).groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in names])
    return overlap_ratios(sums)


def sensor_swaps(blocks: DataFrame, keys: list[str], replicates: int, seed) -> DataFrame:
    """Per replicate and block a coin deciding which sensor takes the native role."""
    ib = indexed_blocks(blocks, keys)
    return with_replicates(ib, replicates).select(*keys, "rep", "block_id", coin(seed, F.col("rep"), F.col("idx")).alias("swap"))


def sensor_randomization(obs: DataFrame, keys: list[str], native: str, degraded: str, replicates: int, seed) -> DataFrame:
    """Two-sided test of the paired AUC difference by within-block sensor swaps.

    Labels and joint support stay fixed.  The numerators of all four sensor combinations come from one
    pass in which a unit is (block, sensor).
    """
    rows = obs.where(F.col(native).isNotNull() & F.col(degraded).isNotNull() & F.col("ref").isNotNull())
    both = rows.select(
        *keys, "block_id", "ref",
        F.explode(F.array(
            F.struct(F.lit("0").alias("s"), F.col(native).cast("double").alias("v")),
            F.struct(F.lit("1").alias("s"), F.col(degraded).cast("double").alias("v")),
        )).alias("x"),
    ).select(*keys, F.concat_ws("|", F.col("x.s"), "block_id").alias("unit"), F.col("x.v").alias("score"), "ref")
    u = pair_numerators(both, keys, "unit")
    side = lambda c: F.substring(c, 1, 1).cast("int")
    blk = lambda c: F.substring(c, F.lit(3), F.length(c))
    u = u.select(*keys, side("p_block").alias("ps"), blk("p_block").alias("pb"), side("n_block").alias("ns"), blk("n_block").alias("nb"), "u")
    n = rows.groupBy(*keys).agg(
        F.count_if(F.col("ref") == 1).alias("n_pos"), F.count_if(F.col("ref") == 0).alias("n_neg"),
    )
    seen = rows.select(*keys, "block_id").distinct()
    swaps = sensor_swaps(seen, keys, replicates, seed)
    p = swaps.select(*keys, "rep", F.col("block_id").alias("pb"), F.col("swap").alias("sp"))
    q = swaps.select(*keys, "rep", F.col("block_id").alias("nb"), F.col("swap").alias("sn"))
    j = u.join(p, [*keys, "pb"]).join(q, [*keys, "rep", "nb"])
    sign = F.when((F.col("ps") == F.col("sp")) & (F.col("ns") == F.col("sn")), 1.0).when(
        (F.col("ps") != F.col("sp")) & (F.col("ns") != F.col("sn")), -1.0
    ).otherwise(0.0)
    null = j.groupBy(*keys, "rep").agg(F.sum(sign * F.col("u")).alias("_d"))
    observed = u.groupBy(*keys).agg(
        F.sum(F.when((F.col("ps") == 0) & (F.col("ns") == 0), F.col("u")).when((F.col("ps") == 1) & (F.col("ns") == 1), -F.col("u")).otherwise(0.0)).alias("_o")
    )
    den = F.col("n_pos").cast("double") * F.col("n_neg")
    k = null.join(observed, keys).join(n, keys)
    # numerators are multiples of one half, so the comparison is exact
    return k.groupBy(*keys).agg(
        F.first(F.col("_o") / den).alias("observed_delta"),
        F.count_if(F.abs("_d") >= F.abs("_o")).alias("exceedances"),
        F.count(F.lit(1)).alias("randomizations"),
    ).withColumn("p_value", (F.col("exceedances") + 1.0) / (F.col("randomizations") + 1.0))
