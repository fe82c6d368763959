"""Reproducible draws as pure functions of ids, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of the replicates that meet the keys of a number of blocks.
PARTS = 48


def hash_int(*parts) -> Column:
    """First 32 bits of the md5 of the colon-joined parts, as BIGINT."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("bigint")


def draw_index(n: Column, *parts) -> Column:
    """Index in ``0..n-1``."""
    return hash_int(*parts) % n


def coin(*parts) -> Column:
    """0 or 1."""
    return hash_int(*parts) % F.lit(2)


def with_replicates(df: DataFrame, replicates: int, name: str = "rep") -> DataFrame:
    """Repeat every (small, block-grain) row once per replicate."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def indexed_blocks(blocks: DataFrame, keys: list[str], block: str = "block_id") -> DataFrame:
    """Blocks numbered ``0..n-1`` per key with the group size ``n_blocks`` (block-grain input)."""
    w = Window.partitionBy(*keys)
    return blocks.select(
        *keys,
        block,
        (F.row_number().over(w.orderBy(block)) - 1).alias("idx"),
        F.count(F.lit(1)).over(w).alias("n_blocks"),
    )


def block_draws(
    blocks: DataFrame, keys: list[str], replicates: int, seed, block: str = "block_id"
) -> DataFrame:
    """Draw complete blocks with replacement: one row per (keys, rep, slot) with the drawn block."""
    ib = indexed_blocks(blocks, keys, block)
    slots = with_replicates(ib.select(*keys, F.col("idx").alias("slot"), "n_blocks"), replicates)
    drawn = slots.select(
        *keys, "rep", "slot", draw_index(F.col("n_blocks"), seed, F.col("rep"), F.col("slot")).alias("idx")
    )
    # the rows that an explode makes are not in Spark's size estimate: never the side of a broadcast
    return drawn.hint("merge").join(ib.select(*keys, F.col("idx").cast("bigint").alias("idx"), block), [*keys, "idx"]).drop("idx")


def block_weights(
    blocks: DataFrame, keys: list[str], replicates: int, seed, block: str = "block_id"
) -> DataFrame:
    """Multiplicity of every block in every replicate (multinomial weights): ``keys, block, n_blocks, draws``, an array by replicate.

    A draw depends on the number of blocks of the key, not on the key: the counts are made once for each number of
    blocks, and a block travels once with its array.  ``weighted_rows`` turns the array into rows.
    """
    ib = indexed_blocks(blocks, keys, block)
    slots = ib.select("n_blocks").distinct().select("n_blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("slot"))
    idx = draw_index(F.col("n_blocks"), seed, F.col("rep"), F.col("slot")).alias("idx")
    counts = with_replicates(slots, replicates).select("n_blocks", "rep", idx).groupBy("n_blocks", "idx", "rep").agg(F.count(F.lit(1)).cast("int").alias("w"))
    drawn = F.map_from_entries(F.collect_list(F.struct("rep", "w")))
    made = counts.groupBy("n_blocks", "idx").agg(drawn.alias("_m")).select(
        "n_blocks", "idx", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0))).alias("draws")
    )
    return ib.withColumn("idx", F.col("idx").cast("bigint")).join(made, ["n_blocks", "idx"]).select(*keys, block, "n_blocks", "draws")


def weighted_rows(df: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` once for each replicate that draws their block: adds ``rep, w``.

    The rows of the replicates come after the join, so that no join has to guess their number.
    """
    rows = df.join(weights.select(*on, "draws"), on).select(*df.columns, F.posexplode("draws").alias("rep", "w"))
    return rows.where("w > 0").withColumn("w", F.col("w").cast("bigint"))


def shuffled_orders(sizes: DataFrame, replicates: int, seed) -> DataFrame:
    """Per number of blocks and replicate a permutation of ``0..n-1``: ``n_blocks, rep, o``, the rank of each index by its hash."""
    lots = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1), lambda i: F.struct(hash_int(seed, F.col("rep"), i).alias("lot"), i.cast("int").alias("i"))
    )
    ranks = F.transform(F.array_sort(lots), lambda e, place: F.struct(e["i"].alias("i"), place.alias("place")))
    return with_replicates(sizes.select("n_blocks").distinct(), replicates).select("n_blocks", "rep", F.transform(F.array_sort(ranks), lambda e: e["place"]).alias("o"))


def over_blocks(blocks: DataFrame, keys: list[str], orders: DataFrame, block: str = "block_id") -> DataFrame:
    """``orders(n_blocks, rep, o)`` laid over the blocks of every key: ``keys, rep, targets, sources``, two arrays.

    An ordering depends on the number of blocks alone, so it is made once and meets the sorted block names of a key.
    Many keys share a number of blocks: replicates are dealt into parts, so that no task makes all rows of one number.
    """
    names = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(block)).alias("targets")).withColumn("n_blocks", F.size("targets").cast("bigint"))
    source = F.transform("o", lambda i: F.col("targets")[i])
    names = names.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    dealt = orders.withColumn("_part", F.pmod(F.col("rep"), F.lit(PARTS)).cast("int"))
    return names.join(dealt, ["n_blocks", "_part"]).select(*keys, "rep", "targets", source.alias("sources"))


def ordering_rows(orders: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rep, target, source`` from arrays; marked so that no join broadcasts rows whose number Spark does not know."""
    pair = F.arrays_zip(F.col("targets").alias("target"), F.col("sources").alias("source"))
    return orders.select(*keys, "rep", F.explode(pair).alias("_p")).select(*keys, "rep", "_p.target", "_p.source").hint("merge")


def block_permutations(
    blocks: DataFrame, keys: list[str], replicates: int, seed, block: str = "block_id"
) -> DataFrame:
    """Per replicate a permutation of the blocks of a key: ``target`` receives ``source``."""
    sizes = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    return ordering_rows(over_blocks(blocks, keys, shuffled_orders(sizes, replicates, seed), block), keys)
