"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .stats import running_totals


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it (itself included)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("m").alias("u"), F.col("v").alias("v")).where("u <> v")
    return moved.unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def components(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Component of every node that has an edge: ``node, root`` with the smallest node as root.

    Each round is two joins by node; lineage is cut per round.  The edge set stops changing when all
    components are stars.
    """
    e = cut(edges.select(F.least(i, j).alias("u"), F.greatest(i, j).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if mark == (now["n"], now["h"]):
            stars = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
            roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return stars.unionByName(roots)
        mark = (now["n"], now["h"])


def clusters(edges: DataFrame, labels: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Members of every component of size two or more: ``cluster_id, node, size, n_labels``.

    Ids number the components by their smallest node.  ``labels(node, label)``.
    """
    c = components(edges, i, j)
    per = c.join(labels, "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("label").alias("n_labels"))
    # one row per component: the running total over roots is the id, without a one-task window
    ids = running_totals(per.select("root", F.lit(1).alias("one")), [], "root", ["one"]).select("root", (F.col("cum_one") - 1).alias("cluster_id"))
    return c.join(per.join(ids, "root"), "root").select("cluster_id", "node", "size", "n_labels")
