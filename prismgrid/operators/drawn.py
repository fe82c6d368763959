"""Exact quantiles under block draws, from packed blocks: a value travels once, however many replicates draw its block."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .stats import attach, checked_small, value_edges

#: Values of a block that its key's bucket edges are taken from; edges only balance the work.
PROBES = 32
#: A key's values are cut into ``2**STEPS`` buckets.
STEPS = 6


def packed_values(values: DataFrame, weights: DataFrame, keys: list[str], block: str, value: str) -> DataFrame:
    """One row per block: ``keys, block, _v`` (its values, ascending) and ``draws``, its multiplicity by replicate; NULL if it is in no draw."""
    v = F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v")
    rows = values.groupBy(*keys, block).agg(v).join(weights.select(*keys, block, "draws").hint("merge"), [*keys, block], "left")
    return cut(rows)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _ends(v: pa.Array, edges: pa.Array) -> pa.Array:
    """Where each bucket but the last ends in the ascending values of a block."""
    return pa.array([np.searchsorted(a.values.to_numpy(), e.values.to_numpy(), "right").astype(np.int32) for a, e in zip(v, edges)], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _above(v: pa.Array, marks: pa.Array) -> pa.Array:
    """Number of the ascending values at or above each mark; marks that are NaN have none."""
    out = []
    for a, m in zip(v, marks):
        at = m.values.to_numpy(zero_copy_only=False)
        out.append(np.where(np.isnan(at), 0, len(a) - np.searchsorted(a.values.to_numpy(), at, "left")))
    return pa.array(out, pa.list_(pa.int64()))


def drawn_quantile(packed: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """Linear-interpolated quantile of the values in the drawn blocks, by multiplicity: ``keys, rep, n, <name>``; draws without values have no row.

    The values of a key are cut into buckets.  Counts by block and bucket times draws tell which buckets hold the wanted ranks
    of which replicates; then only the values in those buckets meet, once for all replicates that want them.
    """
    rows = packed.where(F.col("draws").isNotNull())
    place = F.sequence(F.lit(0), F.lit(PROBES - 1))
    probe = F.explode(F.transform(place, lambda i: F.col("_v")[F.floor(i * (F.size("_v") - 1) / (PROBES - 1)).cast("int")])).alias("_p")
    edges = value_edges(rows.select(*keys, probe), keys, "_p", STEPS)
    # every reader sees the same ends
    rows = cut(attach(rows, checked_small(edges), keys).withColumn("_ends", _ends("_v", "_edges")).drop("_edges"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema.fields)

    def ranks(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.stack(pdf["_ends"]).astype(np.int64)
        counts = np.diff(ends, axis=1, prepend=0, append=pdf["_size"].to_numpy(np.int64)[:, None])
        done = np.cumsum(counts.T @ np.stack(pdf["draws"]).astype(np.int64), axis=0)
        n = done[-1]
        reps = np.flatnonzero(n > 0)
        rank = q * (n[reps] - 1)
        # slots: the lower rank of a replicate, then the upper
        slot, wanted = np.r_[reps, reps + len(n)], np.r_[np.floor(rank), np.ceil(rank)].astype(np.int64)
        bucket = (done[:, slot % len(n)] <= wanted).sum(axis=0)
        off = wanted - np.where(bucket > 0, done[np.maximum(bucket - 1, 0), slot % len(n)], 0)
        key = [pdf[k].iloc[0] for k in keys]
        out = [(*key, int(b), len(n), slot[bucket == b].tolist(), off[bucket == b].tolist()) for b in np.unique(bucket)]
        return pd.DataFrame([*out, (*key, -1, len(n), reps.tolist(), n[reps].tolist())], columns=[*keys, "_b", "_r", "_slot", "_off"])

    slim = rows.select(*keys, "draws", "_ends", F.size("_v").alias("_size"))
    wants = cut(slim.groupBy(*keys).applyInPandas(ranks, f"{kept}, _b int, _r int, _slot array<int>, _off array<bigint>"))
    need = wants.where("_b >= 0").groupBy(*keys).agg(F.collect_list("_b").alias("_need"))
    b = F.col("_b")
    start = F.when(b == 0, 0).otherwise(F.col("_ends")[b - 1])
    stop = F.when(b == F.size("_ends"), F.size("_v")).otherwise(F.try_element_at("_ends", b + 1))
    parts = attach(rows, checked_small(need), keys).select(*keys, "draws", "_v", "_ends", F.explode("_need").alias("_b"))
    parts = parts.withColumn("_part", F.slice("_v", start + 1, F.greatest(stop - start, F.lit(0)))).where(F.size("_part") > 0).select(*keys, "_b", "draws", "_part")

    def pick(values: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(values) or not len(wanted):
            return pd.DataFrame(columns=[*keys, "_rep", "_lo", "_hi"])
        v = np.concatenate(list(values["_part"]))
        order = np.argsort(v, kind="stable")
        v, own = v[order], np.repeat(np.arange(len(values)), [len(x) for x in values["_part"]])[order]
        draws, r = np.stack(values["draws"]), int(wanted["_r"].iloc[0])
        slot, off = np.asarray(wanted["_slot"].iloc[0]), np.asarray(wanted["_off"].iloc[0])
        out = []
        for rep in np.unique(slot % r):
            done = np.cumsum(draws[own, rep], dtype=np.int64)
            mine = slot % r == rep
            at = dict(zip((slot[mine] // r).tolist(), v[np.searchsorted(done, off[mine], "right")].tolist()))
            out.append((*[wanted[f"_w{i}"].iloc[0] for i in range(len(keys))], int(rep), at.get(0), at.get(1)))
        return pd.DataFrame(out, columns=[*keys, "_rep", "_lo", "_hi"])

    # other names: both sides of the cogroup come from the same rows
    right = wants.where("_b >= 0").select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], b.alias("_wb"), "_r", "_slot", "_off")
    sides = right.groupBy(*[f"_w{i}" for i in range(len(keys))], "_wb")
    ends = parts.groupBy(*keys, "_b").cogroup(sides).applyInPandas(pick, f"{kept}, _rep int, _lo double, _hi double")
    ends = ends.groupBy(*keys, F.col("_rep").alias("rep")).agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    n = wants.where("_b = -1").select(*keys, F.explode(F.arrays_zip(F.col("_slot").alias("rep"), F.col("_off").alias("n"))).alias("_x")).select(*keys, "_x.rep", "_x.n")
    rank = F.lit(float(q)) * (F.col("n") - 1)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (rank - F.floor(rank))
    return n.hint("merge").join(ends, [*keys, "rep"]).select(*keys, "rep", "n", value.alias(name))


def counted_above(packed: DataFrame, marks: DataFrame, keys: list[str], mark: str, name: str) -> DataFrame:
    """Values of the key at or above the mark of each replicate: ``keys, rep, <name>``."""
    m = marks.where(F.col(mark).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rep", F.col(mark).alias("m")))).alias("_m"))
    m = m.select(*keys, F.col("_m.rep").alias("_reps"), F.col("_m.m").alias("_m"))
    found = attach(packed.select(*keys, "_v"), checked_small(m), keys).select(*keys, F.explode(F.arrays_zip(F.col("_reps").alias("rep"), _above("_v", "_m").alias("c"))).alias("_x"))
    return found.groupBy(*keys, F.col("_x.rep").alias("rep")).agg(F.sum("_x.c").alias(name))
