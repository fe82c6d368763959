"""Multiple testing over value ranges, numerators in tiles, and the normal tail."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismgrid.operators import agree, inference, resample, stats


def plain_adjusted(p):
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.clip(np.minimum.accumulate(raw[::-1])[::-1], 0, 1)
    return out


def test_a_large_family_is_spread_over_tasks(spark):
    n = 60_000
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.random(n // 2) ** 3, rng.random(n // 2)]), 4)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "family": ["f"] * n, "p_value": p}))
    out = inference.adjust_p_values(df, ["family"])
    got = out.orderBy("id").toPandas()
    np.testing.assert_allclose(got["q_value"], plain_adjusted(p), atol=1e-12)
    # ranks and minima are taken inside value ranges, never over a family
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan


def test_families_missing_values_and_eligibility(spark):
    rows = [(1, "a", 0.01), (2, "a", 0.04), (3, "a", None), (4, "b", 0.5), (5, None, 0.02), (6, None, 0.03), (7, "c", 0.9)]
    df = spark.createDataFrame(rows, "id int, family string, p_value double")
    got = {r["id"]: r["q_value"] for r in inference.adjust_p_values(df, ["family"], eligible=F.col("id") != 7).collect()}
    assert got == {1: 0.02, 2: 0.04, 3: None, 4: 0.5, 5: 0.03, 6: 0.03, 7: None}
    whole = {r["id"]: r["q_value"] for r in inference.adjust_complete_families(df, ["family"]).collect()}
    assert whole == {1: None, 2: None, 3: None, 4: 0.5, 5: 0.03, 6: 0.03, 7: 0.9}


def test_suffix_minimum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 500), "v": rng.permutation(500) / 10, "x": rng.integers(0, 90, 500)})
    got = stats.suffix_minimum(spark.createDataFrame(pdf), ["k"], "v", "x", steps=3).toPandas()
    for r in got.itertuples():
        assert r.min_x == pdf[(pdf.k == r.k) & (pdf.v >= r.v)]["x"].min()


def test_numerators_of_many_blocks_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(resample, "TILE_BLOCKS", 16)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": "s", "block_id": [f"b{i % 90:03d}" for i in range(720)], "score": rng.integers(0, 12, 720).astype(float), "ref": rng.integers(0, 2, 720)})
    got = resample.pair_numerators(spark.createDataFrame(pdf), ["k"], steps=2).toPandas()
    pos, neg = pdf[pdf.ref == 1], pdf[pdf.ref == 0]
    pairs = pos.merge(neg, on="k")
    pairs["u"] = (pairs.score_x > pairs.score_y) + 0.5 * (pairs.score_x == pairs.score_y)
    want = pairs.groupby(["block_id_x", "block_id_y"])["u"].sum()
    want = want[want > 0]
    assert {(r.p_block, r.n_block): r.u for r in got.itertuples()} == want.to_dict()


def test_upper_normal_tail(spark):
    z = [-40.0, -8.0, -3.0, -1e-9, 0.0, 0.3, 1.0, 2.5, 4.2, 4.3, 6.0, 12.0, 37.0]
    df = spark.createDataFrame([(x,) for x in z] + [(None,)], "z double").select("z", agree._upper_normal_tail(F.col("z")).alias("p")).collect()
    for r in df[:-1]:
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert df[-1]["p"] is None


def test_p_values_that_change_when_computed_again_keep_their_rank(spark):
    import random

    from prismgrid.operators.inference import adjust_complete_families, adjust_p_values

    # stands for a mean of doubles, whose last bits depend on the order in which partial sums meet
    noisy = F.udf(lambda i: 0.01 * (i + 1) * (1 + random.randrange(8) * 2.0**-50), "double").asNondeterministic()
    df = spark.range(40).select("id", (F.col("id") % 2).alias("family"), noisy("id").alias("p_value"))
    for out in (adjust_p_values(df, ["family"]), adjust_complete_families(df, ["family"])):
        got = [r.q_value for r in out.collect()]
        assert len(got) == 40 and all(q is not None for q in got), got
