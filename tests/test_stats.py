import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.operators import agree, inference, stats


def skewed(spark, n=3000, seed=1):
    """A third of the rows on one key and one value."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(5, 3, n), 2))
    k = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b"], n))
    r = rng.integers(0, 2, n)
    return [(str(a), float(b), int(c)) for a, b, c in zip(k, v, r)]


def test_quantiles_equal_numpy_under_skew(spark):
    rows = skewed(spark)
    df = spark.createDataFrame(rows, "k string, v double, r int")
    qs = {"lo": 0.025, "mid": 0.5, "hi": 0.999}
    for r in stats.exact_quantiles(df, ["k"], "v", qs).collect():
        v = [b for a, b, _ in rows if a == r.k]
        assert [r.lo, r.mid, r.hi] == pytest.approx(list(np.quantile(v, list(qs.values()))))
    one = stats.exact_quantiles(df, [], "v", {"q": 0.9}).first()
    assert one.q == pytest.approx(np.quantile([b for _, b, _ in rows], 0.9))


def test_weighted_quantile_repeats_values(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (5.0, 3), (9.0, 2)], "v double, w int")
    assert stats.exact_quantiles(df, [], "v", {"q": 0.3}, weight="w").first().q == pytest.approx(np.quantile([1, 5, 5, 5, 9, 9], 0.3))


@pytest.mark.parametrize("partitions", ["3", "8"])
def test_auc_counts_ties_half_whatever_the_partitioning(spark, partitions):
    rows = skewed(spark, 1200)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(rows, "k string, score double, ref int")
    for r in stats.rank_auc(df, ["k"]).collect():
        p = np.array([b for a, b, c in rows if a == r.k and c == 1])
        n = np.array([b for a, b, c in rows if a == r.k and c == 0])
        u = (p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()
        assert r.u == u and r.auc == pytest.approx(u / len(p) / len(n))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_auc_without_a_class_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1)], "k string, score double, ref int")
    assert stats.rank_auc(df, ["k"]).first().auc is None


def test_spearman_constant_side_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 5.0), ("b", 2.0, 4.0)], "k string, x double, y double")
    assert {r.k: r.rho for r in stats.spearman(df, ["k"], "x", "y").collect()} == {"a": None, "b": pytest.approx(-1)}


def test_grid_youden_takes_lowest_threshold_and_flat_scores(spark):
    df = spark.createDataFrame([("a", 0.0, 0), ("a", 1.0, 1), ("b", 3.0, 0), ("b", 3.0, 1)], "k string, score double, ref int")
    got = {r.k: (r.threshold, r.youden_j) for r in agree.grid_youden(df, ["k"]).collect()}
    assert got["a"] == (pytest.approx(1 / 511), 1.0) and got["b"] == (3.0, 0.0)


def test_u_test_against_hand_value(spark):
    df = spark.createDataFrame([("a", float(i), int(i > 9)) for i in range(20)], "k string, score double, ref int")
    p = agree.u_test_greater(stats.rank_auc(df, ["k"])).first().p_value
    assert p == pytest.approx(9.133e-05, rel=1e-3)


def test_empty_overlap_is_undefined(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", None, 1), ("b", 1, 1), ("b", 1, 0)], "k string, x int, y int")
    got = {r.k: r for r in agree.binary_overlap(df, ["k"], "x", "y").collect()}
    assert got["a"].iou is None and got["a"].dice is None and got["b"].iou == 0.5 and got["b"].prevalence_ratio == 0.5


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("g", 0.5)], "fam string, p_value double")
    got = {(r.fam, r.p_value): r.q_value for r in inference.adjust_p_values(df, ["fam"]).collect()}
    assert got[("f", 0.01)] == pytest.approx(0.03) and got[("f", 0.03)] == pytest.approx(0.04) and got[("f", None)] is None
    full = {(r.fam, r.p_value): r.q_value for r in inference.adjust_complete_families(df, ["fam"]).collect()}
    assert full[("f", 0.01)] is None and full[("g", 0.5)] == 0.5


def test_interval_needs_95_percent_of_the_replicates(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(95)] + [("a", None)] * 5 + [("b", float(i)) for i in range(94)] + [("b", None)] * 6, "k string, v double")
    got = {r.k: r for r in inference.governed_interval(df, ["k"], "v", 100).collect()}
    assert got["a"].lower == pytest.approx(np.percentile(range(95), 2.5)) and got["b"].lower is None
    assert got["b"].reason == "fewer_than_95_percent_finite_replicates"


def test_merge_keeps_the_fan_in_whatever_the_number_of_states(spark):
    import numpy as np

    from prismgrid.operators import moments as B

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2))
    rows = [("a" if i % 3 else "b", 1, v.tolist(), [0.0] * 4) for i, v in enumerate(x)]
    states = spark.createDataFrame(rows, "k string, n long, mean array<double>, m2 array<double>").repartition(40)
    got = {r.k: r for r in B.merge_moments(states, ["k"]).collect()}
    for k, own in (("a", x[np.arange(1500) % 3 > 0]), ("b", x[::3])):
        assert got[k].n == len(own) and np.allclose(got[k].mean, own.mean(0))
        assert np.allclose(np.reshape(got[k].m2, (2, 2)), np.cov(own.T) * (len(own) - 1))


def test_a_fit_uses_bands_of_all_endmembers_and_some_pixel(spark):
    from prismgrid.operators import library as L

    pixels = spark.createDataFrame([([None, 1.0, None, 2.0],), ([None, None, None, 1.0],), (None,)], "refl array<double>")
    members = spark.createDataFrame([([1.0, 1.0, 1.0, float("nan")],), ([1.0, 2.0, 1.0, 1.0],)], "refl array<double>")
    assert [r.band_index for r in L.valid_bands(members, pixels, 4).collect()] == [1]


def test_many_keys_are_merged_at_once(spark, monkeypatch):
    from prismgrid.operators import moments as B

    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 2))
    # 1,500 keys with four states each, one key missing: one round, however many states there are
    rows = [((i % 1500) or None, 1, v.tolist(), [0.0] * 4) for i, v in enumerate(x)] + [(7, 0, None, None)]
    states = spark.createDataFrame(rows, "k long, n long, mean array<double>, m2 array<double>").repartition(5)
    out = B.merge_moments(states, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups") == 1
    got = {r.k: r for r in out.collect()}
    assert len(got) == 1500
    for k in (None, 1, 7, 1499):
        own = x[(k or 0) :: 1500]
        assert got[k].n == 4 and np.allclose(got[k].mean, own.mean(0)) and np.allclose(np.reshape(got[k].m2, (2, 2)), np.cov(own.T) * 3)
    # bins of a few keys give the same
    monkeypatch.setattr(B, "MAX_BIN", 100)
    again = {r.k: r for r in B.merge_moments(states, ["k"]).collect()}
    assert again == got
    whole = B.merge_moments(states.drop("k"), []).collect()
    assert len(whole) == 1 and whole[0].n == 6000 and np.allclose(np.reshape(whole[0].m2, (2, 2)), np.cov(x.T) * 5999)


def test_drawn_quantiles_are_exact_and_no_value_travels_by_replicate(spark):
    from prismgrid.functions.draws import block_weights
    from prismgrid.operators import detect

    rng = np.random.default_rng(5)
    rows = [(k, f"b{b}", None if rng.random() < 0.1 else float(rng.integers(-20, 60)) / 4 + 3 * b, float(rng.random())) for k in (1, 2) for b in range(6) for _ in range(40)]
    # a key without any positive score, and blocks that hold none
    rows += [(3, "b0", -1.0, 0.1), (3, "b1", None, 0.2), (2, "b7", -2.0, 0.0), (1, "b8", 5.0, None)]
    df = spark.createDataFrame(rows, "site int, block_id string, score double, infeas double")
    w = block_weights(df.select("site", "block_id").distinct(), ["site"], 25, 4)
    draws = {(r.site, r.block_id): r.draws for r in w.collect()}
    got = {(r.site, r.rep): r for r in detect.calibrated_detection(df, w, ["site"], 0.9, 0.8).collect()}
    assert len(got) == 75
    for (k, rep), r in got.items():
        gated = [(s, draws[k, b][rep]) for site, b, s, i in rows if site == k and s is not None and i is not None and s > 0 and i < 0.8]
        v = np.repeat([s for s, _ in gated], [c for _, c in gated])
        assert r.n_calibration == len(v)
        if not len(v):
            assert (r.threshold, r.reason, r.n_detected) == (None, "no_positive_calibration_scores", 0)
            continue
        assert r.threshold == pytest.approx(np.quantile(v, 0.9), abs=1e-12) and r.reason is None
        assert r.n_detected == sum(s >= r.threshold for s, _ in gated)
