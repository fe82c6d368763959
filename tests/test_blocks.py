import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.operators import blocks as K, crossfit as C, resample as R, sensors as P, variogram as V


def raster(spark, n=12, seed=2):
    rng = np.random.default_rng(seed)
    ref = rng.integers(0, 2, (n, n))
    score = np.round(rng.normal(0, 1, (n, n)) + 0.4 * ref, 1)
    rows = [("s", i, j, float(score[i, j]) if (i * j) % 11 else None, int(ref[i, j])) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "site string, row_i int, col_i int, score double, ref int")


def setup(spark, side=4, halo=1):
    r = raster(spark)
    g = K.grid_shape(r, ["site"])
    return K.in_complete_blocks(r, g, ["site"], side), K.training_pairs(K.complete_blocks(g, ["site"], side), ["site"], halo)


def youden(rows):
    """Plain reading of the block-balanced rule over a list of (block, score, ref)."""
    pb, nb = {b for b, _, r in rows if r}, {b for b, _, r in rows if not r}
    if not pb or not nb:
        return None
    best = None
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        rate = lambda bs, cls: np.mean([np.mean([s >= t for b2, s, r in rows if b2 == b and r == cls]) for b in bs])
        j = round(rate(sorted(pb), 1) - rate(sorted(nb), 0), 12)
        if best is None or j > best[0]:
            best = (j, t)
    return best[1]


def test_cross_fit_equals_brute_force(spark):
    sampled, training = setup(spark)
    obs = [(r.block_id, r.score, r.ref) for r in sampled.collect() if r.score is not None]
    train = {}
    for r in training.collect():
        train.setdefault(r.fold, set()).add(r.block_id)
    got = {r.fold: r.threshold for r in C.fold_thresholds(sampled, training, ["site"]).collect()}
    assert got == {f: youden([o for o in obs if o[0] in bs]) for f, bs in train.items()}


def test_halo_keeps_neighbours_out(spark):
    _, training = setup(spark)
    pairs = {(r.fold, r.block_id) for r in training.collect()}
    assert ("r0000_c0000", "r0000_c0002") in pairs and ("r0000_c0000", "r0001_c0001") not in pairs
    assert not any(a == b for a, b in pairs) and not any(a == "r0001_c0001" for a, _ in pairs)


def test_tied_maxima_take_the_highest_threshold(spark):
    rows = spark.createDataFrame([("k", "b", 1.0, 1, 0, 1, 2, 1), ("k", "b", 2.0, 0, 1, 1, 2, 1), ("k", "b", 0.0, 0, 1, 1, 2, 1)],
                                 "k string, block_id string, score double, pos int, neg int, block_pos int, block_neg int, w int")
    assert C.balanced_youden(rows, ["k"]).first().threshold == 1.0


def test_pair_numerators_equal_brute_force(spark):
    sampled, _ = setup(spark)
    obs = [(r.block_id, r.score, r.ref) for r in sampled.collect() if r.score is not None]
    blocks = sorted({b for b, _, _ in obs})
    want = {}
    for p in blocks:
        for n in blocks:
            a = np.array([s for b, s, r in obs if b == p and r == 1])
            c = np.array([s for b, s, r in obs if b == n and r == 0])
            u = (a[:, None] > c[None]).sum() + 0.5 * (a[:, None] == c[None]).sum()
            if u:
                want[(p, n)] = u
    for steps in (1, 3, None):
        assert {(r.p_block, r.n_block): r.u for r in R.pair_numerators(sampled, ["site"], steps=steps).collect()} == want


def test_held_block_scores_ignore_block_and_halo(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1, 0.2, (12, 12, 3))
    lib = np.array([[2.0, 0.5, 1.0]])

    def scores(cube):
        rows = [("s", i, j, cube[i, j].tolist()) for i in range(12) for j in range(12)]
        df = spark.createDataFrame(rows, "site string, row_i int, col_i int, refl array<double>")
        b = K.complete_blocks(K.grid_shape(df, ["site"]), ["site"], 4)
        out = P.strict_fold_scores(df, b, ["site"], 4, 1, lib, [0, 1, 2], 3, 0.01, ["row_i", "col_i"])
        return {(r.row_i, r.col_i): (r.scores[0], r.n_fit) for r in out.where("fold = 'r0000_c0000'").collect()}

    base = scores(x)
    moved = x.copy()
    moved[4, :5] += 3.0
    moved[:4, 4] -= 2.0
    assert base == scores(moved) and len(base) == 16 and base[(0, 0)][1] == 144 - 25
    far = x.copy()
    far[9, 9] += 3.0
    assert base != scores(far)


def test_orderings_are_all_listed_when_few(spark):
    b = spark.createDataFrame([("s", c) for c in "abc"] + [("t", str(i)) for i in range(9)], "site string, block_id string")
    o = R.block_orderings(b, ["site"], 5, 1)
    n = {r.site: r.n for r in o.groupBy("site").agg(F.countDistinct("rep").alias("n")).collect()}
    assert n == {"s": 6, "t": 5}


def test_semivariogram_of_a_ramp(spark):
    df = spark.createDataFrame([("a", i, j, float(i * 8 + j)) for i in range(8) for j in range(8)], "f string, row_i int, col_i int, v double")
    got = {r.lag_pixels: r for r in V.empirical_semivariogram(df, ["f"], "v", 30.0).collect()}
    sq = [1.0] * 56 + [64.0] * 56 + [81.0] * 49 + [49.0] * 49
    assert got[1].semivariance == pytest.approx(0.5 * np.mean(sq)) and got[1].available_pairs == 210 and set(got) == {1, 2}
    thin = {r.lag_pixels: r for r in V.empirical_semivariogram(df, ["f"], "v", 30.0, max_pairs=20).collect()}
    pick = np.linspace(0, 209, 20, dtype=np.int64)
    assert thin[1].used_pairs == 20 and thin[1].semivariance == pytest.approx(0.5 * np.mean(np.array(sq)[pick]))


def test_exponential_fit_recovers_parameters_and_falls_back(spark):
    lags = np.array([1, 2, 3, 4, 6, 8, 12, 16], float)
    g = 0.2 + 1.5 * (1 - np.exp(-lags / 2))
    rows = [("fit", int(l), float(l), float(v)) for l, v in zip(lags, g)] + [("few", 1, 1.0, 0.5), ("few", 2, 2.0, 1.0)]
    pts = spark.createDataFrame(rows, "f string, lag_pixels int, distance double, semivariance double")
    var = spark.createDataFrame([("fit", 1.7), ("few", 1.0)], "f string, field_variance double")
    got = {r.f: r for r in V.fit_exponential(pts, var, ["f"]).collect()}
    assert got["fit"].scale == pytest.approx(2, rel=1e-4) and got["fit"].practical_range == pytest.approx(2 * np.log(20), rel=1e-4)
    assert got["few"].reason == "fewer_than_three_lags" and got["few"].practical_range == 2.0 and got["few"].nugget is None


def margin_rows(spark):
    sampled, training = setup(spark)
    # integer second score, so that scales are exact
    return sampled.withColumn("b", ((F.col("row_i") * 5 + F.col("col_i") * 3) % 7).cast("double")), training


def test_fold_margins_equal_brute_force(spark):
    rows, training = margin_rows(spark)
    obs = [(r.block_id, r.score, r.b, r.ref) for r in rows.collect() if r.score is not None]
    train = {}
    for r in training.collect():
        train.setdefault(r.fold, set()).add(r.block_id)
    got = {r.fold: r for r in C.fold_margins(rows, training, ["site"], "score", "b", "ref").collect()}
    assert set(got) == set(train)
    for fold, own in train.items():
        t = [o for o in obs if o[0] in own]
        x, y = np.array([o[1] for o in t]), np.array([o[2] for o in t])
        (a1, am, a3), (b1, bm, b3) = (np.quantile(v, [0.25, 0.5, 0.75]) for v in (x, y))
        r = got[fold]
        assert r.n_scale == len(t) and np.allclose([r.a_med, r.a_iqr, r.b_med, r.b_iqr], [am, a3 - a1, bm, b3 - b1])
        margin = (x - r.a_med) / r.a_iqr - (y - r.b_med) / r.b_iqr
        assert np.isclose(r.threshold, youden([(o[0], m, o[3]) for o, m in zip(t, margin, strict=True)]))


def test_margin_rows_are_not_copied_to_folds(spark, monkeypatch):
    rows, training = margin_rows(spark)
    made = []
    for module in (C, P):
        keep = module.cut
        monkeypatch.setattr(module, "cut", lambda df, keep=keep: made.append(keep(df)) or made[-1])
    sensors = {"native": ("score", "b"), "degraded": ("b", "score")}
    out = P.evaluate_margin_pair(rows, training, ["site"], sensors)
    n = rows.where("score IS NOT NULL").count()
    assert out.count() > 0
    # nothing that is materialised holds more rows than both branches, however many folds train on a row
    assert max(df.count() for df in made) <= 2 * n


def test_margin_without_spread_has_a_reason_and_no_threshold(spark):
    rows, training = margin_rows(spark)
    r = C.fold_margins(rows.withColumn("b", F.lit(1.0)), training, ["site"], "score", "b", "ref").first()
    assert r.reason == "zero_second_iqr" and r.threshold is None and r.b_iqr == 0
