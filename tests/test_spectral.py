import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.functions import spectral as S
from prismgrid.functions.arrays import literal_array
from prismgrid.operators import library as L, moments as B


def pixels(spark, rows):
    return spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(rows)], "id int, refl array<double>")


def test_angles_parallel_and_orthogonal(spark):
    lib = np.array([[1.0, 2.0, 3.0], [3.0, 0.0, -1.0]])
    df = pixels(spark, [[2, 4, 6], [3, 0, -1], [1, np.nan, 3]])
    out = [r.a for r in df.select("id", S.sam_angles("refl", lib).alias("a")).orderBy("id").collect()]
    assert out[0][0] == pytest.approx(0, abs=1e-7) and out[0][1] == pytest.approx(np.pi / 2)
    assert out[1][1] == pytest.approx(0, abs=1e-7)
    assert out[2] == [None, None]


def test_pairwise_angle_uses_shared_bands_only(spark):
    df = spark.createDataFrame([([1.0, None, 2.0], [2.0, 9.0, 4.0]), ([1.0, None, None], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.spectral_angle("a", "b")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-7) and got[1] is None


def test_class_takes_first_on_tie_and_none_beyond_gate(spark):
    df = spark.createDataFrame([([0.2, 0.1, 0.1],), ([0.9, 0.8, 0.7],), ([None, None, None],)], "a array<double>")
    assert [r[0] for r in df.select(S.sam_class("a", 0.5)).collect()] == [1, -1, -1]


def test_band_depth_and_continuum(spark):
    df = pixels(spark, [[1.0, 0.4, 0.8], [-1.0, 0.4, -1.0]])
    got = [r[0] for r in df.select(S.feature_depth("refl", [100.0, 150.0, 200.0], 100, 150, 200)).collect()]
    assert got[0] == pytest.approx(1 - 0.4 / 0.9) and got[1] is None
    with pytest.raises(ValueError):
        S.feature_depth("refl", [100.0, 150.0, 200.0], 100, 105, 200)
    flat = df.select(S.continuum_removed("refl", literal_array([100, 150, 200]))).first()[0]
    assert flat[0] == pytest.approx(1) and flat[2] == pytest.approx(1)


def test_byte_stretch_marks_invalid_white_and_missing_black(spark):
    df = spark.createDataFrame([(0.5, False), (None, False), (None, True), (9.0, False)], "v double, bad boolean")
    got = [r[0] for r in df.select(S.stretch_to_byte(F.col("v"), F.lit(0.0), F.lit(1.0), F.col("bad"))).collect()]
    assert got == [127 if round(0.5 / (1 + 1e-9) * 255) == 127 else 128, 0, 255, 255]


def test_simulated_band_needs_half_of_its_response(spark):
    df = pixels(spark, [[1, 2, np.nan, np.nan], [1, np.nan, np.nan, np.nan]])
    got = [r[0] for r in df.select(S.simulate_bands("refl", np.ones((1, 4)))).collect()]
    assert got[0] == [1.5] and got[1] == [None]


@pytest.mark.parametrize("partitions", [1, 5])
def test_planted_target_scores_one_and_matches_numpy(spark, partitions):
    rng = np.random.default_rng(3)
    x = rng.normal(0.5, 0.05, (400, 6))
    target = np.array([0.9, 0.1, 0.8, 0.2, 0.7, 0.3])
    x[0], x[1] = target, 0.5 * target + 0.5 * 0.5
    df = pixels(spark, x).repartition(partitions)
    n, mean, m2 = B.state_of(B.background_moments(df, [], list(range(6)), 6).collect()[0])
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(m2 / 399, np.cov(x.T))
    inv = B.loaded_inverse(n, m2, 0.01)
    got = df.withColumn("s", B.matched_filter("refl", mean, inv, target[None], list(range(6)), 6)).orderBy("id").select("s").collect()
    c, d = x - x.mean(0), target - x.mean(0)
    cov = np.cov(x.T)
    ref = np.linalg.inv(cov + 0.01 * np.trace(cov) / 6 * np.eye(6))
    eta = d @ ref @ d
    alpha = c @ ref @ d / eta
    infeas = np.sqrt(np.clip(np.einsum("ij,jk,ik->i", c, ref, c) - alpha**2 * eta, 0, None)) / np.sqrt(5)
    assert np.allclose([r.s[0] for r in got], alpha) and np.allclose([r.s[1] for r in got], infeas, atol=1e-6)
    assert alpha[0] == pytest.approx(1) and abs(alpha[1] - 0.5) < 0.1


def test_singular_background_is_refused():
    with pytest.raises(ValueError):
        B.loaded_inverse(10, np.zeros((2, 2)), 0.01)
    with pytest.raises(ValueError):
        B.loaded_inverse(1, np.eye(2), 0.01)


def test_resample_bridges_gaps_without_extrapolation(spark):
    src = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, None), ("a", 20.0, 2.0)], "s string, wavelength_nm double, value double")
    t = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0), (3, 25.0), (4, -1.0)], "target_index int, target_nm double")
    got = {r.target_index: r.value for r in L.resample(src, ["s"], t).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: None, 4: None}


def test_medoid_is_closest_to_the_median(spark):
    rows = [("m", 1, [1.0, 1.0, 1.0]), ("m", 2, [1.0, 1.1, 1.0]), ("m", 3, [9.0, 0.0, 1.0])]
    got = L.medoids(spark.createDataFrame(rows, "mineral string, sample int, refl array<double>")).collect()
    assert [(r.mineral, r.sample) for r in got] == [("m", 1)]
