"""Queries over spectra: masks, library, angles, matched filter, detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..functions.arrays import literal_array
from ..operators import detect, library as L, mask as M, moments as B, stats
from .registry import (
    N_BANDS, VIEWS, WAVELENGTHS, bands, ev, filter_views, library, pix, qa, query, r6, rounded, table,
)

WINDOWS = [(1340.0, 1440.0), (1800.0, 1950.0)]  # absorption windows of the stand-in sensor
GATE = 1.0


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "lo_nm double, hi_nm double")


# ---- masks ---------------------------------------------------------------------------------------


@query("q1_pixel_mask", """SELECT vec_id, invalid, CASE WHEN NOT invalid THEN round(list_sum(refl), 6) + 0.0 END AS refl_sum FROM qaok""")
def q1(spark, d):
    m = M.mask_pixels(qa(spark, d).withColumn("invalid", M.qa_invalid()))
    total = F.aggregate("refl", F.lit(0.0), lambda a, v: a + v)
    return m.select("vec_id", "invalid", r6(total).alias("refl_sum"))


BANDS_SQL = """SELECT band_index, wavelength_nm, good, ((wavelength_nm BETWEEN 1340 AND 1440) OR (wavelength_nm BETWEEN 1800 AND 1950)) AS in_window,
 good AND NOT ((wavelength_nm BETWEEN 1340 AND 1440) OR (wavelength_nm BETWEEN 1800 AND 1950)) AS retained FROM bands"""


@query("q2_band_mask", f"""WITH b AS ({BANDS_SQL}) SELECT CAST(v.band_index AS INTEGER) AS band_index, count(*) AS n_pixels,
 CAST(count(CASE WHEN b.retained THEN v.value END) AS BIGINT) AS n_retained, round(avg(CASE WHEN b.retained THEN v.value END), 6) + 0.0 AS mean_value
 FROM (SELECT vec_id, unnest(range(64)) AS band_index, unnest(refl) AS value FROM qa) v JOIN b USING (band_index) GROUP BY v.band_index""")
def q2(spark, d):
    keep = M.retained_bands(bands(spark), windows(spark)).orderBy("band_index").select("retained").collect()
    masked = qa(spark, d).withColumn("refl", M.mask_bands("refl", [r[0] for r in keep]))
    return L.long_spectra(masked, []).groupBy("band_index").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count("value").alias("n_retained"), r6(F.avg("value")).alias("mean_value")
    )


@query("q3_qa_domain", """SELECT 'cirrus' AS field, CAST(k AS INTEGER) AS value, count(*) AS n FROM ev WHERE k NOT IN (0, 1, 255) GROUP BY k""")
def q3(spark, d):
    df = ev(spark, d).select(F.lit(0).alias("cloud"), F.col("k").alias("cirrus"), F.lit(0).alias("nodata"))
    return M.qa_domain_violations(df)


@query("q3_axis_match", """SELECT b.band_index, b.wavelength_nm AS a_nm, m.nm AS b_nm FROM bands b FULL JOIN
 (SELECT band_index, 400.0::DOUBLE + 33.0::DOUBLE * band_index + CASE WHEN count(*) FILTER (WHERE value > 0.38) > 0 THEN 0.001 ELSE 0 END AS nm
  FROM band_values GROUP BY band_index) m USING (band_index) WHERE m.nm IS NULL OR b.wavelength_nm IS NULL OR abs(b.wavelength_nm - m.nm) > 1e-6""")
def q3_axis(spark, d):
    shifted = L.long_spectra(pix(spark, d), []).groupBy("band_index").agg(
        F.count_if(F.col("value") > 0.38).alias("hot")
    ).select("band_index", (F.lit(400.0) + F.lit(33.0) * F.col("band_index") + F.when(F.col("hot") > 0, 0.001).otherwise(0.0)).alias("wavelength_nm"))
    return M.axis_mismatches(bands(spark), shifted)


@query("q4_quality_report", f"""WITH b AS ({BANDS_SQL}) SELECT label, count(*) AS n_total, CAST(count(*) FILTER (WHERE nodata <> 0) AS BIGINT) AS n_nodata,
 CAST(count(*) FILTER (WHERE cloud <> 0) AS BIGINT) AS n_cloud, CAST(count(*) FILTER (WHERE cirrus <> 0) AS BIGINT) AS n_cirrus,
 CAST(count(*) FILTER (WHERE invalid) AS BIGINT) AS n_invalid, max(nb) AS n_bad_bands, max(nw) AS n_window_bands, max(nr) AS n_retained_bands,
 round(count(*) FILTER (WHERE invalid) / count(*)::DOUBLE, 6) + 0.0 AS invalid_fraction
 FROM qaok CROSS JOIN (SELECT count(*) FILTER (WHERE NOT good) AS nb, count(*) FILTER (WHERE in_window) AS nw, count(*) FILTER (WHERE retained) AS nr FROM b)
 GROUP BY label""")
def q4(spark, d):
    return rounded(M.quality_report(qa(spark, d), ["label"], M.retained_bands(bands(spark), windows(spark))), "invalid_fraction")


AUDITED = f"""WITH b AS ({BANDS_SQL}), u AS (SELECT list(band_index ORDER BY band_index) AS idx FROM b WHERE retained),
 x AS (SELECT label, nodata, (cloud = 1 OR cirrus = 1 OR nodata = 1) AS bad, (cloud = 255 OR cirrus = 255 OR nodata = 255) AS fill, list_transform(idx, lambda i: refl[i + 1]) AS v FROM qa, u)"""


@query("q5_quality_audit", AUDITED + """ SELECT label, count(*) AS n_total, count(*) FILTER (WHERE bad) AS n_invalid, count(*) FILTER (WHERE NOT bad) AS n_clear,
 count(*) FILTER (WHERE NOT bad AND list_min(v) < 0) AS n_below_0, count(*) FILTER (WHERE NOT bad AND list_max(v) > 1) AS n_above_1,
 count(*) FILTER (WHERE NOT bad AND list_max(v) > 1.5) AS n_above_1_5, round(min(list_min(v)) FILTER (WHERE NOT bad), 6) + 0.0 AS min_value, round(max(list_max(v)) FILTER (WHERE NOT bad), 6) + 0.0 AS max_value,
 count(*) FILTER (WHERE fill) AS n_qa_fill, count(*) FILTER (WHERE (list_count(v) < len(v)) <> (nodata = 1)) AS n_fill_mismatch,
 round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 6) + 0.0 AS invalid_fraction,
 round(count(*) FILTER (WHERE NOT bad AND list_min(v) < 0) / nullif(count(*) FILTER (WHERE NOT bad), 0)::DOUBLE, 6) + 0.0 AS below_0_fraction,
 round(count(*) FILTER (WHERE NOT bad AND list_max(v) > 1) / nullif(count(*) FILTER (WHERE NOT bad), 0)::DOUBLE, 6) + 0.0 AS above_1_fraction,
 round(count(*) FILTER (WHERE NOT bad AND list_max(v) > 1.5) / nullif(count(*) FILTER (WHERE NOT bad), 0)::DOUBLE, 6) + 0.0 AS above_1_5_fraction
 FROM x GROUP BY label""")
def q5(spark, d):
    return rounded(M.quality_audit(qa(spark, d), ["label"], M.retained_bands(bands(spark), windows(spark))), "min_value", "max_value", "invalid_fraction",
                   "below_0_fraction", "above_1_fraction", "above_1_5_fraction")


@query("q5_quality_counts", """SELECT 'cloud' AS field, cloud AS value, count(*) AS n FROM qa GROUP BY cloud UNION ALL
 SELECT 'cirrus', cirrus, count(*) FROM qa GROUP BY cirrus UNION ALL SELECT 'nodata', nodata, count(*) FROM qa GROUP BY nodata""")
def q5_counts(spark, d):
    return M.quality_value_counts(qa(spark, d), [])


@query("q5_value_quantiles", AUDITED + """ SELECT label, count(v) AS n, round(quantile_cont(v, 0.001), 6) + 0.0 AS q001, round(quantile_cont(v, 0.01), 6) + 0.0 AS q01,
 round(quantile_cont(v, 0.5), 6) + 0.0 AS q50, round(quantile_cont(v, 0.99), 6) + 0.0 AS q99, round(quantile_cont(v, 0.999), 6) + 0.0 AS q999
 FROM (SELECT label, unnest(v) AS v FROM x WHERE NOT bad) WHERE v IS NOT NULL GROUP BY label""")
def q5_quantiles(spark, d):
    qs = {"q001": 0.001, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q999": 0.999}
    values = M.clear_values(qa(spark, d), ["label"], M.retained_bands(bands(spark), windows(spark)))
    return rounded(stats.exact_quantiles(values, ["label"], "value", qs), *qs)


@query("q13_nearest_band", """SELECT t.label, t.target_nm, arg_min(b.band_index, abs(b.wavelength_nm - t.target_nm) + b.band_index * 1e-12) AS band_index
 FROM (SELECT label, 450.0::DOUBLE + 165 * label + count(*) AS target_nm FROM pix GROUP BY label) t CROSS JOIN bands b GROUP BY t.label, t.target_nm""")
def q13(spark, d):
    t = pix(spark, d).groupBy("label").agg((F.lit(450.0) + 165 * F.first("label") + F.count(F.lit(1))).alias("target_nm"))
    axis = F.array(*[F.struct(F.lit(w).alias("nm"), F.lit(i).alias("i")) for i, w in enumerate(WAVELENGTHS)])
    near = F.array_min(F.transform(axis, lambda b: F.struct(F.abs(b["nm"] - F.col("target_nm")).alias("gap"), b["i"].alias("i"))))
    return t.select("label", "target_nm", near["i"].alias("band_index"))


@query("q14_band_depth", """SELECT vec_id, round(CASE WHEN cont > 0 THEN 1 - refl[31] / cont END, 6) + 0.0 AS depth_a,
 round(CASE WHEN cont2 > 0 THEN 1 - refl[55] / cont2 END, 6) + 0.0 AS depth_b FROM
 (SELECT vec_id, refl, refl[28] + (refl[34] - refl[28]) * ((1390.0 - 1291.0) / (1489.0 - 1291.0))::DOUBLE AS cont,
  refl[52] + (refl[58] - refl[52]) * ((2182.0 - 2083.0) / (2281.0 - 2083.0))::DOUBLE AS cont2 FROM pix)""")
def q14(spark, d):
    return pix(spark, d).select(
        "vec_id",
        r6(S.feature_depth("refl", WAVELENGTHS, 1290.0, 1392.0, 1490.0)).alias("depth_a"),
        r6(S.feature_depth("refl", WAVELENGTHS, 2085.0, 2180.0, 2279.0)).alias("depth_b"),
    )


@query("q15_continuum", """SELECT vec_id, CAST(i AS INTEGER) AS band_index, round(refl[i + 1] / (refl[21] + (refl[31] - refl[21]) * (i - 20) / 10.0::DOUBLE), 6) + 0.0 AS value
 FROM (SELECT vec_id, refl, unnest(range(20, 31)) AS i FROM pix)""")
def q15(spark, d):
    win = F.slice("refl", 21, 11)
    removed = S.continuum_removed(win, literal_array(WAVELENGTHS[20:31]))
    return pix(spark, d).select("vec_id", F.posexplode(removed).alias("p", "v")).select(
        "vec_id", (F.col("p") + 20).alias("band_index"), r6("v").alias("value")
    )


@query("q16_unit_spectrum", """SELECT label, band_index, round(greatest(0, least(1, (value - lo) / (hi - lo + 1e-9))), 6) + 0.0 AS value
 FROM (SELECT label, CAST(band_index AS INTEGER) AS band_index, value, quantile_cont(value, 0.02) OVER (PARTITION BY label) AS lo, quantile_cont(value, 0.98) OVER (PARTITION BY label) AS hi
 FROM (SELECT label, band_index, avg(value) AS value FROM band_values GROUP BY label, band_index))""")
def q16(spark, d):
    m = L.mean_spectrum(pix(spark, d), ["label"])
    # one spectrum per key: the number of bands bounds the percentile buffer
    lims = m.groupBy("label").agg(F.percentile("value", [0.02, 0.98]).alias("p"))
    return m.join(lims, "label").select("label", "band_index", r6(S.unit_stretch(F.col("value"), F.col("p")[0], F.col("p")[1])).alias("value"))


PCT_SQL = """SELECT channel, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM
 (SELECT unnest([0, 1, 2]) AS channel, unnest([refl[11], refl[6], refl[3]]) AS v FROM qaok WHERE NOT invalid) GROUP BY channel"""


def display(spark, d) -> DataFrame:
    """Long display channels with the invalid flag."""
    r = F.col("refl")
    chans = F.posexplode(F.array(r[10], r[5], r[2]))
    return qa(spark, d).withColumn("invalid", M.qa_invalid()).select("vec_id", "row_i", "col_i", "label", "invalid", chans.alias("channel", "v"))


@query("a24_pooled_percentiles", f"SELECT CAST(channel AS INTEGER) AS channel, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM ({PCT_SQL})")
def a24(spark, d):
    b = stats.exact_quantiles(display(spark, d).where(~F.col("invalid")), ["channel"], "v", {"lo": 0.02, "hi": 0.98})
    return rounded(b.drop("n"), "lo", "hi")


@query("q17_stretch_byte", f"""SELECT q.vec_id, CAST(c.channel AS INTEGER) AS channel, CASE WHEN invalid THEN 255 ELSE coalesce(CAST(round_even(
 255 * greatest(0, least(1, ([refl[11], refl[6], refl[3]][c.channel + 1] - lo) / (hi - lo + 1e-9))), 0) AS INTEGER), 0) END AS value
 FROM qaok q CROSS JOIN ({PCT_SQL}) c""")
def q17(spark, d):
    x = display(spark, d)
    lim = stats.exact_quantiles(x.where(~F.col("invalid")), ["channel"], "v", {"lo": 0.02, "hi": 0.98}).drop("n")
    return x.join(lim, "channel").select(
        "vec_id", "channel", S.stretch_to_byte(F.col("v"), F.col("lo"), F.col("hi"), F.col("invalid")).alias("value")
    )


@query("q21_valid_display", """SELECT vec_id, NOT (refl[11] IS NULL OR refl[6] IS NULL OR refl[3] IS NULL OR least(refl[11], refl[6], refl[3]) < 0
 OR greatest(refl[11], refl[6], refl[3]) > 1.5) AS displayable FROM qa""")
def q21(spark, d):
    r = F.col("refl")
    return qa(spark, d).select("vec_id", M.valid_display(F.array(r[10], r[5], r[2])).alias("displayable"))


# ---- library and angles ----------------------------------------------------------------------------


@query("a4_library_medoid", "SELECT label AS mineral, vec_id AS sample, round(angle, 6) + 0.0 AS angle FROM medoid")
def a4(spark, d):
    return rounded(L.medoids(library(spark, d)).select("mineral", "sample", "angle"), "angle")


@query("s1_pairwise_angle", """SELECT a.label AS a, b.label AS b, round(degrees(acos(greatest(-1, least(1, list_inner_product(a.refl, b.refl)
 / sqrt(list_inner_product(a.refl, a.refl) * list_inner_product(b.refl, b.refl)))))), 6) + 0.0 AS angle_deg FROM medoid a JOIN medoid b ON a.label < b.label""")
def s1(spark, d):
    m = L.medoids(library(spark, d))
    a = m.select(F.col("mineral").alias("a"), F.col("refl").alias("ra"))
    b = m.select(F.col("mineral").alias("b"), F.col("refl").alias("rb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", r6(S.spectral_angle("ra", "rb", degrees=True)).alias("angle_deg"))


def angle_scores(spark, d) -> tuple[list, DataFrame]:
    names, lib = L.library_matrix(L.medoids(library(spark, d)), "mineral")
    return names, pix(spark, d).withColumn("angles", S.sam_angles("refl", lib))


@query("s2_sam_angles", "SELECT vec_id, mineral, round(angle, 6) + 0.0 AS angle FROM sam")
def s2(spark, d):
    names, df = angle_scores(spark, d)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p") + 1)
    return df.select("vec_id", F.posexplode("angles").alias("p", "a")).select("vec_id", label.alias("mineral"), r6("a").alias("angle"))


def sam_codes(spark, d) -> DataFrame:
    names, df = angle_scores(spark, d)
    pos = S.sam_class("angles", 1.35)
    code = F.when(pos >= 0, F.element_at(F.array(*[F.lit(n) for n in names]), pos + 1)).otherwise(F.lit(-1))
    return df.select("vec_id", "row_i", "col_i", "label", code.alias("code"))


@query("s3_sam_class", "SELECT vec_id, code FROM sam_class")
def s3(spark, d):
    return sam_codes(spark, d).select("vec_id", "code")


@query("a22_class_counts", """SELECT CAST(c AS INTEGER) AS code, count(code) AS n, (SELECT count(*) FROM sam_class) AS n_total,
 round(count(code) / (SELECT count(*) FROM sam_class)::DOUBLE, 6) + 0.0 AS fraction FROM range(-1, 10) t(c) LEFT JOIN sam_class s ON s.code = c GROUP BY c""")
def a22(spark, d):
    return rounded(detect.counts_for(sam_codes(spark, d), [], "code", list(range(-1, 10))), "fraction")


RESAMPLE_TARGETS = [410.0 + 71.5 * i for i in range(32)]


@query("j1_resample", """SELECT label, CAST(i AS INTEGER) AS target_index, 410.0::DOUBLE + 71.5::DOUBLE * i AS target_nm, round(CASE WHEN v1 IS NOT NULL THEN v0 + (v1 - v0) * (t - w0) / (w1 - w0) END, 6) + 0.0 AS value FROM
 (SELECT g.label, g.i, g.t, arg_max(s.wl, s.wl) FILTER (WHERE s.wl <= g.t) AS w0, arg_max(s.value, s.wl) FILTER (WHERE s.wl <= g.t) AS v0,
  arg_min(s.wl, s.wl) FILTER (WHERE s.wl > g.t) AS w1, arg_min(s.value, s.wl) FILTER (WHERE s.wl > g.t) AS v1
  FROM (SELECT DISTINCT label, i, 410.0::DOUBLE + 71.5::DOUBLE * i AS t FROM pix CROSS JOIN range(32) r(i)) g
  JOIN (SELECT label, band_index, 400.0::DOUBLE + 33.0::DOUBLE * band_index AS wl, avg(value) AS value FROM band_values GROUP BY label, band_index
    HAVING band_index % 16 <> 15 AND NOT (400.0 + 33.0 * band_index BETWEEN 1340 AND 1440)) s USING (label) GROUP BY g.label, g.i, g.t)""")
def j1(spark, d):
    m = L.mean_spectrum(pix(spark, d), ["label"]).join(F.broadcast(bands(spark)), "band_index")
    gap = ~F.col("good") | F.col("wavelength_nm").between(1340, 1440)
    src = m.select("label", "wavelength_nm", F.when(~gap, F.col("value")).alias("value"))
    t = spark.createDataFrame(list(enumerate(RESAMPLE_TARGETS)), "target_index int, target_nm double")
    return rounded(L.resample(src, ["label"], t), "value")


@query("a5_shoulders", """WITH w AS (SELECT label, 400.0::DOUBLE + 33.0::DOUBLE * band_index AS wl, value FROM median_long WHERE 400.0 + 33.0 * band_index BETWEEN 1700 AND 2300),
 m AS (SELECT label, count(*) AS n_bands, arg_min(wl, value) AS c FROM w GROUP BY label),
 s AS (SELECT label, n_bands, c, arg_max(wl, value) FILTER (WHERE wl <= c) AS lo, arg_max(wl, value) FILTER (WHERE wl >= c) AS hi FROM w JOIN m USING (label) GROUP BY label, n_bands, c)
 SELECT label AS mineral, n_bands, c AS center_nm, lo AS lo_shoulder_nm, hi AS hi_shoulder_nm, lo < c AND c < hi AS ok FROM s""")
def a5(spark, d):
    med = L.median_spectra(library(spark, d))
    long = med.select("mineral", F.posexplode("median_refl").alias("band_index", "value")).withColumn(
        "wavelength_nm", F.lit(400.0) + F.lit(33.0) * F.col("band_index"))
    return L.shoulders(long, ["mineral"], F.lit(1700.0), F.lit(2300.0))


@query("a5_nominal_shoulders", """WITH w AS (SELECT label, 400.0::DOUBLE + 33.0::DOUBLE * band_index AS wl, value FROM median_long WHERE 400.0 + 33.0 * band_index BETWEEN 2200 - 100 AND 2200 + 100),
 m AS (SELECT label, count(*) AS n_bands, arg_min(wl, value) AS c FROM w GROUP BY label),
 s AS (SELECT label, n_bands, arg_max(wl, value) FILTER (WHERE wl <= c) AS lo, arg_max(wl, value) FILTER (WHERE wl >= c) AS hi FROM w JOIN m USING (label) GROUP BY label, n_bands, c)
 SELECT label AS mineral, n_bands, 2200.0::DOUBLE AS center_nm, lo AS lo_shoulder_nm, hi AS hi_shoulder_nm, lo < 2200 AND 2200 < hi AS ok FROM s""")
def a5_nominal(spark, d):
    med = L.median_spectra(library(spark, d))
    long = med.select("mineral", F.posexplode("median_refl").alias("band_index", "value")).withColumn(
        "wavelength_nm", F.lit(400.0) + F.lit(33.0) * F.col("band_index"))
    return L.shoulders(long, ["mineral"], F.lit(2100.0), F.lit(2300.0), F.lit(2200.0))


@query("a6_mean_spectrum", """SELECT CAST(band_index AS INTEGER) AS band_index, round(avg(value), 6) + 0.0 AS value
 FROM (SELECT unnest(range(64)) AS band_index, unnest(refl) AS value FROM qa) GROUP BY band_index""")
def a6(spark, d):
    return rounded(L.mean_spectrum(qa(spark, d), []), "value")


@query("a8_spectral_agreement", """WITH m AS (SELECT band_index, avg(value) FILTER (WHERE label < 5) AS x, avg(value) FILTER (WHERE label >= 5) AS y FROM band_values GROUP BY band_index)
 SELECT round(corr(x, y), 6) + 0.0 AS r, round(degrees(acos(sum(x * y) / sqrt(sum(x * x) * sum(y * y)))), 6) + 0.0 AS angle_deg, count(*) AS n_bands FROM m""")
def a8(spark, d):
    p = pix(spark, d)
    a = L.mean_spectrum(p.where("label < 5"), [])
    b = L.mean_spectrum(p.where("label >= 5"), [])
    return rounded(L.spectral_agreement(a, b), "r", "angle_deg")


def response_matrix() -> np.ndarray:
    """Triangular response of 13 target bands over the 64 source bands."""
    wl = np.array(WAVELENGTHS)
    centers = 480.0 + 150.0 * np.arange(13)
    return np.clip(1.0 - np.abs(wl[None, :] - centers[:, None]) / 120.0, 0.0, None)


SRF_SQL = """(SELECT CAST(t AS INTEGER) AS target, CAST(b AS INTEGER) AS band_index, 400.0::DOUBLE + 33.0::DOUBLE * b AS wl,
 greatest(1.0::DOUBLE - abs(400.0::DOUBLE + 33.0::DOUBLE * b - (480.0::DOUBLE + 150.0::DOUBLE * t)) / 120.0::DOUBLE, 0) AS w FROM range(13) x(t) CROSS JOIN range(64) y(b))"""


@query("s8_simulated_bands", f"""SELECT q.vec_id, s.target AS target_index, round(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) >= 0.5 * sum(w)
 THEN sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) END, 6) + 0.0 AS value
 FROM (SELECT vec_id, unnest(range(64)) AS band_index, unnest(refl) AS v FROM qa) q JOIN {SRF_SQL} s USING (band_index) GROUP BY q.vec_id, s.target""")
def s8(spark, d):
    sim = S.simulate_bands("refl", response_matrix())
    return qa(spark, d).select("vec_id", F.posexplode(sim).alias("target_index", "v")).select("vec_id", "target_index", r6("v").alias("value"))


def response_rows(spark, d) -> DataFrame:
    """A measured response per label: clipped mean spectrum of its positive side."""
    m = L.mean_spectrum(pix(spark, d), ["label"])
    return m.select(F.col("label").alias("band_name"), (F.lit(400.0) + F.lit(33.0) * F.col("band_index")).alias("wavelength_nm"),
                    F.greatest(F.col("value"), F.lit(0.0)).alias("response"))


@query("a33_response_stats", """WITH r AS (SELECT label, 400.0::DOUBLE + 33.0::DOUBLE * band_index AS wl, greatest(avg(value), 0) AS w FROM band_values GROUP BY label, band_index)
 SELECT label AS band_name, round(sum(w * wl) / sum(w), 6) + 0.0 AS center_nm, round(max(wl) FILTER (WHERE w >= 0.5 * pk) - min(wl) FILTER (WHERE w >= 0.5 * pk), 6) + 0.0 AS fwhm_nm
 FROM (SELECT *, max(w) OVER (PARTITION BY label) AS pk FROM r) GROUP BY label""")
def a33(spark, d):
    return rounded(L.response_stats(response_rows(spark, d)), "center_nm", "fwhm_nm")


@query("a32_separability", f"""WITH deg AS (SELECT label, list(v ORDER BY target) AS dr FROM (SELECT m.label, s.target, sum(m.refl[s.band_index + 1] * s.w) / sum(s.w) AS v
  FROM medoid m CROSS JOIN {SRF_SQL} s GROUP BY m.label, s.target) GROUP BY label),
 a AS (SELECT x.label AS a, y.label AS b, degrees(acos(list_inner_product(x.refl, y.refl) / sqrt(list_inner_product(x.refl, x.refl) * list_inner_product(y.refl, y.refl)))) AS f,
  degrees(acos(list_inner_product(p.dr, q.dr) / sqrt(list_inner_product(p.dr, p.dr) * list_inner_product(q.dr, q.dr)))) AS g
  FROM medoid x JOIN medoid y ON x.label < y.label JOIN deg p ON p.label = x.label JOIN deg q ON q.label = y.label)
 SELECT a, b, round(f, 6) + 0.0 AS full_deg, round(g, 6) + 0.0 AS degraded_deg, round((f - g) / f * 100, 6) + 0.0 AS loss_pct FROM a""")
def a32(spark, d):
    full = L.medoids(library(spark, d)).select("mineral", "refl")
    coarse = full.select("mineral", S.simulate_bands("refl", response_matrix()).alias("refl"))
    names = full.select("mineral")
    pairs = names.select(F.col("mineral").alias("a")).join(names.select(F.col("mineral").alias("b")), F.col("a") < F.col("b"))
    return rounded(L.separability(full, coarse, pairs), "full_deg", "degraded_deg", "loss_pct")


@query("j20_frozen_endmembers", """SELECT f.mineral, f.sample, p.vec_id IS NOT NULL AS found, round(p.refl[1], 6) + 0.0 AS first_band FROM
 (SELECT DISTINCT CAST(o_custkey % 10 AS INTEGER) AS mineral, o_custkey AS sample FROM orders) f LEFT JOIN pix p ON p.label = f.mineral AND p.vec_id = f.sample""")
def j20(spark, d):
    frozen = table(spark, d, "orders").select((F.col("o_custkey") % 10).cast("int").alias("mineral"), F.col("o_custkey").alias("sample")).distinct()
    j = L.lookup_endmembers(frozen, library(spark, d))
    return j.select("mineral", "sample", "found", r6(F.col("refl")[0]).alias("first_band"))


# ---- moments and matched filter ----------------------------------------------------------------------


@query("a1_moments", """SELECT label, b.n, CAST(i AS INTEGER) AS band_a, CAST(j AS INTEGER) AS band_b, round(m, 6) + 0.0 AS mean_a, round(c, 6) + 0.0 AS cov FROM (
 SELECT label, count(*) AS n, i, j, avg(refl[i + 1]) AS m, covar_samp(refl[i + 1], refl[j + 1]) AS c FROM pix CROSS JOIN range(64) x(i) CROSS JOIN range(64) y(j) GROUP BY label, i, j) b""")
def a1(spark, d):
    m = B.background_moments(pix(spark, d), ["label"], list(range(N_BANDS)), N_BANDS)
    long = m.select("label", "n", "mean", F.posexplode("m2").alias("p", "v"))
    a, b = F.floor(F.col("p") / N_BANDS).cast("int"), (F.col("p") % N_BANDS).cast("int")
    return long.select("label", "n", a.alias("band_a"), b.alias("band_b"), r6(F.element_at("mean", a + 1)).alias("mean_a"),
                       r6(F.col("v") / (F.col("n") - 1)).alias("cov"))


@query("a2_loaded_inverse", "SELECT n, round(i00, 4) + 0.0 AS i00, round(i01, 4) + 0.0 AS i01, round(i11, 4) + 0.0 AS i11 FROM inv2")
def a2(spark, d):
    s = B.background_moments(pix(spark, d), [], [0, 1], N_BANDS)
    @F.pandas_udf("array<double>")
    def inv(n, m2):
        return pd.Series([B.loaded_inverse(int(k), np.asarray(m).reshape(2, 2), 0.01).ravel().tolist() for k, m in zip(n, m2)])
    v = s.select("n", inv("n", "m2").alias("v"))
    return v.select("n", *[(F.round(F.col("v")[i], 4) + F.lit(0.0)).alias(c) for i, c in ((0, "i00"), (1, "i01"), (3, "i11"))])


def mf_scores(spark, d, used: list[int]) -> tuple[list, DataFrame]:
    """Pixels with ``scores`` (mf then infeas per endmember) against the whole-scene background."""
    p = pix(spark, d)
    names, lib = L.library_matrix(L.medoids(library(spark, d)), "mineral")
    n, mean, m2 = B.state_of(M.bounded_rows(B.background_moments(p, [], used, N_BANDS), 1)[0])
    col = B.matched_filter("refl", mean, B.loaded_inverse(n, m2, 0.01), lib[:, used], used, N_BANDS)
    return names, p.withColumn("scores", col)


def mf_long(spark, d, used: list[int] = list(range(N_BANDS))) -> DataFrame:
    names, df = mf_scores(spark, d, used)
    k = len(names)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("mineral"), F.col("scores")[i].alias("mf"), F.col("scores")[i + k].alias("infeas"))
        for i, m in enumerate(names)]))
    return df.select("vec_id", "row_i", "col_i", "label", rows.alias("x")).select("vec_id", "row_i", "col_i", "label", "x.*")


@query("s4_matched_filter", "SELECT vec_id, mineral, round(mf, 6) + 0.0 AS mf, round(infeas, 6) + 0.0 AS infeas FROM mf2")
def s4(spark, d):
    return rounded(mf_long(spark, d, [0, 1]).select("vec_id", "mineral", "mf", "infeas"), "mf", "infeas")


@query("s4_matched_filter_all_bands", "SELECT vec_id, mineral, round(mf, 6) + 0.0 AS mf, round(infeas, 6) + 0.0 AS infeas FROM mfall")
def s4_full(spark, d):
    return rounded(mf_long(spark, d).select("vec_id", "mineral", "mf", "infeas"), "mf", "infeas")


def gapped(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pixels without their flagged bands, label 3 also without band 7, and medoids of which one lacks band 21."""
    p, m = pix(spark, d), L.medoids(library(spark, d))
    drop = F.transform("refl", lambda v, i: F.when((i % 16 != 15) & ((i != 7) | (F.col("label") != 3)), v))
    lacking = F.transform("refl", lambda v, i: F.when((i != 21) | (F.col("mineral") != 2), v))
    return p.withColumn("refl", drop), m.withColumn("refl", lacking)


# the same pixels and medoids with gaps, in SQL
VIEWS["gapval"] = "SELECT vec_id, label, band_index, CASE WHEN band_index % 16 <> 15 AND (band_index <> 7 OR label <> 3) THEN value END AS value FROM band_values"
VIEWS["gaplib"] = "SELECT label AS mineral, band_index, CASE WHEN band_index <> 21 OR label <> 2 THEN value END AS value FROM (SELECT label, unnest(range(64)) AS band_index, unnest(refl) AS value FROM medoid)"
_WHOLE = "SELECT band_index FROM gaplib GROUP BY band_index HAVING count(value) = count(*)"
filter_views("gap", "SELECT vec_id, row_i, col_i, label FROM pix WHERE label <> 3",
             f"SELECT vec_id, band_index, value FROM gapval WHERE label <> 3 AND band_index IN ({_WHOLE}) AND band_index IN (SELECT band_index FROM gapval WHERE label <> 3 GROUP BY band_index HAVING count(value) > 0)",
             f"SELECT mineral, band_index, value FROM gaplib WHERE band_index IN ({_WHOLE})")


@query("s4_valid_bands", f"SELECT label, CAST(band_index AS INTEGER) AS band_index FROM gapval WHERE band_index IN ({_WHOLE}) GROUP BY label, band_index HAVING count(value) > 0")
def s4_bands(spark, d):
    p, m = gapped(spark, d)
    return L.valid_bands_by(m, p, ["label"], N_BANDS)


@query("s4_gapped_matched_filter", "SELECT vec_id, mineral, round(mf, 6) + 0.0 AS mf, round(infeas, 6) + 0.0 AS infeas FROM mfgap")
def s4_gapped(spark, d):
    p, m = gapped(spark, d)
    train = p.where("label <> 3")
    used = sorted(r["band_index"] for r in M.bounded_rows(L.valid_bands(m, train, N_BANDS), 5000))
    names, lib = L.library_matrix(m, "mineral")
    n, mean, m2 = B.state_of(M.bounded_rows(B.background_moments(train, [], used, N_BANDS), 1)[0])
    scored = train.withColumn("s", B.matched_filter("refl", mean, B.loaded_inverse(n, m2, 0.01), lib[:, used], used, N_BANDS))
    k = len(names)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("mineral"), F.col("s")[i].alias("mf"), F.col("s")[i + k].alias("infeas")) for i, x in enumerate(names)]))
    return rounded(scored.select("vec_id", rows.alias("x")).select("vec_id", "x.*"), "mf", "infeas")


@query("a3_weighted_moments", """WITH b AS (SELECT label, row_i // 5 AS blk, CAST(1 + (row_i // 5) % 3 AS BIGINT) AS w, refl[1] AS x, refl[2] AS y FROM pix),
 e AS (SELECT label, x, y FROM (SELECT *, unnest(range(w)) AS u FROM b))
 SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_0, round(covar_samp(x, y), 6) + 0.0 AS cov_01 FROM e GROUP BY label""")
def a3(spark, d):
    p = pix(spark, d).withColumn("blk", F.floor(F.col("row_i") / 5).cast("int"))
    per_block = B.background_moments(p, ["label", "blk"], [0, 1], N_BANDS)
    w = p.select("label", "blk").distinct().withColumn("w", F.lit(1) + F.col("blk") % 3).withColumn("member", F.lit(0))
    m = B.weighted_moments(per_block, w, ["label"], "blk", ["member"])
    return m.select("label", "n", r6(F.col("mean")[0]).alias("mean_0"), r6(F.col("m2")[1] / (F.col("n") - 1)).alias("cov_01"))


# ---- detection -----------------------------------------------------------------------------------------

FLOOR_SQL = """(SELECT mineral, count(*) AS n, quantile_cont(mf, 0.9) AS floor FROM mfall WHERE infeas < 1 AND mf > 0 GROUP BY mineral)"""


def gated(spark, d) -> DataFrame:
    m = mf_long(spark, d)
    return m.withColumn("gated", F.when(F.col("infeas") < GATE, F.col("mf")))


@query("q8_feasibility_gate", "SELECT mineral, count(*) AS n, count(CASE WHEN infeas < 1 THEN mf END) AS n_kept, round(sum(CASE WHEN infeas < 1 THEN mf END), 4) + 0.0 AS kept_sum FROM mfall GROUP BY mineral")
def q8(spark, d):
    names, df = mf_scores(spark, d, list(range(N_BANDS)))
    k = len(names)
    mf, inf = F.slice("scores", 1, k), F.slice("scores", k + 1, k)
    kept = df.select(F.posexplode(M.gate_infeasible(mf, inf, GATE)).alias("p", "v"))
    return kept.groupBy(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p") + 1).alias("mineral")).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_kept"), (F.round(F.sum("v"), 4) + F.lit(0.0)).alias("kept_sum"))


@query("a10_detection_floor", f"SELECT mineral, n, round(floor, 6) + 0.0 AS floor FROM {FLOOR_SQL}")
def a10(spark, d):
    return rounded(detect.detection_floors(gated(spark, d), ["mineral"], "gated", 0.9), "floor")


DET_SQL = f"""(SELECT m.*, f.floor, CASE WHEN m.infeas < 1 AND m.mf >= f.floor THEN m.mf / f.floor END AS strength FROM mfall m LEFT JOIN {FLOOR_SQL} f USING (mineral))"""
DOM_SQL = f"""(SELECT vec_id, row_i, col_i, label, coalesce(arg_max(mineral, strength), -1) AS code, max(strength) AS strength FROM {DET_SQL} GROUP BY vec_id, row_i, col_i, label)"""


def dominant(spark, d) -> DataFrame:
    det = detect.detections(gated(spark, d), ["mineral"], "gated", 0.9)
    return detect.dominant_rows(det, ["vec_id", "row_i", "col_i", "label"], "mineral")


@query("s5_dominant_class", f"SELECT vec_id, code, round(strength, 6) + 0.0 AS strength FROM {DOM_SQL}")
def s5(spark, d):
    return rounded(dominant(spark, d).select("vec_id", "code", "strength"), "strength")


@query("q19_opacity", f"""WITH dom AS (SELECT vec_id, strength FROM {DOM_SQL} WHERE strength IS NOT NULL), v AS (SELECT quantile_cont(strength, 0.98) AS vmax FROM dom)
 SELECT vec_id, round(0.4::DOUBLE + 0.6::DOUBLE * greatest(0, least(1, (strength - 1) / greatest(vmax - 1, 1e-9))), 6) + 0.0 AS alpha FROM dom CROSS JOIN v""")
def q19(spark, d):
    dom = dominant(spark, d).where(F.col("strength").isNotNull())
    vmax = stats.exact_quantiles(dom, [], "strength", {"vmax": 0.98}).agg(F.coalesce(F.max("vmax"), F.lit(2.0)).alias("vmax"))
    return dom.join(F.broadcast(vmax)).select("vec_id", r6(detect.opacity(F.col("strength"), F.col("vmax"))).alias("alpha"))


TIER_MINERALS = {0: "jarosite", 1: "goethite", 2: "hematite", 3: "gypsum"}
TIER_SQL = f"""(SELECT vec_id, CASE WHEN bool_or(mineral = 0 AND strength IS NOT NULL) THEN 3 WHEN bool_or(mineral IN (1, 2) AND strength IS NOT NULL) THEN 2
 WHEN bool_or(mineral = 3 AND strength IS NOT NULL) THEN 1 ELSE 0 END AS tier FROM {DET_SQL} GROUP BY vec_id)"""


def tiers(spark, d) -> DataFrame:
    det = detect.detections(gated(spark, d), ["mineral"], "gated", 0.9)
    name = F.element_at(F.create_map(*[F.lit(v) for kv in TIER_MINERALS.items() for v in kv]), F.col("mineral"))
    named = det.withColumn("layer", name)
    return detect.ordinal_tier(named, ["vec_id"], "layer", (F.col("layer") == "jarosite") & F.col("mf").isNotNull())


@query("s6_ordinal_tier", f"SELECT vec_id, tier FROM {TIER_SQL}")
def s6(spark, d):
    return tiers(spark, d)


@query("a22_tier_counts", f"""SELECT CAST(c AS INTEGER) AS code, count(tier) AS n, (SELECT count(*) FROM {TIER_SQL}) AS n_total,
 round(count(tier) / (SELECT count(*) FROM {TIER_SQL})::DOUBLE, 6) + 0.0 AS fraction FROM range(4) t(c) LEFT JOIN {TIER_SQL} s ON s.tier = c GROUP BY c""")
def a22_tiers(spark, d):
    return rounded(detect.counts_for(tiers(spark, d), [], "tier", [0, 1, 2, 3]), "fraction")


@query("w5_representative_spectra", """WITH f AS (SELECT mineral, quantile_cont(mf, 0.98) AS fl FROM mfall WHERE infeas < 1 AND mf > 0 GROUP BY mineral),
 t AS (SELECT mineral, vec_id FROM (SELECT m.mineral, m.vec_id, row_number() OVER (PARTITION BY m.mineral ORDER BY m.mf DESC, m.row_i, m.col_i) AS rn
   FROM mfall m JOIN f USING (mineral) WHERE m.infeas < 1 AND m.mf >= f.fl) WHERE rn <= 20)
 SELECT t.mineral, CAST(v.band_index AS INTEGER) AS band_index, round(avg(v.value), 6) + 0.0 AS value FROM t JOIN band_values v USING (vec_id) GROUP BY t.mineral, v.band_index""")
def w5(spark, d):
    top = detect.strongest(gated(spark, d), ["mineral"], "gated", 0.98, 20, ["row_i", "col_i"])
    spectra = top.select("mineral", "vec_id").join(pix(spark, d).select("vec_id", "refl"), "vec_id")
    return rounded(L.mean_spectrum(spectra, ["mineral"]), "value")
