"""Queries on ensembles, paired sensors, strict scoring, concordance and decisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import spectral as S
from ..operators import blocks as K, crossfit as C, detect, ensemble as E, library as L, moments as B, packets, resample as R, sensors as P, stats
from ..operators.inference import governed_interval, null_summary
from ..operators.mask import bounded_rows
from ..session import cut
from .blocked import HALO, KEYS, PERMS, SIDE, block_table, grids, intervals, samples, training
from .registry import N_BANDS, VIEWS, ev, lay, library, pix, query, r6, rounded, table
from .spectra import SRF_SQL, response_matrix

# ---- member maps: five members of two minerals over the score raster --------------------------------

VIEWS["mem"] = """SELECT e.site, e.row_i, e.col_i, printf('r%04d_c%04d', e.row_i // 20, e.col_i // 20) AS block_id, m.m AS member, x.mineral, e.code,
 CASE WHEN x.mineral = 0 THEN e.score + m.m * ((e.user_id % 7) - 3) ELSE e.score2 * 1.5 + m.m * ((e.k % 5) - 2) END AS score, (e.event_id % 13) / 10.0::DOUBLE + m.m * 0.05::DOUBLE AS infeas
 FROM ev e JOIN shape s ON s.site = e.site CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS m) m CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS mineral) x WHERE e.row_i // 20 < s.n_rows // 20 AND e.col_i // 20 < s.n_cols // 20"""
VIEWS["memd"] = "SELECT *, score IS NOT NULL AS valid, coalesce(score >= 60 AND infeas < 1, false) AS detected FROM mem"
VIEWS["memfreq"] = """SELECT *, CASE WHEN frequency IS NULL THEN 'nodata' WHEN frequency <= 0.2 THEN 'stable_negative' WHEN frequency >= 0.8 THEN 'stable_positive' ELSE 'sensitive' END AS confidence FROM
 (SELECT site, row_i, col_i, block_id, mineral, max(code) AS code, count(*) FILTER (WHERE valid AND detected) AS n_detected, count(*) FILTER (WHERE valid) AS n_valid,
 count(*) FILTER (WHERE valid AND detected) / nullif(count(*) FILTER (WHERE valid), 0)::DOUBLE AS frequency, bool_or(member = 0 AND detected) AS base FROM memd GROUP BY site, row_i, col_i, block_id, mineral)"""


def members(spark, d) -> DataFrame:
    e = K.in_complete_blocks(ev(spark, d), grids(spark, d), ["site"], SIDE)
    e = e.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("mineral", F.explode(F.array(F.lit(0), F.lit(1))))
    m = F.col("member")
    score = F.when(F.col("mineral") == 0, F.col("score") + m * (F.col("user_id") % 7 - 3)).otherwise(F.col("score2") * 1.5 + m * (F.col("k") % 5 - 2))
    e = e.withColumn("infeas", F.col("event_id") % 13 / 10.0 + m * F.lit(0.05)).withColumn("score", score)
    return e.select("site", "row_i", "col_i", "block_id", "member", "mineral", "code", "score", "infeas", F.col("score").isNotNull().alias("valid"),
                    F.coalesce((F.col("score") >= 60) & (F.col("infeas") < 1), F.lit(False)).alias("detected"))


PIXEL = ["site", "row_i", "col_i", "block_id", "mineral"]


@query("a34_member_frequency", "SELECT site, row_i, col_i, block_id, mineral, n_detected, n_valid, round(frequency, 6) + 0.0 AS frequency FROM memfreq")
def a34(spark, d):
    return rounded(E.member_frequency(members(spark, d), PIXEL).drop("confidence"), "frequency")


@query("a35_confidence_class", "SELECT site, mineral, confidence, count(*) AS n FROM memfreq GROUP BY site, mineral, confidence")
def a35(spark, d):
    return E.member_frequency(members(spark, d), PIXEL).groupBy("site", "mineral", "confidence").agg(F.count(F.lit(1)).alias("n"))


VIEWS["memdom"] = """SELECT site, row_i, col_i, member, CASE WHEN bool_or(NOT valid) THEN -2 ELSE coalesce(arg_max(mineral, score / 60 - mineral * 1e-12) FILTER (WHERE detected), -1) END AS code FROM memd GROUP BY site, row_i, col_i, member"""


def member_classes(spark, d) -> DataFrame:
    m = members(spark, d).withColumn("strength", F.when(F.col("detected"), F.col("score") / 60.0))
    return detect.dominant_rows(m, ["site", "row_i", "col_i", "member"], "mineral", nodata=~F.col("valid"))


@query("a36_dominant_summary", """WITH h AS (SELECT site, row_i, col_i, code, count(*) AS c FROM memdom WHERE member > 0 AND code >= -1 GROUP BY ALL), b AS (SELECT site, row_i, col_i, max(code) FILTER (WHERE member = 0) AS base FROM memdom GROUP BY ALL),
 t AS (SELECT site, row_i, col_i, sum(c) AS n, max(c) AS top, arg_min(code, -c * 10 + code) AS modal, -sum(c / tot * ln(c / tot)) / ln(3) AS entropy FROM (SELECT *, (sum(c) OVER (PARTITION BY site, row_i, col_i))::DOUBLE AS tot FROM h) GROUP BY ALL)
 SELECT b.site, b.row_i, b.col_i, coalesce(t.modal, -2) AS modal_class, round(top / n::DOUBLE, 6) + 0.0 AS modal_frequency, round(abs(entropy), 6) + 0.0 AS entropy,
 round(CASE WHEN base >= -1 AND n > 0 THEN (n - coalesce(s.c, 0)) / n::DOUBLE END, 6) + 0.0 AS switch_frequency, CAST(coalesce(n, 0) AS BIGINT) AS n_valid
 FROM b LEFT JOIN t ON t.site = b.site AND t.row_i = b.row_i AND t.col_i = b.col_i LEFT JOIN h s ON s.site = b.site AND s.row_i = b.row_i AND s.col_i = b.col_i AND s.code = b.base""")
def a36(spark, d):
    s = E.dominant_summary(member_classes(spark, d), ["site", "row_i", "col_i"], 2, F.col("member") == 0)
    return rounded(s.withColumn("entropy", F.abs("entropy")), "modal_frequency", "entropy", "switch_frequency")


def frequency_with_base(spark, d) -> DataFrame:
    m = members(spark, d)
    base = m.groupBy(*PIXEL).agg(F.bool_or((F.col("member") == 0) & F.col("detected")).alias("base"), F.max("code").alias("code"))
    return E.member_frequency(m, PIXEL).join(base, PIXEL)


@query("a37_area_fractions", """SELECT site, mineral, block_id, count(*) FILTER (WHERE n_valid > 0) AS n_valid_pixels, count(*) FILTER (WHERE n_valid > 0 AND confidence = 'stable_positive') AS n_stable_positive, count(*) FILTER (WHERE n_valid > 0 AND confidence = 'stable_negative') AS n_stable_negative,
 count(*) FILTER (WHERE n_valid > 0 AND base) AS n_core, count(*) FILTER (WHERE n_valid > 0 AND base AND confidence = 'stable_positive') AS n_core_retained FROM memfreq GROUP BY site, mineral, block_id""")
def a37(spark, d):
    return E.area_fractions(frequency_with_base(spark, d), ["site", "mineral", "block_id"], F.col("base"))


VIEWS["memblk"] = """SELECT m.site, m.mineral, m.member, m.block_id, count(*) FILTER (WHERE m.valid) AS n_valid, count(*) FILTER (WHERE b.valid) AS n_base, count(*) FILTER (WHERE m.valid AND b.valid) AS n_joint, count(*) FILTER (WHERE m.valid AND m.detected) AS n_detected,
 count(*) FILTER (WHERE m.valid AND b.valid AND m.detected <> b.detected) AS n_switched FROM memd m JOIN memd b ON b.member = 0 AND b.site = m.site AND b.row_i = m.row_i AND b.col_i = m.col_i AND b.mineral = m.mineral GROUP BY m.site, m.mineral, m.member, m.block_id"""
VIEWS["memrho"] = """SELECT site, mineral, member, block_id, corr(ra, rb) AS rho FROM (SELECT m.site, m.mineral, m.member, m.block_id, rank() OVER (PARTITION BY m.site, m.mineral, m.member, m.block_id ORDER BY m.score) + (count(*) OVER (PARTITION BY m.site, m.mineral, m.member, m.block_id, m.score) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY m.site, m.mineral, m.member, m.block_id ORDER BY b.score) + (count(*) OVER (PARTITION BY m.site, m.mineral, m.member, m.block_id, b.score) - 1) / 2.0::DOUBLE AS rb
 FROM memd m JOIN memd b ON b.member = 0 AND b.site = m.site AND b.row_i = m.row_i AND b.col_i = m.col_i AND b.mineral = m.mineral WHERE m.valid AND b.valid) GROUP BY site, mineral, member, block_id"""


def block_metrics(spark, d) -> DataFrame:
    m = members(spark, d)
    base = m.where("member = 0").select("site", "row_i", "col_i", "mineral", F.col("score").alias("score0"), F.col("valid").alias("valid0"), F.col("detected").alias("detected0"))
    return E.member_block_metrics(m, base, ["site", "row_i", "col_i", "mineral"], ["site", "mineral", "member"])


@query("a38_member_block_metrics", """SELECT b.site, b.mineral, b.member, b.block_id, n_valid, n_base, n_joint, n_detected, n_switched, round(1 - n_joint / nullif(n_base, 0)::DOUBLE, 6) + 0.0 AS support_loss, round(n_detected / nullif(n_valid, 0)::DOUBLE, 6) + 0.0 AS prevalence,
 round(rho, 6) + 0.0 AS rank_correlation, round(n_switched / nullif(n_joint, 0)::DOUBLE, 6) + 0.0 AS switch_fraction FROM memblk b LEFT JOIN memrho r USING (site, mineral, member, block_id)""")
def a38(spark, d):
    return rounded(block_metrics(spark, d), "support_loss", "prevalence", "rank_correlation", "switch_fraction")


VIEWS["mdraw"] = """SELECT d.site, d.rep, i.block_id, count(*) AS w FROM (SELECT site, r.rep, ('0x' || substr(md5(concat_ws(':', '9', r.rep, idx)), 1, 8))::BIGINT % nb AS didx FROM midx CROSS JOIN range(100) r(rep)) d JOIN midx i ON i.site = d.site AND i.idx = d.didx GROUP BY d.site, d.rep, i.block_id"""
VIEWS["midx"] = "SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site) AS nb FROM (SELECT DISTINCT site, block_id FROM mem)"
VIEWS["mdraw"] = VIEWS.pop("mdraw")
NESTED = 100


@query("x21_nested_ratio", """WITH v AS (SELECT b.site, b.mineral, w.rep, b.member, sum(b.n_detected * w.w) / nullif(sum(b.n_valid * w.w), 0)::DOUBLE AS value FROM memblk b JOIN mdraw w ON w.site = b.site AND w.block_id = b.block_id GROUP BY b.site, b.mineral, w.rep, b.member),
 s AS (SELECT site, mineral, rep, quantile_cont(value, 0.5) AS summary FROM v GROUP BY site, mineral, rep)
 SELECT site, mineral, (SELECT count(DISTINCT block_id) FROM mem m WHERE m.site = s.site) AS n_blocks, count(summary) AS valid_replicates, round(quantile_cont(summary, 0.025), 6) + 0.0 AS lower, round(quantile_cont(summary, 0.975), 6) + 0.0 AS upper FROM s GROUP BY site, mineral""")
def x21(spark, d):
    c = block_metrics(spark, d).select("site", "mineral", "member", "block_id", F.col("n_detected").alias("num"), F.col("n_valid").alias("den"))
    v = E.nested_ratio(c, ["site", "mineral"], NESTED, 9)
    return rounded(E.nested_interval(v, ["site", "mineral"], NESTED).drop("reason"), "lower", "upper")


_BLOCK_VALUES = """SELECT site, mineral, member, block_id, unnest(['support_loss', 'prevalence', 'rank_correlation', 'switch_fraction']) AS metric,
 unnest([1 - n_joint / nullif(n_base, 0)::DOUBLE, n_detected / nullif(n_valid, 0)::DOUBLE, rho, n_switched / nullif(n_joint, 0)::DOUBLE]) AS value FROM memblk b LEFT JOIN memrho r USING (site, mineral, member, block_id)"""


@query("x21_nested_mean", f"""WITH b AS ({_BLOCK_VALUES}), v AS (SELECT b.site, b.mineral, b.metric, w.rep, b.member, sum(b.value * w.w) / nullif(sum(w.w) FILTER (WHERE b.value IS NOT NULL), 0)::DOUBLE AS value FROM b JOIN mdraw w ON w.site = b.site AND w.block_id = b.block_id GROUP BY ALL),
 s AS (SELECT site, mineral, metric, rep, quantile_cont(value, 0.5) AS summary FROM v GROUP BY ALL)
 SELECT site, mineral, metric, (SELECT count(DISTINCT block_id) FROM mem m WHERE m.site = s.site) AS n_blocks, count(summary) AS valid_replicates, round(quantile_cont(summary, 0.025), 6) + 0.0 AS lower, round(quantile_cont(summary, 0.975), 6) + 0.0 AS upper FROM s GROUP BY site, mineral, metric""")
def x21_mean(spark, d):
    names = ["support_loss", "prevalence", "rank_correlation", "switch_fraction"]
    b = block_metrics(spark, d).unpivot(["site", "mineral", "member", "block_id"], names, "metric", "value")
    keys = ["site", "mineral", "metric"]
    return rounded(E.nested_interval(E.nested_mean(b, keys, NESTED, 9), keys, NESTED).drop("reason"), "lower", "upper")


@query("x21_nested_spearman", """WITH x AS (SELECT m.site, m.mineral, m.member, w.rep, m.score, b.score AS score0, unnest(range(w.w)) AS u FROM memd m JOIN memd b ON b.member = 0 AND b.site = m.site AND b.row_i = m.row_i AND b.col_i = m.col_i AND b.mineral = m.mineral
  JOIN mdraw w ON w.site = m.site AND w.block_id = m.block_id WHERE m.valid AND b.valid AND w.rep < 10 AND m.mineral = 0)
 SELECT site, member, rep, round(corr(ra, rb), 6) + 0.0 AS value FROM (SELECT site, member, rep, rank() OVER (PARTITION BY site, member, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, member, rep, score) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY site, member, rep ORDER BY score0) + (count(*) OVER (PARTITION BY site, member, rep, score0) - 1) / 2.0::DOUBLE AS rb FROM x) GROUP BY site, member, rep""")
def x21_spearman(spark, d):
    m = members(spark, d).where("mineral = 0")
    base = m.where("member = 0").select("site", "row_i", "col_i", F.col("score").alias("score0"))
    v = E.nested_spearman(m.join(base, ["site", "row_i", "col_i"]), ["site"], "score", "score0", 10, 9)
    return rounded(v.select("site", "member", F.col("rep").cast("bigint").alias("rep"), "value"), "value")


VIEWS["calrow"] = """SELECT site, mineral, block_id, frequency AS f, CASE WHEN code NOT IN (0,14,45,46,47,48,49,50) THEN CASE WHEN code = 3 THEN 1 ELSE 0 END END AS ref, least(9, CAST(floor(frequency * 10.0::DOUBLE) AS INTEGER)) AS bin FROM memfreq WHERE frequency IS NOT NULL AND code IS NOT NULL AND code <> 14"""


@query("a39_calibration", """WITH s AS (SELECT site, mineral, block_id, bin, count(*) AS n, sum(ref) AS obs, sum(f) AS pred, sum((f - ref) * (f - ref)) AS err FROM calrow GROUP BY ALL),
 i AS (SELECT site, mineral, block_id, row_number() OVER (PARTITION BY site, mineral ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site, mineral) AS nb FROM (SELECT DISTINCT site, mineral, block_id FROM calrow)),
 w AS (SELECT d.site, d.mineral, d.rep, i.block_id, count(*) AS w FROM (SELECT site, mineral, r.rep, ('0x' || substr(md5(concat_ws(':', '13', r.rep, idx)), 1, 8))::BIGINT % nb AS didx FROM i CROSS JOIN range(100) r(rep)) d JOIN i ON i.site = d.site AND i.mineral = d.mineral AND i.idx = d.didx GROUP BY ALL),
 b AS (SELECT s.site, s.mineral, w.rep, s.bin, sum(s.n * w.w) AS n, sum(s.obs * w.w) AS obs, sum(s.pred * w.w) AS pred, sum(s.err * w.w) AS err FROM s JOIN w ON w.site = s.site AND w.mineral = s.mineral AND w.block_id = s.block_id GROUP BY ALL),
 bt AS (SELECT site, mineral, rep, sum(err) / sum(n)::DOUBLE AS brier, sum(n * abs(obs / n::DOUBLE - pred / n::DOUBLE)) / sum(n)::DOUBLE AS ece FROM b GROUP BY ALL),
 p AS (SELECT site, mineral, bin, sum(n) AS n, sum(obs) / sum(n)::DOUBLE AS rate, count(*) AS support_blocks, sum(err) AS err, sum(pred) / sum(n)::DOUBLE AS mf FROM s GROUP BY ALL),
 t AS (SELECT site, mineral, sum(err) / sum(n)::DOUBLE AS brier, sum(n * abs(rate - mf)) / sum(n)::DOUBLE AS ece FROM p GROUP BY ALL),
 q AS (SELECT site, mineral, bin, CASE WHEN count(*) >= 95 THEN quantile_cont(obs / n::DOUBLE, 0.025) END AS lo, CASE WHEN count(*) >= 95 THEN quantile_cont(obs / n::DOUBLE, 0.975) END AS hi FROM b GROUP BY ALL),
 r AS (SELECT site, mineral, quantile_cont(brier, 0.025) AS bl, quantile_cont(brier, 0.975) AS bu, quantile_cont(ece, 0.025) AS el, quantile_cont(ece, 0.975) AS eu FROM bt GROUP BY ALL)
 SELECT t.site, t.mineral, CAST(g.bin AS INTEGER) AS bin, CAST(coalesce(p.n, 0) AS BIGINT) AS support_pixels, coalesce(p.support_blocks, 0) AS support_blocks, round(p.rate, 6) + 0.0 AS rate, round(q.lo, 6) + 0.0 AS rate_lower, round(q.hi, 6) + 0.0 AS rate_upper,
 round(t.brier, 6) + 0.0 AS brier, round(t.ece, 6) + 0.0 AS ece, round(bl, 6) + 0.0 AS brier_lower, round(bu, 6) + 0.0 AS brier_upper, round(el, 6) + 0.0 AS ece_lower, round(eu, 6) + 0.0 AS ece_upper, CASE WHEN p.n IS NULL THEN 'empty_fixed_bin' ELSE 'complete' END AS status
 FROM t CROSS JOIN range(10) g(bin) LEFT JOIN p ON p.site = t.site AND p.mineral = t.mineral AND p.bin = g.bin LEFT JOIN q ON q.site = t.site AND q.mineral = t.mineral AND q.bin = g.bin JOIN r ON r.site = t.site AND r.mineral = t.mineral""")
def a39(spark, d):
    f = frequency_with_base(spark, d)
    from ..operators.mask import in_domain

    f = f.withColumn("ref", F.when(in_domain("code"), (F.col("code") == 3).cast("int")))
    out = E.calibration_table(f, ["site", "mineral"], "frequency", "ref", NESTED, 13)
    return rounded(out, "rate", "rate_lower", "rate_upper", "brier", "ece", "brier_lower", "brier_upper", "ece_lower", "ece_upper")


@query("s7_calibrated_detection", """WITH c AS (SELECT m.site, w.rep, m.score, w.w FROM memd m JOIN mdraw w ON w.site = m.site AND w.block_id = m.block_id WHERE m.member = 0 AND m.mineral = 0 AND m.score > 0 AND m.infeas < 1),
 t AS (SELECT site, rep, quantile_cont(score, 0.9) AS threshold FROM (SELECT site, rep, score, unnest(range(w)) AS u FROM c) GROUP BY site, rep), n AS (SELECT site, rep, CAST(sum(w) AS BIGINT) AS n_calibration FROM c GROUP BY site, rep)
 SELECT e.site, e.rep, coalesce(n_calibration, 0) AS n_calibration, round(threshold, 6) + 0.0 AS threshold, CASE WHEN n_calibration IS NULL THEN 'no_positive_calibration_scores' END AS reason,
 (SELECT count(*) FROM memd m WHERE m.site = e.site AND m.member = 0 AND m.mineral = 0 AND m.infeas < 1 AND m.score >= t.threshold) AS n_detected FROM (SELECT DISTINCT site, rep FROM mdraw) e LEFT JOIN t USING (site, rep) LEFT JOIN n USING (site, rep)""")
def s7(spark, d):
    from ..functions.draws import block_weights

    m = members(spark, d).where("member = 0 AND mineral = 0").select("site", "block_id", "score", "infeas")
    w = block_weights(cut(m.select("site", "block_id").distinct()), ["site"], NESTED, 9)
    t = detect.calibrated_detection(m, w, ["site"], 0.9, 1.0)
    return rounded(t.select("site", F.col("rep").cast("bigint").alias("rep"), "n_calibration", "threshold", "reason", "n_detected"), "threshold")


@query("x23_balanced_schedule", """WITH l AS (SELECT label AS mineral, vec_id AS sample, ('0x' || substr(md5(concat_ws(':', '42', label, vec_id)), 1, 8))::BIGINT AS lot, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 x AS (SELECT mineral, sample, -1 AS copy FROM (SELECT *, row_number() OVER (PARTITION BY mineral ORDER BY lot, sample) AS rk FROM l) WHERE rk <= 120 % n UNION ALL SELECT mineral, sample, unnest(range(1, 120 // n + 1)) AS copy FROM l)
 SELECT CAST(row_number() OVER (PARTITION BY mineral ORDER BY ('0x' || substr(md5(concat_ws(':', '42', 'o', mineral, sample, copy)), 1, 8))::BIGINT, sample, copy) - 1 AS INTEGER) AS replicate, mineral, sample FROM x""")
def x23(spark, d):
    return E.balanced_schedule(library(spark, d), 120, 42)


_GRID = "(SELECT unnest([0.001, 0.01, 0.1]) AS ridge) r CROSS JOIN (SELECT unnest([0.85, 0.90, 0.95]) AS quantile) q CROSS JOIN (SELECT unnest([1.0, NULL]) AS gate) g"
VIEWS["design"] = f"""SELECT site, 'baseline' AS member_class, NULL AS replicate, 0.01::DOUBLE AS ridge, 0.9::DOUBLE AS quantile, 1.0::DOUBLE AS gate, 0 AS cov, 0 AS em FROM shape
 UNION ALL SELECT site, unnest(['endmember_only', 'covariance_only', 'calibration_only']), rep, 0.01, 0.9, 1.0, unnest([0, 1, 0]), unnest([1, 0, 0]) FROM shape CROSS JOIN range(16) t(rep)
 UNION ALL SELECT site, 'analytical_grid', NULL, ridge, quantile, gate, 0, 0 FROM shape CROSS JOIN {_GRID}
 UNION ALL SELECT site, 'joint', rep, ridge, quantile, gate, 1, 1 FROM shape CROSS JOIN range(16) t(rep) CROSS JOIN {_GRID}"""


@query("x24_design", """SELECT d.site, d.member_class, d.n_members, f.n_fits FROM (SELECT site, member_class, count(*) AS n_members FROM design GROUP BY site, member_class) d
 JOIN (SELECT site, count(DISTINCT CASE WHEN cov + em = 0 THEN 'full' || ridge ELSE cov || '-' || em || '-' || replicate || '-' || ridge END) AS n_fits FROM design GROUP BY site) f USING (site)""")
def x24(spark, d):
    g = E.build_design(grids(spark, d))
    fits = g.groupBy("site").agg(F.countDistinct("fit_id").alias("n_fits"))
    return g.groupBy("site", "member_class").agg(F.count("member_id").alias("n_members")).join(fits, "site")


@query("j23_factor_contrasts", """WITH v AS (SELECT d.site, b.block_id, CAST(coalesce(d.replicate, -1) AS INTEGER) AS replicate, d.ridge, d.quantile, coalesce(d.gate, 0) AS gate, b.m * d.quantile + 10 * d.ridge + coalesce(d.gate, 3) * b.s + coalesce(d.replicate, 0) AS value
  FROM design d JOIN (SELECT site, block_id, avg(score) AS m, stddev_samp(score) / 100 AS s FROM obs WHERE layer = 'alpha' GROUP BY site, block_id) b ON b.site = d.site WHERE d.member_class IN ('joint', 'analytical_grid')),
 c AS (SELECT 'ridge' AS factor, a.*, b.value AS rv FROM v a JOIN v b ON b.site = a.site AND b.block_id = a.block_id AND b.replicate = a.replicate AND b.quantile = a.quantile AND b.gate = a.gate AND b.ridge = 0.01 AND a.ridge <> 0.01
  UNION ALL SELECT 'quantile', a.*, b.value FROM v a JOIN v b ON b.site = a.site AND b.block_id = a.block_id AND b.replicate = a.replicate AND b.ridge = a.ridge AND b.gate = a.gate AND b.quantile = 0.9 AND a.quantile <> 0.9
  UNION ALL SELECT 'gate', a.*, b.value FROM v a JOIN v b ON b.site = a.site AND b.block_id = a.block_id AND b.replicate = a.replicate AND b.ridge = a.ridge AND b.quantile = a.quantile AND b.gate = 1 AND a.gate <> 1)
 SELECT site, factor, replicate, count(*) AS n, round(avg(value - rv), 6) + 0.0 AS mean_effect FROM c GROUP BY site, factor, replicate""")
def j23(spark, d):
    s = samples(spark, d).where("layer = 'alpha' AND score IS NOT NULL AND ref IS NOT NULL").groupBy("site", "block_id").agg(F.avg("score").alias("m"), (F.stddev_samp("score") / 100).alias("s"))
    g = E.build_design(grids(spark, d)).where(F.col("member_class").isin("joint", "analytical_grid"))
    gate = F.coalesce("gate", F.lit(3.0))
    v = g.join(s, "site").select("site", "block_id", F.coalesce("replicate", F.lit(-1)).alias("replicate"), "ridge", "quantile", F.coalesce("gate", F.lit(0.0)).alias("gate"),
                                 (F.col("m") * F.col("quantile") + F.col("ridge") * 10 + gate * F.col("s") + F.coalesce("replicate", F.lit(0))).alias("value"))
    c = E.factor_contrasts(v, ["site", "block_id", "replicate"], {"ridge": 0.01, "quantile": 0.9, "gate": 1.0})
    return c.groupBy("site", "factor", "replicate").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("effect")).alias("mean_effect"))


# ---- paired sensors -------------------------------------------------------------------------------------

VIEWS["sens"] = """SELECT site, block_id, row_i, col_i, score AS na, s2 AS nk, score * 0.9 + (k % 17) AS da, s2 + (u % 5) * 3 AS dk, CASE WHEN code NOT IN (0,14,45,46,47,48,49,50) THEN CASE WHEN code = 3 THEN 1 ELSE 0 END END AS ref
 FROM (SELECT e.site, printf('r%04d_c%04d', e.row_i // 20, e.col_i // 20) AS block_id, e.row_i, e.col_i, e.score, e.score2 AS s2, e.k, e.user_id AS u, e.code FROM ev e JOIN shape s ON s.site = e.site WHERE e.row_i // 20 < s.n_rows // 20 AND e.col_i // 20 < s.n_cols // 20)"""
VIEWS["sensobs"] = """SELECT site, block_id, ref, unnest(['native', 'degraded']) AS branch, unnest([na, da]) AS score FROM sens WHERE na IS NOT NULL AND da IS NOT NULL AND ref IS NOT NULL"""


def sensor_rows(spark, d) -> DataFrame:
    from ..operators.mask import in_domain

    e = K.in_complete_blocks(ev(spark, d), grids(spark, d), ["site"], SIDE)
    return e.select(
        "site", "block_id", "row_i", "col_i", F.col("score").alias("na"), F.col("score2").alias("nk"), (F.col("score") * 0.9 + F.col("k") % 17).alias("da"),
        (F.col("score2") + (F.col("user_id") % 5) * 3).alias("dk"), F.when(in_domain("code"), (F.col("code") == 3).cast("int")).alias("ref"))


def _fold_sql(src: str, k: str) -> str:
    """Cross-fit of rows (site, block_id, score, ref, {k}) as CTE text ending in view fold_oof."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ["site", *k.split(", ")])
    q = lambda a: ", ".join(f"{a}.{c}" for c in ["site", *k.split(", ")])
    return f"""fc AS (SELECT site, {k}, block_id, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM {src} GROUP BY ALL),
 fb AS (SELECT site, {k}, block_id, sum(pos) AS bp, sum(neg) AS bn FROM fc GROUP BY ALL),
 fn AS (SELECT {q('fb')}, t.fold, count(*) FILTER (WHERE bp > 0) AS np, count(*) FILTER (WHERE bn > 0) AS nn FROM train t JOIN fb ON t.site = fb.site AND t.block_id = fb.block_id GROUP BY ALL),
 fs AS (SELECT {q('fc')}, t.fold, fc.score, sum(CASE WHEN fc.pos > 0 THEN fc.pos / fb.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN fc.neg > 0 THEN fc.neg / fb.bn::DOUBLE ELSE 0 END) AS wn FROM train t JOIN fc ON t.site = fc.site AND t.block_id = fc.block_id JOIN fb ON {on('fb', 'fc')} AND fb.block_id = fc.block_id GROUP BY ALL),
 fj AS (SELECT fs.*, round(sum(wp) OVER w / np - sum(wn) OVER w / nn, 12) AS j FROM fs JOIN fn ON {on('fn', 'fs')} AND fn.fold = fs.fold WHERE np > 0 AND nn > 0 WINDOW w AS (PARTITION BY {q('fs')}, fs.fold ORDER BY fs.score DESC)),
 ft AS (SELECT site, {k}, fold, max(score) AS threshold FROM (SELECT *, max(j) OVER (PARTITION BY site, {k}, fold) AS mj FROM fj) WHERE j = mj GROUP BY ALL),
 fold_oof AS (SELECT s.*, t.threshold, CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END AS pred FROM {src} s JOIN ft t ON {on('t', 's')} AND t.fold = s.block_id)"""


_BRANCH_METRICS = """bm AS (SELECT site, branch, count(*) AS n, count(*) FILTER (WHERE pred = 1 AND ref = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND ref = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND ref = 0) AS tn, count(*) FILTER (WHERE pred = 0 AND ref = 1) AS fn FROM fold_oof GROUP BY site, branch),
 ba AS (SELECT site, branch, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc FROM (SELECT *, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY site, branch) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY site, branch) AS nn,
  rank() OVER (PARTITION BY site, branch ORDER BY score) + (count(*) OVER (PARTITION BY site, branch, score) - 1) / 2.0::DOUBLE AS rk FROM fold_oof) GROUP BY site, branch, np, nn)"""
_BRANCH_SELECT = "SELECT m.site, m.branch, n, tp, fp, tn, fn, round(auc, 6) + 0.0 AS auc, round(0.5 * (tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE), 6) + 0.0 AS balanced_accuracy FROM bm m JOIN ba a ON a.site = m.site AND a.branch = m.branch"


def branch_metrics(oof: DataFrame) -> DataFrame:
    from ..operators.agree import pooled_metrics

    m = pooled_metrics(oof, ["site", "branch"])
    return rounded(m.select("site", "branch", (F.col("n_pos") + F.col("n_neg")).alias("n"), "tp", "fp", "tn", "fn", "auc", "balanced_accuracy"), "auc", "balanced_accuracy")


ENSEMBLE_REPS = 100
VIEWS["ensobs"] = "SELECT site, block_id, ref, m.member, na + m.member * ((row_i * 7 + col_i * 3) % 11) / 2.0::DOUBLE AS score FROM sens CROSS JOIN range(4) m(member) WHERE na IS NOT NULL AND ref IS NOT NULL"


@query("x21_nested_external", f"""WITH {_fold_sql('ensobs', 'member')},
 i AS (SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site) AS nb FROM (SELECT DISTINCT site, block_id FROM ensobs)),
 w AS (SELECT d.site, d.rep, i.block_id, count(*) AS w FROM (SELECT site, r.rep, ('0x' || substr(md5(concat_ws(':', '41', r.rep, idx)), 1, 8))::BIGINT % nb AS didx FROM i CROSS JOIN range({ENSEMBLE_REPS}) r(rep)) d JOIN i ON i.site = d.site AND i.idx = d.didx GROUP BY ALL
  UNION ALL SELECT site, -1, block_id, 1 FROM i),
 k AS (SELECT site, member, block_id, count(*) FILTER (WHERE pred = 1 AND ref = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND ref = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND ref = 0) AS tn, count(*) FILTER (WHERE pred = 0 AND ref = 1) AS fn FROM fold_oof GROUP BY ALL),
 u AS (SELECT p.site, p.member, p.block_id AS pb, n.block_id AS qb, sum(p.pos * n.neg * CASE WHEN n.score < p.score THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS u FROM fc p JOIN fc n ON n.site = p.site AND n.member = p.member AND p.pos > 0 AND n.neg > 0 AND n.score <= p.score GROUP BY ALL),
 c AS (SELECT w.site, k.member, w.rep, sum(w * tp)::BIGINT AS tp, sum(w * fp)::BIGINT AS fp, sum(w * tn)::BIGINT AS tn, sum(w * fn)::BIGINT AS fn FROM w JOIN k USING (site, block_id) GROUP BY ALL),
 g AS (SELECT w.site, b.member, w.rep, sum(w * bp)::BIGINT AS np, sum(w * bn)::BIGINT AS nn FROM w JOIN fb b USING (site, block_id) GROUP BY ALL),
 q AS (SELECT u.site, u.member, a.rep, sum(a.w * b.w * u.u) AS num FROM u JOIN w a ON a.site = u.site AND a.block_id = u.pb JOIN w b ON b.site = u.site AND b.rep = a.rep AND b.block_id = u.qb GROUP BY ALL),
 m AS (SELECT site, member, rep, CASE WHEN np * nn > 0 THEN coalesce(num, 0) / (np::DOUBLE * nn) END AS auc, np / nullif(np + nn, 0)::DOUBLE AS prevalence, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
  2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS p1, 2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE AS n1 FROM g JOIN c USING (site, member, rep) LEFT JOIN q USING (site, member, rep)),
 l AS (SELECT site, member, rep, unnest(['auc', 'balanced_accuracy', 'positive_f1', 'negative_f1', 'macro_f1', 'tpr', 'fpr', 'prevalence']) AS metric, unnest([auc, 0.5::DOUBLE * (tpr + 1 - fpr), p1, n1, 0.5::DOUBLE * (p1 + n1), tpr, fpr, prevalence]) AS value FROM m),
 s AS (SELECT site, metric, rep, quantile_cont(value, 0.5) AS summary FROM l GROUP BY ALL),
 t AS (SELECT site, min(n) AS complete_blocks, min(p) AS positive_blocks, min(q) AS negative_blocks FROM (SELECT site, member, count(*) AS n, count(*) FILTER (WHERE bp > 0) AS p, count(*) FILTER (WHERE bn > 0) AS q FROM fb GROUP BY ALL) GROUP BY site)
 SELECT s.site, s.metric, round(max(summary) FILTER (WHERE rep = -1), 6) + 0.0 AS point_estimate, round(quantile_cont(summary, 0.025) FILTER (WHERE rep >= 0), 6) + 0.0 AS lower, round(quantile_cont(summary, 0.975) FILTER (WHERE rep >= 0), 6) + 0.0 AS upper, count(summary) FILTER (WHERE rep >= 0) AS valid_replicates,
 complete_blocks, positive_blocks, negative_blocks, CASE WHEN least(positive_blocks, negative_blocks) < {rules.EXPLORATORY_BLOCKS} THEN 'counts_and_maps_only' WHEN least(positive_blocks, negative_blocks) < {rules.CONFIRMATORY_BLOCKS} THEN 'exploratory_only' ELSE 'confirmatory_eligible' END AS support_tier
 FROM s JOIN t USING (site) GROUP BY s.site, s.metric, complete_blocks, positive_blocks, negative_blocks""")
def x21_external(spark, d):
    s = sensor_rows(spark, d).where("na IS NOT NULL AND ref IS NOT NULL")
    m = s.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("member"))
    m = m.select("site", "member", "block_id", "ref", (F.col("na") + F.col("member") * ((F.col("row_i") * 7 + F.col("col_i") * 3) % 11) / 2.0).alias("score"))
    oof = C.cross_fit(m, training(spark, d), ["site", "member"])
    return rounded(E.nested_external_intervals(oof, ["site"], ENSEMBLE_REPS, 41).drop("reason"), "point_estimate", "lower", "upper")


@query("x13_score_pair", f"WITH {_fold_sql('sensobs', 'branch')}, {_BRANCH_METRICS} {_BRANCH_SELECT}")
def x13(spark, d):
    return branch_metrics(P.evaluate_score_pair(sensor_rows(spark, d), training(spark, d), ["site"], "na", "da"))


VIEWS["sens4"] = "SELECT site, block_id, ref, unnest(['native', 'degraded']) AS branch, unnest([na, da]) AS a, unnest([nk, dk]) AS b FROM sens WHERE na IS NOT NULL AND nk IS NOT NULL AND da IS NOT NULL AND dk IS NOT NULL AND ref IS NOT NULL"
VIEWS["marginfit"] = """SELECT s.site, s.branch, t.fold, quantile_cont(a, 0.5) AS am, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ai, quantile_cont(b, 0.5) AS bm, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS bi FROM train t JOIN sens4 s ON s.site = t.site AND s.block_id = t.block_id GROUP BY s.site, s.branch, t.fold"""


@query("x13_margin_pair", f"""WITH tr AS (SELECT s.site, s.branch, t.fold, s.block_id, s.ref, (a - am) / ai - (b - bm) / bi AS score FROM train t JOIN sens4 s ON s.site = t.site AND s.block_id = t.block_id JOIN marginfit f ON f.site = s.site AND f.branch = s.branch AND f.fold = t.fold),
 c AS (SELECT site, branch, fold, block_id, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM tr GROUP BY ALL), b AS (SELECT site, branch, fold, block_id, sum(pos) AS bp, sum(neg) AS bn FROM c GROUP BY ALL),
 n AS (SELECT site, branch, fold, count(*) FILTER (WHERE bp > 0) AS np, count(*) FILTER (WHERE bn > 0) AS nn FROM b GROUP BY ALL),
 s AS (SELECT c.site, c.branch, c.fold, c.score, sum(CASE WHEN c.pos > 0 THEN c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN c.neg / b.bn::DOUBLE ELSE 0 END) AS wn FROM c JOIN b USING (site, branch, fold, block_id) GROUP BY ALL),
 j AS (SELECT s.*, round(sum(wp) OVER w / np - sum(wn) OVER w / nn, 12) AS j FROM s JOIN n USING (site, branch, fold) WINDOW w AS (PARTITION BY s.site, s.branch, s.fold ORDER BY s.score DESC)),
 th AS (SELECT site, branch, fold, max(score) AS threshold FROM (SELECT *, max(j) OVER (PARTITION BY site, branch, fold) AS mj FROM j) WHERE j = mj GROUP BY ALL),
 fold_oof AS (SELECT x.site, x.branch, x.block_id, x.ref, (a - am) / ai - (b - bm) / bi AS score, CASE WHEN (a - am) / ai - (b - bm) / bi >= threshold THEN 1 ELSE 0 END AS pred FROM sens4 x JOIN marginfit f ON f.site = x.site AND f.branch = x.branch AND f.fold = x.block_id JOIN th ON th.site = x.site AND th.branch = x.branch AND th.fold = x.block_id),
 {_BRANCH_METRICS} {_BRANCH_SELECT}""")
def x13_margin(spark, d):
    return branch_metrics(P.evaluate_margin_pair(sensor_rows(spark, d), training(spark, d), ["site"], {"native": ("na", "nk"), "degraded": ("da", "dk")}))


@query("a21_robust_margin", """SELECT site, fold, round(am, 6) + 0.0 AS a_med, round(ai, 6) + 0.0 AS a_iqr, round(bm, 6) + 0.0 AS b_med, round(bi, 6) + 0.0 AS b_iqr FROM marginfit WHERE branch = 'native'""")
def a21(spark, d):
    rows = sensor_rows(spark, d).where(" AND ".join(f"{c} IS NOT NULL" for c in ("na", "nk", "da", "dk", "ref")))
    return rounded(C.fold_margins(rows, training(spark, d), ["site"], "na", "nk").drop("n_scale", "reason"), "a_med", "a_iqr", "b_med", "b_iqr")


_DRAW = """i AS (SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site) AS nb FROM (SELECT DISTINCT site, block_id FROM {src})),
 w AS (SELECT d.site, d.rep, i.block_id, count(*) AS w FROM (SELECT site, r.rep, ('0x' || substr(md5(concat_ws(':', '{seed}', r.rep, idx)), 1, 8))::BIGINT % nb AS didx FROM i CROSS JOIN range({n}) r(rep)) d JOIN i ON i.site = d.site AND i.idx = d.didx GROUP BY ALL)"""


@query("x11_paired_bootstrap", f"""WITH {_fold_sql('sensobs', 'branch')}, {_DRAW.format(src='fold_oof', seed=17, n=30)},
 c AS (SELECT site, branch, block_id, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM fold_oof GROUP BY ALL),
 u AS (SELECT p.site, p.branch, p.block_id AS pb, n.block_id AS nb, sum(p.pos * n.neg * CASE WHEN n.score < p.score THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS u FROM c p JOIN c n ON n.site = p.site AND n.branch = p.branch AND p.pos > 0 AND n.neg > 0 AND n.score <= p.score GROUP BY ALL),
 num AS (SELECT u.site, u.branch, a.rep, sum(a.w * b.w * u.u) AS num FROM u JOIN w a ON a.site = u.site AND a.block_id = u.pb JOIN w b ON b.site = u.site AND b.rep = a.rep AND b.block_id = u.nb GROUP BY ALL),
 k AS (SELECT site, branch, block_id, count(*) FILTER (WHERE ref = 1) AS np, count(*) FILTER (WHERE ref = 0) AS nn, count(*) FILTER (WHERE pred = 1 AND ref = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND ref = 0) AS fp FROM fold_oof GROUP BY ALL),
 s AS (SELECT k.site, k.branch, w.rep, sum(w.w * np) AS np, sum(w.w * nn) AS nn, sum(w.w * tp) AS tp, sum(w.w * fp) AS fp FROM k JOIN w ON w.site = k.site AND w.block_id = k.block_id GROUP BY ALL),
 m AS (SELECT s.site, s.branch, s.rep, num / (np::DOUBLE * nn) AS auc, 0.5::DOUBLE * (tp / np::DOUBLE + 1 - fp / nn::DOUBLE) AS ba FROM s JOIN num ON num.site = s.site AND num.branch = s.branch AND num.rep = s.rep)
 SELECT a.site, a.rep, round(a.auc, 6) + 0.0 AS native_auc, round(b.auc, 6) + 0.0 AS degraded_auc, round(a.auc - b.auc, 6) + 0.0 AS delta_auc, round(a.ba - b.ba, 6) + 0.0 AS delta_balanced_accuracy FROM m a JOIN m b ON b.site = a.site AND b.rep = a.rep AND a.branch = 'native' AND b.branch = 'degraded'""")
def x11(spark, d):
    oof = P.evaluate_score_pair(sensor_rows(spark, d), training(spark, d), ["site"], "na", "da")
    out = P.paired_bootstrap(oof, ["site"], 30, 17)
    return rounded(out.select("site", F.col("rep").cast("bigint").alias("rep"), "native_auc", "degraded_auc", "delta_auc", "delta_balanced_accuracy"), "native_auc", "degraded_auc", "delta_auc", "delta_balanced_accuracy")


@query("x12_sensor_randomization", """WITH s AS (SELECT * FROM sens WHERE na IS NOT NULL AND da IS NOT NULL AND ref IS NOT NULL), i AS (SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx FROM (SELECT DISTINCT site, block_id FROM s)),
 c AS (SELECT site, rep, block_id, ('0x' || substr(md5(concat_ws(':', '19', rep, idx)), 1, 8))::BIGINT % 2 AS sw FROM i CROSS JOIN range(50) r(rep)),
 l AS (SELECT site, block_id, ref, 0 AS src, na AS v FROM s UNION ALL SELECT site, block_id, ref, 1, da FROM s), g AS (SELECT site, block_id, src, v, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM l GROUP BY ALL),
 u AS (SELECT p.site, p.src AS ps, p.block_id AS pb, n.src AS ns, n.block_id AS nb, sum(p.pos * n.neg * CASE WHEN n.v < p.v THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS u FROM g p JOIN g n ON n.site = p.site AND p.pos > 0 AND n.neg > 0 AND n.v <= p.v GROUP BY ALL),
 o AS (SELECT site, sum(CASE WHEN ps = 0 AND ns = 0 THEN u WHEN ps = 1 AND ns = 1 THEN -u ELSE 0 END) AS o FROM u GROUP BY site),
 d AS (SELECT u.site, a.rep, sum(CASE WHEN u.ps = a.sw AND u.ns = b.sw THEN u.u WHEN u.ps <> a.sw AND u.ns <> b.sw THEN -u.u ELSE 0 END) AS d FROM u JOIN c a ON a.site = u.site AND a.block_id = u.pb JOIN c b ON b.site = u.site AND b.rep = a.rep AND b.block_id = u.nb GROUP BY u.site, a.rep)
 SELECT d.site, round(max(o.o) / (SELECT (count(*) FILTER (WHERE ref = 1))::DOUBLE * count(*) FILTER (WHERE ref = 0) FROM s WHERE s.site = d.site), 6) + 0.0 AS observed_delta, count(*) FILTER (WHERE abs(d.d) >= abs(o.o)) AS exceedances, count(*) AS randomizations,
 round((count(*) FILTER (WHERE abs(d.d) >= abs(o.o)) + 1.0::DOUBLE) / (count(*) + 1), 6) + 0.0 AS p_value FROM d JOIN o ON o.site = d.site GROUP BY d.site""")
def x12(spark, d):
    return rounded(R.sensor_randomization(sensor_rows(spark, d), ["site"], "na", "da", 50, 19), "observed_delta", "p_value")


@query("d7_metric_rows", f"""WITH {_fold_sql('sensobs', 'branch')}, {_BRANCH_METRICS}, v AS (SELECT m.site, m.branch, auc, 0.5::DOUBLE * (tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE) AS balanced_accuracy FROM bm m JOIN ba a ON a.site = m.site AND a.branch = m.branch),
 x AS (SELECT a.site, a.auc AS na, b.auc AS da, a.balanced_accuracy AS nb, b.balanced_accuracy AS db FROM v a JOIN v b ON a.site = b.site AND a.branch = 'native' AND b.branch = 'degraded'),
 t AS (SELECT site, CASE WHEN least(p, n) < 5 THEN 'counts_and_maps_only' WHEN least(p, n) < 10 THEN 'exploratory_only' ELSE 'confirmatory_eligible' END AS tier FROM (SELECT site, count(DISTINCT block_id) FILTER (WHERE ref = 1) AS p, count(DISTINCT block_id) FILTER (WHERE ref = 0) AS n FROM sensobs GROUP BY site)),
 r AS (SELECT site, unnest(['native', 'degraded', 'delta', 'native', 'degraded', 'delta']) AS sensor, unnest(['auc', 'auc', 'auc', 'balanced_accuracy', 'balanced_accuracy', 'balanced_accuracy']) AS metric, unnest([na, da, na - da, nb, db, nb - db]) AS value FROM x)
 SELECT r.site, sensor, metric, round(CASE WHEN tier <> 'counts_and_maps_only' THEN value END, 6) + 0.0 AS value, tier AS inference_status FROM r JOIN t ON t.site = r.site""")
def d7(spark, d):
    from ..session import cut

    oof = cut(P.evaluate_score_pair(sensor_rows(spark, d), training(spark, d), ["site"], "na", "da"))
    support = K.bearing_blocks(oof.where("branch = 'native'"), ["site"])
    rows = P.metric_rows(oof, P.paired_bootstrap(oof, ["site"], 30, 17), support, ["site"], ["auc", "balanced_accuracy"], 30)
    return rounded(rows.drop("lower", "upper"), "value")


# ---- strict scoring and degraded scoring on the spectra ---------------------------------------------------

VIEWS["simpix"] = f"""SELECT b.vec_id, b.label, sum(b.value * s.w) FILTER (WHERE s.target = 2) / sum(s.w) FILTER (WHERE s.target = 2) AS s0, sum(b.value * s.w) FILTER (WHERE s.target = 9) / sum(s.w) FILTER (WHERE s.target = 9) AS s1
 FROM band_values b JOIN {SRF_SQL} s USING (band_index) GROUP BY b.vec_id, b.label"""

MF_SQL = """m AS (SELECT count(*) AS n, avg(s0) AS m0, avg(s1) AS m1, covar_samp(s0, s0) AS c00, covar_samp(s0, s1) AS c01, covar_samp(s1, s1) AS c11 FROM px),
 l AS (SELECT *, c00 + 0.01::DOUBLE * (c00 + c11) / 2 AS l00, c11 + 0.01::DOUBLE * (c00 + c11) / 2 AS l11 FROM m), v AS (SELECT m0, m1, l11 / (l00 * l11 - c01 * c01) AS i00, -c01 / (l00 * l11 - c01 * c01) AS i01, l00 / (l00 * l11 - c01 * c01) AS i11 FROM l),
 t AS (SELECT mineral, t0 - m0 AS d0, t1 - m1 AS d1, i00 * (t0 - m0) + i01 * (t1 - m1) AS w0, i01 * (t0 - m0) + i11 * (t1 - m1) AS w1 FROM tg CROSS JOIN v),
 sc AS (SELECT p.vec_id, t.mineral, t.d0 * t.w0 + t.d1 * t.w1 AS eta, ((p.s0 - m0) * t.w0 + (p.s1 - m1) * t.w1) / (t.d0 * t.w0 + t.d1 * t.w1) AS mf, (p.s0 - m0) * (i00 * (p.s0 - m0) + i01 * (p.s1 - m1)) + (p.s1 - m1) * (i01 * (p.s0 - m0) + i11 * (p.s1 - m1)) AS rx FROM px p CROSS JOIN v CROSS JOIN t)"""


@query("x14_degraded_scores", f"""WITH px AS (SELECT vec_id, s0, s1 FROM simpix), tg AS (SELECT m.label AS mineral, s.s0 AS t0, s.s1 AS t1 FROM medoid m JOIN simpix s ON s.vec_id = m.vec_id), {MF_SQL}
 SELECT vec_id, mineral, round(mf, 6) + 0.0 AS mf, round(sqrt(greatest(rx - mf * mf * eta, 0)), 6) + 0.0 AS infeas FROM sc""")
def x14(spark, d):
    w = response_matrix()[[2, 9]]
    names, lib = L.library_matrix(L.medoids(library(spark, d)), "mineral")
    coarse_lib = np.where(np.isfinite(lib), lib, 0.0) @ w.T / w.sum(axis=1)
    p = pix(spark, d).select("vec_id", S.simulate_bands("refl", w).alias("refl"))
    n, mean, m2 = B.state_of(bounded_rows(B.background_moments(p, [], [0, 1], 2), 1)[0])
    s = p.withColumn("scores", B.matched_filter("refl", mean, B.loaded_inverse(n, m2, 0.01), coarse_lib, [0, 1], 2))
    return rounded(score_rows(s, names, ["vec_id"]), "mf", "infeas")


def score_rows(df: DataFrame, names: list, ids: list[str]) -> DataFrame:
    k = len(names)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("mineral"), F.col("scores")[i].alias("mf"), F.col("scores")[i + k].alias("infeas")) for i, m in enumerate(names)]))
    return df.select(*ids, rows.alias("x")).select(*ids, "x.*")


# strict scoring: complete blocks of side 5 over 25 columns, halo 1; the edge remainder is background only
VIEWS["pgrid"] = "SELECT vec_id, label, vec_id // 500 AS scene, CAST(row_i % 20 AS INTEGER) AS r, col_i AS c, refl[1] AS s0, refl[2] AS s1 FROM pix"
VIEWS["strict"] = """SELECT p.scene, p.vec_id, p.label, printf('r%04d_c%04d', p.r // 5, p.c // 5) AS fold, f.n, t.mineral, ((p.s0 - m0) * (i00 * (t0 - m0) + i01 * (t1 - m1)) + (p.s1 - m1) * (i01 * (t0 - m0) + i11 * (t1 - m1))) / ((t0 - m0) * (i00 * (t0 - m0) + i01 * (t1 - m1)) + (t1 - m1) * (i01 * (t0 - m0) + i11 * (t1 - m1))) AS mf
 FROM pgrid p JOIN (SELECT scene, br, bc, n, m0, m1, l11 / (l00 * l11 - c01 * c01) AS i00, -c01 / (l00 * l11 - c01 * c01) AS i01, l00 / (l00 * l11 - c01 * c01) AS i11 FROM (SELECT *, c00 + 0.01::DOUBLE * (c00 + c11) / 2 AS l00, c11 + 0.01::DOUBLE * (c00 + c11) / 2 AS l11 FROM
  (SELECT b.scene, b.br, b.bc, count(*) AS n, avg(s0) AS m0, avg(s1) AS m1, covar_samp(s0, s0) AS c00, covar_samp(s0, s1) AS c01, covar_samp(s1, s1) AS c11 FROM (SELECT DISTINCT scene, r // 5 AS br, c // 5 AS bc FROM pgrid JOIN (SELECT scene, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols FROM pgrid GROUP BY scene) USING (scene) WHERE r // 5 < n_rows // 5 AND c // 5 < n_cols // 5) b JOIN pgrid q ON q.scene = b.scene
   WHERE NOT (q.r >= b.br * 5 - 1 AND q.r < b.br * 5 + 6 AND q.c >= b.bc * 5 - 1 AND q.c < b.bc * 5 + 6) GROUP BY b.scene, b.br, b.bc))) f ON f.scene = p.scene AND f.br = p.r // 5 AND f.bc = p.c // 5
 CROSS JOIN (SELECT label AS mineral, refl[1] AS t0, refl[2] AS t1 FROM medoid) t"""


def strict_scores(spark, d) -> tuple[list, DataFrame]:
    names, lib = L.library_matrix(L.medoids(library(spark, d)), "mineral")
    p = pix(spark, d).select("vec_id", "label", F.floor(F.col("vec_id") / 500).alias("scene"), (F.col("row_i") % 20).cast("int").alias("row_i"), "col_i", "refl")
    blocks = K.complete_blocks(K.grid_shape(p, ["scene"]), ["scene"], 5)
    s = P.strict_fold_scores(p, blocks, ["scene"], 5, 1, lib[:, [0, 1]], [0, 1], N_BANDS, 0.01, ["vec_id", "label"])
    return names, s


@query("x15_strict_fold_scores", "SELECT scene, fold, vec_id, n AS n_fit, mineral, round(mf, 6) + 0.0 AS mf FROM strict")
def x15(spark, d):
    names, s = strict_scores(spark, d)
    return rounded(score_rows(s, names, ["scene", "fold", "vec_id", "n_fit"]).drop("infeas"), "mf")


@query("x27_strict_maps", "SELECT scene, fold, 'ok' AS status, count(DISTINCT vec_id) AS n_pixels, max(n) AS n_fit FROM strict GROUP BY scene, fold")
def x27(spark, d):
    _, s = strict_scores(spark, d)
    return s.groupBy("scene", "fold", "status").agg(F.count(F.lit(1)).alias("n_pixels"), F.max("n_fit").alias("n_fit"))


@query("x16_strict_against_full", """WITH j AS (SELECT s.scene, s.mineral, s.mf AS strict, f.mf AS full_, CASE WHEN s.label = s.mineral THEN 1 ELSE 0 END AS ref FROM strict s JOIN mf2 f ON f.vec_id = s.vec_id AND f.mineral = s.mineral),
 r AS (SELECT *, rank() OVER (PARTITION BY scene, mineral ORDER BY strict) + (count(*) OVER (PARTITION BY scene, mineral, strict) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY scene, mineral ORDER BY full_) + (count(*) OVER (PARTITION BY scene, mineral, full_) - 1) / 2.0::DOUBLE AS rb,
  count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY scene, mineral) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY scene, mineral) AS nn FROM j),
 a AS (SELECT scene, mineral, np AS n_pos, nn AS n_neg, (sum(CASE WHEN ref = 1 THEN ra END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS sa, (sum(CASE WHEN ref = 1 THEN rb END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS fa FROM r GROUP BY scene, mineral, np, nn)
 SELECT scene, mineral, n_pos, n_neg, round(sa, 6) + 0.0 AS strict_auc, round(fa, 6) + 0.0 AS full_auc, round(sa - fa, 6) + 0.0 AS delta, sign(sa - 0.5) = sign(fa - 0.5) AS direction_preserved FROM a""")
def x16(spark, d):
    from .spectra import mf_long

    names, s = strict_scores(spark, d)
    a = score_rows(s, names, ["scene", "vec_id", "label"]).select("scene", "vec_id", "label", "mineral", F.col("mf").alias("strict"))
    j = a.join(mf_long(spark, d, [0, 1]).select("vec_id", "mineral", F.col("mf").alias("full_")), ["vec_id", "mineral"]).withColumn("ref", (F.col("label") == F.col("mineral")).cast("int"))
    return rounded(P.strict_against_full(j, ["scene", "mineral"], "strict", "full_"), "strict_auc", "full_auc", "delta")


# ---- resampled training, transferred threshold, concordance, nulls ------------------------------------------

VIEWS["drawtrain"] = """SELECT d.site, d.fold, d.rep, t.block_id, count(*) AS w FROM (SELECT site, fold, rep, ('0x' || substr(md5(concat_ws(':', '23', fold, rep, idx)), 1, 8))::BIGINT % nt AS didx FROM (SELECT *, row_number() OVER (PARTITION BY site, fold ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site, fold) AS nt FROM train) CROSS JOIN range(4) r(rep)) d
 JOIN (SELECT *, row_number() OVER (PARTITION BY site, fold ORDER BY block_id) - 1 AS idx FROM train) t ON t.site = d.site AND t.fold = d.fold AND t.idx = d.didx GROUP BY d.site, d.fold, d.rep, t.block_id"""


@query("x22_bootstrap_trained_thresholds", """WITH n AS (SELECT b.site, b.layer, t.fold, t.rep, sum(CASE WHEN bp > 0 THEN w ELSE 0 END) AS np, sum(CASE WHEN bn > 0 THEN w ELSE 0 END) AS nn FROM drawtrain t JOIN btot b ON t.site = b.site AND t.block_id = b.block_id GROUP BY ALL),
 s AS (SELECT c.site, c.layer, t.fold, t.rep, c.score, sum(CASE WHEN c.pos > 0 THEN t.w * c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN t.w * c.neg / b.bn::DOUBLE ELSE 0 END) AS wn FROM drawtrain t JOIN cnt c ON t.site = c.site AND t.block_id = c.block_id JOIN btot b ON b.site = c.site AND b.layer = c.layer AND b.block_id = c.block_id GROUP BY ALL),
 j AS (SELECT s.*, round(sum(wp) OVER w / np - sum(wn) OVER w / nn, 12) AS j FROM s JOIN n USING (site, layer, fold, rep) WHERE np > 0 AND nn > 0 WINDOW w AS (PARTITION BY s.site, s.layer, s.fold, s.rep ORDER BY s.score DESC)),
 t AS (SELECT site, layer, fold, rep, max(score) AS threshold FROM (SELECT *, max(j) OVER (PARTITION BY site, layer, fold, rep) AS mj FROM j) WHERE j = mj GROUP BY ALL)
 SELECT t.site, t.layer, t.rep, t.fold AS block_id, threshold, count(*) AS n_test, count(*) FILTER (WHERE o.score >= threshold) AS n_pred FROM t JOIN obs o ON o.site = t.site AND o.layer = t.layer AND o.block_id = t.fold GROUP BY ALL""")
def x22(spark, d):
    dt = P.drawn_training(training(spark, d), ["site"], 4, 23)
    oof = C.cross_fit(samples(spark, d), dt, KEYS)
    return oof.groupBy(*KEYS, F.col("rep").cast("bigint").alias("rep"), "block_id", "threshold").agg(F.count(F.lit(1)).alias("n_test"), F.sum("pred").alias("n_pred"))


@query("x10_fixed_threshold_bootstrap", f"""WITH o AS (SELECT * FROM obs WHERE layer = 'alpha'), {_DRAW.format(src='o', seed=29, n=30)},
 k AS (SELECT site, block_id, count(*) FILTER (WHERE ref = 1) AS np, count(*) FILTER (WHERE ref = 0) AS nn, count(*) FILTER (WHERE score >= 60 AND ref = 1) AS tp, count(*) FILTER (WHERE score >= 60 AND ref = 0) AS fp FROM o GROUP BY ALL),
 s AS (SELECT k.site, w.rep, CAST(sum(w * np) AS BIGINT) AS np, CAST(sum(w * nn) AS BIGINT) AS nn, CAST(sum(w * tp) AS BIGINT) AS tp, CAST(sum(w * fp) AS BIGINT) AS fp FROM k JOIN w ON w.site = k.site AND w.block_id = k.block_id GROUP BY ALL),
 u AS (SELECT u.site, a.rep, sum(a.w * b.w * u.u) AS num FROM umat u JOIN w a ON a.site = u.site AND a.block_id = u.p_block JOIN w b ON b.site = u.site AND b.rep = a.rep AND b.block_id = u.n_block WHERE u.layer = 'alpha' GROUP BY ALL)
 SELECT s.site, s.rep, round(num / (np::DOUBLE * nn), 6) + 0.0 AS auc, round(0.5::DOUBLE * (tp / np::DOUBLE + 1 - fp / nn::DOUBLE), 6) + 0.0 AS balanced_accuracy, round(0.5::DOUBLE * (2 * tp / (2 * tp + fp + np - tp)::DOUBLE + 2 * (nn - fp) / (2 * (nn - fp) + fp + np - tp)::DOUBLE), 6) + 0.0 AS macro_f1
 FROM s JOIN u ON u.site = s.site AND u.rep = s.rep""")
def x10(spark, d):
    o = samples(spark, d).where("layer = 'alpha'").select("site", "block_id", "score", "ref")
    out = P.fixed_threshold_bootstrap(o, ["site"], 60.0, 30, 29)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "auc", "balanced_accuracy", "macro_f1")


NULLS = 999
VIEWS["alphaidx"] = "SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx FROM (SELECT DISTINCT site, block_id FROM blk WHERE layer = 'alpha')"
VIEWS["nullperm"] = """SELECT s.site, s.rep, s.block_id AS target, i.block_id AS source FROM (SELECT site, block_id, rep, row_number() OVER (PARTITION BY site, rep ORDER BY ('0x' || substr(md5(concat_ws(':', '37', rep, idx)), 1, 8))::BIGINT, idx) - 1 AS pidx
 FROM alphaidx CROSS JOIN range(999) r(rep)) s JOIN alphaidx i ON i.site = s.site AND i.idx = s.pidx UNION ALL SELECT site, -1, block_id, block_id FROM alphaidx"""


@query("x10_fixed_threshold_null", """WITH b AS (SELECT site, block_id, row_i % 20 AS r, col_i % 20 AS c, score, ref FROM blk WHERE layer = 'alpha'),
 c AS (SELECT t.site, t.block_id AS target, s.block_id AS source, s.score, count(*) FILTER (WHERE t.ref = 1) AS pos, count(*) FILTER (WHERE t.ref = 0) AS neg FROM b t JOIN b s ON s.site = t.site AND s.r = t.r AND s.c = t.c WHERE t.ref IS NOT NULL AND s.score IS NOT NULL GROUP BY ALL),
 v AS (SELECT site, rep, score, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM nullperm p JOIN c USING (site, target, source) GROUP BY ALL),
 w AS (SELECT *, sum(neg) OVER (PARTITION BY site, rep ORDER BY score) - neg / 2.0::DOUBLE AS below FROM v),
 m AS (SELECT site, rep, sum(pos)::BIGINT AS np, sum(neg)::BIGINT AS nn, sum(pos * below) AS u, (sum(pos) FILTER (WHERE score >= 60))::BIGINT AS tp, (sum(neg) FILTER (WHERE score >= 60))::BIGINT AS fp FROM w GROUP BY ALL),
 k AS (SELECT site, rep, CASE WHEN np > 0 AND nn > 0 THEN u / (np::DOUBLE * nn) END AS auc, CASE WHEN np > 0 AND nn > 0 THEN (tp / np::DOUBLE + (nn - fp) / nn::DOUBLE) / 2 END AS balanced_accuracy,
  CASE WHEN np > 0 AND nn > 0 THEN (coalesce(2 * tp / nullif(tp + fp + np, 0)::DOUBLE, 0) + coalesce(2 * (nn - fp) / nullif(2 * (nn - fp) + fp + np - tp, 0)::DOUBLE, 0)) / 2 END AS macro_f1 FROM m),
 l AS (SELECT site, rep, unnest(['auc', 'balanced_accuracy', 'macro_f1']) AS metric, round(unnest([auc, balanced_accuracy, macro_f1]), 9) AS value FROM k),
 o AS (SELECT site, metric, value AS observed FROM l WHERE rep = -1),
 g AS (SELECT site, count(*) FILTER (WHERE p > 0) AS positive_blocks, count(*) FILTER (WHERE n > 0) AS negative_blocks FROM (SELECT site, block_id, count(*) FILTER (WHERE ref = 1) AS p, count(*) FILTER (WHERE ref = 0) AS n FROM b WHERE score IS NOT NULL GROUP BY ALL) GROUP BY site)
 SELECT l.site, l.metric, round(observed, 6) + 0.0 AS observed, count(value) AS valid_replicates, round(quantile_cont(value, 0.025), 6) + 0.0 AS null_lower, round(quantile_cont(value, 0.5), 6) + 0.0 AS null_median, round(quantile_cont(value, 0.975), 6) + 0.0 AS null_upper,
 round((count(*) FILTER (WHERE value >= observed) + 1.0::DOUBLE) / (count(value) + 1), 6) + 0.0 AS p_value, positive_blocks, negative_blocks, positive_blocks >= 10 AND negative_blocks >= 10 AS support_eligible
 FROM l JOIN o USING (site, metric) JOIN g USING (site) WHERE rep >= 0 GROUP BY l.site, l.metric, observed, positive_blocks, negative_blocks""")
def x10_null(spark, d):
    s = samples(spark, d).where("layer = 'alpha'").select("site", "block_id", "row_i", "col_i", "score", "ref")
    blocks = cut(s.select("site", "block_id").distinct())
    orders = packets.with_identity(R.ordering_lists(blocks, ["site"], NULLS, 37), blocks, ["site"])
    names = ["auc", "balanced_accuracy", "macro_f1"]
    # read twice, as null and as observed values
    made = cut(packets.permuted(s, orders, ["site"], ["score", "ref"], SIDE, packets.fixed_threshold(60.0), names))
    reps = made.unpivot(["site", "rep"], names, "metric", "value").withColumn("value", F.round("value", 9))
    out = null_summary(reps.where("rep >= 0"), reps.where("rep = -1").drop("rep"), ["site", "metric"], "value", NULLS).drop("reason")
    out = out.join(packets.block_support(s, ["site"]), "site")
    return rounded(out, "observed", "null_lower", "null_median", "null_upper", "p_value")


VIEWS["conc"] = """SELECT site, block_id, row_i, col_i, na AS score, nk AS depth, ref FROM sens WHERE na IS NOT NULL AND nk IS NOT NULL AND ref IS NOT NULL"""


@query("x19_concordance_bootstrap", f"""WITH o AS (SELECT * FROM conc), {_DRAW.format(src='o', seed=31, n=20)},
 e AS (SELECT o.site, w.rep, o.score, o.depth, o.ref, unnest(range(w.w)) AS u FROM o JOIN w ON w.site = o.site AND w.block_id = o.block_id),
 r AS (SELECT *, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS rk, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY site, rep) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY site, rep) AS nn FROM e),
 a AS (SELECT site, rep, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc, np / (np + nn)::DOUBLE AS prevalence FROM r GROUP BY site, rep, np, nn),
 s AS (SELECT site, rep, corr(ra, rb) AS rho FROM (SELECT site, rep, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY site, rep ORDER BY depth) + (count(*) OVER (PARTITION BY site, rep, depth) - 1) / 2.0::DOUBLE AS rb FROM e WHERE ref = 1) GROUP BY site, rep),
 b AS (SELECT w.site, w.rep, CAST(sum(CASE WHEN p > 0 THEN w END) AS BIGINT) AS positive_blocks, CAST(sum(CASE WHEN n > 0 THEN w END) AS BIGINT) AS negative_blocks FROM w JOIN (SELECT site, block_id, count(*) FILTER (WHERE ref = 1) AS p, count(*) FILTER (WHERE ref = 0) AS n FROM o GROUP BY ALL) k ON k.site = w.site AND k.block_id = w.block_id GROUP BY ALL)
 SELECT a.site, a.rep, round(auc, 6) + 0.0 AS auc, round(prevalence, 6) + 0.0 AS prevalence, positive_blocks, negative_blocks, round(rho, 6) + 0.0 AS spearman FROM a JOIN b USING (site, rep) LEFT JOIN s USING (site, rep)""")
def x19(spark, d):
    s = sensor_rows(spark, d).where("na IS NOT NULL AND nk IS NOT NULL AND ref IS NOT NULL").select("site", "block_id", F.col("na").alias("score"), F.col("nk").alias("depth"), "ref")
    out = P.concordance_bootstrap(s, ["site"], "depth", 20, 31)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "auc", "prevalence", "spearman")


@query("x19_packet_footprints", "SELECT site, block_id, count(*) AS n FROM blk WHERE layer = 'alpha' AND NOT (block_id = 'r0002_c0001' AND col_i % 20 = 3) GROUP BY site, block_id HAVING count(*) <> 400")
def x19_packets(spark, d):
    s = samples(spark, d).where((F.col("layer") == "alpha") & ~((F.col("block_id") == "r0002_c0001") & (F.col("col_i") % 20 == 3)))
    return P.packet_mismatches(s, ["site"], SIDE)


VIEWS["packets"] = """SELECT 'whole' AS scene, site, block_id, row_i, col_i, na AS score, nk AS depth, ref AS target, (row_i + col_i) % 11 <> 0 AS valid FROM sens
 UNION ALL SELECT 'cut', site, block_id, row_i, col_i, na, nk, ref, true FROM sens WHERE NOT (block_id = 'r0002_c0001' AND col_i % 20 = 3)"""


@query("x19_packet_null", """WITH b AS (SELECT scene, site, block_id, row_i % 20 AS r, col_i % 20 AS c, score, depth, target, valid FROM packets),
 e AS (SELECT scene, site, count(DISTINCT block_id) AS n_blocks, count(DISTINCT n) AS sizes FROM (SELECT scene, site, block_id, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT p.site, p.rep, t.block_id, t.score, s.depth, s.target FROM nullperm p JOIN b t ON t.scene = 'whole' AND t.site = p.site AND t.block_id = p.target JOIN b s ON s.scene = 'whole' AND s.site = p.site AND s.block_id = p.source AND s.r = t.r AND s.c = t.c
   WHERE p.rep < 199 AND t.score IS NOT NULL AND s.valid AND s.depth IS NOT NULL AND s.target IS NOT NULL),
 q AS (SELECT *, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS rk FROM j),
 a AS (SELECT site, rep, count(*) FILTER (WHERE target = 1) AS np, count(*) FILTER (WHERE target = 0) AS nn, sum(rk) FILTER (WHERE target = 1) AS s, count(DISTINCT block_id) FILTER (WHERE target = 1) AS pb, count(DISTINCT block_id) FILTER (WHERE target = 0) AS nb FROM q GROUP BY ALL),
 h AS (SELECT site, rep, corr(ra, rb) AS spearman FROM (SELECT site, rep, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY site, rep ORDER BY depth) + (count(*) OVER (PARTITION BY site, rep, depth) - 1) / 2.0::DOUBLE AS rb FROM j WHERE target = 1) GROUP BY ALL),
 k AS (SELECT site, rep, (s - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc, np / (np + nn)::DOUBLE AS prevalence, np + nn AS support, pb, nb, spearman FROM a LEFT JOIN h USING (site, rep)),
 l AS (SELECT site, rep, prevalence, support, pb, nb, unnest(['auc', 'spearman']) AS metric, round(unnest([auc, spearman]), 9) AS value FROM k),
 o AS (SELECT site, metric, value AS observed, prevalence, support, pb, nb FROM l WHERE rep = -1),
 n AS (SELECT l.site, l.metric, o.observed, o.prevalence, o.support, o.pb, o.nb, count(value) AS valid_replicates, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.975) AS hi, count(*) FILTER (WHERE value >= o.observed) AS ex
   FROM l JOIN o ON o.site = l.site AND o.metric = l.metric WHERE rep >= 0 GROUP BY ALL)
 SELECT e.scene, e.site, e.n_blocks, CASE WHEN e.n_blocks < 2 THEN 'fewer_than_two_blocks' WHEN e.sizes > 1 THEN 'unequal_footprints' END AS reason, n.metric, round(n.observed, 6) + 0.0 AS observed, round(n.prevalence, 6) + 0.0 AS prevalence, n.support, n.pb AS positive_blocks, n.nb AS negative_blocks,
 n.valid_replicates, round(lo, 6) + 0.0 AS null_lower, round(med, 6) + 0.0 AS null_median, round(hi, 6) + 0.0 AS null_upper, round((ex + 1.0::DOUBLE) / (n.valid_replicates + 1), 6) + 0.0 AS p_value
 FROM e LEFT JOIN n ON n.site = e.site AND e.sizes = 1 AND e.n_blocks >= 2""")
def x19_null(spark, d):
    s = sensor_rows(spark, d).select("site", "block_id", "row_i", "col_i", F.col("na").alias("score"), F.col("nk").alias("depth"), F.col("ref").alias("target"))
    whole = s.select(F.lit("whole").alias("scene"), "*", ((F.col("row_i") + F.col("col_i")) % 11 != 0).alias("valid"))
    cut_out = (F.col("block_id") == "r0002_c0001") & (F.col("col_i") % 20 == 3)
    scenes = whole.unionByName(s.where(~cut_out).select(F.lit("cut").alias("scene"), "*", F.lit(True).alias("valid")))
    by = ["scene", "site"]
    scenes = cut(scenes)
    design = cut(packets.exchangeable(scenes, by, SIDE))
    fit = scenes.join(design.where("reason IS NULL").select(*by), by, "left_semi")
    blocks = cut(fit.select(*by, "block_id").distinct())
    orders = packets.with_identity(R.block_orderings(blocks, by, 199, 37), blocks, by)
    made = packets.permuted(fit.withColumn("valid", F.col("valid").cast("int")), orders, by, ["score", "depth", "target", "valid"], SIDE, packets.moved_packets, ["auc", "spearman", "prevalence", "support", "positive_blocks", "negative_blocks"])
    reps = made.unpivot([*by, "rep"], ["auc", "spearman"], "metric", "value").withColumn("value", F.round("value", 9))
    null = null_summary(reps.where("rep >= 0"), reps.where("rep = -1").drop("rep"), [*by, "metric"], "value", 199).drop("reason")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("support", "positive_blocks", "negative_blocks")]
    own = made.where("rep = -1").select(*by, "prevalence", *counts)
    out = design.join(null.join(own, by), by, "left")
    return rounded(out, "observed", "prevalence", "null_lower", "null_median", "null_upper", "p_value")


@query("x20_null_summary", """WITH a AS (SELECT site, layer, rep, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc FROM (SELECT *, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY site, layer, rep) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY site, layer, rep) AS nn,
  rank() OVER (PARTITION BY site, layer, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, layer, rep, score) - 1) / 2.0::DOUBLE AS rk FROM permobs) GROUP BY site, layer, rep, np, nn)
 SELECT a.site, a.layer, round(max(p.auc), 6) + 0.0 AS observed, count(a.auc) AS valid_replicates, round(quantile_cont(a.auc, 0.025), 6) + 0.0 AS null_lower, round(quantile_cont(a.auc, 0.5), 6) + 0.0 AS null_median, round(quantile_cont(a.auc, 0.975), 6) + 0.0 AS null_upper,
 round((count(*) FILTER (WHERE a.auc >= p.auc) + 1.0::DOUBLE) / (count(*) + 1), 6) + 0.0 AS p_value FROM a JOIN pooled p ON p.site = a.site AND p.layer = a.layer GROUP BY a.site, a.layer""")
def x20(spark, d):
    from ..functions.draws import block_permutations

    s = samples(spark, d)
    perms = block_permutations(s.select(*KEYS, "block_id").distinct(), KEYS, PERMS, 11)
    null = packets.permuted(s, perms, KEYS, ["score", "ref"], SIDE, packets.moved_scores, ["auc"])
    obs = stats.rank_auc(s, KEYS).select(*KEYS, "auc")
    return rounded(null_summary(null, obs, KEYS, "auc", PERMS).drop("reason"), "observed", "null_lower", "null_median", "null_upper", "p_value")


@query("a41_zone_summary", """WITH q AS (SELECT site, layer, ref, count(*) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) AS q3 FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY site, layer, ref)
 SELECT q.site, q.layer, q.ref, q.n, round(q1, 6) + 0.0 AS q1, round(med, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1)) AS whisker_high
 FROM q JOIN lay l ON l.site = q.site AND l.layer = q.layer AND l.ref = q.ref GROUP BY q.site, q.layer, q.ref, q.n, q1, med, q3""")
def a41(spark, d):
    rows = lay(spark, d).where(F.col("score").isNotNull() & F.col("ref").isNotNull())
    by = [*KEYS, "ref"]
    q = stats.exact_quantiles(rows, by, "score", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    s = F.col("score")
    out = rows.join(q, by).groupBy(*by, "n", "q1", "median", "q3").agg(F.min(F.when(s >= F.col("q1") - reach, s)).alias("whisker_low"), F.max(F.when(s <= F.col("q3") + reach, s)).alias("whisker_high"))
    return rounded(out, "q1", "median", "q3")


# ---- decisions ---------------------------------------------------------------------------------------------------


@query("d1_support_tier", "SELECT site, layer, tier, tier <> 'counts_and_maps_only' AS metrics_allowed, tier <> 'counts_and_maps_only' AS intervals_allowed, tier = 'confirmatory_eligible' AS p_values_allowed FROM bearing")
def d1(spark, d):
    b = K.bearing_blocks(samples(spark, d), KEYS)
    return b.select(*KEYS, "tier", *[v.alias(k) for k, v in rules.permits("tier").items()])


VIEWS["auc2"] = """SELECT site, layer, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc FROM (SELECT *, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY site, layer) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY site, layer) AS nn, rank() OVER (PARTITION BY site, layer ORDER BY score) + (count(*) OVER (PARTITION BY site, layer, score) - 1) / 2.0::DOUBLE AS rk
 FROM (SELECT l.* FROM lay l JOIN shape s ON s.site = l.site WHERE l.row_i // 40 < s.n_rows // 40 AND l.col_i // 40 < s.n_cols // 40 AND l.score IS NOT NULL AND l.ref IS NOT NULL)) GROUP BY site, layer, np, nn"""


@query("d2_external_gate", """SELECT b.site, b.layer, CASE WHEN least(positive_blocks, negative_blocks) < 10 OR a.lower IS NULL OR t.auc IS NULL THEN 'unavailable' WHEN NOT (a.lower > 0.5 AND t.auc > 0.5) THEN 'fail' WHEN coalesce(c.lower > 0.5, false) THEN 'pass' ELSE 'ranking_only' END AS gate
 FROM bearing b LEFT JOIN bootci a ON a.site = b.site AND a.layer = b.layer AND a.metric = 'auc' LEFT JOIN bootci c ON c.site = b.site AND c.layer = b.layer AND c.metric = 'balanced_accuracy' LEFT JOIN auc2 t ON t.site = b.site AND t.layer = b.layer""")
def d2(spark, d):
    ci = intervals(spark, d)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("lower")))
    low = ci.groupBy(*KEYS).agg(pick("auc").alias("auc_lower"), pick("balanced_accuracy").alias("balanced_lower"))
    double = stats.rank_auc(K.in_complete_blocks(lay(spark, d), grids(spark, d), ["site"], 2 * SIDE), KEYS).select(*KEYS, F.col("auc").alias("auc_2l"))
    j = K.bearing_blocks(samples(spark, d), KEYS).join(low, KEYS, "left").join(double, KEYS, "left")
    return j.select(*KEYS, rules.external_gate(F.col("positive_blocks"), F.col("negative_blocks"), F.col("auc_lower"), F.col("balanced_lower"), F.col("auc_2l")).alias("gate"))


# evidence per user: the result rows a decision table starts from
VIEWS["evid"] = """SELECT user_id, user_id // 4 AS grp, CASE WHEN user_id % 9 <> 4 THEN (avg(value) - 45) / 50 END AS a, CASE WHEN user_id % 7 <> 2 THEN count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) / count(*)::DOUBLE END AS b,
 CASE WHEN user_id % 11 <> 5 THEN avg(CAST(json_extract(props, '$.k') AS INTEGER)) / 80 END AS c, stddev_samp(value) / 60 AS e, count(*) AS n FROM events GROUP BY user_id"""


def evidence(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    u = F.col("user_id")
    g = e.groupBy("user_id").agg(F.avg("value").alias("v"), F.count_if(F.col("event_type").isin("view", "click", "error")).alias("t"), F.avg("k").alias("k"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.floor(u / 4).alias("grp"), F.when(u % 9 != 4, (F.col("v") - 45) / 50).alias("a"), F.when(u % 7 != 2, F.col("t") / F.col("n")).alias("b"), F.when(u % 11 != 5, F.col("k") / 80).alias("c"), (F.col("s") / 60).alias("e"), "n")


@query("d3_pair_gates", """WITH g AS (SELECT user_id, grp, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS evaluable, coalesce(a > 0 AND b > 0.5 AND c > 0.55, false) AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS passed FROM evid),
 r AS (SELECT grp, count(*) FILTER (WHERE passed) AS n_passed, bool_and(evaluable) AS ev, count(*) AS n FROM g GROUP BY grp),
 k AS (SELECT grp, n_passed, CASE WHEN n <> 4 THEN NULL WHEN n_passed = 4 THEN 'strong' WHEN n_passed >= 1 THEN 'date-dependent' WHEN ev THEN 'unsupported' ELSE 'unavailable' END AS repeatability, CASE grp % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unavailable' END AS external_status FROM r)
 SELECT grp, n_passed, repeatability, CASE WHEN external_status = 'unavailable' OR repeatability = 'unavailable' OR repeatability IS NULL THEN 'unavailable' WHEN external_status = 'pass' AND repeatability = 'strong' THEN 'validated_and_repeatable' WHEN repeatability = 'strong' THEN 'stable_only'
 WHEN external_status = 'pass' THEN 'acquisition_specific' ELSE 'failed' END AS public_gate FROM k""")
def d3(spark, d):
    gate = rules.pair_gate(F.col("a"), F.col("b"), F.col("c"), F.lit(0.55))
    g = evidence(spark, d).select("grp", *[v.alias(k) for k, v in gate.items()])
    r = g.groupBy("grp").agg(F.count_if("passed").alias("n_passed"), F.bool_and("evaluable").alias("ev"), F.count(F.lit(1)).alias("n"))
    k = r.select("grp", "n_passed", rules.repeatability_class(F.col("n_passed"), F.col("ev"), F.col("n")).alias("repeatability"))
    ext = F.when(F.col("grp") % 3 == 0, "pass").when(F.col("grp") % 3 == 1, "fail").otherwise("unavailable")
    return k.select("*", rules.public_gate(ext, F.col("repeatability")).alias("public_gate"))


@query("d4_claim_gate", """WITH g AS (SELECT user_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR e IS NULL THEN NULL ELSE a + 0.7 >= 0.8 AND b + 0.3 >= 0.8 AND c > 0.5 AND e - 0.6 <= 0.2 END AS st, CASE WHEN n % 4 <> 0 AND b IS NOT NULL AND c IS NOT NULL THEN b > 0.5 AND b + 0.1 > 0.5 AND c + 0.1 > 0.5 END AS ex, CASE WHEN c IS NULL THEN NULL ELSE c > 0.6 END AS sr FROM evid)
 SELECT user_id, st AS stable, ex AS external, CASE WHEN st IS NULL OR ex IS NULL OR sr IS NULL THEN 'unavailable_required_evidence' WHEN st AND ex AND sr THEN 'validated_analytically_robust_alteration_zone_discrimination' WHEN st AND NOT ex THEN 'analytically_stable_spatial_pattern_only'
 WHEN ex AND NOT sr THEN 'operational_discrimination_not_strictly_held_out' WHEN ex AND NOT st THEN 'discriminative_but_analytically_sensitive' ELSE 'negative_or_unstable_result' END AS claim FROM g""")
def d4(spark, d):
    e = evidence(spark, d)
    inputs = [F.col("a") + 0.7, F.col("b") + 0.3, F.col("c"), F.col("e") - 0.6]
    e = e.withColumn("stable", rules.claim_gate(*inputs, external=[]))
    external = rules.external_component(F.col("b"), F.col("b") + 0.1, F.col("c") + 0.1, F.col("n") % 4 != 0)
    return e.select("user_id", "stable", external.alias("external"), rules.permitted_claim(F.col("stable"), external, F.col("c") > 0.6).alias("claim"))


VIEWS["endp"] = """SELECT user_id, grp, CASE user_id % 5 WHEN 0 THEN 'prevalence' WHEN 1 THEN 'spearman' ELSE 'auc' END AS metric, CASE WHEN n % 13 < 3 THEN 'counts_and_maps_only' WHEN n % 13 < 6 THEN 'exploratory_only' ELSE 'confirmatory_eligible' END AS tier, CASE WHEN user_id % 4 = 1 THEN 'broader' ELSE 'exact' END AS mapping,
 a IS NOT NULL AS ci, c IS NOT NULL AS nu, b AS value, CASE WHEN user_id % 6 <> 0 THEN e / 3 END AS q, b - 0.05 AS lower, b + 0.05 AS upper FROM evid"""
VIEWS["endps"] = """SELECT *, CASE WHEN metric = 'prevalence' THEN 'descriptive_only' WHEN tier = 'counts_and_maps_only' THEN 'counts_and_maps_only' WHEN tier = 'exploratory_only' THEN 'exploratory_estimate_only' WHEN mapping = 'broader' AND ci AND nu AND value IS NOT NULL AND q IS NOT NULL THEN 'secondary_inference_available'
 WHEN mapping = 'broader' THEN 'secondary_inference_unavailable' WHEN NOT (ci AND nu AND value IS NOT NULL) THEN 'inference_unavailable' ELSE 'confirmatory_eligible' END AS inference_status,
 CASE WHEN metric = 'prevalence' THEN 'descriptive_prevalence' WHEN tier = 'counts_and_maps_only' THEN 'no_inferential_claim' WHEN tier = 'exploratory_only' THEN 'no_confirmatory_claim' WHEN mapping = 'broader' THEN 'secondary_endpoint_no_confirmatory_claim' WHEN NOT (ci AND nu AND value IS NOT NULL) THEN 'no_confirmatory_claim'
 WHEN coalesce(lower > 0.6, false) THEN 'confirmatory_concordance_supported' WHEN coalesce(upper < 0.6, false) THEN 'confirmatory_reversed_result' ELSE 'confirmatory_concordance_not_supported' END AS claim_status FROM endp"""


def endpoints(spark, d) -> DataFrame:
    e, u = evidence(spark, d), F.col("user_id")
    n = F.col("n") % 13
    e = e.select(
        "user_id", "grp", F.when(u % 5 == 0, "prevalence").when(u % 5 == 1, "spearman").otherwise("auc").alias("metric"),
        F.when(n < 3, "counts_and_maps_only").when(n < 6, "exploratory_only").otherwise("confirmatory_eligible").alias("tier"), F.when(u % 4 == 1, "broader").otherwise("exact").alias("mapping"),
        F.col("a").isNotNull().alias("ci"), F.col("c").isNotNull().alias("nu"), F.col("b").alias("value"), F.when(u % 6 != 0, F.col("e") / 3).alias("q"), (F.col("b") - 0.05).alias("lower"), (F.col("b") + 0.05).alias("upper"))
    st = rules.endpoint_status(F.col("metric"), F.col("tier"), F.col("mapping"), F.col("ci"), F.col("nu"), F.col("value"), F.col("q"), F.col("lower"), F.col("upper"), F.lit(0.6))
    return e.select("*", *[v.alias(k) for k, v in st.items()])


@query("d5_endpoint_status", "SELECT user_id, inference_status, claim_status FROM endps")
def d5(spark, d):
    return endpoints(spark, d).select("user_id", "inference_status", "claim_status")


@query("d5_global_status", """SELECT grp, CASE WHEN s OR r OR e THEN 'confirmatory_result_available' WHEN x THEN 'secondary_only' WHEN p THEN 'exploratory_only' WHEN c THEN 'counts_and_maps_only' ELSE 'unavailable' END AS status,
 CASE WHEN s THEN 'confirmatory_concordance_supported' WHEN r THEN 'confirmatory_reversed_result' WHEN e THEN 'confirmatory_concordance_not_supported' WHEN x OR p THEN 'no_confirmatory_claim' ELSE 'no_inferential_claim' END AS claim FROM
 (SELECT grp, bool_or(claim_status = 'confirmatory_concordance_supported') AS s, bool_or(claim_status = 'confirmatory_reversed_result') AS r, bool_or(inference_status = 'confirmatory_eligible') AS e, bool_or(inference_status = 'secondary_inference_available') AS x,
  bool_or(inference_status = 'exploratory_estimate_only') AS p, bool_or(inference_status = 'counts_and_maps_only') AS c FROM endps GROUP BY grp)""")
def d5_global(spark, d):
    g = rules.global_status(F.col("inference_status"), F.col("claim_status"))
    return endpoints(spark, d).groupBy("grp").agg(*[v.alias(k) for k, v in g.items()])


@query("d6_decision_checks", """SELECT grp, bool_and(tier = 'confirmatory_eligible') AS support_ok, bool_and(coalesce(a > 0, false)) AS interval_ok, bool_or(coalesce(c > 0.6, false)) AS direction_ok, bool_and(tier = 'confirmatory_eligible') AND bool_and(coalesce(a > 0, false)) AND bool_or(coalesce(c > 0.6, false)) AS gate_passed
 FROM evid JOIN (SELECT user_id AS u, tier FROM endp) ON u = user_id GROUP BY grp""")
def d6(spark, d):
    j = evidence(spark, d).select("user_id", "grp", "a", "c").join(endpoints(spark, d).select("user_id", "tier"), "user_id")
    return j.groupBy("grp").agg(*[v.alias(k) for k, v in rules.decision_checks(F.col("tier"), F.col("a"), F.col("c") - 0.6).items()])


@query("d8_endpoint_role", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'goldfield' WHEN o_orderstatus = 'F' THEN 'bingham' ELSE 'other' END AS site, CASE WHEN o_custkey % 2 = 0 THEN 'feature' ELSE 'mtmf' END AS family,
  CASE o_orderkey % 6 WHEN 0 THEN 'al_oh_doublet' WHEN 1 THEN 'gypsum_carbonate' WHEN 2 THEN 'alunite' WHEN 3 THEN 'muscovite' WHEN 4 THEN 'jarosite' ELSE 'hematite' END AS layer FROM orders)
 SELECT site, family, layer, CASE WHEN site = 'goldfield' AND family = 'feature' AND layer = 'al_oh_doublet' THEN 'primary' WHEN (site = 'goldfield' AND ((family = 'feature' AND layer = 'gypsum_carbonate') OR (family = 'mtmf' AND layer IN ('alunite', 'muscovite')))) OR (site = 'bingham' AND family = 'feature' AND layer = 'gypsum_carbonate') THEN 'key_secondary'
 WHEN layer = 'jarosite' THEN 'descriptive' ELSE 'exploratory' END AS role, count(*) AS n FROM r GROUP BY ALL""")
def d8(spark, d):
    o = table(spark, d, "orders")
    st, k = F.col("o_orderstatus"), F.col("o_orderkey") % 6
    names = F.array(*[F.lit(x) for x in ("al_oh_doublet", "gypsum_carbonate", "alunite", "muscovite", "jarosite", "hematite")])
    r = o.select(F.when(st == "O", "goldfield").when(st == "F", "bingham").otherwise("other").alias("site"), F.when(F.col("o_custkey") % 2 == 0, "feature").otherwise("mtmf").alias("family"), F.get(names, k.cast("int")).alias("layer"))
    return r.groupBy("site", "family", "layer", rules.endpoint_role(F.col("site"), F.col("family"), F.col("layer")).alias("role")).agg(F.count(F.lit(1)).alias("n"))
