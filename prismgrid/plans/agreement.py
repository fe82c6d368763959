"""Queries on agreement: discrimination, overlap, rank correlation, raster and table comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import class_list
from ..operators import agree, mask as M, stats
from ..operators.inference import adjust_complete_families, adjust_p_values
from .registry import POSITIVE, VIEWS, ev, lay, layers, query, r6, rounded, table

VIEWS["auc"] = """SELECT site, layer, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN u END AS u,
 CASE WHEN n_pos > 0 AND n_neg > 0 THEN u / (n_pos::DOUBLE * n_neg) END AS auc FROM (
 SELECT site, layer, count(*) FILTER (WHERE ref = 1) AS n_pos, count(*) FILTER (WHERE ref = 0) AS n_neg,
  sum(CASE WHEN ref = 1 THEN rk END) - count(*) FILTER (WHERE ref = 1) * (count(*) FILTER (WHERE ref = 1) + 1) / 2.0::DOUBLE AS u
 FROM (SELECT site, layer, ref, rank() OVER (PARTITION BY site, layer ORDER BY score) + (count(*) OVER (PARTITION BY site, layer, score) - 1) / 2.0::DOUBLE AS rk
  FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL) GROUP BY site, layer)"""
VIEWS["youden"] = """SELECT site, layer, min(t) AS threshold, max(j) AS j FROM (SELECT *, round(tpr - fpr, 12) AS j, max(round(tpr - fpr, 12)) OVER (PARTITION BY site, layer) AS mj FROM (
 SELECT g.site, g.layer, g.t, count(*) FILTER (WHERE l.ref = 1 AND l.score >= g.t) / g.np::DOUBLE AS tpr, count(*) FILTER (WHERE l.ref = 0 AND l.score >= g.t) / g.nn::DOUBLE AS fpr
 FROM (SELECT site, layer, np, nn, CASE WHEN k = 511 THEN hi ELSE lo + k * ((hi - lo) / 511.0::DOUBLE) END AS t FROM
  (SELECT site, layer, min(score) AS lo, max(score) AS hi, count(*) FILTER (WHERE ref = 1) AS np, count(*) FILTER (WHERE ref = 0) AS nn FROM lay
   WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY site, layer) CROSS JOIN range(512) r(k)) g
 JOIN lay l ON l.site = g.site AND l.layer = g.layer WHERE l.score IS NOT NULL AND l.ref IS NOT NULL GROUP BY g.site, g.layer, g.t, g.np, g.nn))
 WHERE j = mj GROUP BY site, layer"""


@query("q6_binary_reference", "SELECT site, layer, count(*) AS n, count(ref) AS n_ref, CAST(sum(ref) AS BIGINT) AS n_pos FROM lay GROUP BY site, layer")
def q6(spark, d):
    return lay(spark, d).groupBy("site", "layer").agg(F.count(F.lit(1)).alias("n"), F.count("ref").alias("n_ref"), F.sum("ref").alias("n_pos"))


@query("q7_analysis_domain", "SELECT site, code, count(*) AS n FROM ev WHERE code IS NOT NULL AND code NOT IN (0, 14, 45, 46, 47, 48, 49, 50) GROUP BY site, code")
def q7(spark, d):
    return ev(spark, d).where(M.in_domain("code")).groupBy("site", "code").agg(F.count(F.lit(1)).alias("n"))


@query("q9_threshold_mask", """SELECT event_id, CASE WHEN k < 90 AND score IS NOT NULL THEN CASE WHEN score >= t THEN 1 ELSE 0 END END AS m
 FROM ev JOIN (SELECT site, avg(score) AS t FROM ev GROUP BY site) USING (site)""")
def q9(spark, d):
    e = ev(spark, d)
    t = e.groupBy("site").agg(F.avg("score").alias("t"))
    return e.join(t, "site").select("event_id", M.threshold_mask("score", F.col("k") < 90, F.col("t")).alias("m"))


@query("q10_joint_support", """SELECT site, count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL AND code IS NOT NULL AND k < 90 AND user_id > 10) AS n_support,
 count(*) FILTER (WHERE code IS NOT NULL AND code < 0) AS n_bad_ids FROM ev GROUP BY site""")
def q10(spark, d):
    e = ev(spark, d)
    support = M.joint_support([F.col("score").isNotNull(), F.col("score2").isNotNull(), F.col("code").isNotNull(), F.col("k") < 90, F.col("user_id") > 10])
    bad = M.bad_ids(e, "code").groupBy("site").agg(F.count(F.lit(1)).alias("n_bad_ids"))
    n = e.groupBy("site").agg(F.count_if(support).alias("n_support"))
    return n.join(bad, "site", "left").select("site", "n_support", F.coalesce("n_bad_ids", F.lit(0).cast("bigint")).alias("n_bad_ids"))


LEDGER = [("missing_score", "score IS NULL"), ("missing_reference", "code IS NULL"), ("excluded_class", "code IN (0, 14, 45, 46, 47, 48, 49, 50)"), ("quality", "k >= 90")]


@query("q11_exclusion_ledger", """WITH t AS (SELECT site, CASE WHEN score IS NULL THEN 'missing_score' WHEN code IS NULL THEN 'missing_reference'
 WHEN code IN (0, 14, 45, 46, 47, 48, 49, 50) THEN 'excluded_class' WHEN k >= 90 THEN 'quality' ELSE 'included' END AS reason FROM ev)
 SELECT s.site, r.reason, CAST(r.position AS INTEGER) AS position, count(t.reason) AS n, s.denominator, round(count(t.reason) / s.denominator::DOUBLE, 6) + 0.0 AS fraction
 FROM (SELECT site, count(*) AS denominator FROM t GROUP BY site) s CROSS JOIN (SELECT unnest(['missing_score', 'missing_reference', 'excluded_class', 'quality', 'included']) AS reason, unnest(range(5)) AS position) r
 LEFT JOIN t ON t.site = s.site AND t.reason = r.reason GROUP BY s.site, r.reason, r.position, s.denominator""")
def q11(spark, d):
    return rounded(M.exclusion_ledger(ev(spark, d), ["site"], [(n, F.expr(c)) for n, c in LEDGER]), "fraction")


@query("q12_site_box", """SELECT c_nationkey AS nation, round(min(c_acctbal) / 100 - 0.25, 6) + 0.0 AS lon_min, round(min(c_custkey) / 100.0::DOUBLE - 0.25, 6) + 0.0 AS lat_min,
 round(max(c_acctbal) / 100 + 0.25, 6) + 0.0 AS lon_max, round(max(c_custkey) / 100.0::DOUBLE + 0.25, 6) + 0.0 AS lat_max FROM customer GROUP BY c_nationkey""")
def q12(spark, d):
    pts = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 100.0).alias("lon"), (F.col("c_custkey") / 100.0).alias("lat"))
    return rounded(M.site_search_box(pts, ["nation"], 0.25), "lon_min", "lat_min", "lon_max", "lat_max")


@query("q12_confirm_identity", """SELECT p_brand AS brand, n_match, n_match > 0 AS confirmed FROM (SELECT p_brand, count(*) FILTER (WHERE contains(lower(p_name), 'red')
 AND list_contains(string_split(p_name, ' '), 'widget') AND p_type IN ('SMALL', 'PROMO')) AS n_match FROM part GROUP BY p_brand)""")
def q12_confirm(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_name").alias("commodities"), F.col("p_type").alias("status"))
    return M.confirm_deposits(p, ["brand"], "Red", "widget", ["SMALL", "PROMO"])


@query("q18_class_color", """SELECT e.event_id, p.red, p.green, p.blue, CASE WHEN p.code IS NOT NULL AND NOT p.transparent THEN 255 ELSE 0 END AS alpha FROM ev e LEFT JOIN
 (SELECT CAST(n_nationkey AS INTEGER) AS code, CAST(n_nationkey * 10 AS INTEGER) AS red, CAST(n_regionkey * 40 AS INTEGER) AS green, 128 AS blue, n_regionkey = 0 AS transparent FROM nation) p ON e.code = p.code""")
def q18(spark, d):
    n = table(spark, d, "nation")
    palette = n.select(F.col("n_nationkey").cast("int").alias("code"), (F.col("n_nationkey") * 10).cast("int").alias("red"),
                       (F.col("n_regionkey") * 40).cast("int").alias("green"), F.lit(128).alias("blue"), (F.col("n_regionkey") == 0).alias("transparent"))
    return M.class_color(ev(spark, d), palette).select("event_id", "red", "green", "blue", "alpha")


@query("q20_versus_chance", """SELECT site, layer, CASE WHEN auc IS NULL THEN 'unavailable' WHEN auc > 0.5 THEN 'above' WHEN auc < 0.5 THEN 'below' ELSE 'at_chance' END AS direction FROM auc""")
def q20(spark, d):
    return stats.rank_auc(lay(spark, d), ["site", "layer"]).select("site", "layer", M.versus_chance("auc").alias("direction"))


@query("a7_pearson", """SELECT site, count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) AS n, round(corr(score, score2), 6) + 0.0 AS r FROM ev GROUP BY site""")
def a7(spark, d):
    both = F.col("score").isNotNull() & F.col("score2").isNotNull()
    return ev(spark, d).groupBy("site").agg(F.count_if(both).alias("n"), r6(stats.pearson("score", "score2")).alias("r"))


@query("a12_rank_auc", "SELECT site, layer, n_pos, n_neg, u, round(auc, 6) + 0.0 AS auc FROM auc")
def a12(spark, d):
    return rounded(stats.rank_auc(lay(spark, d), ["site", "layer"]).drop("tie_sum"), "auc")


VIEWS["utest"] = """SELECT site, layer, u, (u - np::DOUBLE * nn / 2 - 0.5) / sqrt(np::DOUBLE * nn / 12 * ((np + nn + 1) - ties / ((np + nn)::DOUBLE * (np + nn - 1)))) AS z FROM
 (SELECT site, layer, sum(pos)::BIGINT AS np, sum(neg)::BIGINT AS nn, sum(pos * (below + neg / 2.0::DOUBLE)) AS u, sum((pos + neg)::DOUBLE * (pos + neg) * (pos + neg) - (pos + neg)) AS ties FROM (SELECT *, sum(neg) OVER (PARTITION BY site, layer ORDER BY score) - neg AS below FROM
 (SELECT site, layer, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY ALL)) GROUP BY ALL) WHERE np > 0 AND nn > 0"""


@query("a13_u_test", """WITH t AS (SELECT *, abs(z) / sqrt(2) AS x FROM utest),
 e AS (SELECT *, CASE WHEN x < 3 THEN 0.5 - 0.5 * exp(-x * x) * list_sum(list_transform(range(80), lambda n: pow(x, 2 * n + 1) / gamma(n + 1.5::DOUBLE)))
  ELSE 0.5 * exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(x, range(80, 0, -1)::DOUBLE[]), lambda f, k: x + k / 2 / f) END AS upper FROM t)
 SELECT site, layer, u, round(CASE WHEN z < 0 THEN 1 - upper ELSE upper END, 9) + 0.0 AS p_value FROM e""")
def a13(spark, d):
    tested = agree.u_test_greater(stats.rank_auc(lay(spark, d), ["site", "layer"]))
    return tested.where("u IS NOT NULL").select("site", "layer", "u", (F.round("p_value", 9) + F.lit(0.0)).alias("p_value"))


@query("a14_discrimination", """WITH m AS (SELECT site, layer, quantile_cont(score, 0.5) FILTER (WHERE ref = 1) AS mi, quantile_cont(score, 0.5) FILTER (WHERE ref = 0) AS mo
  FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY site, layer)
 SELECT a.site, a.layer, n_pos, n_neg, u, round(auc, 6) + 0.0 AS auc, round(mi, 6) + 0.0 AS median_in, round(mo, 6) + 0.0 AS median_out, round(threshold, 6) + 0.0 AS threshold, round(j, 6) + 0.0 AS youden_j
 FROM auc a JOIN m USING (site, layer) JOIN youden USING (site, layer) WHERE n_pos > 0 AND n_neg > 0""")
def a14(spark, d):
    out = agree.discrimination(lay(spark, d), ["site", "layer"]).drop("p_value", "tpr", "fpr")
    return rounded(out, "auc", "median_in", "median_out", "threshold", "youden_j")


@query("a15_grid_youden", "SELECT site, layer, round(threshold, 6) + 0.0 AS threshold, round(j, 6) + 0.0 AS youden_j FROM youden")
def a15(spark, d):
    return rounded(agree.grid_youden(lay(spark, d), ["site", "layer"]).drop("tpr", "fpr"), "threshold", "youden_j")


VIEWS["binpair"] = """SELECT site, row_i, col_i, CASE WHEN score IS NOT NULL THEN CASE WHEN score >= 40 THEN 1 ELSE 0 END END AS m_a,
 CASE WHEN score2 IS NOT NULL THEN CASE WHEN score2 >= 50 THEN 1 ELSE 0 END END AS m_b, score, score2, code, k, user_id FROM ev"""


def binpair(spark, d) -> DataFrame:
    e = ev(spark, d)
    return e.select(
        "site", "row_i", "col_i",
        F.when(F.col("score").isNotNull(), (F.col("score") >= 40).cast("int")).alias("m_a"),
        F.when(F.col("score2").isNotNull(), (F.col("score2") >= 50).cast("int")).alias("m_b"),
        "score", "score2", "code", "k", "user_id",
    )


@query("a18_binary_overlap", """SELECT site, n_both, n_either, n_anchor, n_repeat, round(n_both / nullif(n_either, 0)::DOUBLE, 6) + 0.0 AS iou, round(2 * n_both / nullif(n_anchor + n_repeat, 0)::DOUBLE, 6) + 0.0 AS dice,
 round(n_repeat / nullif(n_anchor, 0)::DOUBLE, 6) + 0.0 AS prevalence_ratio FROM (SELECT site, count(*) FILTER (WHERE m_a = 1 AND m_b = 1) AS n_both, count(*) FILTER (WHERE m_a = 1 OR m_b = 1) AS n_either,
 count(*) FILTER (WHERE m_a = 1) AS n_anchor, count(*) FILTER (WHERE m_b = 1) AS n_repeat FROM binpair WHERE m_a IS NOT NULL AND m_b IS NOT NULL GROUP BY site)""")
def a18(spark, d):
    return rounded(agree.binary_overlap(binpair(spark, d), ["site"], "m_a", "m_b"), "iou", "dice", "prevalence_ratio")


@query("a19_spearman", """SELECT site, n, round(rho, 6) + 0.0 AS rho FROM (SELECT site, count(*) AS n, corr(ra, rb) AS rho FROM (
 SELECT site, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY site ORDER BY score2) + (count(*) OVER (PARTITION BY site, score2) - 1) / 2.0::DOUBLE AS rb
 FROM ev WHERE score IS NOT NULL AND score2 IS NOT NULL) GROUP BY site)""")
def a19(spark, d):
    return rounded(stats.spearman(ev(spark, d), ["site"], "score", "score2"), "rho")


@query("w1_average_rank", """SELECT site, score, count(*) AS n_tied, min(rk) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM (SELECT site, score, rank() OVER (PARTITION BY site ORDER BY score) AS rk
 FROM ev WHERE score IS NOT NULL) GROUP BY site, score""")
def w1(spark, d):
    return stats.average_ranks(ev(spark, d), ["site"], "score")


@query("w2_weighted_running", """SELECT layer, score, CAST(sum(pos) OVER (PARTITION BY layer ORDER BY score DESC) AS BIGINT) AS cum_pos, CAST(sum(neg) OVER (PARTITION BY layer ORDER BY score DESC) AS BIGINT) AS cum_neg
 FROM (SELECT layer, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY layer, score)""")
def w2(spark, d):
    c = stats.class_counts(lay(spark, d), ["layer"], "score", "ref")
    return stats.running_totals(c, ["layer"], "score", ["pos", "neg"], descending=True).select("layer", "score", "cum_pos", "cum_neg")


@query("w8_upper_decile", """SELECT site, layer, count(*) AS n, round(quantile_cont(score, 0.9), 6) + 0.0 AS threshold FROM lay WHERE score IS NOT NULL AND ref IS NOT NULL GROUP BY site, layer""")
def w8(spark, d):
    x = lay(spark, d).where(F.col("ref").isNotNull())
    return rounded(stats.exact_quantiles(x, ["site", "layer"], "score", {"threshold": 0.9}), "threshold")


@query("a11_weighted_quantile", """SELECT site, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(score, 0.9), 6) + 0.0 AS q90, round(quantile_cont(score, 0.5), 6) + 0.0 AS q50
 FROM (SELECT site, score, unnest(range(1 + k % 3)) AS u FROM ev WHERE score > 0) GROUP BY site""")
def a11(spark, d):
    x = ev(spark, d).where("score > 0").withColumn("w", F.lit(1) + F.col("k") % 3)
    return rounded(stats.exact_quantiles(x, ["site"], "score", {"q90": 0.9, "q50": 0.5}, weight="w"), "q90", "q50")


@query("a20_endpoint_metrics", """WITH s AS (SELECT site, score, score2, row_i // 20 * 100 + col_i // 20 AS blk, CASE WHEN code IN (3) THEN 1 ELSE 0 END AS ref FROM ev WHERE score IS NOT NULL AND score2 IS NOT NULL AND code IS NOT NULL AND k < 90),
 r AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2.0::DOUBLE AS rk FROM s),
 a AS (SELECT site, count(*) AS joint_support_n, count(*) FILTER (WHERE ref = 1) AS n_pos, count(*) FILTER (WHERE ref = 0) AS n_neg, count(DISTINCT CASE WHEN ref = 1 THEN blk END) AS positive_blocks,
   count(DISTINCT CASE WHEN ref = 0 THEN blk END) AS negative_blocks, sum(CASE WHEN ref = 1 THEN rk END) AS sr FROM r GROUP BY site),
 t AS (SELECT site, count(*) AS spearman_n, corr(ra, rb) AS rho FROM (SELECT site, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2.0::DOUBLE AS ra,
   rank() OVER (PARTITION BY site ORDER BY score2) + (count(*) OVER (PARTITION BY site, score2) - 1) / 2.0::DOUBLE AS rb FROM s WHERE ref = 1) GROUP BY site)
 SELECT a.site, joint_support_n, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 6) + 0.0 AS auc, round(n_pos / joint_support_n::DOUBLE, 6) + 0.0 AS prevalence,
 positive_blocks, negative_blocks, CASE WHEN least(positive_blocks, negative_blocks) < 5 THEN 'counts_and_maps_only' WHEN least(positive_blocks, negative_blocks) < 10 THEN 'exploratory_only' ELSE 'confirmatory_eligible' END AS tier,
 round(rho, 6) + 0.0 AS spearman, spearman_n FROM a JOIN t USING (site)""")
def a20(spark, d):
    e = ev(spark, d).withColumn("blk", F.floor(F.col("row_i") / 20) * 100 + F.floor(F.col("col_i") / 20))
    support = M.joint_support([F.col("score").isNotNull(), F.col("score2").isNotNull(), F.col("code").isNotNull(), F.col("k") < 90])
    out = agree.endpoint_metrics(e, ["site"], "score", "code", "score2", "blk", support, [3])
    return rounded(out.drop("auc_reason", "spearman_reason"), "auc", "prevalence", "spearman")


# two dates of one raster: the stream before and after the middle of the month, cell by cell
VIEWS["dates"] = """SELECT CAST(user_id AS INTEGER) AS row_i, event_type AS band, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS b,
 count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS na, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS nb FROM events GROUP BY user_id, event_type"""


def two_dates(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").cast("int").alias("row_i"), F.col("event_type").alias("band"), "ts", "value")
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    make = lambda x: x.groupBy("row_i", "band").agg(F.avg("value").alias("v"), F.count(F.lit(1)).cast("int").alias("code"))
    return make(e.where(F.col("ts") < cut)), make(e.where(F.col("ts") >= cut))


RASTER_SQL = """SELECT band, count(a) AS legacy_valid, count(b) AS corrected_valid, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS overlap,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS newly_excluded, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS newly_included,
 round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / nullif(count(a), 0)::DOUBLE, 6) + 0.0 AS retained_fraction,
 round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(*)::DOUBLE, 6) + 0.0 AS jaccard"""


@query("a25_compare_rasters", f"""{RASTER_SQL}, round(corr(a, b), 6) + 0.0 AS pearson_r, round(avg(abs(b - a)), 6) + 0.0 AS mae, round(sqrt(avg((b - a) * (b - a))), 6) + 0.0 AS rmse FROM dates GROUP BY band""")
def a25(spark, d):
    a, b = two_dates(spark, d)
    return rounded(agree.compare_rasters(a, b, ["row_i", "band"], ["band"], "v"), "retained_fraction", "jaccard", "pearson_r", "mae", "rmse")


@query("a25_compare_classes", """SELECT band, count(*) FILTER (WHERE na > 0) AS legacy_valid, count(*) FILTER (WHERE nb > 0) AS corrected_valid, count(*) FILTER (WHERE na > 0 AND nb > 0) AS overlap,
 count(*) FILTER (WHERE na > 0 AND na = nb) AS agreement, round(count(*) FILTER (WHERE na > 0 AND na = nb) / nullif(count(*) FILTER (WHERE na > 0 AND nb > 0), 0)::DOUBLE, 6) + 0.0 AS agreement_fraction FROM dates GROUP BY band""")
def a25_classes(spark, d):
    a, b = two_dates(spark, d)
    out = agree.compare_rasters(a, b, ["row_i", "band"], ["band"], "code", categorical=True)
    return rounded(out.select("band", "legacy_valid", "corrected_valid", "overlap", "agreement", "agreement_fraction"), "agreement_fraction")


def raster_rows(spark, d) -> DataFrame:
    """Comparison rows per user group and band, the result table of a comparison run."""
    a, b = two_dates(spark, d)
    a, b = a.withColumn("grp", F.col("row_i") % 10), b.withColumn("grp", F.col("row_i") % 10)
    return agree.compare_rasters(a, b, ["row_i", "grp", "band"], ["grp", "band"], "v")


VIEWS["rasterrows"] = """SELECT row_i % 10 AS grp, band, count(a) AS legacy_valid, count(b) AS corrected_valid, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS overlap,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS newly_excluded, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS newly_included, sqrt(avg((b - a) * (b - a))) AS rmse FROM dates GROUP BY 1, 2"""


@query("a44_validity_patterns", """SELECT grp, legacy_valid, corrected_valid, newly_excluded, newly_included, overlap, count(*) AS n_layers, string_agg(band, ';' ORDER BY band) AS layers
 FROM rasterrows GROUP BY grp, legacy_valid, corrected_valid, newly_excluded, newly_included, overlap""")
def a44(spark, d):
    return agree.validity_patterns(raster_rows(spark, d), ["grp"], "band")


@query("w7_extreme_row", """SELECT grp, band, round(rmse, 6) + 0.0 AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY -abs(rmse), band) AS rn FROM rasterrows WHERE rmse IS NOT NULL) WHERE rn = 1""")
def w7(spark, d):
    return rounded(agree.extreme_row(raster_rows(spark, d).select("grp", "band", "rmse"), ["grp"], "rmse", "band", absolute=True), "rmse")


@query("a26_distribution_rows", """SELECT site, matched, field, count(*) AS category_count, count(value) AS finite_count, count(*) - count(value) AS missing_count, round((count(*) - count(value)) / count(*)::DOUBLE, 6) + 0.0 AS missing_fraction,
 round(min(value), 6) + 0.0 AS minimum, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(max(value), 6) + 0.0 AS maximum
 FROM (SELECT site, code IS NOT NULL AND code = 3 AS matched, 'score' AS field, score AS value FROM ev UNION ALL SELECT site, code IS NOT NULL AND code = 3, 'score2', score2 FROM ev) GROUP BY site, matched, field""")
def a26(spark, d):
    e = ev(spark, d).withColumn("matched", F.coalesce(F.col("code") == 3, F.lit(False)))
    return rounded(agree.distribution_rows(e, ["site", "matched"], ["score", "score2"]), "missing_fraction", "minimum", "median", "maximum")


def validation_table(spark, d, part: int) -> DataFrame:
    """A validation result table per user parity: n, AUC, class list."""
    e = ev(spark, d).where(F.col("user_id") % 3 != part)
    e = e.withColumn("kind", F.concat(F.lit("u"), F.col("user_id") % 7))
    b = M.binary_reference(e, layers(spark)).withColumn("score", F.when(F.col("layer") == "alpha", F.col("score")).otherwise(F.col("score2")))
    auc = stats.rank_auc(b, ["kind", "layer"]).where(F.col("n_pos") >= F.when(F.col("kind") == f"u{part}", 10**9).otherwise(1))
    cls = layers(spark).groupBy("layer").agg(class_list(F.collect_set("code")).alias("positive_classes"))
    return auc.join(F.broadcast(cls), "layer").select("kind", "layer", "positive_classes", "auc", (F.col("n_pos") / 2.0).alias("threshold"), "n_pos", "n_neg")


def _validation_sql(part: int) -> str:
    return f"""(SELECT kind, layer, CASE layer WHEN 'alpha' THEN '3' ELSE '5;7' END AS positive_classes, n_pos, n_neg, n_pos / 2.0::DOUBLE AS threshold, (sr - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg) AS auc FROM (
 SELECT kind, layer, count(*) FILTER (WHERE ref = 1) AS n_pos, count(*) FILTER (WHERE ref = 0) AS n_neg, sum(CASE WHEN ref = 1 THEN rk END) AS sr FROM (
 SELECT *, rank() OVER (PARTITION BY kind, layer ORDER BY score) + (count(*) OVER (PARTITION BY kind, layer, score) - 1) / 2.0::DOUBLE AS rk FROM (
  SELECT 'u' || (e.user_id % 7) AS kind, l.layer, l.score, l.ref FROM ev e JOIN lay l ON e.site = l.site AND e.row_i = l.row_i AND e.col_i = l.col_i WHERE e.user_id % 3 <> {part} AND l.score IS NOT NULL AND l.ref IS NOT NULL))
 GROUP BY kind, layer) WHERE n_pos > 0 AND kind <> 'u{part}')"""


@query("j19_compare_results", f"""SELECT o.kind, o.layer, o.positive_classes AS legacy_positive_classes, n.positive_classes AS corrected_positive_classes, o.positive_classes = n.positive_classes AS positive_classes_match,
 round(n.auc - o.auc, 6) + 0.0 AS auc_delta, n.n_pos - o.n_pos AS n_pos_delta, n.n_neg - o.n_neg AS n_neg_delta, n.threshold - o.threshold AS threshold_delta,
 CASE WHEN o.n_pos < 20 AND n.n_pos < 20 THEN 'both_low' WHEN o.n_pos < 20 THEN 'legacy_low' WHEN n.n_pos < 20 THEN 'corrected_low' ELSE '' END AS n_pos_note
 FROM {_validation_sql(0)} o JOIN {_validation_sql(1)} n USING (kind, layer)""")
def j19(spark, d):
    out = agree.compare_results(validation_table(spark, d, 0), validation_table(spark, d, 1), ["kind", "layer"])
    return rounded(out.select("kind", "layer", "legacy_positive_classes", "corrected_positive_classes", "positive_classes_match", "auc_delta", "n_pos_delta", "n_neg_delta", "threshold_delta", "n_pos_note"), "auc_delta")


@query("g2_key_inventory", f"""SELECT kind, layer, CASE WHEN n.auc IS NULL THEN 'legacy_only' WHEN o.auc IS NULL THEN 'corrected_only' ELSE 'shared' END AS presence FROM {_validation_sql(0)} o FULL JOIN {_validation_sql(1)} n USING (kind, layer)""")
def g2(spark, d):
    return agree.key_inventory(validation_table(spark, d, 0), validation_table(spark, d, 1), ["kind", "layer"])


@query("g3_endpoint_stack", """SELECT layer, count(*) AS n, count(score) AS n_score FROM (SELECT 'alpha' AS layer, score FROM ev UNION ALL SELECT 'beta', score2 FROM ev UNION ALL SELECT 'depth', score - score2 FROM ev) GROUP BY layer""")
def g3(spark, d):
    e = ev(spark, d)
    feature = e.select(F.lit("depth").alias("layer"), (F.col("score") - F.col("score2")).alias("score"))
    both = lay(spark, d).select("layer", "score").unionByName(feature)
    return both.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_score"))


def p_table(spark, d) -> DataFrame:
    """Pseudo p-values per user group, some missing: the table an FDR step starts from."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    p = F.col("m") / 200.0
    return e.select("user_id", (F.col("user_id") % 5).alias("family"), F.when(((F.col("user_id") % 11 != 3) | (F.col("user_id") % 5 > 1)) & (p <= 1), p).alias("p_value"), (F.col("user_id") % 2 == 0).alias("confirmatory"))


P_SQL = """(SELECT user_id, user_id % 5 AS family, CASE WHEN (user_id % 11 <> 3 OR user_id % 5 > 1) AND m / 200 <= 1 THEN m / 200 END AS p_value, user_id % 2 = 0 AS confirmatory FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id))"""
BH = """SELECT user_id, family, round(least(1, greatest(0, min(raw) OVER (PARTITION BY {by} ORDER BY rk DESC))), 6) + 0.0 AS q_value FROM
 (SELECT *, p * count(*) OVER (PARTITION BY {by}) / row_number() OVER (PARTITION BY {by} ORDER BY p) AS raw, row_number() OVER (PARTITION BY {by} ORDER BY p) AS rk FROM ({src}))"""


def _bh_sql(by: str, cond: str) -> str:
    use = f"SELECT user_id, family, p_value AS p FROM {P_SQL} WHERE p_value IS NOT NULL AND {cond}"
    rest = f"SELECT user_id, family, CAST(NULL AS DOUBLE) AS q_value FROM {P_SQL} WHERE p_value IS NULL OR NOT ({cond})"
    return BH.format(by=by, src=use) + " UNION ALL " + rest


@query("w3_adjust_p", _bh_sql("1", "true"))
def w3(spark, d):
    return rounded(adjust_p_values(p_table(spark, d).withColumn("all", F.lit(1)), ["all"]).select("user_id", "family", "q_value"), "q_value")


@query("w4_adjust_by_family", _bh_sql("family", "confirmatory"))
def w4(spark, d):
    return rounded(adjust_p_values(p_table(spark, d), ["family"], eligible=F.col("confirmatory")).select("user_id", "family", "q_value"), "q_value")


@query("w4_complete_family", _bh_sql("family", f"family NOT IN (SELECT family FROM {P_SQL} WHERE p_value IS NULL)"))
def w4_complete(spark, d):
    return rounded(adjust_complete_families(p_table(spark, d), ["family"]).select("user_id", "family", "q_value"), "q_value")
