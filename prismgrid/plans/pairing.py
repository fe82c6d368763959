"""Queries on variograms, patches, look-alike pairs, clusters, catalogues, sources and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import patch_name
from ..operators import catalog_joins as J, graph, mask as M, pairs as P, variogram as V
from ..session import checkpoint_dir
from ..sources import pixels as SRC, sinks as SNK
from .registry import N_BANDS, VIEWS, ev, lay, library, pix, qa, query, r6, rounded, table

# ---- variogram --------------------------------------------------------------------------------------

LAG_SQL = "[1, 2, 3, 4, 6, 8, 12, 16, 24]"
VIEWS["vpairs"] = """SELECT a.site, l.lag, dd.dir, a.row_i, a.col_i, (a.score - b.score) * (a.score - b.score) AS sq FROM ev a
 CROSS JOIN (SELECT unnest([1, 2, 3, 4, 6, 8, 12, 16, 24]) AS lag) l CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS dir, unnest([0, 1, 1, 1]) AS dr, unnest([1, 0, 1, -1]) AS dc) dd
 JOIN (SELECT site AS s, least(max(row_i) + 1, max(col_i) + 1) // 4 AS ml FROM ev GROUP BY site) sh ON sh.s = a.site AND l.lag <= sh.ml
 JOIN ev b ON b.site = a.site AND b.row_i = a.row_i + dd.dr * l.lag AND b.col_i = a.col_i + dd.dc * l.lag WHERE a.score IS NOT NULL AND b.score IS NOT NULL"""
VIEWS["vord"] = "SELECT *, row_number() OVER (PARTITION BY site, lag ORDER BY dir, row_i, col_i) - 1 AS o, count(*) OVER (PARTITION BY site, lag) AS n FROM vpairs"


def semivariogram(spark, d, max_pairs: int) -> DataFrame:
    return V.empirical_semivariogram(ev(spark, d), ["site"], "score", 30.0, [1, 2, 3, 4, 6, 8, 12, 16, 24], max_pairs)


@query("a28_semivariogram", """SELECT site, CAST(lag AS INTEGER) AS lag_pixels, lag * 30.0::DOUBLE AS distance, round(0.5 * avg(sq), 6) + 0.0 AS semivariance, count(*) AS available_pairs, count(*) AS used_pairs FROM vord GROUP BY site, lag""")
def a28(spark, d):
    return rounded(semivariogram(spark, d, None), "semivariance")


@query("a28_thinned_semivariogram", """SELECT v.site, CAST(v.lag AS INTEGER) AS lag_pixels, round(0.5 * avg(sq), 6) + 0.0 AS semivariance, max(n) AS available_pairs, count(*) AS used_pairs FROM vord v
 JOIN (SELECT DISTINCT site, lag, CASE WHEN i = 4999 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 4999.0::DOUBLE)) AS BIGINT) END AS o FROM (SELECT DISTINCT site, lag, n FROM vord) CROSS JOIN range(5000) r(i)) k ON k.site = v.site AND k.lag = v.lag AND k.o = v.o
 GROUP BY v.site, v.lag""")
def a28_thin(spark, d):
    return rounded(semivariogram(spark, d, 5000).drop("distance"), "semivariance")


def _fit_sql() -> str:
    """The zooming search over scales, one row per site and candidate, as CTEs that end in ``fit(site, s, nugget, sill)``."""
    out = """pts AS MATERIALIZED (SELECT *, y - avg(y) OVER (PARTITION BY site) AS c FROM (SELECT site, lag * 30.0::DOUBLE AS d, 0.5 * avg(sq) AS y FROM vord GROUP BY site, lag)), fv AS (SELECT site, var_pop(score) AS fv FROM ev GROUP BY site),
 b0 AS (SELECT site, ln(min(d) / 50) AS bottom, ln(max(d) * 200) AS top, ln(min(d) / 50) AS lo, ln(max(d) * 200) AS hi FROM pts GROUP BY site HAVING count(*) >= 3)"""
    for k in range(V.ZOOMS + 1):
        m = V.FIRST_SCALES if k == 0 else V.ZOOM_SCALES
        out += f""",
 t{k} AS (SELECT e.site, bottom, top, lo, hi, i, s, count(*)::DOUBLE AS n, sum(g) AS sg, sum(y) AS sy, sum(g * g) AS sgg, sum(g * y) AS sgy, sum(y * y) AS syy, sum(g * c) AS sgc, sum(c * c) AS scc FROM (SELECT e.*, p.y, p.c, 1 - exp(-p.d / exp(s)) AS g FROM (SELECT b.*, i, lo + (hi - lo) * i / {m - 1}::DOUBLE AS s FROM b{k} b CROSS JOIN range({m}) r(i)) e JOIN pts p ON p.site = e.site) e GROUP BY ALL),
 a{k} AS (SELECT *, (sy - b * sg) / n AS a, CASE WHEN sgg > 0 THEN greatest(sgy / sgg, 0) ELSE 0 END AS slope, greatest(sy / n, 0) AS flat FROM (SELECT *, CASE WHEN sgg - sg * sg / n > 0 THEN sgc / (sgg - sg * sg / n) ELSE 0 END AS b FROM t{k})),
 o{k} AS (SELECT *, CASE WHEN free THEN ef WHEN es <= el THEN es ELSE el END AS e, CASE WHEN free THEN a WHEN es <= el THEN 0 ELSE flat END AS nugget, CASE WHEN free THEN b WHEN es <= el THEN slope ELSE 0 END AS sill FROM (SELECT *, a >= 0 AND b >= 0 AS free, scc - b * sgc AS ef, syy + slope * slope * sgg - 2 * slope * sgy AS es, syy + n * flat * flat - 2 * flat * sy AS el FROM a{k})),
 b{k + 1} AS (SELECT site, bottom, top, greatest(bottom, s - (hi - lo) / {m - 1}::DOUBLE) AS lo, least(top, s + (hi - lo) / {m - 1}::DOUBLE) AS hi, s, nugget, sill FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY e, i) AS r FROM o{k}) WHERE r = 1)"""
    for k in range(1, V.ZOOMS + 1):
        out = out.replace(f"SELECT b.*, i, lo + (hi - lo) * i / {V.ZOOM_SCALES - 1}::DOUBLE AS s FROM b{k} b", f"SELECT b.site, bottom, top, lo, hi, i, lo + (hi - lo) * i / {V.ZOOM_SCALES - 1}::DOUBLE AS s FROM b{k} b")
    return out + f", fit AS (SELECT site, exp(s) AS scale, nugget, sill, -exp(s) * ln(0.05::DOUBLE) AS reach FROM b{V.ZOOMS + 1})"


@query("a29_variogram_fit", f"""WITH {_fit_sql()}, r AS (SELECT p.site, count(*) AS n, max(d) AS last, min(d) FILTER (WHERE y >= 0.95::DOUBLE * fv) AS hit FROM pts p JOIN fv USING (site) GROUP BY p.site),
 j AS (SELECT r.*, f.*, CASE WHEN n < 3 THEN 'fewer_than_three_lags' WHEN sill IS NULL OR sill <= 0 THEN 'nonfinite_or_nonpositive_sill' WHEN reach > last THEN 'fitted_practical_range_beyond_largest_evaluated_lag' END AS reason FROM r LEFT JOIN fit f USING (site))
 SELECT site, CASE WHEN reason IS NULL THEN round(nugget, 3) + 0.0 END AS nugget, CASE WHEN reason IS NULL THEN round(sill, 3) + 0.0 END AS sill, CASE WHEN reason IS NULL THEN round(scale, 3) + 0.0 END AS scale, round(CASE WHEN reason IS NULL THEN reach ELSE coalesce(hit, last) END, 3) + 0.0 AS practical_range,
 CASE WHEN reason IS NULL THEN 'exponential_bounded_least_squares' WHEN hit IS NOT NULL THEN 'empirical_fallback_first_lag_at_95pct_variance' ELSE 'empirical_fallback_largest_evaluated_lag' END AS method, reason FROM j""")
def a29(spark, d):
    v = ev(spark, d).groupBy("site").agg(F.var_pop("score").alias("field_variance"))
    out = V.fit_exponential(semivariogram(spark, d, None), v, ["site"])
    return out.select("site", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("nugget", "sill", "scale", "practical_range")], "method", "reason")


# ---- patches -------------------------------------------------------------------------------------------

VIEWS["tiles"] = """SELECT vec_id // 500 AS scene, row_i % 20 AS row_i, col_i, label - 1 AS code, refl[2] > 0.36 AS invalid, refl, [round(128 + 300 * refl[11]), round(128 + 300 * refl[6]), round(128 + 300 * refl[3])] AS rgb FROM pix"""
VIEWS["patchcode"] = "SELECT scene, row_i // 5 AS patch_row, col_i // 5 AS patch_col, code, count(*) AS n FROM tiles GROUP BY ALL"
VIEWS["patches"] = """SELECT t.scene, t.patch_row, t.patch_col, m.label, m.top / 25.0::DOUBLE AS purity, CASE WHEN bad THEN 'invalid' WHEN m.label < 0 THEN 'no_detection' WHEN m.top / 25.0 < 0.2 THEN 'low_purity' ELSE 'labeled' END AS fate, m0, m1, m2, s0, s1, s2
 FROM (SELECT scene, row_i // 5 AS patch_row, col_i // 5 AS patch_col, bool_or(invalid) AS bad, avg(rgb[1]) AS m0, avg(rgb[2]) AS m1, avg(rgb[3]) AS m2, stddev_pop(rgb[1]) AS s0, stddev_pop(rgb[2]) AS s1, stddev_pop(rgb[3]) AS s2 FROM tiles GROUP BY ALL HAVING count(*) = 25) t
 JOIN (SELECT scene, patch_row, patch_col, max(n) AS top, min(code) FILTER (WHERE n = mx) AS label FROM (SELECT *, max(n) OVER (PARTITION BY scene, patch_row, patch_col) AS mx FROM patchcode) GROUP BY ALL) m USING (scene, patch_row, patch_col)"""


def tiles(spark, d) -> DataFrame:
    r = F.col("refl")
    tone = lambda b: F.round(F.lit(128.0) + F.lit(300.0) * r[b])
    return pix(spark, d).select(
        F.floor(F.col("vec_id") / 500).alias("scene"), (F.col("row_i") % 20).alias("row_i"), "col_i", (F.col("label") - 1).alias("code"), (r[1] > 0.36).alias("invalid"),
        F.array(tone(10), tone(5), tone(2)).alias("rgb"), F.slice("refl", 41, 10).alias("swir"), "refl")


@query("a23_tile_patches", """SELECT scene, CAST(patch_row AS INTEGER) AS patch_row, CAST(patch_col AS INTEGER) AS patch_col, label, purity, round(m0, 6) + 0.0 AS mean_0, round(s1, 6) + 0.0 AS std_1, round(sw, 6) + 0.0 AS swir_0 FROM patches
 JOIN (SELECT scene, row_i // 5 AS patch_row, col_i // 5 AS patch_col, avg(refl[41]) AS sw FROM tiles GROUP BY ALL) USING (scene, patch_row, patch_col) WHERE fate = 'labeled'""")
def a23(spark, d):
    kept, _ = P.tile_patches(tiles(spark, d), ["scene"], 5, 0.2)
    return kept.select("scene", "patch_row", "patch_col", "label", "purity", r6(F.col("rgb_mean")[0]).alias("mean_0"), r6(F.col("rgb_std")[1]).alias("std_1"), r6(F.col("swir_mean")[0]).alias("swir_0"))


@query("a23_discard_counts", """SELECT scene, count(*) AS total, count(*) FILTER (WHERE fate = 'invalid') AS invalid, count(*) FILTER (WHERE fate = 'no_detection') AS no_detection, count(*) FILTER (WHERE fate = 'low_purity') AS low_purity,
 count(*) FILTER (WHERE fate = 'labeled') AS labeled FROM patches GROUP BY scene""")
def a23_counts(spark, d):
    return P.tile_patches(tiles(spark, d), ["scene"], 5, 0.2)[1]


VIEWS["pt"] = """SELECT p_partkey AS id, p_type AS label, CAST(p_size AS DOUBLE) AS m0, p_retailprice - 900 AS m1, CAST(length(p_name) AS DOUBLE) AS m2, CAST(p_partkey % 97 AS DOUBLE) AS s0, CAST(p_partkey % 89 AS DOUBLE) AS s1, CAST(p_size % 7 AS DOUBLE) AS s2,
 [p_size + 1.0::DOUBLE, p_retailprice / 10, p_partkey % 13 + 1.0::DOUBLE, p_partkey % 17 + 1.0::DOUBLE, 40.0::DOUBLE] AS sw FROM part"""
VIEWS["pd"] = """SELECT a.id AS i, b.id AS j, a.label <> b.label AS differ, sqrt((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) + (a.m2 - b.m2) * (a.m2 - b.m2)) AS dm, sqrt((a.s0 - b.s0) * (a.s0 - b.s0) + (a.s1 - b.s1) * (a.s1 - b.s1) + (a.s2 - b.s2) * (a.s2 - b.s2)) AS ds,
 degrees(acos(greatest(-1, least(1, list_inner_product(a.sw, b.sw) / sqrt(list_inner_product(a.sw, a.sw) * list_inner_product(b.sw, b.sw)))))) AS ang FROM pt a JOIN pt b ON a.id < b.id"""
VIEWS["bars"] = "SELECT quantile_cont(dm, 0.02) FILTER (WHERE differ) AS tm, quantile_cont(ds, 0.02) FILTER (WHERE differ) AS ts, quantile_cont(ang, 0.6) FILTER (WHERE NOT differ) AS bar, count(*) FILTER (WHERE differ) AS n_cross FROM pd"
VIEWS["cand"] = "SELECT i, j, dm, ds, ang, bar FROM pd CROSS JOIN bars WHERE differ AND dm <= tm AND ds <= ts"
Q_PAIR = 0.02
NULL_Q = 0.6  # the stand-in spectra of one label are unrelated, so the usual 0.95 bar would keep nothing


def patch_table(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    f = lambda c: c.cast("double")
    return p.select(
        k.alias("id"), F.col("p_type").alias("label"), F.array(f(F.col("p_size")), F.col("p_retailprice") - 900, f(F.length("p_name"))).alias("rgb_mean"),
        F.array(f(k % 97), f(k % 89), f(F.col("p_size") % 7)).alias("rgb_std"),
        F.array(F.col("p_size") + F.lit(1.0), F.col("p_retailprice") / 10, k % 13 + F.lit(1.0), k % 17 + F.lit(1.0), F.lit(40.0)).alias("swir_mean"))


def candidates(spark, d) -> DataFrame:
    return P.ambiguous_pairs(patch_table(spark, d), "id", "label", Q_PAIR, 3)[0]


@query("j11_ambiguous_pairs", "SELECT i, j, round(dm, 6) + 0.0 AS mean_l2, round(ds, 6) + 0.0 AS std_l2 FROM cand")
def j11(spark, d):
    return rounded(candidates(spark, d), "mean_l2", "std_l2")


@query("j11_pair_thresholds", "SELECT round(tm, 6) + 0.0 AS mean_threshold, round(ts, 6) + 0.0 AS std_threshold FROM bars")
def j11_thresholds(spark, d):
    p = patch_table(spark, d)
    a, b = (P.pair_quantile(p, "id", "label", f"rgb_{n}", P.L2, Q_PAIR, P.vector_diameter(p, f"rgb_{n}", 3), True).select(r6("threshold").alias(f"{n}_threshold")) for n in ("mean", "std"))
    return a.join(F.broadcast(b))


@query("j12_separable_pairs", "SELECT i, j, round(ang, 6) + 0.0 AS angle_deg FROM cand WHERE ang > bar")
def j12(spark, d):
    p = patch_table(spark, d)
    out = P.ambiguous_pairs(p, "id", "label", Q_PAIR, 3, above=P.null_angle(p, "id", "label", NULL_Q))[0]
    return rounded(out.select("i", "j", "angle_deg"), "angle_deg")


def all_angles(spark, d) -> DataFrame:
    return P.ambiguous_pairs(patch_table(spark, d), "id", "label", Q_PAIR, 3, above=0.0)[0]


@query("w6_ranked_pairs", "SELECT i, j, CAST(row_number() OVER (ORDER BY round(ang, 9) DESC, i, j) AS BIGINT) AS rank FROM cand WHERE ang > 0")
def w6(spark, d):
    a = all_angles(spark, d).select("i", "j", F.round("angle_deg", 9).alias("angle_deg"))
    return P.ranked_pairs(a).select("i", "j", "rank")


@query("w6_top_pairs", "SELECT i, j, round(ang, 6) + 0.0 AS angle_deg FROM cand WHERE ang > 0 ORDER BY round(ang, 9) DESC, i, j LIMIT 5")
def w6_top(spark, d):
    a = all_angles(spark, d).withColumn("angle_deg", F.round("angle_deg", 9))
    return rounded(P.ranked_pairs(a, 5).select("i", "j", "angle_deg"), "angle_deg")


VIEWS["tight"] = "SELECT i, j FROM pd CROSS JOIN (SELECT quantile_cont(dm, 0.01) FILTER (WHERE differ) AS tm, quantile_cont(ds, 0.01) FILTER (WHERE differ) AS ts FROM pd) WHERE differ AND dm <= tm AND ds <= ts"
COMPONENTS = """WITH RECURSIVE e AS (SELECT i AS u, j AS v FROM tight UNION SELECT j, i FROM tight), reach(node, r) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node),
 c AS (SELECT node, min(r) AS root FROM reach GROUP BY node), s AS (SELECT c.root, count(*) AS size, count(DISTINCT pt.label) AS n_labels FROM c JOIN pt ON pt.id = c.node GROUP BY c.root), k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM s)"""


def cluster_rows(spark, d) -> DataFrame:
    p = patch_table(spark, d)
    e = P.ambiguous_links(p, "id", "label", 0.01, 3)
    return graph.clusters(e, p.select(F.col("id").alias("node"), "label"))


@query("g1_components", COMPONENTS + " SELECT k.cluster_id, c.node, s.size, s.n_labels FROM c JOIN s USING (root) JOIN k USING (root)")
def g1(spark, d):
    return cluster_rows(spark, d)


@query("a40_cluster_accuracy", COMPONENTS + ", o AS (SELECT k.cluster_id, bool_and(c.node % 5 <> 0) AS ok FROM c JOIN k USING (root) GROUP BY k.cluster_id) SELECT count(*) AS n_clusters, count(*) FILTER (WHERE ok) AS n_correct, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS accuracy FROM o")
def a40(spark, d):
    pred = cluster_rows(spark, d).select("cluster_id", (F.col("node") % 5 != 0).alias("correct"))
    return rounded(P.cluster_accuracy(pred), "accuracy")


@query("j17_table_contract", """WITH members AS (SELECT l_suppkey AS cluster_id, l_partkey * 3 AS patch_id FROM lineitem), ends AS (SELECT DISTINCT l_partkey * 2 AS patch_id FROM lineitem UNION SELECT DISTINCT l_suppkey FROM lineitem)
 SELECT 'duplicate_membership' AS "check", patch_id FROM members GROUP BY patch_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'member_without_patch', patch_id FROM members WHERE patch_id NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'pair_without_patch', patch_id FROM ends WHERE patch_id NOT IN (SELECT p_partkey FROM part)""")
def j17(spark, d):
    l = table(spark, d, "lineitem")
    return P.contract_violations(
        table(spark, d, "part").select(F.col("p_partkey").alias("patch_id")), l.select((F.col("l_partkey") * 2).alias("i"), F.col("l_suppkey").alias("j")),
        l.select(F.col("l_suppkey").alias("cluster_id"), (F.col("l_partkey") * 3).alias("patch_id")))


# ---- catalogues ----------------------------------------------------------------------------------------------

VIEWS["gran"] = """SELECT o_orderkey AS granule, o_orderstatus AS site, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'O' OR o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice % 100, 2) + CASE WHEN o_orderstatus = 'P' THEN 11 ELSE 0 END END AS cloud, (o_custkey % 20) / 10.0::DOUBLE AS lon_min, (o_custkey % 20) / 10.0::DOUBLE + 3 AS lon_max,
 (o_orderkey % 30) / 10.0::DOUBLE AS lat_min, (o_orderkey % 30) / 10.0::DOUBLE + 3.5::DOUBLE AS lat_max FROM orders"""
VIEWS["granover"] = """SELECT *, greatest(0, least(lon_max, 3.0) - greatest(lon_min, 1.5)) * greatest(0, least(lat_max, 3.2) - greatest(lat_min, 1.2)) / (1.5 * 2.0)::DOUBLE AS overlap FROM gran"""


def granules(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    lon, lat = (F.col("o_custkey") % 20) / 10.0, (F.col("o_orderkey") % 30) / 10.0
    g = o.select(
        F.col("o_orderkey").alias("granule"), F.col("o_orderstatus").alias("site"), F.to_date("o_orderdate").alias("date"),
        F.when((F.col("o_orderstatus") != "O") & (F.col("o_orderkey") % 5 != 0), F.round(F.col("o_totalprice") % 100, 2) + F.when(F.col("o_orderstatus") == "P", 11).otherwise(0)).alias("cloud"),
        lon.alias("lon_min"), (lon + 3).alias("lon_max"), lat.alias("lat_min"), (lat + 3.5).alias("lat_max"))
    box = g.select("site").distinct().select("site", *[F.lit(v).alias(n) for n, v in (("s_lon_min", 1.5), ("s_lon_max", 3.0), ("s_lat_min", 1.2), ("s_lat_max", 3.2))])
    return g, box


@query("j21_granule_rank", """WITH k AS (SELECT *, coalesce(cloud <= 10, false) AS clear, coalesce(bool_or(cloud <= 10) OVER (PARTITION BY site), false) AS anyclear FROM granover WHERE overlap >= 0.99)
 SELECT site, granule, NOT anyclear AS fallback, CAST(rn AS INTEGER) AS rank, round(overlap, 6) + 0.0 AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(cloud, 1000), date, granule) AS rn FROM k WHERE clear OR NOT anyclear) WHERE rn <= 5""")
def j21(spark, d):
    g, box = granules(spark, d)
    return rounded(J.rank_granules(g, box, ["site"], 5).select("site", "granule", "fallback", "rank", "overlap"), "overlap")


@query("j22_repeat_pairs", """WITH s AS (SELECT o_custkey AS site, o_orderkey AS scene, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS anchor FROM orders)
 SELECT a.site, a.scene AS first, b.scene AS second, CASE WHEN a.anchor THEN 'primary' ELSE 'secondary' END AS kind FROM s a JOIN s b ON a.site = b.site AND ((a.anchor AND NOT b.anchor) OR (NOT a.anchor AND NOT b.anchor AND a.scene < b.scene))""")
def j22(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("scene"))
    a = o.groupBy("site").agg(F.min("scene").alias("_a"))
    s = o.join(a, "site").select("site", "scene", F.when(F.col("scene") == F.col("_a"), "anchor").otherwise("repeat").alias("role"))
    return J.repeat_pairs(s, ["site"])


VIEWS["xmap"] = """SELECT s_nationkey % 4 AS grp, s_nationkey AS idx, CASE WHEN s_suppkey % 3 = 0 THEN 'unmapped' ELSE 'mapped' END AS status, CASE WHEN s_suppkey % 7 <> 1 THEN s_suppkey END AS target, CASE WHEN s_suppkey % 5 = 0 THEN 'no_match' END AS reason FROM supplier"""


def crosswalk(spark, d) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    k = F.col("s_suppkey")
    m = s.select((F.col("s_nationkey") % 4).alias("grp"), F.col("s_nationkey").alias("idx"), F.when(k % 3 == 0, "unmapped").otherwise("mapped").alias("status"), F.when(k % 7 != 1, k).alias("target"), F.when(k % 5 == 0, "no_match").alias("reason"))
    return n.select((F.col("n_nationkey") % 5).alias("grp"), F.col("n_nationkey").alias("idx")), m


@query("j16_crosswalk", """WITH r AS (SELECT n_nationkey % 5 AS grp, n_nationkey AS idx FROM nation), m AS (SELECT grp, idx, count(*) AS n FROM xmap GROUP BY grp, idx)
 SELECT 'record_without_mapping' AS violation, grp, idx FROM r WHERE (grp, idx) NOT IN (SELECT (grp, idx) FROM m) UNION ALL SELECT 'mapping_without_record', grp, idx FROM m WHERE (grp, idx) NOT IN (SELECT (grp, idx) FROM r)
 UNION ALL SELECT 'duplicate_mapping', grp, idx FROM m WHERE n > 1 UNION ALL SELECT 'mapped_without_target', grp, idx FROM xmap WHERE status = 'mapped' AND target IS NULL UNION ALL SELECT 'unmapped_without_reason', grp, idx FROM xmap WHERE status <> 'mapped' AND reason IS NULL""")
def j16(spark, d):
    return J.crosswalk_violations(*crosswalk(spark, d))


@query("x25_endpoint_groups", "SELECT grp, string_agg(CAST(idx AS VARCHAR), ';' ORDER BY idx) AS targets FROM (SELECT DISTINCT grp, idx FROM xmap WHERE status = 'mapped') GROUP BY grp")
def x25(spark, d):
    return J.endpoint_groups(crosswalk(spark, d)[1], ["grp"], "idx")


@query("io10_scene_inventory", """SELECT l_orderkey AS scene, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS categories, bool_or(l_linestatus = 'O') AS has_asset, count(*) AS n_rows FROM lineitem
 WHERE l_quantity < 30 AND l_quantity + 4 > 10 AND l_discount * 100 < 8 AND l_discount * 100 + 4 > 5 GROUP BY l_orderkey""")
def io10(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("lon"), (F.col("l_discount") * 100).alias("lat"), F.lit(4.0).alias("width"), F.col("l_linestatus").alias("asset"))
    return J.scene_inventory(rows, (10.0, 5.0, 30.0, 8.0), "O")


# ---- sources and sinks -------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"out-{uuid.uuid4().hex}")


@query("io1_scene_scan", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total FROM embeddings WHERE label >= 3")
def io1(spark, d):
    schema = "vec_id bigint, embedding array<float>, label int"
    from pyspark.sql.types import _parse_datatype_string as parse

    df = SRC.read_pixels(spark, f"{d}/embeddings.parquet", parse(schema), F.col("label") >= 3, "embedding")
    return df.select("vec_id", "label", r6(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def library_files(spark, d) -> DataFrame:
    p = pix(spark, d)
    vid = F.col("vec_id")
    token = F.when(vid % 13 == 5, "_OTHER").when(vid % 2 == 0, "_ASDFRa").otherwise("_BECKb")
    # some names go on after the mineral, some carry another collection
    name = F.concat(
        F.when(vid % 19 == 6, "set2_").otherwise("set1_"), F.when(vid % 11 == 0, "M").otherwise("m"), F.col("label"),
        F.when(vid % 17 == 4, "ite").otherwise(""), F.lit("_"), vid, token, F.lit(".txt"))
    cells = F.transform("refl", lambda v: F.when(v >= -0.2, v).otherwise(F.lit(-1.23e34)).cast("string"))
    kept = F.when(vid % 7 == 3, F.slice(cells, 1, 60)).otherwise(cells)
    return p.select(name.alias("file_name"), F.concat(F.lit("header line\n"), F.array_join(kept, "\n"), F.lit("\n")).alias("value"))


@query("io2_library_parse", """SELECT 'm' || label AS mineral, 'set1_' || CASE WHEN vec_id % 11 = 0 THEN 'M' ELSE 'm' END || label || CASE WHEN vec_id % 17 = 4 THEN 'ite' ELSE '' END || '_' || vec_id || CASE WHEN vec_id % 2 = 0 THEN '_ASDFRa' ELSE '_BECKb' END AS sample, CASE WHEN vec_id % 2 = 0 THEN 'ASD' ELSE 'BECK' END AS spectrometer,
 CAST(list_count(list_filter(refl, lambda v: v >= -0.2)) AS INTEGER) AS n_present, round(list_sum(list_filter(refl, lambda v: v >= -0.2)), 5) + 0.0 AS total FROM pix WHERE vec_id % 7 <> 3 AND vec_id % 13 <> 5 AND vec_id % 17 <> 4 AND vec_id % 19 <> 6""")
def io2(spark, d):
    files = library_files(spark, d)
    sizes = spark.createDataFrame([("ASD", N_BANDS), ("BECK", N_BANDS)], "spectrometer string, n_bands int")
    good, _ = SRC.parse_library(files, [f"m{i}" for i in range(10)], sizes, "set1")
    present = F.filter("refl", lambda v: v.isNotNull())
    return good.select("mineral", "sample", "spectrometer", F.size(present).alias("n_present"), (F.round(F.aggregate(present, F.lit(0.0), lambda s, v: s + v), 5) + F.lit(0.0)).alias("total"))


# micrometres; the second spectrometer has other bands, one of them deleted
AXES = {"set1_Wavelengths_ASDFR.txt": [0.4 + 0.033 * b for b in range(N_BANDS)], "set1_Wavelengths_BECK.txt": [0.41 + 0.0315 * b if b != 20 else -1.23e34 for b in range(N_BANDS)]}
SENSOR_NM = [410.0 + 71.5 * i for i in range(32)]
VIEWS["libtext"] = """SELECT *, CASE WHEN vec_id % 13 = 5 THEN NULL WHEN vec_id % 2 = 0 THEN 'ASD' ELSE 'BECK' END AS spectrometer, CASE WHEN vec_id % 19 = 6 THEN 'set2_' ELSE 'set1_' END || CASE WHEN vec_id % 11 = 0 THEN 'M' ELSE 'm' END || label || CASE WHEN vec_id % 17 = 4 THEN 'ite' ELSE '' END || '_' || vec_id || CASE WHEN vec_id % 13 = 5 THEN '_OTHER' WHEN vec_id % 2 = 0 THEN '_ASDFRa' ELSE '_BECKb' END AS sample,
 CASE WHEN vec_id % 19 = 6 OR vec_id % 17 = 4 THEN 'unknown_mineral' WHEN vec_id % 13 = 5 THEN 'unknown_spectrometer' WHEN vec_id % 7 = 3 THEN 'length_mismatch' END AS reason FROM pix"""


def library_tree(spark, d) -> DataFrame:
    """Value files and the wavelength files of both spectrometers."""
    axes = [(name, "micrometres\n" + "\n".join(map(repr, values)) + "\n") for name, values in AXES.items()]
    return library_files(spark, d).unionByName(spark.createDataFrame(axes, "file_name string, value string"))


def on_sensor(spark, d) -> tuple[DataFrame, DataFrame]:
    targets = spark.createDataFrame(list(enumerate(SENSOR_NM)), "target_index int, target_nm double")
    return SRC.library_on_axis(library_tree(spark, d), [f"m{i}" for i in range(10)], "set1", targets)


@query("io2_library_on_sensor", """WITH s AS (SELECT 'm' || label AS mineral, sample, spectrometer, CASE WHEN spectrometer = 'ASD' THEN 400 + 33.0::DOUBLE * b ELSE 410 + 31.5::DOUBLE * b END AS wl, refl[b + 1] AS value FROM libtext CROSS JOIN range(64) r(b) WHERE reason IS NULL AND refl[b + 1] >= -0.2 AND NOT (spectrometer = 'BECK' AND b = 20)),
 g AS (SELECT DISTINCT 'm' || label AS mineral, sample, spectrometer, i, 410.0::DOUBLE + 71.5::DOUBLE * i AS t FROM libtext CROSS JOIN range(32) r(i) WHERE reason IS NULL),
 n AS (SELECT g.*, max(s.wl) FILTER (WHERE s.wl <= g.t + 1e-7) AS w0, arg_max(s.value, s.wl) FILTER (WHERE s.wl <= g.t + 1e-7) AS v0, min(s.wl) FILTER (WHERE s.wl >= g.t - 1e-7) AS w1, arg_min(s.value, s.wl) FILTER (WHERE s.wl >= g.t - 1e-7) AS v1 FROM g LEFT JOIN s ON s.sample = g.sample GROUP BY ALL)
 SELECT mineral, sample, spectrometer, CAST(i AS INTEGER) AS target_index, round(CASE WHEN w1 - w0 < 1e-6 THEN v0 WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (t - w0) / (w1 - w0) END, 5) + 0.0 AS value FROM n""")
def io2_sensor(spark, d):
    good, _ = on_sensor(spark, d)
    return good.select("mineral", "sample", "spectrometer", "target_index", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("io2_library_rejects", "SELECT sample, spectrometer, reason FROM libtext WHERE reason IS NOT NULL")
def io2_rejects(spark, d):
    _, rejects = on_sensor(spark, d)
    return rejects.select("sample", "spectrometer", "reason")


@query("io4_fill_values", """SELECT CAST(i AS INTEGER) AS band_index, count(CASE WHEN v >= -0.3 AND i % 16 <> 15 THEN v END) AS n_present, round(sum(CASE WHEN v >= -0.3 AND i % 16 <> 15 THEN v END), 5) + 0.0 AS total FROM (SELECT unnest(range(64)) AS i, unnest(refl) AS v FROM pix) GROUP BY i""")
def io4(spark, d):
    coded = pix(spark, d).select(F.transform("refl", lambda v: F.when(v >= -0.3, v).otherwise(F.lit(-9999.0))).alias("refl"))
    clean = coded.select(M.null_fill("refl", [b % 16 != 15 for b in range(N_BANDS)]).alias("refl"))
    return clean.select(F.posexplode("refl").alias("band_index", "v")).groupBy("band_index").agg(F.count("v").alias("n_present"), (F.round(F.sum("v"), 5) + F.lit(0.0)).alias("total"))


@query("io5_layer_sink", "SELECT CAST(site AS INTEGER) AS scene_id, layer, count(*) AS n, round(sum(score), 4) + 0.0 AS total FROM lay GROUP BY site, layer")
def io5(spark, d):
    path = scratch(spark)
    SNK.write_layers(lay(spark, d).withColumnRenamed("site", "scene_id"), path)
    return spark.read.parquet(path).groupBy("scene_id", "layer").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("score"), 4) + F.lit(0.0)).alias("total"))


@query("io6_result_table", "SELECT printf('%d', site) AS site, printf('%d', row_i) AS row_i, coalesce(printf('%.6f', score), '') AS score FROM (SELECT site, row_i, max(score) FILTER (WHERE code = 3 AND col_i > 80) AS score FROM ev GROUP BY site, row_i)")
def io6(spark, d):
    e = ev(spark, d).groupBy("site", "row_i").agg(F.max(F.when((F.col("code") == 3) & (F.col("col_i") > 80), F.col("score"))).alias("score"))
    return SNK.formatted(e, ["site", "row_i", "score"])


def chip_rows(spark, d) -> DataFrame:
    t = tiles(spark, d)
    kept, _ = P.tile_patches(t, ["scene"], 5, 0.2)
    kept = kept.withColumn("patch_id", patch_name(F.concat(F.lit("s"), "scene"), F.col("patch_row"), F.col("patch_col")))
    return SNK.chips(t.select("scene", "row_i", "col_i", "refl"), kept, ["scene"], 5)


@query("io7_patch_chips", """SELECT 's' || t.scene || '_r' || p.patch_row || '_c' || p.patch_col AS patch_id, t.row_i, t.col_i, CAST(p.patch_row * 5 + 2 AS INTEGER) AS center_row, CAST(p.patch_col * 5 + 2 AS INTEGER) AS center_col, round(t.refl[64], 6) + 0.0 AS last_band
 FROM tiles t JOIN patches p ON p.scene = t.scene AND p.patch_row = t.row_i // 5 AND p.patch_col = t.col_i // 5 WHERE p.fate = 'labeled'""")
def io7(spark, d):
    return chip_rows(spark, d).select("patch_id", "row_i", "col_i", "center_row", "center_col", r6(F.col("refl")[63]).alias("last_band"))


@query("io8_round_trip", """SELECT count(*) AS n_source, 0::BIGINT AS n_different FROM tiles t JOIN patches p ON p.scene = t.scene AND p.patch_row = t.row_i // 5 AND p.patch_col = t.col_i // 5 WHERE p.fate = 'labeled'""")
def io8(spark, d):
    path = scratch(spark)
    src = chip_rows(spark, d).select("patch_id", "scene", "row_i", "col_i", "refl")
    SNK.write_chips(src, path)
    diff = SNK.round_trip_differences(spark.read.parquet(path), src, ["scene", "row_i", "col_i"], "refl").agg(F.count(F.lit(1)).alias("n_different"))
    return src.agg(F.count(F.lit(1)).alias("n_source")).join(F.broadcast(diff))


@query("io9_checksum_manifest", """SELECT 's' || scene || '_r' || patch_row || '_c' || patch_col AS patch_id, CASE WHEN patch_col = 1 THEN 'changed' ELSE 'extra' END AS status FROM patches WHERE fate = 'labeled' AND patch_col IN (1, 2)""")
def io9(spark, d):
    path = scratch(spark)
    SNK.write_chips(chip_rows(spark, d).select("patch_id", "scene", "row_i", "col_i", "refl"), path)
    seen = SRC.checksum_manifest(spark, path, ".parquet")
    declared = seen.withColumn("sha256", F.when(F.contains("path", F.lit("_c1/")), F.sha2("path", 256)).otherwise(F.col("sha256")))
    extra = F.contains("path", F.lit("_c2/"))
    return SRC.manifest_differences(declared.where(~extra), seen).select(F.regexp_extract("path", r"patch_id=([^/]+)/", 1).alias("patch_id"), "status")
