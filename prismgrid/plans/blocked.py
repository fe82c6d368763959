"""Queries on spatial blocks: construction, cross-fitting, bootstrap, permutation, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import rules
from ..functions.grid import class_list, col_of, flat_index, patch_name, row_of
from ..operators import agree, blocks as K, crossfit as C, packets, resample as R, stats
from ..operators.inference import governed_interval, null_summary
from ..session import cut
from .registry import VIEWS, ev, lay, query, r6, rounded, table

SIDE, HALO, REPS, PERMS = 20, 3, 200, 12

VIEWS["shape"] = "SELECT site, max(row_i) + 1 AS n_rows, max(col_i) + 1 AS n_cols FROM ev GROUP BY site"
VIEWS["blocks"] = """SELECT site, CAST(br AS INTEGER) AS block_row, CAST(bc AS INTEGER) AS block_col, printf('r%04d_c%04d', br, bc) AS block_id, CAST(br * (n_cols // 20) + bc + 1 AS INTEGER) AS numeric_block_id,
 CAST(br * 20 AS INTEGER) AS row_start, CAST(br * 20 + 20 AS INTEGER) AS row_stop, CAST(bc * 20 AS INTEGER) AS col_start, CAST(bc * 20 + 20 AS INTEGER) AS col_stop
 FROM (SELECT site, n_cols, br, unnest(range(n_cols // 20)) AS bc FROM (SELECT site, n_cols, n_rows, unnest(range(n_rows // 20)) AS br FROM shape))"""
VIEWS["train"] = """SELECT h.site, h.block_id AS fold, b.block_id FROM blocks h JOIN blocks b ON h.site = b.site AND h.block_id <> b.block_id
 WHERE NOT (b.row_start < h.row_stop + 3 AND b.row_stop > h.row_start - 3 AND b.col_start < h.col_stop + 3 AND b.col_stop > h.col_start - 3)"""
VIEWS["cnt"] = "SELECT site, layer, block_id, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM obs GROUP BY site, layer, block_id, score"
VIEWS["btot"] = "SELECT site, layer, block_id, CAST(sum(pos) AS BIGINT) AS bp, CAST(sum(neg) AS BIGINT) AS bn FROM cnt GROUP BY site, layer, block_id"
VIEWS["thr"] = """SELECT site, layer, fold, nt, max(score) AS threshold, max(j) AS j FROM (SELECT *, max(j) OVER (PARTITION BY site, layer, fold) AS mj FROM (
 SELECT s.site, s.layer, s.fold, s.score, n.nt, round(sum(s.wp) OVER w / n.np - sum(s.wn) OVER w / n.nn, 12) AS j FROM
 (SELECT c.site, c.layer, t.fold, c.score, sum(CASE WHEN c.pos > 0 THEN c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN c.neg / b.bn::DOUBLE ELSE 0 END) AS wn
  FROM train t JOIN cnt c ON t.site = c.site AND t.block_id = c.block_id JOIN btot b ON b.site = c.site AND b.layer = c.layer AND b.block_id = c.block_id GROUP BY c.site, c.layer, t.fold, c.score) s
 JOIN (SELECT b.site, b.layer, t.fold, count(*) FILTER (WHERE bp > 0) AS np, count(*) FILTER (WHERE bn > 0) AS nn, count(*) AS nt FROM train t JOIN btot b ON t.site = b.site AND t.block_id = b.block_id
  GROUP BY b.site, b.layer, t.fold) n ON n.site = s.site AND n.layer = s.layer AND n.fold = s.fold WHERE n.np > 0 AND n.nn > 0
 WINDOW w AS (PARTITION BY s.site, s.layer, s.fold ORDER BY s.score DESC))) WHERE j = mj GROUP BY site, layer, fold, nt"""
VIEWS["oof"] = """SELECT o.site, o.layer, o.block_id, o.row_i, o.col_i, o.score, o.ref, t.threshold, CASE WHEN t.threshold IS NOT NULL THEN CASE WHEN o.score >= t.threshold THEN 1 ELSE 0 END END AS pred
 FROM obs o LEFT JOIN thr t ON t.site = o.site AND t.layer = o.layer AND t.fold = o.block_id"""
VIEWS["bidx"] = """SELECT site, layer, block_id, row_number() OVER (PARTITION BY site, layer ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site, layer) AS nb FROM btot"""
VIEWS["weights"] = """SELECT d.site, d.layer, d.rep, i.block_id, count(*) AS w FROM (SELECT site, layer, r.rep, ('0x' || substr(md5(concat_ws(':', '7', r.rep, idx)), 1, 8))::BIGINT % nb AS didx
 FROM bidx CROSS JOIN range(200) r(rep)) d JOIN bidx i ON i.site = d.site AND i.layer = d.layer AND i.idx = d.didx GROUP BY d.site, d.layer, d.rep, i.block_id"""
VIEWS["umat"] = """SELECT p.site, p.layer, p.block_id AS p_block, n.block_id AS n_block, sum(p.pos * n.neg * CASE WHEN n.score < p.score THEN 1.0::DOUBLE WHEN n.score = p.score THEN 0.5::DOUBLE ELSE 0 END) AS u
 FROM cnt p JOIN cnt n ON p.site = n.site AND p.layer = n.layer AND p.pos > 0 AND n.neg > 0 AND n.score <= p.score GROUP BY p.site, p.layer, p.block_id, n.block_id"""
VIEWS["bconf"] = """SELECT site, layer, block_id, count(*) FILTER (WHERE pred = 1 AND ref = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND ref = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND ref = 0) AS tn,
 count(*) FILTER (WHERE pred = 0 AND ref = 1) AS fn FROM oof WHERE pred IS NOT NULL GROUP BY site, layer, block_id"""
VIEWS["bootauc"] = """SELECT d.site, d.layer, d.rep, d.bp, d.bn, CASE WHEN d.bp * d.bn > 0 THEN coalesce(n.num, 0) / (d.bp::DOUBLE * d.bn) END AS auc FROM
 (SELECT w.site, w.layer, w.rep, CAST(sum(w.w * b.bp) AS BIGINT) AS bp, CAST(sum(w.w * b.bn) AS BIGINT) AS bn FROM weights w JOIN btot b ON w.site = b.site AND w.layer = b.layer AND w.block_id = b.block_id GROUP BY w.site, w.layer, w.rep) d
 LEFT JOIN (SELECT a.site, a.layer, a.rep, sum(a.w * b.w * u.u) AS num FROM umat u JOIN weights a ON a.site = u.site AND a.layer = u.layer AND a.block_id = u.p_block
  JOIN weights b ON b.site = u.site AND b.layer = u.layer AND b.block_id = u.n_block AND b.rep = a.rep GROUP BY a.site, a.layer, a.rep) n ON n.site = d.site AND n.layer = d.layer AND n.rep = d.rep"""
VIEWS["bootmet"] = """SELECT a.site, a.layer, a.rep, a.auc, a.bp / nullif(a.bp + a.bn, 0)::DOUBLE AS prevalence, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS positive_f1, 2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE AS negative_f1
 FROM bootauc a LEFT JOIN (SELECT w.site, w.layer, w.rep, CAST(sum(w.w * tp) AS BIGINT) AS tp, CAST(sum(w.w * fp) AS BIGINT) AS fp, CAST(sum(w.w * tn) AS BIGINT) AS tn, CAST(sum(w.w * fn) AS BIGINT) AS fn
  FROM weights w JOIN bconf b ON w.site = b.site AND w.layer = b.layer AND w.block_id = b.block_id GROUP BY w.site, w.layer, w.rep) c ON c.site = a.site AND c.layer = a.layer AND c.rep = a.rep"""
VIEWS["bootlong"] = """SELECT site, layer, rep, unnest(['auc', 'balanced_accuracy', 'positive_f1', 'negative_f1', 'macro_f1', 'tpr', 'fpr', 'prevalence']) AS metric,
 unnest([auc, 0.5::DOUBLE * (tpr + 1 - fpr), positive_f1, negative_f1, 0.5::DOUBLE * (positive_f1 + negative_f1), tpr, fpr, prevalence]) AS value FROM bootmet"""
VIEWS["bootci"] = """SELECT site, layer, metric, count(value) AS valid_replicates, CASE WHEN count(value) >= 190 THEN quantile_cont(value, 0.025) END AS lower, CASE WHEN count(value) >= 190 THEN quantile_cont(value, 0.975) END AS upper
 FROM bootlong GROUP BY site, layer, metric"""
VIEWS["pooled"] = """SELECT site, layer, n_pos, n_neg, auc, tp, fp, tn, fn, n_pos / (n_pos + n_neg)::DOUBLE AS prevalence, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN tp / (tp + fn)::DOUBLE END AS tpr,
 CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN fp / (fp + tn)::DOUBLE END AS fpr, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END AS positive_f1,
 CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) END AS negative_f1
 FROM (SELECT u.site, u.layer, np AS n_pos, nn AS n_neg, num / (np::DOUBLE * nn) AS auc, tp, fp, tn, fn FROM (SELECT site, layer, sum(u) AS num FROM umat GROUP BY site, layer) u
  JOIN (SELECT site, layer, CAST(sum(bp) AS BIGINT) AS np, CAST(sum(bn) AS BIGINT) AS nn FROM btot GROUP BY site, layer) b ON u.site = b.site AND u.layer = b.layer
  JOIN (SELECT site, layer, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM bconf GROUP BY site, layer) c ON c.site = u.site AND c.layer = u.layer)"""
VIEWS["bearing"] = """SELECT site, layer, count(*) FILTER (WHERE bp > 0) AS positive_blocks, count(*) FILTER (WHERE bn > 0) AS negative_blocks, CAST(sum(bp) AS BIGINT) AS n_pos, CAST(sum(bn) AS BIGINT) AS n_neg,
 CASE WHEN least(count(*) FILTER (WHERE bp > 0), count(*) FILTER (WHERE bn > 0)) < 5 THEN 'counts_and_maps_only' WHEN least(count(*) FILTER (WHERE bp > 0), count(*) FILTER (WHERE bn > 0)) < 10 THEN 'exploratory_only'
 ELSE 'confirmatory_eligible' END AS tier FROM btot GROUP BY site, layer"""

KEYS = ["site", "layer"]


def grids(spark, d) -> DataFrame:
    return K.grid_shape(ev(spark, d), ["site"])


def block_table(spark, d) -> DataFrame:
    return K.complete_blocks(grids(spark, d), ["site"], SIDE)


def samples(spark, d) -> DataFrame:
    return K.in_complete_blocks(lay(spark, d), grids(spark, d), ["site"], SIDE)


def training(spark, d) -> DataFrame:
    return K.training_pairs(block_table(spark, d), ["site"], HALO)


def out_of_fold(spark, d) -> DataFrame:
    return C.cross_fit(samples(spark, d), training(spark, d), KEYS)


@query("a30_block_dimensions", """SELECT site, CAST(greatest(1, ceil(2 * max(r) / 30)) AS INTEGER) AS side, CAST(greatest(1, ceil(max(r) / 30)) AS INTEGER) AS halo
 FROM (SELECT site, user_id, avg(score) * 5 AS r FROM ev GROUP BY site, user_id) GROUP BY site""")
def a30(spark, d):
    r = ev(spark, d).groupBy("site", "user_id").agg((F.avg("score") * 5.0).alias("practical_range"))
    return K.block_dimensions(r, ["site"], 30.0)


@query("a31_complete_blocks", "SELECT * FROM blocks")
def a31(spark, d):
    return block_table(spark, d)


@query("j24_block_samples", "SELECT site, layer, block_id, count(*) AS n, count(score) AS n_score, count(ref) AS n_ref FROM blk GROUP BY site, layer, block_id")
def j24(spark, d):
    return samples(spark, d).groupBy(*KEYS, "block_id").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_score"), F.count("ref").alias("n_ref"))


@query("j24_broken_blocks", """SELECT site, block_id, count(*) AS n_cells, max(row_i) - min(row_i) + 1 AS height, max(col_i) - min(col_i) + 1 AS width FROM blk WHERE layer = 'alpha' AND score IS NOT NULL
 GROUP BY site, block_id HAVING count(*) <> 400 OR max(row_i) - min(row_i) + 1 <> 20 OR max(col_i) - min(col_i) + 1 <> 20""")
def j24_broken(spark, d):
    x = samples(spark, d).where((F.col("layer") == "alpha") & F.col("score").isNotNull())
    return K.broken_blocks(x, ["site"], SIDE)


@query("j25_overlap_blocks", """SELECT site, block_id FROM (SELECT site, printf('r%04d_c%04d', row_i // 20, col_i // 20) AS block_id, score, score2 FROM ev) WHERE score IS NOT NULL AND score2 IS NOT NULL AND (score > 150) GROUP BY site, block_id""")
def j25(spark, d):
    e = K.in_complete_blocks(ev(spark, d).withColumn("score", F.when(F.col("score") > 150, F.col("score"))), grids(spark, d), ["site"], SIDE)
    return K.overlap_blocks(e, ["site"], "score", "score2")


@query("j9_halo_training", "SELECT site, fold, count(*) AS n_training FROM train GROUP BY site, fold")
def j9(spark, d):
    return training(spark, d).groupBy("site", "fold").agg(F.count(F.lit(1)).alias("n_training"))


@query("j9_halo_cells", """SELECT e.site, b.block_id AS fold, count(*) AS n_cells FROM ev e JOIN blocks b ON e.site = b.site AND e.row_i >= b.row_start - 3 AND e.row_i < b.row_stop + 3 AND e.col_i >= b.col_start - 3 AND e.col_i < b.col_stop + 3
 GROUP BY e.site, b.block_id""")
def j9_cells(spark, d):
    c = K.halo_cells(ev(spark, d).select("site", "row_i", "col_i"), block_table(spark, d), ["site"], SIDE, HALO)
    return c.groupBy("site", "fold").agg(F.count(F.lit(1)).alias("n_cells"))


@query("j10_fold_checks", """WITH b AS (SELECT site, block_id || CASE WHEN block_row = 1 THEN '' ELSE 'x' END AS block_id, row_start, row_stop + CASE WHEN block_col = 0 THEN 2 ELSE 0 END AS row_stop, col_start, col_stop FROM blocks
  UNION ALL SELECT site, block_id, row_start, row_start, col_start, col_stop FROM blocks WHERE block_row = 1 AND block_col = 2)
 SELECT site, block_id, 'bad_bounds' AS violation FROM b WHERE row_start >= row_stop UNION ALL
 SELECT site, block_id, 'duplicate_id' FROM b GROUP BY site, block_id HAVING count(*) > 1 UNION ALL
 SELECT DISTINCT x.site, x.block_id, 'overlap' FROM b x JOIN b y ON x.site = y.site AND x.block_id <> y.block_id AND x.row_start < y.row_stop AND x.row_stop > y.row_start AND x.col_start < y.col_stop AND x.col_stop > y.col_start""")
def j10(spark, d):
    t = block_table(spark, d)
    b = t.select("site", F.concat("block_id", F.when(F.col("block_row") == 1, "").otherwise("x")).alias("block_id"), "row_start",
                 (F.col("row_stop") + F.when(F.col("block_col") == 0, 2).otherwise(0)).alias("row_stop"), "col_start", "col_stop")
    bad = t.where("block_row = 1 AND block_col = 2").select("site", "block_id", "row_start", F.col("row_start").alias("row_stop"), "col_start", "col_stop")
    return K.fold_checks(b.unionByName(bad), ["site"])


@query("a27_bearing_blocks", "SELECT * FROM bearing")
def a27(spark, d):
    return K.bearing_blocks(samples(spark, d), KEYS)


@query("s9_class_support", "SELECT layer, site, count(*) FILTER (WHERE bp > 0) AS positive_blocks, count(*) FILTER (WHERE bn > 0) AS negative_blocks, CAST(sum(bp + bn) AS BIGINT) AS n_support FROM btot GROUP BY layer, site")
def s9(spark, d):
    return K.bearing_blocks(samples(spark, d), KEYS).select(*KEYS, "positive_blocks", "negative_blocks", (F.col("n_pos") + F.col("n_neg")).alias("n_support"))


@query("s10_ids", """SELECT site, block_id, printf('s%d_r%d_c%d', site, block_row, block_col) AS patch_id, string_agg(DISTINCT CAST(k AS VARCHAR), ';' ORDER BY CAST(k AS VARCHAR)) AS codes
 FROM blocks JOIN (SELECT site AS s, row_i // 20 AS r, col_i // 20 AS c, k % 10 AS k FROM ev) e ON e.s = site AND e.r = block_row AND e.c = block_col GROUP BY site, block_id, block_row, block_col""")
def s10(spark, d):
    e = K.in_complete_blocks(ev(spark, d), grids(spark, d), ["site"], SIDE)
    br, bc = F.floor(F.col("row_i") / SIDE), F.floor(F.col("col_i") / SIDE)
    return e.groupBy("site", "block_id", br.alias("br"), bc.alias("bc")).agg(class_list(F.collect_set((F.col("k") % 10))).alias("codes")).select(
        "site", "block_id", patch_name(F.concat(F.lit("s"), "site"), F.col("br"), F.col("bc")).alias("patch_id"), "codes")


@query("s11_coordinates", """SELECT event_id, 500000.0::DOUBLE + (col_i + 0.5) * 30 AS x, 4200000.0::DOUBLE - (row_i + 0.5) * 30 AS y, row_i * 100::BIGINT + col_i AS flat, row_i, col_i FROM ev""")
def s11(spark, d):
    from ..functions.grid import cell_center

    flat = flat_index(F.col("row_i"), F.col("col_i"), 100)
    e = ev(spark, d).select("event_id", cell_center(F.col("col_i"), 500000.0, 30.0).alias("x"), cell_center(F.col("row_i"), 4200000.0, -30.0).alias("y"), flat.alias("flat"))
    return e.withColumn("row_i", row_of(F.col("flat"), 100)).withColumn("col_i", col_of(F.col("flat"), 100))


@query("a16_balanced_youden", """WITH s AS (SELECT c.site, c.layer, c.score, sum(CASE WHEN c.pos > 0 THEN c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN c.neg / b.bn::DOUBLE ELSE 0 END) AS wn FROM cnt c JOIN btot b USING (site, layer, block_id) GROUP BY c.site, c.layer, c.score),
 j AS (SELECT s.site, s.layer, s.score, round(sum(wp) OVER w / positive_blocks - sum(wn) OVER w / negative_blocks, 12) AS j FROM s JOIN bearing USING (site, layer) WINDOW w AS (PARTITION BY s.site, s.layer ORDER BY s.score DESC))
 SELECT site, layer, max(score) AS threshold, round(max(mj), 6) + 0.0 AS youden_j FROM (SELECT *, max(j) OVER (PARTITION BY site, layer) AS mj FROM j) WHERE j = mj GROUP BY site, layer""")
def a16(spark, d):
    rows = C.block_score_counts(samples(spark, d), KEYS).withColumn("w", F.lit(1))
    return rounded(C.balanced_youden(rows, KEYS).drop("n_training_blocks"), "youden_j")


@query("x17_transfer_threshold", """WITH s AS (SELECT c.site, c.layer, c.score, sum(CASE WHEN c.pos > 0 THEN c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN c.neg / b.bn::DOUBLE ELSE 0 END) AS wn FROM cnt c JOIN btot b USING (site, layer, block_id) GROUP BY c.site, c.layer, c.score),
 j AS (SELECT s.site, s.layer, s.score, round(sum(wp) OVER w / positive_blocks - sum(wn) OVER w / negative_blocks, 12) AS j FROM s JOIN bearing USING (site, layer) WINDOW w AS (PARTITION BY s.site, s.layer ORDER BY s.score DESC)),
 t AS (SELECT site, layer, max(score) AS threshold FROM (SELECT *, max(j) OVER (PARTITION BY site, layer) AS mj FROM j) WHERE j = mj GROUP BY site, layer)
 SELECT site, layer, positive_blocks, negative_blocks, tier <> 'counts_and_maps_only' AS available, CASE WHEN tier <> 'counts_and_maps_only' THEN threshold END AS threshold FROM bearing LEFT JOIN t USING (site, layer)""")
def x17(spark, d):
    s = samples(spark, d)
    b = K.bearing_blocks(s, KEYS)
    thr = C.balanced_youden(C.block_score_counts(s, KEYS).withColumn("w", F.lit(1)), KEYS).select(*KEYS, "threshold")
    ok = F.col("tier") != "counts_and_maps_only"
    return b.join(thr, KEYS, "left").select(*KEYS, "positive_blocks", "negative_blocks", ok.alias("available"), F.when(ok, F.col("threshold")).alias("threshold"))


@query("x2_cross_fit", """SELECT o.site, o.layer, o.block_id, count(*) AS n_test, CAST(sum(o.ref) AS BIGINT) AS n_pos, CAST(sum(pred) AS BIGINT) AS n_pred, max(o.threshold) AS threshold, max(t.nt) AS n_training_blocks
 FROM oof o LEFT JOIN thr t ON t.site = o.site AND t.layer = o.layer AND t.fold = o.block_id GROUP BY o.site, o.layer, o.block_id""")
def x2(spark, d):
    return out_of_fold(spark, d).groupBy(*KEYS, "block_id").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("ref").alias("n_pos"), F.sum("pred").alias("n_pred"), F.max("threshold").alias("threshold"), F.max("n_training_blocks").alias("n_training_blocks"))


@query("x28_fold_thresholds", "SELECT site, layer, count(*) AS n_folds, min(threshold) AS threshold_min, round(quantile_cont(threshold, 0.5), 6) + 0.0 AS threshold_median, max(threshold) AS threshold_max FROM thr GROUP BY site, layer")
def x28(spark, d):
    t = C.fold_thresholds(samples(spark, d), training(spark, d), KEYS)
    # one row per fold of a site: the grid bounds the percentile buffer
    return t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_folds"), F.min("threshold").alias("threshold_min"), r6(F.percentile("threshold", 0.5)).alias("threshold_median"), F.max("threshold").alias("threshold_max"))


@query("a17_pooled_metrics", """SELECT site, layer, n_pos, n_neg, round(auc, 6) + 0.0 AS auc, round(prevalence, 6) + 0.0 AS prevalence, tp, fp, tn, fn, round(0.5 * (tpr + 1 - fpr), 6) + 0.0 AS balanced_accuracy, round(positive_f1, 6) + 0.0 AS positive_f1,
 round(negative_f1, 6) + 0.0 AS negative_f1, round(0.5 * (positive_f1 + negative_f1), 6) + 0.0 AS macro_f1, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr FROM pooled""")
def a17(spark, d):
    m = agree.pooled_metrics(cut(out_of_fold(spark, d)), KEYS)
    return rounded(m, "auc", "prevalence", "balanced_accuracy", "positive_f1", "negative_f1", "macro_f1", "tpr", "fpr")


@query("x4_pair_numerators", "SELECT site, layer, p_block, n_block, u FROM umat")
def x4(spark, d):
    return R.pair_numerators(samples(spark, d), KEYS)


@query("x26_block_draws", """SELECT site, rep, count(*) AS n_slots, count(DISTINCT idx2) AS n_distinct, string_agg(block_id, ',' ORDER BY slot) AS blocks FROM (SELECT d.*, i.block_id, d.didx AS idx2 FROM
 (SELECT site, layer, rep, idx AS slot, ('0x' || substr(md5(concat_ws(':', '7', rep, idx)), 1, 8))::BIGINT % nb AS didx FROM bidx CROSS JOIN range(200) r(rep) WHERE layer = 'alpha') d JOIN bidx i ON i.site = d.site AND i.layer = d.layer AND i.idx = d.didx) GROUP BY site, rep""")
def x26(spark, d):
    b = R.block_class_counts(samples(spark, d), KEYS).where(F.col("layer") == "alpha")
    dr = D.block_draws(b, ["site"], REPS, 7)
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "block_id"))), lambda s: s["block_id"]), ",")
    return dr.groupBy("site", "rep").agg(F.count(F.lit(1)).alias("n_slots"), F.countDistinct("block_id").alias("n_distinct"), order.alias("blocks")).withColumn("rep", F.col("rep").cast("bigint"))


@query("x26_draw_record", """SELECT site, rep, '[' || string_agg('{"block_id":"' || block_id || '","multiplicity":' || w || '}', ',' ORDER BY block_id) || ']' AS record FROM weights WHERE layer = 'alpha' GROUP BY site, rep""")
def x26_record(spark, d):
    b = R.block_class_counts(samples(spark, d), KEYS).where(F.col("layer") == "alpha")
    w = D.weighted_rows(b.select("site", "block_id"), D.block_weights(b, ["site"], REPS, 7), ["site", "block_id"])
    rec = F.to_json(F.array_sort(F.collect_list(F.struct("block_id", F.col("w").alias("multiplicity")))))
    return w.groupBy("site", "rep").agg(rec.alias("record")).withColumn("rep", F.col("rep").cast("bigint"))


def bootstrap(spark, d) -> DataFrame:
    return R.bootstrap_metrics(out_of_fold(spark, d), KEYS, REPS, 7)


METRICS = ["auc", "balanced_accuracy", "positive_f1", "negative_f1", "macro_f1", "tpr", "fpr", "prevalence"]


@query("x3_block_bootstrap", """SELECT site, layer, rep, round(auc, 6) + 0.0 AS auc, round(0.5 * (tpr + 1 - fpr), 6) + 0.0 AS balanced_accuracy, round(0.5 * (positive_f1 + negative_f1), 6) + 0.0 AS macro_f1, round(prevalence, 6) + 0.0 AS prevalence FROM bootmet""")
def x3(spark, d):
    out = bootstrap(spark, d).select(*KEYS, F.col("rep").cast("bigint").alias("rep"), "auc", "balanced_accuracy", "macro_f1", "prevalence")
    return rounded(out, "auc", "balanced_accuracy", "macro_f1", "prevalence")


def intervals(spark, d) -> DataFrame:
    return governed_interval(R.long_metrics(bootstrap(spark, d), [*KEYS, "rep"], METRICS), [*KEYS, "metric"], "value", REPS)


@query("x1_governed_interval", "SELECT site, layer, metric, valid_replicates, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper FROM bootci")
def x1(spark, d):
    return rounded(intervals(spark, d).select(*KEYS, "metric", "valid_replicates", "lower", "upper"), "lower", "upper")


@query("a43_replicate_metrics", """SELECT site, layer, rep, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr, round(positive_f1, 6) + 0.0 AS positive_f1, round(negative_f1, 6) + 0.0 AS negative_f1 FROM bootmet""")
def a43(spark, d):
    out = bootstrap(spark, d).select(*KEYS, F.col("rep").cast("bigint").alias("rep"), "tpr", "fpr", "positive_f1", "negative_f1")
    return rounded(out, "tpr", "fpr", "positive_f1", "negative_f1")


VIEWS["perm"] = """SELECT s.site, s.layer, s.rep, s.block_id AS target, i.block_id AS source FROM (SELECT site, layer, block_id, rep, row_number() OVER (PARTITION BY site, layer, rep ORDER BY ('0x' || substr(md5(concat_ws(':', '11', rep, idx)), 1, 8))::BIGINT, idx) - 1 AS pidx
 FROM allidx CROSS JOIN range(12) r(rep)) s JOIN allidx i ON i.site = s.site AND i.layer = s.layer AND i.idx = s.pidx"""
VIEWS["allidx"] = """SELECT site, layer, block_id, row_number() OVER (PARTITION BY site, layer ORDER BY block_id) - 1 AS idx FROM (SELECT DISTINCT site, layer, block_id FROM blk)"""
VIEWS["permobs"] = """SELECT p.site, p.layer, p.rep, p.target AS block_id, s.score, t.ref FROM perm p JOIN blk t ON t.site = p.site AND t.layer = p.layer AND t.block_id = p.target
 JOIN blk s ON s.site = p.site AND s.layer = p.layer AND s.block_id = p.source AND s.row_i % 20 = t.row_i % 20 AND s.col_i % 20 = t.col_i % 20 WHERE s.score IS NOT NULL AND t.ref IS NOT NULL"""
# move the base view before the ones that use it
VIEWS["perm"], VIEWS["permobs"] = VIEWS.pop("perm"), VIEWS.pop("permobs")

_PERM_METRICS = """SELECT a.{k}, a.auc, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN 0.5::DOUBLE * (tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE) END AS ba FROM
 (SELECT {k}, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc FROM (SELECT *, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY {k}) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY {k}) AS nn,
   rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS rk FROM permobs) GROUP BY {k}, np, nn) a"""

PERM_SQL = """WITH c AS (SELECT site, layer, rep, block_id, score, count(*) FILTER (WHERE ref = 1) AS pos, count(*) FILTER (WHERE ref = 0) AS neg FROM permobs GROUP BY ALL),
 b AS (SELECT site, layer, rep, block_id, sum(pos) AS bp, sum(neg) AS bn FROM c GROUP BY ALL),
 n AS (SELECT b.site, b.layer, b.rep, t.fold, count(*) FILTER (WHERE bp > 0) AS np, count(*) FILTER (WHERE bn > 0) AS nn FROM train t JOIN b ON t.site = b.site AND t.block_id = b.block_id GROUP BY ALL),
 s AS (SELECT c.site, c.layer, c.rep, t.fold, c.score, sum(CASE WHEN c.pos > 0 THEN c.pos / b.bp::DOUBLE ELSE 0 END) AS wp, sum(CASE WHEN c.neg > 0 THEN c.neg / b.bn::DOUBLE ELSE 0 END) AS wn FROM train t JOIN c ON t.site = c.site AND t.block_id = c.block_id
  JOIN b ON b.site = c.site AND b.layer = c.layer AND b.rep = c.rep AND b.block_id = c.block_id GROUP BY ALL),
 j AS (SELECT s.*, round(sum(wp) OVER w / np - sum(wn) OVER w / nn, 12) AS j FROM s JOIN n ON n.site = s.site AND n.layer = s.layer AND n.rep = s.rep AND n.fold = s.fold WINDOW w AS (PARTITION BY s.site, s.layer, s.rep, s.fold ORDER BY s.score DESC)),
 t AS (SELECT site, layer, rep, fold, max(score) AS threshold FROM (SELECT *, max(j) OVER (PARTITION BY site, layer, rep, fold) AS mj FROM j) WHERE j = mj GROUP BY ALL),
 k AS (SELECT p.site, p.layer, p.rep, count(*) FILTER (WHERE p.score >= t.threshold AND ref = 1) AS tp, count(*) FILTER (WHERE p.score >= t.threshold AND ref = 0) AS fp, count(*) FILTER (WHERE p.score < t.threshold AND ref = 0) AS tn,
  count(*) FILTER (WHERE p.score < t.threshold AND ref = 1) AS fn FROM permobs p JOIN t ON t.site = p.site AND t.layer = p.layer AND t.rep = p.rep AND t.fold = p.block_id GROUP BY ALL),
 r AS (SELECT site, layer, rep, (sum(CASE WHEN ref = 1 THEN rk END) - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) AS auc FROM (SELECT *, count(*) FILTER (WHERE ref = 1) OVER (PARTITION BY site, layer, rep) AS np, count(*) FILTER (WHERE ref = 0) OVER (PARTITION BY site, layer, rep) AS nn,
  rank() OVER (PARTITION BY site, layer, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, layer, rep, score) - 1) / 2.0::DOUBLE AS rk FROM permobs) GROUP BY site, layer, rep, np, nn),
 m AS (SELECT r.site, r.layer, r.rep, r.auc, 0.5::DOUBLE * (tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE) AS ba FROM r JOIN k ON r.site = k.site AND r.layer = k.layer AND r.rep = k.rep)
 SELECT m.site, m.layer, round(p.auc, 6) + 0.0 AS auc, round(0.5 * (p.tpr + 1 - p.fpr), 6) + 0.0 AS balanced_accuracy, count(m.auc) AS valid_auc, count(m.ba) AS valid_balanced,
 round((count(*) FILTER (WHERE m.auc >= p.auc) + 1.0::DOUBLE) / (count(m.auc) + 1), 6) + 0.0 AS auc_p, round((count(*) FILTER (WHERE m.ba >= 0.5::DOUBLE * (p.tpr + 1 - p.fpr)) + 1.0::DOUBLE) / (count(m.ba) + 1), 6) + 0.0 AS balanced_p
 FROM m JOIN pooled p ON m.site = p.site AND m.layer = p.layer GROUP BY m.site, m.layer, p.auc, p.tpr, p.fpr"""


@query("x5_permutation_test", PERM_SQL)
def x5(spark, d):
    out = packets.permutation_test(samples(spark, d), training(spark, d), KEYS, SIDE, PERMS, 11)
    return rounded(out, "auc", "balanced_accuracy", "auc_p", "balanced_p")
