"""Queries that move values between grids: lookup tables, regridding, nearest joins, shifts, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection as PJ
from ..operators import agree, blocks as K, catalog_joins as J, compare_dates as CD, knn, packets, regrid as G, stats
from ..operators.inference import governed_interval
from .agreement import binpair
from .blocked import SIDE, block_table, grids
from .registry import VIEWS, ev, pix, query, r6, rounded, table

UNIT = G.Grid(0.0, 1.0, 100.0, -1.0, 100, 100)

VIEWS["glt"] = """SELECT site, row_i, col_i, CASE WHEN k % 10 = 0 OR k = 11 THEN 0 ELSE CAST((col_i * 7 + k) % 100 + 1 AS INTEGER) END AS src_x,
 CASE WHEN k % 10 = 0 THEN 0 ELSE CAST((row_i * 3 + user_id) % 100 + 1 AS INTEGER) END AS src_y FROM ev"""


def glt(spark, d) -> DataFrame:
    e = ev(spark, d)
    fill = F.col("k") % 10 == 0
    return e.select(
        "site", "row_i", "col_i",
        F.when(fill | (F.col("k") == 11), 0).otherwise((F.col("col_i") * 7 + F.col("k")) % 100 + 1).cast("int").alias("src_x"),
        F.when(fill, 0).otherwise((F.col("row_i") * 3 + F.col("user_id")) % 100 + 1).cast("int").alias("src_y"),
    )


def swath(spark, d) -> DataFrame:
    return ev(spark, d).select("site", F.col("row_i").alias("src_row"), F.col("col_i").alias("src_col"), "score")


@query("j2_glt_gather", "SELECT g.site, g.row_i, g.col_i, s.score FROM glt g LEFT JOIN ev s ON g.src_x > 0 AND g.src_y > 0 AND s.site = g.site AND s.row_i = g.src_y - 1 AND s.col_i = g.src_x - 1")
def j2(spark, d):
    return G.glt_gather(glt(spark, d), swath(spark, d), ["site"], ["score"]).select("site", "row_i", "col_i", "score")


@query("j2_glt_violations", "SELECT site, row_i, col_i, 'fill_disagrees' AS violation FROM glt WHERE (src_x = 0) <> (src_y = 0)")
def j2_bad(spark, d):
    return G.glt_violations(glt(spark, d), 100, 100).select("site", "row_i", "col_i", "violation")


@query("io3_window_scan", """SELECT g.site, g.row_i, g.col_i, s.score FROM glt g LEFT JOIN ev s ON g.src_x > 0 AND g.src_y > 0 AND s.site = g.site AND s.row_i = g.src_y - 1 AND s.col_i = g.src_x - 1
 WHERE g.row_i >= 35 AND g.row_i < 61 AND g.col_i >= 20 AND g.col_i < 52""")
def io3(spark, d):
    win = G.in_window(glt(spark, d), UNIT, (20.5, 40.0, 50.5, 64.5))
    return G.glt_gather(win, G.swath_window(win, swath(spark, d)), ["site"], ["score"]).select("site", "row_i", "col_i", "score")


VIEWS["tpoints"] = """SELECT event_id, site, col_i * 1.02::DOUBLE + k / 100.0::DOUBLE - 0.5::DOUBLE AS x, 100.0::DOUBLE - (row_i * 0.97::DOUBLE + user_id / 70.0::DOUBLE) AS y FROM ev"""


def tpoints(spark, d) -> DataFrame:
    e = ev(spark, d)
    return e.select(
        "event_id", "site", (F.col("col_i") * F.lit(1.02) + F.col("k") / 100.0 - F.lit(0.5)).alias("x"),
        (F.lit(100.0) - (F.col("row_i") * F.lit(0.97) + F.col("user_id") / 70.0)).alias("y"),
    )


@query("j3_nearest_regrid", """SELECT t.event_id, s.code FROM tpoints t LEFT JOIN ev s ON s.site = t.site AND s.row_i = CAST(floor((t.y - 100.0::DOUBLE) / -1.0::DOUBLE) AS INTEGER) AND s.col_i = CAST(floor(t.x) AS INTEGER)""")
def j3(spark, d):
    return G.nearest_regrid(tpoints(spark, d), ev(spark, d), UNIT, ["site"], ["code"]).select("event_id", "code")


VIEWS["bilin"] = """SELECT t.event_id, t.site, sum(w * s.score) / sum(w) AS score FROM (SELECT event_id, site, u, v, CAST(floor(u) AS INTEGER) + j AS c, CAST(floor(v) AS INTEGER) + i AS r,
  (CASE WHEN i = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
  FROM (SELECT event_id, site, x - 0.5::DOUBLE AS u, (y - 100.0::DOUBLE) / -1.0::DOUBLE - 0.5::DOUBLE AS v FROM tpoints) CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)) t
 JOIN ev s ON s.site = t.site AND s.row_i = t.r AND s.col_i = t.c WHERE u >= -0.5 AND u < 99.5 AND v >= -0.5 AND v < 99.5 AND s.score IS NOT NULL AND w > 0 GROUP BY t.event_id, t.site"""


def bilinear(spark, d) -> DataFrame:
    return G.bilinear_regrid(tpoints(spark, d), ev(spark, d).select("site", "row_i", "col_i", "score"), UNIT, ["site"], "score", ["site", "event_id"])


@query("j4_bilinear_regrid", "SELECT t.event_id, round(b.score, 6) + 0.0 AS score FROM tpoints t LEFT JOIN bilin b ON b.event_id = t.event_id")
def j4(spark, d):
    return rounded(bilinear(spark, d).select("event_id", "score"), "score")


@query("a9_detection_agreement", "SELECT e.site, count(*) AS n_pixels, round(corr(b.score, e.score), 6) + 0.0 AS r FROM ev e JOIN bilin b ON b.event_id = e.event_id WHERE e.score IS NOT NULL GROUP BY e.site")
def a9(spark, d):
    j = ev(spark, d).select("event_id", "site", F.col("score").alias("a")).join(bilinear(spark, d).select("event_id", F.col("score").alias("b")), "event_id")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.groupBy("site").agg(F.count_if(both).alias("n_pixels"), r6(stats.pearson("a", "b")).alias("r"))


COARSE = G.Grid(0.0, 3.5, 0.0, 2.5, 40, 29)
FINE = G.Grid(0.0, 1.0, 0.0, 1.0, 100, 100)


def coarse(spark, d, h: float, w: float) -> DataFrame:
    return ev(spark, d).select("site", F.floor(F.col("row_i") / h).cast("int").alias("row_i"), F.floor(F.col("col_i") / w).cast("int").alias("col_i")).distinct()


@query("j5_area_average", """SELECT t.site, t.row_i, t.col_i, round(sum(w * s.score) / sum(CASE WHEN s.score IS NOT NULL THEN w END), 6) + 0.0 AS score FROM (
 SELECT t.site, t.row_i, t.col_i, e.score, (least(e.row_i + 1, (t.row_i + 1) * 2.5::DOUBLE) - greatest(e.row_i, t.row_i * 2.5::DOUBLE)) * (least(e.col_i + 1, (t.col_i + 1) * 3.5::DOUBLE) - greatest(e.col_i, t.col_i * 3.5::DOUBLE)) AS w
 FROM (SELECT DISTINCT site, CAST(floor(row_i / 2.5::DOUBLE) AS INTEGER) AS row_i, CAST(floor(col_i / 3.5::DOUBLE) AS INTEGER) AS col_i FROM ev) t JOIN ev e ON e.site = t.site AND e.row_i < (t.row_i + 1) * 2.5 AND e.row_i + 1 > t.row_i * 2.5
 AND e.col_i < (t.col_i + 1) * 3.5 AND e.col_i + 1 > t.col_i * 3.5) s JOIN (SELECT DISTINCT site, CAST(floor(row_i / 2.5::DOUBLE) AS INTEGER) AS row_i, CAST(floor(col_i / 3.5::DOUBLE) AS INTEGER) AS col_i FROM ev) t USING (site, row_i, col_i)
 GROUP BY t.site, t.row_i, t.col_i""")
def j5(spark, d):
    src = ev(spark, d).select("site", "row_i", "col_i", "score")
    return rounded(G.area_average(coarse(spark, d, 2.5, 3.5), src, COARSE, FINE, ["site"], "score"), "score")


@query("j18_block_footprint", """WITH t AS (SELECT DISTINCT site, row_i // 7 AS r, col_i // 7 AS c FROM ev),
 o AS (SELECT t.site, t.r, t.c, count(*) AS n, min(b.block_id) AS lo, max(b.block_id) AS hi FROM t JOIN (SELECT DISTINCT site, row_i, col_i, block_id FROM blk) b ON b.site = t.site AND b.row_i // 7 = t.r AND b.col_i // 7 = t.c GROUP BY t.site, t.r, t.c)
 SELECT t.site, t.r AS row_i, t.c AS col_i, CASE WHEN n = 49 AND lo = hi THEN lo END AS block_id, coalesce(n = 49 AND lo <> hi, false) AS crosses_boundary, coalesce(n < 49, true) AS incomplete_support
 FROM t LEFT JOIN o ON t.site = o.site AND t.r = o.r AND t.c = o.c""")
def j18(spark, d):
    cells = K.in_complete_blocks(ev(spark, d).select("site", "row_i", "col_i"), grids(spark, d), ["site"], SIDE)
    return G.block_footprint(coarse(spark, d, 7, 7), cells, G.Grid(0.0, 7.0, 0.0, 7.0, 15, 15), FINE, ["site"])


# ---- geographic coordinates: projected before they meet a grid in metres -------------------------------------

# reference points of a northern and a southern scene: longitude, latitude, zone, easting, northing of the scene's middle
NORTH, SOUTH = (-116.8, 37.6, 11, 517654.0, 4161454.0), (-68.5, -22.4, 19, 551465.0, 7522812.0)
METRES = G.Grid(-1500.0, 30.0, 1500.0, -30.0, 100, 100)
DEGREES = G.Grid(-0.0165, 0.00033, 0.0135, -0.00027, 100, 100)
_PICK = "CASE WHEN south THEN {1} ELSE {0} END"
_LON0, _LAT0, _ZONE, _X0, _Y0 = (_PICK.format(f"({n})::DOUBLE" if i != 2 else n, f"({s})::DOUBLE" if i != 2 else s) for i, (n, s) in enumerate(zip(NORTH, SOUTH, strict=True)))


def _utm_sql(source: str) -> str:
    """Rows of ``source`` (lon, lat, zone, south) on the earth, with x and y."""
    east = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(PJ.FORWARD, 1)]])
    north = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(PJ.FORWARD, 1)]])
    return f"""SELECT *, 500000 + {PJ.RADIUS!r}::DOUBLE * ({east}) AS x, CASE WHEN south THEN 10000000 ELSE 0 END + {PJ.RADIUS!r}::DOUBLE * ({north}) AS y FROM
 (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (SELECT *, sinh(atanh(s) - {PJ.ECCENTRICITY!r}::DOUBLE * atanh({PJ.ECCENTRICITY!r}::DOUBLE * s)) AS t FROM
 (SELECT *, sin(radians(lat)) AS s, radians(lon - (zone * 6 - 183)) AS lam FROM {source} WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)))"""


VIEWS["geo"] = f"""SELECT event_id, site, south, {_ZONE} AS zone, {_LON0} + (col_i + k / 100.0::DOUBLE - 50) * 0.0003::DOUBLE AS lon, CASE WHEN user_id % 97 = 5 THEN 95 ELSE {_LAT0} + (50 - row_i - (user_id % 50) / 50.0::DOUBLE) * 0.00027::DOUBLE END AS lat
 FROM (SELECT *, user_id % 2 = 1 AS south FROM ev)"""
VIEWS["geoutm"] = _utm_sql("geo")


def picked(south, i: int):
    return F.when(south, F.lit(SOUTH[i])).otherwise(F.lit(NORTH[i]))


def geo(spark, d) -> DataFrame:
    s = F.col("south")
    e = ev(spark, d).withColumn("south", F.col("user_id") % 2 == 1)
    lat = picked(s, 1) + (F.lit(50) - F.col("row_i") - F.col("user_id") % 50 / F.lit(50.0)) * F.lit(0.00027)
    return e.select(
        "event_id", "site", "south", picked(s, 2).alias("zone"), (picked(s, 0) + (F.col("col_i") + F.col("k") / 100.0 - 50) * F.lit(0.0003)).alias("lon"),
        F.when(F.col("user_id") % 97 == 5, F.lit(95.0)).otherwise(lat).alias("lat"),
    )


@query("j3_projected_regrid", f"""SELECT g.event_id, u.event_id IS NOT NULL AS on_earth, s.code FROM geo g LEFT JOIN (SELECT *, x - {_X0} AS gx, y - {_Y0} AS gy FROM geoutm) u ON u.event_id = g.event_id
 LEFT JOIN ev s ON s.site = u.site AND s.row_i = CAST(floor((gy - 1500.0::DOUBLE) / -30.0::DOUBLE) AS INTEGER) AND s.col_i = CAST(floor((gx + 1500.0::DOUBLE) / 30.0::DOUBLE) AS INTEGER)""")
def j3_projected(spark, d):
    t = PJ.projected(geo(spark, d), F.col("zone"), F.col("south"), valid="on_earth")
    t = t.withColumn("x", F.col("x") - picked(F.col("south"), 3)).withColumn("y", F.col("y") - picked(F.col("south"), 4))
    return G.nearest_regrid(t, ev(spark, d), METRES, ["site"], ["code"]).select("event_id", "on_earth", "code")


VIEWS["metric"] = f"""SELECT event_id, site, south, {_ZONE} AS zone, {_X0} + (col_i + k / 100.0::DOUBLE - 50) * 30 AS x, {_Y0} + (50 - row_i - (user_id % 50) / 50.0::DOUBLE) * 30 AS y FROM (SELECT *, user_id % 2 = 1 AS south FROM ev)"""
_BACK = {n: " ".join([v, *[f"- {c!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(PJ.BACKWARD, 1)]]) for n, v, f, g in (("a", "xi", "sin", "cosh"), ("b", "eta", "cos", "sinh"))}
_PHI = " ".join(["chi", *[f"+ {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(PJ.LATITUDE, 1)]])
VIEWS["metricgeo"] = f"""SELECT event_id, site, south, zone * 6 - 183 + degrees(atan2(sinh(b), cos(a))) AS lon, degrees({_PHI}) AS lat FROM (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM (SELECT *, {_BACK['a']} AS a, {_BACK['b']} AS b FROM
 (SELECT *, (y - CASE WHEN south THEN 10000000 ELSE 0 END) / {PJ.RADIUS!r}::DOUBLE AS xi, (x - 500000) / {PJ.RADIUS!r}::DOUBLE AS eta FROM metric)))"""


@query("j4_projected_regrid", f"""WITH p AS (SELECT event_id, site, (lon - {_LON0} + 0.0165::DOUBLE) / 0.00033::DOUBLE - 0.5 AS u, (lat - {_LAT0} - 0.0135::DOUBLE) / -0.00027::DOUBLE - 0.5 AS v FROM metricgeo),
 n AS (SELECT event_id, site, CAST(floor(u) AS INTEGER) + j AS c, CAST(floor(v) AS INTEGER) + i AS r, (CASE WHEN i = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
  FROM p CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) WHERE u >= -0.5 AND u < 99.5 AND v >= -0.5 AND v < 99.5)
 SELECT m.event_id, round(b.score, 6) + 0.0 AS score FROM metric m LEFT JOIN (SELECT n.event_id, sum(w * s.score) / sum(w) AS score FROM n JOIN ev s ON s.site = n.site AND s.row_i = n.r AND s.col_i = n.c WHERE s.score IS NOT NULL AND w > 0 GROUP BY n.event_id) b USING (event_id)""")
def j4_projected(spark, d):
    s = F.col("south")
    e = ev(spark, d).withColumn("south", F.col("user_id") % 2 == 1)
    x = picked(s, 3) + (F.col("col_i") + F.col("k") / 100.0 - 50) * 30
    y = picked(s, 4) + (F.lit(50) - F.col("row_i") - F.col("user_id") % 50 / F.lit(50.0)) * 30
    t = PJ.from_utm(e.select("event_id", "site", "south", x.alias("x"), y.alias("y")), picked(s, 2), s)
    t = t.select("event_id", "site", (F.col("lon") - picked(s, 0)).alias("x"), (F.col("lat") - picked(s, 1)).alias("y"))
    out = G.bilinear_regrid(t, ev(spark, d).select("site", "row_i", "col_i", "score"), DEGREES, ["site"], "score", ["site", "event_id"])
    return rounded(out.select("event_id", "score"), "score")


VIEWS["swath"] = """SELECT c_custkey AS source_id, CAST(c_custkey // 1500 AS INTEGER) AS site, true AS south, 19 AS zone, -68.5::DOUBLE + ((c_acctbal + 1000) / 110 - 50) * 0.00029::DOUBLE AS lon, CASE WHEN c_nationkey = 3 THEN 95 ELSE -22.4::DOUBLE + (50 - (c_custkey * 37 % 1000) / 10.0::DOUBLE) * 0.00027::DOUBLE END AS lat, c_nationkey % 5 <> 0 AS qa_valid FROM customer"""
VIEWS["swathutm"] = _utm_sql("swath")
VIEWS["cells30"] = f"SELECT event_id AS target_id, site, {SOUTH[3]} - 1500 + (col_i + 0.5::DOUBLE) * 30 AS x, {SOUTH[4]} + 1500 - (row_i + 0.5::DOUBLE) * 30 AS y, k < 90 AS qa_valid FROM ev"


@query("j6_projected_mapping", """WITH n AS (SELECT site, target_id, source_id, s_ok, sqrt(d2) AS distance FROM (SELECT t.site, t.target_id, s.source_id, s.qa_valid AS s_ok, (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) AS d2,
  row_number() OVER (PARTITION BY t.target_id ORDER BY (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y), s.source_id) AS rn FROM cells30 t JOIN swathutm s ON s.site = t.site WHERE t.qa_valid) WHERE rn = 1)
 SELECT o.site, o.target_id, n.source_id, round(n.distance, 3) + 0.0 AS distance, CASE WHEN NOT o.qa_valid THEN 'ortho_qa_invalid' WHEN n.source_id IS NULL THEN 'no_geolocated_source' WHEN s_ok THEN 'mapped' ELSE 'source_qa_no_call' END AS status FROM cells30 o LEFT JOIN n USING (target_id)""")
def j6_projected(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    lat = F.when(F.col("c_nationkey") == 3, F.lit(95.0)).otherwise(F.lit(-22.4) + (F.lit(50) - (k * 37 % 1000) / 10.0) * F.lit(0.00027))
    swath = c.select(
        k.alias("source_id"), F.floor(k / 1500).cast("int").alias("site"), (F.lit(-68.5) + ((F.col("c_acctbal") + 1000) / 110 - 50) * F.lit(0.00029)).alias("lon"), lat.alias("lat"),
        (F.col("c_nationkey") % 5 != 0).alias("qa_valid"),
    )
    source = PJ.projected(swath, F.lit(19), F.lit(True))
    x, y = F.lit(SOUTH[3] - 1500) + (F.col("col_i") + 0.5) * 30, F.lit(SOUTH[4] + 1500) - (F.col("row_i") + 0.5) * 30
    target = ev(spark, d).select(F.col("event_id").alias("target_id"), "site", x.alias("x"), y.alias("y"), (F.col("k") < 90).alias("qa_valid"))
    out = knn.map_native(target, source.select("source_id", "site", "x", "y", "geo_valid", "qa_valid"), ["site"], 30.0)
    return out.select("site", "target_id", "source_id", (F.round("distance", 3) + F.lit(0.0)).alias("distance"), "status")


# ---- native to ortho ---------------------------------------------------------------------------------

VIEWS["native"] = """SELECT c_custkey AS source_id, CAST(c_custkey // 1500 AS INTEGER) AS site, (c_acctbal + 1000) / 110 AS x, (c_custkey * 37 % 1000) / 10.0::DOUBLE AS y, c_nationkey <> 3 AS geo_valid, c_nationkey % 5 <> 0 AS qa_valid FROM customer"""
VIEWS["ortho"] = "SELECT event_id AS target_id, site, col_i + 0.5::DOUBLE AS x, row_i + 0.5::DOUBLE AS y, k < 90 AS qa_valid FROM ev"
VIEWS["mapping"] = """SELECT o.site, o.target_id, n.source_id, n.distance, CASE WHEN NOT o.qa_valid THEN 'ortho_qa_invalid' WHEN n.source_id IS NULL THEN 'no_geolocated_source' WHEN s.qa_valid THEN 'mapped' ELSE 'source_qa_no_call' END AS status,
 CASE WHEN n.source_id IS NULL THEN 0 ELSE count(n.source_id) OVER (PARTITION BY o.site, n.source_id) END AS multiplicity
 FROM ortho o LEFT JOIN (SELECT site, target_id, source_id, sqrt(d2) AS distance FROM (SELECT t.site, t.target_id, s.source_id, (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) AS d2,
   row_number() OVER (PARTITION BY t.target_id ORDER BY (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y), s.source_id) AS rn FROM ortho t JOIN native s ON s.site = t.site WHERE t.qa_valid AND s.geo_valid) WHERE rn = 1) n
 ON n.target_id = o.target_id LEFT JOIN native s ON s.site = o.site AND s.source_id = n.source_id"""


def native(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("source_id"), F.floor(k / 1500).cast("int").alias("site"), ((F.col("c_acctbal") + 1000) / 110).alias("x"), ((k * 37 % 1000) / 10.0).alias("y"),
        (F.col("c_nationkey") != 3).alias("geo_valid"), (F.col("c_nationkey") % 5 != 0).alias("qa_valid"),
    )


def ortho(spark, d) -> DataFrame:
    return ev(spark, d).select(F.col("event_id").alias("target_id"), "site", (F.col("col_i") + 0.5).alias("x"), (F.col("row_i") + 0.5).alias("y"), (F.col("k") < 90).alias("qa_valid"))


def mapping(spark, d) -> DataFrame:
    return knn.map_native(ortho(spark, d), native(spark, d), ["site"], 1.0)


@query("j6_native_to_ortho", "SELECT site, target_id, source_id, round(distance, 6) + 0.0 AS distance, status, multiplicity FROM mapping")
def j6(spark, d):
    return rounded(mapping(spark, d), "distance")


@query("j6_mapping_counts", """SELECT t.*, total_source, invalid_qa_source, invalid_geo_source, used_source, shared_source, duplicate_assignments, total_source - coalesce(used_source, 0) AS unused_source FROM
 (SELECT site, count(*) AS total_target, count(*) FILTER (WHERE status = 'ortho_qa_invalid') AS invalid_qa_target, count(*) FILTER (WHERE status = 'source_qa_no_call') AS source_no_call_target,
  count(*) FILTER (WHERE status = 'no_geolocated_source') AS no_source_target, count(*) FILTER (WHERE status = 'mapped') AS mapped_target, count(*) FILTER (WHERE status <> 'mapped') AS unmapped_target FROM mapping GROUP BY site) t
 JOIN (SELECT site, count(*) AS total_source, count(*) FILTER (WHERE NOT qa_valid) AS invalid_qa_source, count(*) FILTER (WHERE NOT geo_valid) AS invalid_geo_source FROM native GROUP BY site) s USING (site)
 LEFT JOIN (SELECT site, count(*) AS used_source, count(*) FILTER (WHERE m > 1) AS shared_source, CAST(sum(m - 1) AS BIGINT) AS duplicate_assignments FROM (SELECT site, source_id, count(*) AS m FROM mapping WHERE source_id IS NOT NULL GROUP BY site, source_id) GROUP BY site) u USING (site)""")
def j6_counts(spark, d):
    return knn.mapping_counts(mapping(spark, d), native(spark, d), ["site"])


@query("j7_project_field", "SELECT m.site, m.target_id, CASE WHEN m.status = 'mapped' THEN c.c_acctbal END AS value FROM mapping m LEFT JOIN customer c ON c.c_custkey = m.source_id")
def j7(spark, d):
    f = native(spark, d).select("site", "source_id").join(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_acctbal").alias("value")), "source_id")
    return knn.project_field(mapping(spark, d), f, ["site"], "value")


@query("j8_copy_audit", """WITH n AS (SELECT vec_id AS source_id, embedding AS refl FROM embeddings WHERE label < 7), o AS (SELECT vec_id AS target_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda v: CAST(v * 2 AS FLOAT)) ELSE embedding END AS refl FROM embeddings),
 m AS (SELECT vec_id AS target_id, CASE WHEN vec_id % 4 = 0 THEN vec_id + 1 ELSE vec_id END AS source_id FROM embeddings WHERE label < 9)
 SELECT valid_ortho, match_any, mapped_ortho, match_selected, round(match_any / valid_ortho::DOUBLE, 6) + 0.0 AS match_any_fraction, round(match_selected / mapped_ortho::DOUBLE, 6) + 0.0 AS match_selected_fraction FROM
 (SELECT count(*) AS valid_ortho, count(*) FILTER (WHERE refl IN (SELECT refl FROM n)) AS match_any FROM o) CROSS JOIN
 (SELECT count(*) AS mapped_ortho, count(*) FILTER (WHERE o.refl = n.refl) AS match_selected FROM o JOIN m USING (target_id) LEFT JOIN n USING (source_id))""")
def j8(spark, d):
    e = table(spark, d, "embeddings").withColumn("scene", F.lit(0))
    n = e.where("label < 7").select("scene", F.col("vec_id").alias("source_id"), F.col("embedding").alias("refl"))
    twice = F.transform("embedding", lambda v: (v * 2).cast("float"))
    o = e.select("scene", F.col("vec_id").alias("target_id"), F.when(F.col("vec_id") % 3 == 0, twice).otherwise(F.col("embedding")).alias("refl"))
    m = e.where("label < 9").select("scene", F.col("vec_id").alias("target_id"), (F.col("vec_id") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)).alias("source_id"), F.lit(knn.MAPPED).alias("status"))
    return rounded(knn.copy_audit(o, n, m, ["scene"]).drop("scene"), "match_any_fraction", "match_selected_fraction")


# ---- shifts and boundaries -------------------------------------------------------------------------------

VIEWS["shifted"] = """SELECT a.site, a.row_i, a.col_i, CAST(y.o AS INTEGER) AS dy, CAST(x.o AS INTEGER) AS dx, a.m_a, a.score, b.m_b AS shifted_m_b, b.score2 AS shifted_score2 FROM binpair a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) y CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) x
 LEFT JOIN binpair b ON b.site = a.site AND b.row_i = a.row_i - y.o AND b.col_i = a.col_i - x.o"""


@query("j13_shift_join", """SELECT site, dy, dx, count(*) AS n_cells, count(*) FILTER (WHERE score IS NOT NULL AND shifted_score2 IS NOT NULL) AS n_joint, CAST(sum(m_a * shifted_m_b) AS BIGINT) AS n_both FROM shifted GROUP BY site, dy, dx""")
def j13(spark, d):
    s = G.shifted_pairs(binpair(spark, d), ["site"], ["m_a", "score"], ["m_b", "score2"])
    return s.groupBy("site", "dy", "dx").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("score").isNotNull() & F.col("shifted_score2").isNotNull()).alias("n_joint"), F.sum(F.col("m_a") * F.col("shifted_m_b")).alias("n_both"))


BOUNDARY = """SELECT a.{k}, a.row_i, a.col_i, a.{a} = 1 AND bool_or(b.{a} = 0) AS on_a, a.{b} = 1 AND bool_or(b.{b} = 0) AS on_b FROM {t} a JOIN {t} b ON {j} AND abs(b.row_i - a.row_i) <= 1 AND abs(b.col_i - a.col_i) <= 1
 WHERE a.{a} IS NOT NULL AND a.{b} IS NOT NULL AND b.{a} IS NOT NULL AND b.{b} IS NOT NULL GROUP BY a.{k}, a.row_i, a.col_i, a.{a}, a.{b} HAVING (a.{a} = 1 AND bool_or(b.{a} = 0)) OR (a.{b} = 1 AND bool_or(b.{b} = 0))"""
VIEWS["edges"] = BOUNDARY.format(k="site", a="m_a", b="m_b", t="binpair", j="b.site = a.site")
VIEWS["blkpair"] = """SELECT p.*, printf('r%04d_c%04d', p.row_i // 20, p.col_i // 20) AS block_id FROM binpair p JOIN shape s ON s.site = p.site WHERE p.row_i // 20 < s.n_rows // 20 AND p.col_i // 20 < s.n_cols // 20"""
VIEWS["blkedges"] = BOUNDARY.format(k="site, a.block_id", a="m_a", b="m_b", t="blkpair", j="b.site = a.site AND b.block_id = a.block_id")


def blkpair(spark, d) -> DataFrame:
    return K.in_complete_blocks(binpair(spark, d), grids(spark, d), ["site"], SIDE)


@query("j14_boundary_cells", "SELECT site, row_i, col_i, on_a, on_b FROM edges")
def j14(spark, d):
    return G.boundary_cells(binpair(spark, d), ["site"], "m_a", "m_b")


@query("j14_block_boundaries", "SELECT site, block_id, row_i, col_i, on_a, on_b FROM blkedges")
def j14_blocks(spark, d):
    return G.boundary_cells(blkpair(spark, d), ["site", "block_id"], "m_a", "m_b")


DIRECTED = """SELECT {k}, quantile_cont(dist, 0.95) AS q FROM (SELECT {ka}, min(sqrt((p.row_i - q.row_i) * (p.row_i - q.row_i) * 900.0::DOUBLE + (p.col_i - q.col_i) * (p.col_i - q.col_i) * 900.0::DOUBLE)) AS dist
 FROM {t} p JOIN {t} q ON {j} WHERE p.{a} AND q.{b} GROUP BY {ka}, p.row_i, p.col_i{extra}) GROUP BY {k}"""


def _symmetric_sql(t: str, k: list[str]) -> str:
    kw = dict(k=", ".join(k), ka=", ".join(f"p.{c}" for c in k), t=t, j=" AND ".join(f"q.{c} = p.{c}" for c in k), extra="")
    return f"""SELECT {", ".join(f"x.{c}" for c in k)}, greatest(x.q, y.q) AS boundary_m FROM ({DIRECTED.format(a="on_a", b="on_b", **kw)}) x JOIN ({DIRECTED.format(a="on_b", b="on_a", **kw)}) y ON {" AND ".join(f"x.{c} = y.{c}" for c in k)}"""


@query("j15_boundary_distance", f"SELECT site, round(boundary_m, 6) + 0.0 AS boundary_m FROM ({_symmetric_sql('edges', ['site'])})")
def j15(spark, d):
    return rounded(knn.symmetric_boundary_distance(binpair(spark, d), ["site"], "m_a", "m_b", 30.0, 30.0), "boundary_m")


# sparser maps, so that boundaries lie apart
VIEWS["sparse"] = "SELECT site, row_i, col_i, CASE WHEN score IS NOT NULL THEN CASE WHEN score >= 200 THEN 1 ELSE 0 END END AS m_a, CASE WHEN score2 IS NOT NULL THEN CASE WHEN score2 >= 98 THEN 1 ELSE 0 END END AS m_b, score, score2 FROM ev"
VIEWS["sparseshift"] = """SELECT a.site, a.row_i, a.col_i, CAST(y.o AS INTEGER) AS dy, CAST(x.o AS INTEGER) AS dx, a.m_a, a.score, b.m_b, b.score2 FROM sparse a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) y CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) x
 LEFT JOIN sparse b ON b.site = a.site AND b.row_i = a.row_i - y.o AND b.col_i = a.col_i - x.o"""
VIEWS["shiftedges"] = BOUNDARY.format(k="site, a.dy, a.dx", a="m_a", b="m_b", t="sparseshift", j="b.site = a.site AND b.dy = a.dy AND b.dx = a.dx")
VIEWS["shiftmetric"] = f"""SELECT o.site, o.dy, o.dx, o.n_joint, n_both / nullif(n_either, 0)::DOUBLE AS iou, 2 * n_both / nullif(n_anchor + n_repeat, 0)::DOUBLE AS dice, n_repeat / nullif(n_anchor, 0)::DOUBLE AS prevalence_ratio, r.rho, b.boundary_m FROM
 (SELECT site, dy, dx, count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) AS n_joint, count(*) FILTER (WHERE m_a = 1 AND m_b = 1) AS n_both, count(*) FILTER (WHERE m_a IS NOT NULL AND m_b IS NOT NULL AND (m_a = 1 OR m_b = 1)) AS n_either,
  count(*) FILTER (WHERE m_a = 1 AND m_b IS NOT NULL) AS n_anchor, count(*) FILTER (WHERE m_b = 1 AND m_a IS NOT NULL) AS n_repeat FROM sparseshift GROUP BY site, dy, dx) o
 JOIN (SELECT site, dy, dx, corr(ra, rb) AS rho FROM (SELECT site, dy, dx, rank() OVER (PARTITION BY site, dy, dx ORDER BY score) + (count(*) OVER (PARTITION BY site, dy, dx, score) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY site, dy, dx ORDER BY score2) + (count(*) OVER (PARTITION BY site, dy, dx, score2) - 1) / 2.0::DOUBLE AS rb FROM sparseshift WHERE score IS NOT NULL AND score2 IS NOT NULL) GROUP BY site, dy, dx) r USING (site, dy, dx)
 LEFT JOIN ({_symmetric_sql('shiftedges', ['site', 'dy', 'dx'])}) b USING (site, dy, dx)"""


def sparse(spark, d) -> DataFrame:
    e = ev(spark, d)
    return e.select(
        "site", "row_i", "col_i", F.when(F.col("score").isNotNull(), (F.col("score") >= 200).cast("int")).alias("m_a"),
        F.when(F.col("score2").isNotNull(), (F.col("score2") >= 98).cast("int")).alias("m_b"), "score", "score2")


@query("x18_registration_sensitivity", """SELECT site, dy, dx, n_joint, round(iou, 6) + 0.0 AS iou, round(dice, 6) + 0.0 AS dice, round(prevalence_ratio, 6) + 0.0 AS prevalence_ratio, round(rho, 6) + 0.0 AS rho, round(boundary_m, 6) + 0.0 AS boundary_m FROM shiftmetric""")
def x18(spark, d):
    m = CD.registration_sensitivity(sparse(spark, d), ["site"], "score", "score2", "m_a", "m_b", 30.0, 30.0)
    return rounded(m, "iou", "dice", "prevalence_ratio", "rho", "boundary_m")


@query("x18_registration_range", """SELECT site, round(min(iou), 6) + 0.0 AS iou_min, round(max(iou), 6) + 0.0 AS iou_max, round(max(iou) FILTER (WHERE dy = 0 AND dx = 0), 6) + 0.0 AS iou_unshifted, round(min(rho), 6) + 0.0 AS rho_min,
 round(max(rho), 6) + 0.0 AS rho_max, round(max(rho) FILTER (WHERE dy = 0 AND dx = 0), 6) + 0.0 AS rho_unshifted FROM shiftmetric GROUP BY site""")
def x18_range(spark, d):
    m = CD.registration_sensitivity(sparse(spark, d), ["site"], "score", "score2", "m_a", "m_b", 30.0, 30.0)
    return rounded(CD.shift_ranges(m, ["site"], ["iou", "rho"]), "iou_min", "iou_max", "iou_unshifted", "rho_min", "rho_max", "rho_unshifted")


VIEWS["sparseblk"] = """SELECT p.*, printf('r%04d_c%04d', p.row_i // 20, p.col_i // 20) AS block_id FROM sparse p JOIN shape s ON s.site = p.site WHERE p.row_i // 20 < s.n_rows // 20 AND p.col_i // 20 < s.n_cols // 20"""
VIEWS["sparseedges"] = BOUNDARY.format(k="site, a.block_id", a="m_a", b="m_b", t="sparseblk", j="b.site = a.site AND b.block_id = a.block_id")
VIEWS["sidx"] = "SELECT site, block_id, row_number() OVER (PARTITION BY site ORDER BY block_id) - 1 AS idx, count(*) OVER (PARTITION BY site) AS nb FROM (SELECT DISTINCT site, block_id FROM sparseblk)"
VIEWS["sdraw"] = """SELECT d.site, d.rep, i.block_id, count(*) AS w FROM (SELECT site, r.rep, ('0x' || substr(md5(concat_ws(':', '5', r.rep, idx)), 1, 8))::BIGINT % nb AS didx FROM sidx CROSS JOIN range(20) r(rep)) d
 JOIN sidx i ON i.site = d.site AND i.idx = d.didx GROUP BY d.site, d.rep, i.block_id"""
VIEWS["repedges"] = "SELECT e.site, d.rep, e.row_i, e.col_i, e.on_a, e.on_b, d.w FROM sparseedges e JOIN sdraw d ON d.site = e.site AND d.block_id = e.block_id"


def sparse_blocks(spark, d) -> DataFrame:
    return K.in_complete_blocks(sparse(spark, d), grids(spark, d), ["site"], SIDE)


def _weighted_directed(a: str, b: str) -> str:
    return f"""SELECT site, rep, quantile_cont(dist, 0.95) AS q FROM (SELECT site, rep, dist, unnest(range(w)) AS u FROM (SELECT p.site, p.rep, p.w, min(sqrt((p.row_i - q.row_i) * (p.row_i - q.row_i) * 900.0::DOUBLE + (p.col_i - q.col_i) * (p.col_i - q.col_i) * 900.0::DOUBLE)) AS dist
 FROM repedges p JOIN repedges q ON q.site = p.site AND q.rep = p.rep WHERE p.{a} AND q.{b} GROUP BY p.site, p.rep, p.w, p.row_i, p.col_i)) GROUP BY site, rep"""


@query("x9_boundary_bootstrap", f"SELECT x.site, x.rep, round(greatest(x.q, y.q), 6) + 0.0 AS boundary_m FROM ({_weighted_directed('on_a', 'on_b')}) x JOIN ({_weighted_directed('on_b', 'on_a')}) y USING (site, rep)")
def x9(spark, d):
    out = CD.boundary_bootstrap(sparse_blocks(spark, d), ["site"], "m_a", "m_b", 30.0, 30.0, 20, 5)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "boundary_m")


VIEWS["sperm"] = """SELECT s.site, s.rep, s.block_id AS target, i.block_id AS source FROM (SELECT site, block_id, rep, row_number() OVER (PARTITION BY site, rep ORDER BY ('0x' || substr(md5(concat_ws(':', '5', rep, idx)), 1, 8))::BIGINT, idx) - 1 AS pidx
 FROM sidx CROSS JOIN range(20) r(rep)) s JOIN sidx i ON i.site = s.site AND i.idx = s.pidx"""
VIEWS["nullgrid"] = """SELECT p.site, p.rep, p.target AS block_id, a.row_i, a.col_i, a.m_a, b.m_b FROM sperm p JOIN sparseblk a ON a.site = p.site AND a.block_id = p.target
 JOIN sparseblk b ON b.site = p.site AND b.block_id = p.source AND b.row_i % 20 = a.row_i % 20 AND b.col_i % 20 = a.col_i % 20 WHERE p.rep < 10"""
VIEWS["nulledges"] = BOUNDARY.format(k="site, a.rep, a.block_id", a="m_a", b="m_b", t="nullgrid", j="b.site = a.site AND b.rep = a.rep AND b.block_id = a.block_id")


@query("x9_boundary_null", f"SELECT site, rep, round(boundary_m, 6) + 0.0 AS boundary_m FROM ({_symmetric_sql('nulledges', ['site', 'rep'])})")
def x9_null(spark, d):
    out = CD.boundary_null(sparse_blocks(spark, d), ["site"], "m_a", "m_b", 30.0, 30.0, SIDE, 10, 5)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "boundary_m")


@query("a42_overlap_accounting", """SELECT site, count(*) AS n_cells, count(*) FILTER (WHERE score IS NOT NULL) AS anchor_valid, count(*) FILTER (WHERE score2 IS NOT NULL) AS repeat_valid, count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) AS joint,
 round(count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) / count(*)::DOUBLE, 6) + 0.0 AS joint_of_grid, round(count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) / nullif(count(*) FILTER (WHERE score IS NOT NULL), 0)::DOUBLE, 6) + 0.0 AS joint_of_anchor,
 round(count(*) FILTER (WHERE score IS NOT NULL AND score2 IS NOT NULL) / nullif(count(*) FILTER (WHERE score2 IS NOT NULL), 0)::DOUBLE, 6) + 0.0 AS joint_of_repeat FROM ev GROUP BY site""")
def a42(spark, d):
    return rounded(CD.overlap_accounting(ev(spark, d), ["site"], F.col("score").isNotNull(), F.col("score2").isNotNull()), "joint_of_grid", "joint_of_anchor", "joint_of_repeat")


# ---- repeat maps: bootstrap and nulls ------------------------------------------------------------------------


@query("x6_paired_bootstrap", """SELECT site, rep, count(*) AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT site, rep, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY site, rep ORDER BY score2) + (count(*) OVER (PARTITION BY site, rep, score2) - 1) / 2.0::DOUBLE AS rb FROM (SELECT d.site, d.rep, b.score, b.score2, unnest(range(d.w)) AS u FROM sparseblk b JOIN sdraw d ON d.site = b.site AND d.block_id = b.block_id
 WHERE b.score IS NOT NULL AND b.score2 IS NOT NULL)) GROUP BY site, rep""")
def x6(spark, d):
    from ..operators import resample as R

    out = R.paired_spearman_bootstrap(sparse_blocks(spark, d), ["site"], "score", "score2", 20, 5)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "rho")


VIEWS["snull"] = """SELECT p.site, p.rep, a.score, b.score2, a.m_a, b.m_b FROM sperm p JOIN sparseblk a ON a.site = p.site AND a.block_id = p.target JOIN sparseblk b ON b.site = p.site AND b.block_id = p.source AND b.row_i % 20 = a.row_i % 20 AND b.col_i % 20 = a.col_i % 20"""


@query("x7_paired_null", """SELECT site, rep, count(*) AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT site, rep, rank() OVER (PARTITION BY site, rep ORDER BY score) + (count(*) OVER (PARTITION BY site, rep, score) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY site, rep ORDER BY score2) + (count(*) OVER (PARTITION BY site, rep, score2) - 1) / 2.0::DOUBLE AS rb FROM snull WHERE score IS NOT NULL AND score2 IS NOT NULL) GROUP BY site, rep""")
def x7(spark, d):
    from ..operators import resample as R

    s = sparse_blocks(spark, d)
    orders = R.block_orderings(s.select("site", "block_id").distinct(), ["site"], 20, 5)
    out = packets.permuted(s, orders, ["site"], ["score", "score2"], SIDE, packets.moved_ranks("score", "score2"), ["n", "rho"])
    return rounded(out.select("site", F.col("rep").cast("bigint").alias("rep"), F.col("n").cast("bigint").alias("n"), "rho"), "rho")


_RATIOS = """round(n_both / nullif(n_either, 0)::DOUBLE, 6) + 0.0 AS iou, round(2 * n_both / nullif(n_anchor + n_repeat, 0)::DOUBLE, 6) + 0.0 AS dice"""


@query("x8_overlap_bootstrap", f"""SELECT site, rep, {_RATIOS} FROM (SELECT d.site, d.rep, sum(w) FILTER (WHERE m_a = 1 AND m_b = 1) AS n_both, sum(w) FILTER (WHERE m_a = 1 OR m_b = 1) AS n_either, sum(w) FILTER (WHERE m_a = 1) AS n_anchor, sum(w) FILTER (WHERE m_b = 1) AS n_repeat
 FROM blkpair b JOIN sdraw d ON d.site = b.site AND d.block_id = b.block_id WHERE m_a IS NOT NULL AND m_b IS NOT NULL GROUP BY d.site, d.rep) t(site, rep, n_both, n_either, n_anchor, n_repeat)""")
def x8(spark, d):
    from ..operators import resample as R

    out = R.overlap_bootstrap(blkpair(spark, d), ["site"], "m_a", "m_b", 20, 5).select("site", F.col("rep").cast("bigint").alias("rep"), "iou", "dice")
    return rounded(out, "iou", "dice")


@query("x8_overlap_null", f"""SELECT site, rep, {_RATIOS} FROM (SELECT p.site, p.rep, count(*) FILTER (WHERE a.m_a = 1 AND b.m_b = 1) AS n_both, count(*) FILTER (WHERE a.m_a = 1 OR b.m_b = 1) AS n_either, count(*) FILTER (WHERE a.m_a = 1) AS n_anchor, count(*) FILTER (WHERE b.m_b = 1) AS n_repeat
 FROM sperm p JOIN blkpair a ON a.site = p.site AND a.block_id = p.target JOIN blkpair b ON b.site = p.site AND b.block_id = p.source AND b.row_i % 20 = a.row_i % 20 AND b.col_i % 20 = a.col_i % 20 WHERE a.m_a IS NOT NULL AND b.m_b IS NOT NULL GROUP BY p.site, p.rep)""")
def x8_null(spark, d):
    from ..operators import resample as R

    out = R.overlap_null(blkpair(spark, d), ["site"], "m_a", "m_b", SIDE, 20, 5).select("site", F.col("rep").cast("bigint").alias("rep"), "iou", "dice")
    return rounded(out, "iou", "dice")


@query("x9_null_tails", f"""WITH o AS (SELECT site, rep, n_both / nullif(n_either, 0)::DOUBLE AS iou FROM (SELECT p.site, p.rep, count(*) FILTER (WHERE a.m_a = 1 AND b.m_b = 1) AS n_both, count(*) FILTER (WHERE a.m_a = 1 OR b.m_b = 1) AS n_either
 FROM sperm p JOIN blkpair a ON a.site = p.site AND a.block_id = p.target JOIN blkpair b ON b.site = p.site AND b.block_id = p.source AND b.row_i % 20 = a.row_i % 20 AND b.col_i % 20 = a.col_i % 20 WHERE a.m_a IS NOT NULL AND b.m_b IS NOT NULL GROUP BY p.site, p.rep)),
 u AS (SELECT site, count(iou) AS n, quantile_cont(iou, 0.95) AS q FROM o GROUP BY site), l AS (SELECT site, count(boundary_m) AS n, quantile_cont(boundary_m, 0.05) AS q FROM ({_symmetric_sql('nulledges', ['site', 'rep'])}) GROUP BY site)
 SELECT u.site, CASE WHEN u.n >= 19 THEN round(u.q, 6) + 0.0 END AS iou_null_95, CASE WHEN l.n >= 10 THEN round(l.q, 6) + 0.0 END AS boundary_null_05 FROM u LEFT JOIN l USING (site)""")
def x9_tails(spark, d):
    from ..operators import resample as R
    from ..operators.inference import null_tails

    iou = null_tails(R.overlap_null(blkpair(spark, d), ["site"], "m_a", "m_b", SIDE, 20, 5), ["site"], "iou", 20)
    edge = null_tails(CD.boundary_null(sparse_blocks(spark, d), ["site"], "m_a", "m_b", 30.0, 30.0, SIDE, 10, 5), ["site"], "boundary_m", 10)
    out = iou.select("site", F.col("null_95").alias("iou_null_95")).join(edge.select("site", F.col("null_05").alias("boundary_null_05")), "site", "left")
    return rounded(out, "iou_null_95", "boundary_null_05")


@query("g4_complete_orderings", """SELECT site, n AS n_orders, n AS n_distinct, n * nb AS n_rows FROM (SELECT site, count(*) AS nb, least(factorial(least(count(*), 12)::INTEGER), 9999)::BIGINT AS n FROM sidx GROUP BY site)""")
def g4_complete(spark, d):
    from ..operators import resample as R

    b = sparse_blocks(spark, d).select("site", "block_id").distinct()
    o = R.ordering_lists(b, ["site"], 9_999, 5)
    per = o.select("site", "rep", F.array_join("sources", ",").alias("o"), F.size("targets").cast("bigint").alias("n"))
    return per.groupBy("site").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o").alias("n_distinct"), F.sum("n").alias("n_rows"))


@query("g4_orderings", """SELECT site, count(DISTINCT rep) AS n_orders, count(*) AS n_rows FROM sperm GROUP BY site""")
def g4(spark, d):
    from ..operators import resample as R

    s = sparse_blocks(spark, d).select("site", "block_id").distinct()
    return R.block_orderings(s, ["site"], 20, 5).groupBy("site").agg(F.countDistinct("rep").alias("n_orders"), F.count(F.lit(1)).alias("n_rows"))
