"""Query registry and the views that let the given tables stand in for rasters and spectra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its DuckDB text (view names it uses are expanded into CTEs)."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- SQL views; a view may use those before it -------------------------------------------------

VIEWS: dict[str, str] = {
    "pix": """SELECT vec_id, CAST(vec_id // 25 AS INTEGER) AS row_i, CAST(vec_id % 25 AS INTEGER) AS col_i,
       list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS refl, label FROM embeddings""",
    "band_values": """SELECT vec_id, row_i, col_i, label, unnest(range(64)) AS band_index, unnest(refl) AS value FROM pix""",
    "bands": """SELECT CAST(b AS INTEGER) AS band_index, 400.0::DOUBLE + 33.0::DOUBLE * b AS wavelength_nm,
       (b % 16 <> 15) AS good FROM range(64) t(b)""",
    "qa": """SELECT vec_id, row_i, col_i, label,
       CASE WHEN refl[1] > 0.3 THEN 1 WHEN refl[1] < -0.3 THEN 255 ELSE 0 END AS cloud,
       CASE WHEN refl[2] > 0.3 THEN 1 ELSE 0 END AS cirrus,
       CASE WHEN refl[3] > 0.33 THEN 1 ELSE 0 END AS nodata,
       list_transform(refl, lambda v: CASE WHEN v >= -0.38 THEN v END) AS refl FROM pix""",
    "qaok": """SELECT *, (cloud <> 0 OR cirrus <> 0 OR nodata <> 0
         OR list_count(refl) < 64) AS invalid FROM qa""",
    # pixels with a valid spectrum, long
    "clear_values": """SELECT vec_id, row_i, col_i, label, unnest(range(64)) AS band_index, unnest(refl) AS value
       FROM qaok WHERE NOT invalid""",
    "median_long": """SELECT label, band_index, quantile_cont(value, 0.5) AS value FROM band_values GROUP BY label, band_index""",
    "median_arr": """SELECT label, list(value ORDER BY band_index) AS mrefl FROM median_long GROUP BY label""",
    "medoid": """SELECT label, vec_id, refl, angle FROM (SELECT p.label, p.vec_id, p.refl,
         acos(greatest(-1, least(1, list_inner_product(p.refl, m.mrefl)
           / sqrt(list_inner_product(p.refl, p.refl) * list_inner_product(m.mrefl, m.mrefl))))) AS angle,
         row_number() OVER (PARTITION BY p.label ORDER BY acos(greatest(-1, least(1, list_inner_product(p.refl, m.mrefl)
           / sqrt(list_inner_product(p.refl, p.refl) * list_inner_product(m.mrefl, m.mrefl))))), p.vec_id) AS rn
         FROM pix p JOIN median_arr m USING (label)) WHERE rn = 1""",
    "sam": """SELECT p.vec_id, p.row_i, p.col_i, m.label AS mineral,
         acos(greatest(-1, least(1, list_inner_product(p.refl, m.refl)
           / (sqrt(list_inner_product(p.refl, p.refl)) * sqrt(list_inner_product(m.refl, m.refl)))))) AS angle
         FROM pix p CROSS JOIN medoid m""",
    "sam_class": """SELECT vec_id, row_i, col_i, CASE WHEN min(angle) <= 1.35 THEN arg_min(mineral, angle) ELSE -1 END AS code
         FROM sam GROUP BY vec_id, row_i, col_i""",
    # matched filter on bands 0 and 1: closed-form 2x2 inverse, ridge 0.01
    "mom2": """SELECT count(*) AS n, avg(refl[1]) AS m0, avg(refl[2]) AS m1, covar_samp(refl[1], refl[1]) AS c00,
         covar_samp(refl[1], refl[2]) AS c01, covar_samp(refl[2], refl[2]) AS c11 FROM pix""",
    "inv2": """SELECT n, m0, m1, l11 / det AS i00, -c01 / det AS i01, l00 / det AS i11 FROM (SELECT *, l00 * l11 - c01 * c01 AS det
         FROM (SELECT *, c00 + 0.01::DOUBLE * (c00 + c11) / 2 AS l00, c11 + 0.01::DOUBLE * (c00 + c11) / 2 AS l11 FROM mom2))""",
    "target2": """SELECT label AS mineral, t0 - m0 AS d0, t1 - m1 AS d1,
         i00 * (t0 - m0) + i01 * (t1 - m1) AS w0, i01 * (t0 - m0) + i11 * (t1 - m1) AS w1
         FROM (SELECT label, refl[1] AS t0, refl[2] AS t1 FROM medoid) CROSS JOIN inv2""",
    "mf2": """SELECT vec_id, row_i, col_i, label, mineral, mf,
         sqrt(greatest(rx - mf * mf * eta, 0)) AS infeas FROM (
         SELECT p.vec_id, p.row_i, p.col_i, p.label, t.mineral, t.d0 * t.w0 + t.d1 * t.w1 AS eta,
         ((p.refl[1] - m0) * t.w0 + (p.refl[2] - m1) * t.w1) / (t.d0 * t.w0 + t.d1 * t.w1) AS mf,
         (p.refl[1] - m0) * (i00 * (p.refl[1] - m0) + i01 * (p.refl[2] - m1))
           + (p.refl[2] - m1) * (i01 * (p.refl[1] - m0) + i11 * (p.refl[2] - m1)) AS rx
         FROM pix p CROSS JOIN inv2 CROSS JOIN target2 t)""",
    # score raster from the event stream: sites of 100 x 100 cells
    "ev": """SELECT event_id, CAST(event_id // 10000 AS INTEGER) AS site, CAST((event_id % 10000) // 100 AS INTEGER) AS row_i,
         CAST(event_id % 100 AS INTEGER) AS col_i, CASE WHEN k >= 3 THEN value END AS score,
         CASE WHEN k <> 7 THEN CAST(k AS DOUBLE) END AS score2,
         CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 5 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 14 ELSE NULL END AS code,
         k, ts, user_id, event_type FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
    # two layers with their positive classes, binarised reference
    "lay": """SELECT site, row_i, col_i, 'alpha' AS layer, score, CASE WHEN code NOT IN (0,14,45,46,47,48,49,50)
           THEN CASE WHEN code IN (3) THEN 1 ELSE 0 END END AS ref FROM ev
         UNION ALL SELECT site, row_i, col_i, 'beta', score2, CASE WHEN code NOT IN (0,14,45,46,47,48,49,50)
           THEN CASE WHEN code IN (5, 7) THEN 1 ELSE 0 END END FROM ev""",
    # complete blocks of side 20
    "blk": """SELECT site, layer, row_i // 20 AS block_row, col_i // 20 AS block_col,
         printf('r%04d_c%04d', row_i // 20, col_i // 20) AS block_id, row_i, col_i, score, ref
         FROM lay JOIN (SELECT site, (max(row_i) + 1) // 20 AS nbr, (max(col_i) + 1) // 20 AS nbc FROM ev GROUP BY site) g USING (site)
         WHERE row_i // 20 < nbr AND col_i // 20 < nbc""",
    "obs": "SELECT * FROM blk WHERE score IS NOT NULL AND ref IS NOT NULL",
}


#: Views that several others read: computed once.
MATERIALIZED: set[str] = set()


def filter_views(tag: str, pixels: str, values: str, targets: str) -> None:
    """Matched filter of any number of bands as views ending in ``mf{tag}``, the inverse by Gauss-Jordan elimination.

    ``pixels``: vec_id, row_i, col_i, label; ``values``: vec_id, band_index, value; ``targets``: mineral, band_index, value.
    """
    VIEWS.update({
        f"val{tag}": values,
        f"mean{tag}": f"SELECT band_index, avg(value) AS mean, row_number() OVER (ORDER BY band_index) - 1 AS r, count(*) OVER () AS nb FROM val{tag} GROUP BY band_index",
        f"cen{tag}": f"SELECT v.vec_id, m.r, v.value - m.mean AS x FROM val{tag} v JOIN mean{tag} m USING (band_index)",
        f"cov{tag}": f"SELECT a.r AS i, b.r AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM cen{tag} a JOIN cen{tag} b USING (vec_id) GROUP BY ALL",
        f"aug{tag}": f"""SELECT i, j, nb, c + CASE WHEN i = j THEN 0.01::DOUBLE * (SELECT avg(c) FROM cov{tag} WHERE i = j) ELSE 0 END AS v FROM cov{tag} CROSS JOIN (SELECT DISTINCT nb FROM mean{tag})
          UNION ALL SELECT r, nb + CAST(c AS BIGINT), nb, CASE WHEN r = c THEN 1.0::DOUBLE ELSE 0 END FROM mean{tag} CROSS JOIN (SELECT r AS c FROM mean{tag})""",
        f"elim{tag}": f"""SELECT 0::BIGINT AS k, i, j, nb, v FROM aug{tag} UNION ALL SELECT k + 1, i, j, nb, CASE WHEN i = k THEN v / lead_v ELSE v - own * top / lead_v END FROM (SELECT *, max(v) FILTER (WHERE i = k AND j = k) OVER () AS lead_v,
          max(v) FILTER (WHERE i = k) OVER (PARTITION BY j) AS top, max(v) FILTER (WHERE j = k) OVER (PARTITION BY i) AS own FROM elim{tag}) WHERE k < nb""",
        f"inv{tag}": f"SELECT i, j - nb AS j, v FROM elim{tag} WHERE k = nb AND j >= nb",
        f"tgt{tag}": targets,
        f"dir{tag}": f"SELECT mineral, i.j AS r, sum((t.value - m.mean) * i.v) AS w FROM tgt{tag} t JOIN mean{tag} m USING (band_index) JOIN inv{tag} i ON i.i = m.r GROUP BY ALL",
        f"eta{tag}": f"SELECT mineral, sum(d.w * (t.value - m.mean)) AS eta FROM dir{tag} d JOIN mean{tag} m USING (r) JOIN tgt{tag} t USING (mineral, band_index) GROUP BY mineral",
        f"rx{tag}": f"SELECT c.vec_id, sum(c.x * i.v * o.x) AS rx FROM cen{tag} c JOIN inv{tag} i ON i.i = c.r JOIN cen{tag} o ON o.vec_id = c.vec_id AND o.r = i.j GROUP BY c.vec_id",
        f"mf{tag}": f"""SELECT p.vec_id, p.row_i, p.col_i, p.label, s.mineral, s.s / e.eta AS mf, sqrt(greatest(x.rx - s.s * s.s / e.eta, 0)) / sqrt((SELECT max(nb) - 1 FROM mean{tag})) AS infeas
          FROM (SELECT c.vec_id, d.mineral, sum(c.x * d.w) AS s FROM cen{tag} c JOIN dir{tag} d USING (r) GROUP BY ALL) s JOIN eta{tag} e USING (mineral) JOIN rx{tag} x USING (vec_id) JOIN ({pixels}) p USING (vec_id)""",
    })
    MATERIALIZED.update({f"val{tag}", f"mean{tag}", f"cen{tag}", f"cov{tag}", f"inv{tag}", f"dir{tag}", f"mf{tag}"})


filter_views("all", "SELECT vec_id, row_i, col_i, label FROM pix", "SELECT vec_id, band_index, value FROM band_values",
             "SELECT label AS mineral, unnest(range(64)) AS band_index, unnest(refl) AS value FROM medoid")


def with_views(sql: str) -> str:
    """Prefix the CTEs a query needs, in order."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                need.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({VIEWS[n]})" for n in VIEWS if n in need)
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE" or any(n.startswith("elim") for n in need)
    start = "WITH RECURSIVE" if recursive else "WITH"
    if body[:14].upper() == "WITH RECURSIVE":
        return f"{start} {ctes},\n{body[14:]}"
    if body[:5].upper() == "WITH ":
        return f"{start} {ctes},\n{body[5:]}"
    return f"{start} {ctes}\n{body}"


# ---- the same views on Spark ---------------------------------------------------------------------

N_BANDS = 64
WAVELENGTHS = [400.0 + 33.0 * b for b in range(N_BANDS)]


def pix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / 25).cast("int").alias("row_i"),
        (F.col("vec_id") % 25).cast("int").alias("col_i"),
        F.col("embedding").cast("array<double>").alias("refl"),
        "label",
    )


def bands(spark: SparkSession) -> DataFrame:
    b = F.col("id")
    return spark.range(N_BANDS).select(
        b.cast("int").alias("band_index"),
        (F.lit(400.0) + F.lit(33.0) * b).alias("wavelength_nm"),
        (b % 16 != 15).alias("good"),
    )


def qa(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("refl")
    return pix(spark, d).select(
        "vec_id", "row_i", "col_i", "label",
        F.when(r[0] > 0.3, 1).when(r[0] < -0.3, 255).otherwise(0).alias("cloud"),
        F.when(r[1] > 0.3, 1).otherwise(0).alias("cirrus"),
        F.when(r[2] > 0.33, 1).otherwise(0).alias("nodata"),
        F.transform(r, lambda v: F.when(v >= -0.38, v)).alias("refl"),
    )


def library(spark: SparkSession, d: str) -> DataFrame:
    return pix(spark, d).select(F.col("label").alias("mineral"), F.col("vec_id").alias("sample"), "refl")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    eid = F.col("event_id")
    t = F.col("event_type")
    return e.select(
        "event_id",
        F.floor(eid / 10000).cast("int").alias("site"),
        F.floor((eid % 10000) / 100).cast("int").alias("row_i"),
        (eid % 100).cast("int").alias("col_i"),
        F.when(F.col("k") >= 3, F.col("value")).alias("score"),
        F.when(F.col("k") != 7, F.col("k").cast("double")).alias("score2"),
        F.when(t == "view", 3).when(t == "click", 5).when(t == "signup", 7).when(t == "purchase", 14).alias("code"),
        "k", "ts", "user_id", "event_type",
    )


POSITIVE = {"alpha": [3], "beta": [5, 7]}


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(l, c) for l, cs in POSITIVE.items() for c in cs], "layer string, code int")


def lay(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mask import binary_reference

    b = binary_reference(ev(spark, d), layers(spark))
    return b.select(
        "site", "row_i", "col_i", "layer",
        F.when(F.col("layer") == "alpha", F.col("score")).otherwise(F.col("score2")).alias("score"),
        "ref",
    )
