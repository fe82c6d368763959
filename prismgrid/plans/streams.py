"""Streaming queries over the given tables, run to completion with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import running as ST
from .pairing import scratch
from .registry import N_BANDS, query, r6, rounded, table


def stream(spark, d: str, name: str):
    """The table as a stream, whether it is one file or a folder of part files: a pattern may name either, a plain path no file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


@query("st1_running_moments", """SELECT label, count(*) AS n, round(avg(refl[1]), 6) + 0.0 AS mean_0, round(covar_samp(refl[1], refl[3]), 6) + 0.0 AS cov_02 FROM pix GROUP BY label""")
def st1(spark, d):
    tiles = stream(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("refl"))
    state = scratch(spark)
    ST.start_moments(tiles, state, scratch(spark), ["label"], [0, 1, 2], N_BANDS).awaitTermination()
    m = ST.current_moments(spark, state, ["label"])
    return m.select("label", "n", r6(F.col("mean")[0]).alias("mean_0"), r6(F.col("m2")[2] / (F.col("n") - 1)).alias("cov_02"))


@query("st2_running_frequency", """SELECT user_id, event_type, count(*) FILTER (WHERE value >= 60 AND k >= 3) AS n_detected, count(*) FILTER (WHERE k >= 3) AS n_valid, round(count(*) FILTER (WHERE value >= 60 AND k >= 3) / nullif(count(*) FILTER (WHERE k >= 3), 0)::DOUBLE, 6) + 0.0 AS frequency
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id, event_type""")
def st2(spark, d):
    e = stream(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    # every member arrives twice, as after a redelivery
    m = e.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("event_id").alias("member_id"), "user_id", "event_type", (F.col("value") >= 60).alias("detected"), (F.col("k") >= 3).alias("valid"))
    target = scratch(spark)
    ST.start_frequency(ST.running_frequency(m, ["user_id", "event_type"]), target, scratch(spark)).awaitTermination()
    return rounded(ST.latest_frequency(spark, target, ["user_id", "event_type"]), "frequency")
