import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismgrid.functions import rules
from prismgrid.operators import detect, ensemble as E, mask as M
from prismgrid.sources import pixels as SRC, sinks as SNK
from prismgrid.streaming import running as ST


def test_library_files(spark, tmp_path):
    for name, lines in {"lib1_Alunite_1_ASDFRa.txt": ["0.5", "-1.23e34", "0.7"], "LIB1_ALUNITE_2_BECKb.txt": ["0.1", "0.2"], "lib1_opalite_ASDFRa.txt": ["1", "2", "3"],
                        "lib1_alunite_3_ASDFRa.txt": ["1"], "alunite_4_ASDFRa.txt": ["1", "2", "3"], "lib1_opal_x_ASDFRa.txt": ["1", "2", "3"]}.items():
        (tmp_path / name).write_text("\n".join(["head", *lines]) + "\n")
    grids = spark.createDataFrame([("ASD", 3), ("BECK", 2)], "spectrometer string, n_bands int")
    good, bad = SRC.parse_library(SRC.read_library_text(spark, str(tmp_path)), ["alunite", "opal", "opal_x"], grids, "lib1")
    assert {(r.mineral, r["sample"]): r.refl for r in good.collect()} == {
        ("alunite", "lib1_Alunite_1_ASDFRa"): [0.5, None, 0.7], ("alunite", "LIB1_ALUNITE_2_BECKb"): [0.1, 0.2],
        ("opal", "lib1_opal_x_ASDFRa"): [1, 2, 3], ("opal_x", "lib1_opal_x_ASDFRa"): [1, 2, 3]}
    assert {r["sample"]: r.reason for r in bad.collect()} == {
        "lib1_opalite_ASDFRa": "unknown_mineral", "alunite_4_ASDFRa": "unknown_mineral", "lib1_alunite_3_ASDFRa": "length_mismatch"}


def test_manifest_finds_missing_extra_and_changed(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.bin").write_text(n)
    m = SRC.checksum_manifest(spark, str(tmp_path)).collect()
    declared = spark.createDataFrame([(r.path, r.sha256) for r in m], "path string, sha256 string")
    assert SRC.manifest_differences(declared, SRC.checksum_manifest(spark, str(tmp_path))).count() == 0
    (tmp_path / "a.bin").write_text("x")
    (tmp_path / "d.bin").write_text("d")
    os.remove(tmp_path / "b.bin")
    got = {r.path: r.status for r in SRC.manifest_differences(declared, SRC.checksum_manifest(spark, str(tmp_path))).collect()}
    assert got == {"a.bin": "changed", "b.bin": "missing", "d.bin": "extra"}


def test_pixel_reader_turns_nan_into_null_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 1.0, [1.0, float("nan")]), ("t", 1, float("nan"), [2.0, 3.0])], "scene_id string, tile_row int, x double, refl array<float>")
    df.write.partitionBy("scene_id").parquet(str(tmp_path / "p"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tile_row", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("refl", T.ArrayType(T.FloatType())), T.StructField("scene_id", T.StringType())])
    got = SRC.read_pixels(spark, str(tmp_path / "p"), schema, F.col("scene_id") == "s")
    assert got.first().refl == [1.0, None]
    assert "PartitionFilters: [isnotnull(scene_id" in got._jdf.queryExecution().toString()
    assert SRC.read_pixels(spark, str(tmp_path / "p"), schema, F.col("scene_id") == "t").first().x is None


def test_result_table_and_layers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", None, 2)], "name string, v double, n int")
    SNK.write_results(df.coalesce(1), str(tmp_path / "r"), ["n", "v", "name"], 3)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["1,0.500,a", "2,,b", "n,v,name"]
    SNK.write_layers(spark.createDataFrame([("s", "l", 1, 0.5)], "scene_id string, layer string, row_i int, score double"), str(tmp_path / "l"))
    assert os.path.isdir(tmp_path / "l" / "scene_id=s" / "layer=l")


def test_masking_drops_undocumented_quality_and_keeps_overshoot(spark):
    rows = [(0, 0, 0, [0.1, 1.7]), (255, 0, 0, [0.1, 0.2]), (0, 0, 1, [0.1, 0.2]), (0, 0, 0, [0.1, None]), (7, 0, 0, [0.3, 0.3])]
    df = spark.createDataFrame(rows, "cloud int, cirrus int, nodata int, refl array<double>")
    assert [r.refl for r in M.mask_pixels(df).collect()] == [[0.1, 1.7], None, None, None, None]
    assert [(r.field, r.value) for r in M.qa_domain_violations(df).collect()] == [("cloud", 7)]


@pytest.mark.parametrize("present,tier", [({"jarosite", "gypsum"}, 3), ({"hematite", "gypsum"}, 2), ({"gypsum"}, 1), (set(), 0)])
def test_tier_priority(spark, present, tier):
    rows = [(1, m, m in present, 0.1) for m in ("jarosite", "goethite", "hematite", "gypsum")] + [(2, "jarosite", False, None)]
    df = spark.createDataFrame(rows, "p int, layer string, present boolean, mf double")
    got = {r.p: r.tier for r in detect.ordinal_tier(df, ["p"], "layer", (F.col("layer") == "jarosite") & F.col("mf").isNotNull()).collect()}
    assert got == {1: tier, 2: None}


def test_gate_is_strict_and_floor_inclusive(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.99, 1.0])], "mf array<double>, i array<double>")
    assert df.select(M.gate_infeasible("mf", "i", 1.0)).first()[0] == [1.0, None]
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, -5.0)] + [("b", -1.0)], "k string, v double")
    got = [(r.v, r.present) for r in detect.detections(d, ["k"], "v", 0.5).orderBy("v").collect()]
    assert got == [(-5.0, False), (-1.0, False), (1.0, False), (2.0, True), (3.0, True)]


def test_decision_truth_tables(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    b = lambda v: F.lit(v).cast("boolean")
    d = lambda v: F.lit(v).cast("double")
    assert [pick(rules.support_tier(F.lit(p), F.lit(n))) for p, n in ((4, 50), (5, 50), (10, 9), (10, 10))] == ["counts_and_maps_only", "exploratory_only", "exploratory_only", "confirmatory_eligible"]
    gate = lambda *v: pick(rules.external_gate(*[d(x) for x in v]))
    assert gate(10, 10, 0.6, 0.6, 0.6) == "pass" and gate(10, 10, 0.6, 0.5, 0.6) == "ranking_only" and gate(10, 10, 0.6, None, 0.6) == "ranking_only"
    assert gate(10, 10, 0.5, 0.6, 0.6) == "fail" and gate(9, 10, 0.6, 0.6, 0.6) == "unavailable" and gate(10, 10, None, 0.6, 0.6) == "unavailable"
    claim = lambda *v: pick(rules.permitted_claim(*[b(x) for x in v]))
    assert claim(True, True, None) == "unavailable_required_evidence" and claim(True, False, False) == "analytically_stable_spatial_pattern_only"
    assert claim(False, True, False) == "operational_discrimination_not_strictly_held_out" and claim(False, True, True) == "discriminative_but_analytically_sensitive"
    rep = lambda p, e: pick(rules.repeatability_class(F.lit(p), F.lit(e), F.lit(4)))
    assert [rep(4, True), rep(2, False), rep(0, True), rep(0, False)] == ["strong", "date-dependent", "unsupported", "unavailable"]
    assert [pick(rules.confidence_class(d(v))) for v in (0.2, 0.21, 0.8, None)] == ["stable_negative", "sensitive", "stable_positive", "nodata"]


def test_design_accounting(spark):
    m = E.build_design(spark.createDataFrame([("a",), ("b",)], "site string"))
    r = {x.site: (x.n, x.f) for x in m.groupBy("site").agg(F.countDistinct("member_id").alias("n"), F.countDistinct("fit_id").alias("f")).collect()}
    assert r == {"a": (355, 83), "b": (355, 83)}


def test_schedule_is_balanced(spark):
    lib = spark.createDataFrame([("m", i) for i in range(7)] + [("k", i) for i in range(40)], "mineral string, sample int")
    s = E.balanced_schedule(lib, 16, 42)
    n = {r.mineral: (r.lo, r.hi, r.t) for r in s.groupBy("mineral", "sample").count().groupBy("mineral").agg(F.min("count").alias("lo"), F.max("count").alias("hi"), F.sum("count").alias("t")).collect()}
    assert n == {"m": (2, 3, 16), "k": (1, 1, 16)}


def test_running_moments_survive_a_repeated_batch(spark, tmp_path):
    schema = "scene string, refl array<double>"
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("s", [1.0, 2.0]), ("s", [3.0, 1.0])], schema).coalesce(1).write.parquet(src)
    run = lambda ck: ST.start_moments(spark.readStream.schema(schema).parquet(src), state, str(tmp_path / ck), ["scene"], [0, 1], 2).awaitTermination()
    run("c1")
    spark.createDataFrame([("s", [5.0, 3.0])], schema).coalesce(1).write.mode("append").parquet(src)
    run("c1")
    r = ST.current_moments(spark, state, ["scene"]).first()
    assert r.n == 3 and r["mean"] == pytest.approx([3.0, 2.0]) and r.m2[0] == pytest.approx(8.0)


def test_running_frequency_counts_a_member_once(spark, tmp_path):
    schema = "member_id int, px int, valid boolean, detected boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: ST.start_frequency(ST.running_frequency(spark.readStream.schema(schema).parquet(src), ["px"]), out, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(1, 1, True, True), (1, 2, False, True)], schema).write.parquet(src)
    run()
    spark.createDataFrame([(1, 1, True, True), (2, 1, True, False)], schema).write.mode("append").parquet(src)
    run()
    got = {r.px: (r.n_detected, r.n_valid, r.frequency) for r in ST.latest_frequency(spark, out, ["px"]).collect()}
    assert got == {1: (1, 2, 0.5), 2: (0, 0, None)}


def test_member_block_metrics_in_one_pass(spark):
    rng = np.random.default_rng(4)
    cells = [(m, i, j, f"b{i // 3}") for m in range(3) for i in range(6) for j in range(3)]
    # the second block of member 2 has no value at all
    rows = [("s", m, i, j, b, None if (m == 2 and b == "b1") or (i + j + m) % 5 == 0 else float(rng.integers(0, 4))) for m, i, j, b in cells]
    m = spark.createDataFrame(rows, "site string, member int, row_i int, col_i int, block_id string, score double")
    m = m.withColumn("valid", F.col("score").isNotNull()).withColumn("detected", F.coalesce(F.col("score") >= 2, F.lit(False)))
    base = m.where("member = 0").select("site", "row_i", "col_i", F.col("score").alias("score0"), F.col("valid").alias("valid0"), F.col("detected").alias("detected0"))
    out = E.member_block_metrics(m, base, ["site", "row_i", "col_i"], ["site", "member"])
    own = {(r[1], r[2], r[3]): r[5] for r in rows}
    got = {(r.member, r.block_id): r for r in out.collect()}
    assert len(got) == 6
    for (member, block), r in got.items():
        pairs = [(own[member, i, j], own[0, i, j]) for mm, i, j, b in cells if mm == member and b == block]
        both = pd.DataFrame([p for p in pairs if None not in p], columns=["a", "b"])
        assert (r.n_valid, r.n_joint) == (sum(a is not None for a, _ in pairs), len(both))
        want = both["a"].rank().corr(both["b"].rank()) if len(both) > 1 else None
        assert r.rank_correlation is None if want is None or want != want else abs(r.rank_correlation - want) < 1e-9
    # the rank correlation needs no second reading of the members
    p = out._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("LogicalRDD") + p.count("LocalRelation") <= 2 and "percentile_approx" not in p
