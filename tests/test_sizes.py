"""Joins and tables whose size Spark's estimate does not know: none of them may be collected for a broadcast."""

from pyspark.sql import functions as F

from prismgrid.functions import draws as D
from prismgrid.operators import blocks as K, resample as R, stats


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_halo_cells_are_not_broadcast(spark):
    cells = spark.range(144).select(F.lit("s").alias("site"), (F.col("id") / 12).cast("int").alias("row_i"), (F.col("id") % 12).cast("int").alias("col_i"))
    blocks = K.complete_blocks(K.grid_shape(cells, ["site"]), ["site"], 4)
    out = K.halo_cells(cells, blocks, ["site"], 4, 1)
    assert "Broadcast" not in plan(out)
    # the middle block sees 6 x 6 cells, an edge block 6 x 5, a corner block 5 x 5
    assert sorted(r["count"] for r in out.groupBy("fold").count().collect()) == [25] * 4 + [30] * 4 + [36]


def test_streams_read_a_folder_of_files(spark, tmp_path):
    from prismgrid.plans.streams import stream

    spark.range(10).repartition(2).write.parquet(str(tmp_path / "folder.parquet"))
    q = stream(spark, str(tmp_path), "folder").writeStream.format("memory").queryName("folder_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("folder_rows").count() == 10


def some_blocks(spark, keys=3, n=9):
    return spark.range(keys * n).select((F.col("id") % keys).alias("k"), F.format_string("b%02d", (F.col("id") / keys).cast("int")).alias("block_id"))


def test_draws_are_not_broadcast(spark):
    b = some_blocks(spark)
    w = D.block_weights(b, ["k"], 50, 7)
    # one row for each block, the replicates inside
    assert w.count() == 27 and set(w.columns) == {"k", "block_id", "n_blocks", "draws"}
    rows = D.weighted_rows(b, w, ["k", "block_id"])
    want = D.block_draws(b, ["k"], 50, 7).groupBy("k", "rep", "block_id").agg(F.count(F.lit(1)).alias("w"))
    assert {tuple(r) for r in rows.select("k", "rep", "block_id", "w").collect()} == {tuple(r) for r in want.select("k", "rep", "block_id", "w").collect()}


def test_orderings_are_arrays_until_the_end(spark):
    b = some_blocks(spark)
    o = R.ordering_lists(b, ["k"], 60, 5)
    assert o.count() == 180 and o.select("k", "sources").distinct().count() == 180
    assert "BroadcastHashJoin" not in plan(D.block_permutations(b, ["k"], 60, 5))


def test_edges_that_are_not_broadcast_are_materialised(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_BROADCAST_ROWS", 3)
    small = stats.checked_small(spark.range(100).groupBy((F.col("id") % 10).alias("k")).agg(F.max("id").alias("v")))
    assert "HashAggregate" not in plan(small) and small.count() == 10


def test_strict_sql_scores_complete_blocks_only():
    import duckdb

    import __spark_entry__ as entry
    from oracle import DATA

    con = duckdb.connect()
    # the second scene ends in its eleventh row: two rows of blocks and a remainder
    copies = f"SELECT vec_id + 500 * i AS vec_id, embedding, label FROM '{DATA}/sf0.001/embeddings.parquet' CROSS JOIN range(2) r(i)"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM ({copies}) WHERE vec_id < 756")
    rows = con.execute("SELECT scene, count(*) FROM (" + entry.oracle_sql()["x27_strict_maps"] + ") GROUP BY scene ORDER BY scene").fetchall()
    assert rows == [(0, 20), (1, 10)], rows


def test_cells_are_not_broadcast_to_their_grid(spark):
    cells = spark.range(144).select((F.col("id") % 2).alias("site"), (F.col("id") / 12).cast("int").alias("row_i"), (F.col("id") % 12).cast("int").alias("col_i"))
    out = K.in_complete_blocks(cells, K.grid_shape(cells, ["site"]), ["site"], 5)
    # the side that is kept is the cells, so only the grids can be broadcast
    assert "LeftOuter" in plan(out) and "BuildLeft" not in plan(out)
    assert out.count() == 100


def test_members_are_counted_before_they_meet_the_patches(spark):
    from prismgrid.operators import pairs as P

    patches = spark.createDataFrame([(1,), (2,)], "patch_id long")
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "i long, j long")
    members = spark.createDataFrame([(0, 1), (0, 7), (1, 7), (1, None), (2, 2)], "cluster_id long, patch_id long")
    out = P.contract_violations(patches, pairs, members)
    got = sorted((r.check, r.patch_id if r.patch_id is not None else -1) for r in out.collect())
    assert got == [("duplicate_membership", 7), ("member_without_patch", -1), ("member_without_patch", 7), ("pair_without_patch", 9)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(lines) if "Join LeftAnti" in line]
    assert len(joins) == 2 and all("Aggregate" in lines[i + 1] for i in joins)


def test_tasks_follow_the_rows_however_well_they_compress(spark, monkeypatch):
    from prismgrid.operators import crossfit as C

    cells = spark.range(2 * 900).select(
        (F.col("id") % 2).alias("site"), (F.floor(F.col("id") / 2) / 30).cast("int").alias("row_i"), (F.floor(F.col("id") / 2) % 30).cast("int").alias("col_i"),
        (F.pmod(F.hash("id"), F.lit(97)) / 7.0).alias("score"), F.pmod(F.hash("id", F.lit(1)), F.lit(2)).alias("ref"))
    grid = K.grid_shape(cells, ["site"])
    obs = K.in_complete_blocks(cells, grid, ["site"], 6)
    folds = K.training_pairs(K.complete_blocks(grid, ["site"], 6), ["site"], 1)
    want = sorted(map(tuple, C.fold_thresholds(obs, folds, ["site"], steps=4).drop("youden_j").collect()))
    pairs = sorted(map(tuple, R.pair_numerators(obs, ["site"]).collect()))
    monkeypatch.setattr(stats, "TASK_ROWS", 50)
    steps, edges = [], C.value_edges
    monkeypatch.setattr(C, "value_edges", lambda df, keys, value, n: steps.append(n) or edges(df, keys, value, n))
    got, tiles = C.fold_thresholds(obs, folds, ["site"]), R.pair_numerators(obs, ["site"])
    # tasks are dealt by number, which Spark does not put together again by compressed bytes
    assert plan(got).count("REPARTITION_BY_NUM") == 2 and plan(tiles).count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, got.drop("youden_j").collect())) == want and sorted(map(tuple, tiles.collect())) == pairs
    # a small key has two buckets, so the list of a fold travels twice and not sixteen times
    assert steps == [1]


def test_a_bootstrap_is_joined_from_materialised_block_tables(spark):
    oof = spark.range(400).select(
        (F.col("id") % 2).alias("k"), F.format_string("b%02d", (F.col("id") % 9).cast("int")).alias("block_id"),
        (F.pmod(F.hash("id"), F.lit(31)) / 3.0).alias("score"), F.pmod(F.hash("id", F.lit(1)), F.lit(2)).alias("ref"), (F.col("id") % 2).cast("int").alias("pred"))
    out = R.bootstrap_metrics(oof, ["k"], 20, 7)
    p = plan(out)
    # the last join reads two tables; no window, draw or cogroup before it shares its tasks
    assert "Window" not in p and "FlatMapCoGroups" not in p and "Generate" not in p
    assert out.count() == 40
