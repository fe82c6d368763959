import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.functions import projection
from prismgrid.operators import graph, knn, pairs as P, regrid as G


def test_neighbourhood_sees_diagonals_across_gaps(spark):
    cells = {(0, 0): 1, (1, 1): 2, (2, 0): 3, (0, 3): 4}
    df = spark.createDataFrame([("s", r, c, v) for (r, c), v in cells.items()], "k string, row_i int, col_i int, v int")
    for row in G.neighbourhood(df, ["k"], ["v"]).collect():
        want = {(a - row.row_i, b - row.col_i, v) for (a, b), v in cells.items() if abs(a - row.row_i) <= 1 and abs(b - row.col_i) <= 1}
        assert {(n.dr, n.dc, n.v) for n in row.nb} == want


def test_shift_moves_without_wraparound(spark):
    df = spark.createDataFrame([("s", r, c, r * 3 + c) for r in range(3) for c in range(3)], "k string, row_i int, col_i int, v int")
    got = {(r.row_i, r.col_i): r.shifted_v for r in G.shifted_pairs(df, ["k"], ["v"], ["v"]).where("dy = 1 AND dx = 0").collect()}
    assert got[(0, 0)] is None and got[(1, 0)] == 0 and got[(2, 2)] == 5


def test_boundaries_skip_edges_and_missing(spark):
    a = [[1, 1, 0], [1, None, 1], [1, 1, 1]]
    df = spark.createDataFrame([("s", r, c, a[r][c], 1) for r in range(3) for c in range(3)], "k string, row_i int, col_i int, a int, b int")
    got = {(r.row_i, r.col_i) for r in G.boundary_cells(df, ["k"], "a", "b").where("on_a").collect()}
    assert got == {(0, 1), (1, 2)}


def test_nearest_equals_brute_force_with_far_and_dense_points(spark):
    rng = np.random.default_rng(0)
    src = np.vstack([np.round(rng.normal(0, 0.05, (300, 2)), 2), np.round(rng.uniform(-20, 20, (40, 2)), 1)])
    tgt = np.vstack([rng.uniform(-25, 25, (60, 2)), [[900.0, -900.0]]])
    s = spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(src)], "g string, sid long, x double, y double")
    t = spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(tgt)], "g string, tid long, x double, y double")
    got = {r.tid: (r.sid, r.distance) for r in knn.nearest(t, s, ["g"], ["tid"], "sid", 0.5).collect()}
    for i, p in enumerate(tgt):
        d2 = (p[0] - src[:, 0]) ** 2 + (p[1] - src[:, 1]) ** 2
        assert got[i] == (int(np.flatnonzero(d2 == d2.min())[0]), pytest.approx(np.sqrt(d2.min())))


def test_empty_boundary_gives_no_distance(spark):
    df = spark.createDataFrame([("s", r, c, 0, int(c > 1)) for r in range(3) for c in range(3)], "k string, row_i int, col_i int, a int, b int")
    assert knn.symmetric_boundary_distance(df, ["k"], "a", "b", 30.0, 30.0).count() == 0


def test_utm_known_points_and_round_trip(spark):
    # the central meridian is easting 500 km; the equator is northing 0 or 10,000 km; known values of two towns
    rows = [(-117.0, 0.0, 11, False), (-117.0, 0.0, 11, True), (-79.387139, 43.642567, 17, False), (174.776, -41.2865, 60, True)]
    rows += [((lon0 + dlon + 180) % 360 - 180, lat, int((lon0 + 183) // 6), lat < 0) for lon0 in (-177.0, 3.0, 177.0) for dlon in (-3.4, -1.0, 0.0, 2.9) for lat in (-79.0, -33.3, -0.01, 12.5, 66.0, 83.9)]
    c = F.col
    df = spark.createDataFrame(rows, "lon double, lat double, zone int, south boolean")
    df = projection.to_utm(df, c("zone"), c("south"))
    got = projection.from_utm(df, c("zone"), c("south"), lon="lon2", lat="lat2").collect()
    assert (got[0].x, got[0].y) == pytest.approx((500_000, 0), abs=1e-6) and (got[1].x, got[1].y) == pytest.approx((500_000, 1e7), abs=1e-6)
    assert (got[2].x, got[2].y) == pytest.approx((630_084, 4_833_439), abs=1.0)
    assert (got[3].x, got[3].y) == pytest.approx((313_800, 5_427_000), abs=1_500)
    for r in got:
        # under a millimetre
        turn = (r.lon2 - r.lon + 180) % 360 - 180
        assert abs(turn) * 111_320 * np.cos(np.radians(r.lat)) < 1e-3 and abs(r.lat2 - r.lat) * 111_320 < 1e-3, r


def test_positions_off_the_earth_are_not_projected(spark):
    rows = [(10.0, 95.0), (181.0, 0.0), (None, 1.0), (float("nan"), 1.0), (10.0, 45.0)]
    df = projection.projected(spark.createDataFrame(rows, "lon double, lat double"), F.lit(32), F.lit(False))
    assert [(r.geo_valid, r.x is None) for r in df.collect()] == [(False, True)] * 4 + [(True, False)]
    zones = spark.createDataFrame([(-180.0,), (-177.1,), (0.0,), (179.9,), (180.0,)], "lon double").select(projection.utm_zone(F.col("lon")).alias("z"))
    assert [r.z for r in zones.collect()] == [1, 1, 31, 60, 1]


def test_patch_fates(spark):
    code = np.array([[0, 0, -1, 0], [0, 1, 0, -1], [0, 1, 0, 0], [2, 3, 0, 0]])
    rows = [("s", r, c, int(code[r, c]), r >= 2 and c >= 2 and (r, c) == (2, 2), [float(r), 0.0, 1.0], [1.0 * c, 2.0]) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "scene string, row_i int, col_i int, code int, invalid boolean, rgb array<double>, swir array<double>")
    kept, counts = P.tile_patches(df, ["scene"], 2, 0.7)
    c = counts.first()
    assert (c.total, c.invalid, c.no_detection, c.low_purity, c.labeled) == (4, 1, 1, 1, 1)
    k = kept.first()
    assert (k.patch_row, k.patch_col, k.label, k.purity) == (0, 0, 0, 0.75) and k.rgb_std[0] == 0.5 and k.swir_mean == [0.5, 2.0]


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    rng = np.random.default_rng(4)
    n = 40
    mean, std, sw = np.round(rng.uniform(0, 9, (n, 3)), 0), np.round(rng.uniform(0, 5, (n, 3)), 0), rng.uniform(0.1, 1, (n, 4))
    lab = ["hot" if v < 0.5 else "x" for v in rng.random(n)]
    df = spark.createDataFrame([(i, lab[i], mean[i].tolist(), std[i].tolist(), sw[i].tolist()) for i in range(n)],
                               "id long, label string, rgb_mean array<double>, rgb_std array<double>, swir_mean array<double>")
    ij = [(i, j) for i in range(n) for j in range(i + 1, n)]
    dm = {p: np.sqrt(((mean[p[0]] - mean[p[1]]) ** 2).sum()) for p in ij}
    ds = {p: np.sqrt(((std[p[0]] - std[p[1]]) ** 2).sum()) for p in ij}
    cross = [p for p in ij if lab[p[0]] != lab[p[1]]]
    tm, ts = np.quantile([dm[p] for p in cross], 0.3), np.quantile([ds[p] for p in cross], 0.3)
    cand, thr = P.ambiguous_pairs(df, "id", "label", 0.3, 3)
    assert thr == {"rgb_mean": pytest.approx(tm), "rgb_std": pytest.approx(ts)}
    want = {p for p in cross if dm[p] <= tm and ds[p] <= ts}
    assert {(r.i, r.j) for r in cand.collect()} == want and want
    ang = {p: np.degrees(np.arccos(sw[p[0]] @ sw[p[1]] / np.linalg.norm(sw[p[0]]) / np.linalg.norm(sw[p[1]]))) for p in ij}
    bar = np.quantile([ang[p] for p in ij if p not in set(cross)], 0.6)
    assert P.null_angle(df, "id", "label", 0.6) == pytest.approx(bar)
    ranked = P.ranked_pairs(P.separable_pairs(cand, df, "id", bar)).orderBy("rank").collect()
    assert [(r.i, r.j) for r in ranked] == sorted((p for p in want if ang[p] > bar), key=lambda p: -ang[p])
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_far_chunks_do_not_meet_and_repeated_rows_count(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 8)
    rng = np.random.default_rng(5)
    n = 128
    mean = np.repeat(np.round(rng.uniform(0, [99, 4, 4], (n // 2, 3)), 0), 2, axis=0)
    lab = [str(v) for v in rng.integers(0, 3, n)]
    df = spark.createDataFrame([(i, lab[i], mean[i].tolist(), mean[i][::-1].tolist()) for i in range(n)], "id long, label string, rgb_mean array<double>, rgb_std array<double>")
    near = {"rgb_mean": 10.0}
    met = P.chunk_pairs(P.packs(df, "id", "label", ["rgb_mean"], near), ["rgb_mean"], near).collect()
    ij = [(i, j) for i in range(n) for j in range(i + 1, n)]
    dist = {p: np.sqrt(((mean[p[0]] - mean[p[1]]) ** 2).sum()) for p in ij}
    seen = {(min(i, j), max(i, j)) for r in met for i in r.ia for j in r.ib if i != j}
    # all that lie within reach of each other meet, most others do not
    assert {p for p in ij if dist[p] <= 10} <= seen and len(seen) < len(ij) / 2
    cross = [p for p in ij if lab[p[0]] != lab[p[1]]]
    q = P.pair_quantile(df, "id", "label", "rgb_mean", P.L2, 0.05, P.vector_diameter(df, "rgb_mean", 3), True).first()
    bar = np.quantile([dist[p] for p in cross], 0.05)
    assert q.n_pairs == len(cross) and q.threshold == pytest.approx(bar)
    want = graph.components(spark.createDataFrame([p for p in cross if dist[p] <= bar], "i long, j long")).collect()
    assert sorted(graph.components(P.ambiguous_links(df, "id", "label", 0.05, 3)).collect()) == sorted(want)


def test_components_chain_star_and_isolated(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    c = graph.components(spark.createDataFrame(edges, "i long, j long"))
    roots = {r.node: r.root for r in c.collect()}
    assert all(roots[i] == 0 for i in range(31)) and all(roots[k] == 100 for k in range(100, 140)) and roots[201] == 200 and len(roots) == 73
    lab = spark.createDataFrame([(n, str(n % 2)) for n in roots], "node long, label string")
    got = {r.cluster_id: (r.size, r.n_labels) for r in graph.clusters(spark.createDataFrame(edges, "i long, j long"), lab).collect()}
    assert got == {0: (31, 2), 1: (40, 2), 2: (2, 2)}


def test_a_window_reads_only_the_swath_it_points_into(spark, tmp_path):
    from prismgrid.operators import regrid as G

    rows = [("s", i, j, float(10 * i + j)) for i in range(10) for j in range(10)]
    spark.createDataFrame(rows, "site string, src_row int, src_col int, v double").write.parquet(str(tmp_path / "swath"))
    swath = spark.read.parquet(str(tmp_path / "swath"))
    glt = spark.createDataFrame([("s", 0, 0, 4, 3), ("s", 0, 1, 6, 5), ("s", 0, 2, 0, 0)], "site string, row_i int, col_i int, src_x int, src_y int")
    part = G.swath_window(glt, swath)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(src_row,4" in plan and part.count() == 9  # printed plans are cut short
    assert {r.col_i: r.v for r in G.glt_gather(glt, part, ["site"], ["v"]).collect()} == {0: 23.0, 1: 45.0, 2: None}
    assert G.swath_window(glt.where("src_x = 0"), swath).count() == 0


def brute_distance(on_a, on_b, w=None):
    """Larger of the two directed 95th percentiles over lists of boundary cells, by all pairs."""
    def directed(p, q):
        d = [min(np.hypot((r - i) * 20.0, (c - j) * 30.0) for i, j in q) for r, c in p]
        return np.quantile(np.repeat(d, [1 if w is None else w[x] for x in p]), 0.95)

    return max(directed(on_a, on_b), directed(on_b, on_a)) if on_a and on_b else None


def brute_boundary(grid, one, other):
    near = lambda r, c: [grid[x] for x in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if x in grid and None not in grid[x]]
    on = lambda k: [x for x, v in grid.items() if None not in v and v[k] == 1 and any(n[k] == 0 for n in near(*x))]
    return on(one), on(other)


def two_maps(spark, seed=1, n=12):
    rng = np.random.default_rng(seed)
    grid = {(r, c): tuple(None if rng.random() < 0.1 else int(rng.random() < p) for p in (0.2, 0.3)) for r in range(n) for c in range(n) if (r, c) != (5, 5)}
    df = spark.createDataFrame([("s", r, c, a, b, float(r * c % 7) if a is not None else None, float(c % 5)) for (r, c), (a, b) in grid.items()],
                               "site string, row_i int, col_i int, a int, b int, x double, y double")
    return grid, df


def generated(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate")


def test_nearest_boundary_cells_equal_brute_force(monkeypatch):
    from prismgrid.operators import edges

    rng = np.random.default_rng(3)
    for pairs in (3, 2_000_000):
        monkeypatch.setattr(edges, "PAIRS", pairs)
        for n, m, span in ((1, 1, 3), (40, 3, 200), (3, 60, 10**6), (80, 80, 9)):
            t, s = rng.integers(-span, span, (n, 2)), rng.integers(-span, span, (m, 2))
            got = edges.nearest_distances(t[:, 0], t[:, 1], s[:, 0], s[:, 1], 30.0, 20.0)
            want = np.sqrt((((t[:, 0, None] - s[:, 0]) * 20.0) ** 2 + ((t[:, 1, None] - s[:, 1]) * 30.0) ** 2).min(1))
            assert np.allclose(got, want, rtol=1e-12)
    v, w = rng.integers(0, 9, 50).astype(float), rng.integers(1, 5, 50)
    assert edges.weighted_quantile(v, w, 0.95) == pytest.approx(np.quantile(np.repeat(v, w), 0.95))


def test_boundary_distance_moves_a_cell_once(spark):
    grid, df = two_maps(spark)
    out = knn.symmetric_boundary_distance(df, ["site"], "a", "b", 30.0, 20.0)
    assert generated(out) == 0
    assert out.first().boundary_m == pytest.approx(brute_distance(*brute_boundary(grid, 0, 1)))
    on_a, on_b = brute_boundary(grid, 0, 1)
    weight = {x: 1 + (x[0] + x[1]) % 3 for x in grid}
    cells = G.boundary_cells(df, ["site"], "a", "b").withColumn("w", 1 + (F.col("row_i") + F.col("col_i")) % 3)
    assert knn.boundary_distance(cells, ["site"], 30.0, 20.0, "w").first().boundary_m == pytest.approx(brute_distance(on_a, on_b, weight))


def test_registration_shifts_without_a_copy_of_the_cells(spark):
    from prismgrid.operators import compare_dates as CD

    grid, df = two_maps(spark, 2)
    out = CD.registration_sensitivity(df, ["site"], "x", "y", "a", "b", 30.0, 20.0)
    assert generated(out) == 0
    rows = out.collect()
    assert len(rows) == 9
    for r in rows:
        moved = {x: (v[0], grid.get((x[0] - r.dy, x[1] - r.dx), (None, None))[1]) for x, v in grid.items()}
        joint = [v for v in moved.values() if None not in v]
        assert r.iou == pytest.approx(sum(v == (1, 1) for v in joint) / sum(1 in v for v in joint))
        assert r.n_joint == sum(grid[x][0] is not None and (x[0] - r.dy, x[1] - r.dx) in grid for x in grid)
        assert r.boundary_m == pytest.approx(brute_distance(*brute_boundary(moved, 0, 1)))


def test_boundary_null_without_a_copy_of_the_cells(spark):
    from prismgrid.operators import blocks as K, compare_dates as CD, resample as R

    grid, df = two_maps(spark, 5)
    b = K.in_complete_blocks(df, K.grid_shape(df, ["site"]), ["site"], 4)
    out = CD.boundary_null(b, ["site"], "a", "b", 30.0, 20.0, 4, 6, 5)
    got = {r.rep: r.boundary_m for r in out.collect()}
    orders = {}
    for r in R.block_orderings(b.select("site", "block_id").distinct(), ["site"], 6, 5).collect():
        orders.setdefault(r.rep, {})[r.target] = r.source
    place = lambda name: (int(name[1:5]) * 4, int(name[7:11]) * 4)
    assert len(orders) == 6
    for rep, order in orders.items():
        on_a, on_b = [], []
        for target, source in order.items():
            (tr, tc), (sr, sc) = place(target), place(source)
            cells = {(tr + i, tc + j): (grid[tr + i, tc + j][0], grid[sr + i, sc + j][1]) for i in range(4) for j in range(4) if (tr + i, tc + j) in grid and (sr + i, sc + j) in grid}
            x, y = brute_boundary(cells, 0, 1)
            on_a, on_b = on_a + x, on_b + y
        assert got.get(rep) == pytest.approx(brute_distance(on_a, on_b))
    # cells travel in blocks: no join by cell
    assert "cell#" not in out._jdf.queryExecution().optimizedPlan().toString().split("CoGroup")[0]


def test_sums_over_targets_are_taken_from_the_source_cells(spark):
    rng = np.random.default_rng(6)
    value = rng.normal(size=(12, 10))
    value[rng.random(value.shape) < 0.2] = np.nan
    fine, wide = G.Grid(5.0, 1.0, 9.0, -0.5, 12, 10), G.Grid(4.0, 3.3, 10.0, -1.7, 5, 4)
    cells = [("s", i, j, None if np.isnan(value[i, j]) else float(value[i, j]), f"b{i // 4}") for i in range(12) for j in range(10)]
    src = spark.createDataFrame(cells, "site string, row_i int, col_i int, v double, block_id string")
    targets = spark.createDataFrame([("s", i, j) for i in range(5) for j in range(4)] + [("t", 0, 0)], "site string, row_i int, col_i int")

    def overlap(t0, ts, i, s0, ss, k):
        (a, b), (c, d) = sorted((t0 + i * ts, t0 + (i + 1) * ts)), sorted((s0 + k * ss, s0 + (k + 1) * ss))
        return max(0.0, min(b, d) - max(a, c)) / (b - a)

    mean = G.area_average(targets, src.drop("block_id"), wide, fine, ["site"], "v")
    foot = G.block_footprint(targets, src.drop("v"), wide, fine, ["site"])
    got = {(r.site, r.row_i, r.col_i): r.v for r in mean.collect()}
    block = {(r.site, r.row_i, r.col_i): (r.block_id, r.crosses_boundary, r.incomplete_support) for r in foot.collect()}
    assert len(got) == len(block) == 21 and got["t", 0, 0] is None and block["t", 0, 0] == (None, False, True)
    for i in range(5):
        for j in range(4):
            w = np.array([[overlap(10.0, -1.7, i, 9.0, -0.5, r) * overlap(4.0, 3.3, j, 5.0, 1.0, c) for c in range(10)] for r in range(12)])
            present = np.where(np.isnan(value), 0.0, w)
            want = (present * np.nan_to_num(value)).sum() / present.sum() if present.sum() > 1e-9 else None
            assert got["s", i, j] == (pytest.approx(want) if want is not None else None)
            full = w.sum() > 1 - 1e-9
            names = {f"b{r // 4}" for r in np.flatnonzero(w.sum(1) > 1e-9)}
            assert block["s", i, j] == (min(names) if full and len(names) == 1 else None, full and len(names) > 1, not full)
    # the only join brings the sums to the targets: source cells are not looked up one by one
    for df in (mean, foot):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pairs_are_read_leaf_by_leaf(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "LEAF", 8)
    monkeypatch.setattr(P, "ANGLE_LEAF", 4)
    rng = np.random.default_rng(8)
    n = 900
    v = np.round(rng.uniform(1, 9, (n, 3)), 1)
    v[700:] = v[:200]  # equal vectors, of their own and of other labels
    mean, std = rng.uniform(0, 50, (n, 2)), rng.uniform(0, 50, (n, 2))
    lab = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))
    one = lambda x: pa.array([x.ravel().tolist()], pa.list_(pa.float64()))
    names = {"ia": pa.array([list(range(n))]), "ib": pa.array([list(range(n))]), "la": pa.array([lab.tolist()]), "lb": pa.array([lab.tolist()]), "same": pa.array([True])}
    cols = {f"{k}_{s}": one(m) for k, m in (("m", mean), ("s", std), ("v", v), ("t", np.ones((n, 1)))) for s in "ab"}
    batch = pa.RecordBatch.from_pydict(names | cols)
    x, y = np.triu_indices(n, 1)
    dm, ds, ang = P.l2(mean[x], mean[y]), P.l2(std[x], std[y]), P.angle_deg(v[x], v[y])
    thr = {"m": 6.0, "s": 7.0}
    strips = list(P._close_strips(batch, thr, {}))
    assert sum(s.products["m"][0].size for s in strips) < 0.4 * n * n / 2
    got = sorted(tuple(sorted((int(s.ia[i]), int(s.ib[j])))) for s in strips for i, j in zip(*P._close(s, thr)[:2]))
    assert got == sorted(zip(*(z[(dm <= 6) & (ds <= 7) & (lab[x] != lab[y])].tolist() for z in (x, y))))
    # leaves that lie nearer as a whole are counted without a look
    ((whole, of),) = P._angle_strips(batch, "v", "t", 20.0, 20.5)
    below = seen = 0
    for s in of:
        under, _ = P._split(s, "v", P.ANGLE, 20.0, 20.5)
        below, seen = below + int(under.sum()), seen + under.size
    assert whole > 0 and seen + whole < n * n / 2 and whole + below == int((ang < 20.0).sum())

    monkeypatch.setattr(P, "CHUNK", 64)
    monkeypatch.setattr(P, "SAMPLE", 60)
    rows = [(i, str(lab[i]), [float(e) for e in mean[i]], [float(e) for e in std[i]], [float(e) for e in v[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label string, rgb_mean array<double>, rgb_std array<double>, swir_mean array<double>")
    inside = ang[lab[x] == lab[y]]
    for q in (0.6, 0.0, 0.999):
        r = P.pair_quantile(df, "id", "label", "swir_mean", P.ANGLE, q, 180.0, False).first()
        assert (r.n_pairs, r.threshold) == (len(inside), pytest.approx(np.quantile(inside, q), abs=1e-9))
    pairs, t = P.ambiguous_pairs(df, "id", "label", 0.1, 2, above=15.0)
    want = (dm <= t["rgb_mean"]) & (ds <= t["rgb_std"]) & (lab[x] != lab[y]) & (ang > 15.0)
    assert sorted((r.i, r.j) for r in pairs.collect()) == sorted(zip(x[want].tolist(), y[want].tolist()))


def test_ranked_pairs_are_found_once_and_ties_share_no_task(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 10)
    made = spark.sparkContext.accumulator(0)

    def found(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rng = np.random.default_rng(6)
    # most pairs have one angle
    rows = [(i, i + 1 + k, float(rng.integers(0, 3)) if i < 4 else 1.0) for i in range(40) for k in range(5)]
    pairs = spark.createDataFrame(rows, "i long, j long, angle_deg double").repartition(4).mapInArrow(found, "i bigint, j bigint, angle_deg double")
    got = P.ranked_pairs(pairs)
    parts = {r.p for r in got.where("angle_deg = 1").select(F.spark_partition_id().alias("p")).collect()}
    assert [(r.i, r.j) for r in got.orderBy("rank").collect()] == [(i, j) for i, j, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))]
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 201))
    assert made.value == 200 and len(parts) > 3
