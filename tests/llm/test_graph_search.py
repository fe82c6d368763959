import random

import numpy as np
from oracle import DATA

from prismgrid.llm import graph_search
from prismgrid.llm.queries import QUERIES


def plain_nearest(rows, asked, k):
    """All distances in double precision; equal ids count once, at their nearest."""
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    dim = max(len(v) for _, v in usable)
    wide = [(i, np.pad(v, (0, dim - len(v)))) for i, v in usable]
    out = []
    for q in asked:
        x = min((v.tolist() for i, v in wide if i == q), default=None)
        if x is None:
            continue
        nearest = {}
        for i, v in wide:
            if i != q:
                nearest[i] = min(nearest.get(i, np.inf), float(np.sqrt(((v - x) ** 2).sum())))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted((round(d, 9), i) for i, d in nearest.items())[:k], 1)]
    return out


def recall(got, want):
    pairs = {(r[0], r[2]) for r in want}
    return len(pairs & {(r[0], r[2]) for r in got}) / len(pairs)


def test_query_recall(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = sorted(map(tuple, QUERIES["op12_graph_search"](spark, f"{DATA}/sf0.1").collect()))
    want = plain_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    exact = {(i, v[0]): v[1] for i, v in ((q, (o, d)) for q, _, o, d in want)}
    assert all(abs(exact[q, o] - d) < 1e-8 for q, _, o, d in got if (q, o) in exact)
    for q in {r[0] for r in got}:
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r[3], r[2]))


def test_clusters_far_apart_and_a_narrow_beam(spark):
    # separate clusters: no link leads from one to another, and queries must start in their own
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 100
    rows = [(i, (centres[i % 12] + rng.standard_normal(8)).tolist()) for i in range(1_500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = list(map(tuple, graph_search.nearest_neighbours(frame, frame.where("vec_id % 50 = 0"), 10, beam=64).collect()))
    assert recall(got, plain_nearest(rows, range(0, 1_500, 50), 10)) >= 0.95


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    common = [0.5, -0.25, 0.0, 1.0]
    rows += [(100 + i, common) for i in range(90)]  # a third of all rows is one vector
    rows += [(5, rows[5][1]), (6, rows[7][1]), (None, common), (200, None), (201, [0.0, 0.0]), (202, [1.0, None]), (203, [float("nan"), 1.0]), (204, [float("inf")]), (205, []), (206, [3.0]), (207, [3.0, 0.0])]
    frame = spark.createDataFrame([(*r, "?", "?", "?", 0.0) for r in rows], "vec_id long, embedding array<double>, id string, v string, node string, score double").repartition(3)
    asked = [0, 5, 6, 100, 143, 189, 200, 201, 206]
    queries = frame.where(f"vec_id in ({','.join(map(str, asked))})")
    got = [(*r[:3], round(r[3], 9)) for r in sorted(map(tuple, graph_search.nearest_neighbours(frame, queries, 10).collect()))]
    want = plain_nearest(rows, asked, 10)
    assert recall(got, want) == 1 and [r[:3] for r in got] == [r[:3] for r in want]
    none = frame.where("1 = 0")
    assert graph_search.nearest_neighbours(none, none).count() == 0
    assert graph_search.nearest_neighbours(frame, none).count() == 0
    assert graph_search.nearest_neighbours(none, queries).count() == 0
    one = frame.where("vec_id = 0")
    assert graph_search.nearest_neighbours(one, one).count() == 0
