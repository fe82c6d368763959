"""Extendible hashing and temperature mixing: invariants on odd tables and plain-Python readings."""

import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F
from texts import prose

from prismgrid.llm import mixing, sharding


def test_buckets_split_only_when_too_large(spark):
    rows = [(i, "w" * (i % 50 + 1)) for i in range(400)]
    limit = 300
    got = {r.doc_id: r for r in sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()}
    address = {i: bin(int(hashlib.md5(f"={i}".encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    size = {i: len(t) for i, t in rows}
    for i, r in got.items():
        own = [j for j in address if address[j].startswith(r.shard)]
        above = [j for j in address if address[j].startswith(r.shard[:-1])]
        assert address[i].startswith(r.shard) and len(r.shard) == r.depth
        assert r.shard_bytes == sum(size[j] for j in own) <= limit < sum(size[j] for j in above)
        assert r.shard_rows == len(own) and r.fits
    assert len(got) == 400


def test_one_key_splits_by_text_and_copies_stay_together(spark):
    rows = [(1, f"text {i}") for i in range(100)] + [(2, "copy of one row")] * 20
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert len(got) == 120
    assert all(r.fits and r.shard_bytes <= 100 for r in got if r.doc_id == 1)
    copies = [r for r in got if r.doc_id == 2]
    assert len({r.shard for r in copies}) == 1 and not copies[0].fits and copies[0].shard_rows == 20


def test_shards_of_odd_tables(odd_documents, no_documents, tmp_path, spark):
    got = sharding.shards(odd_documents, 1000).collect()
    assert len(got) == odd_documents.count() and sum(r.n_bytes == 0 for r in got) == 3
    assert {r.doc_id for r in got if not r.fits} == {4}
    assert sharding.shards(no_documents, 1000).count() == 0
    sharding.write_shards(odd_documents, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd_documents.count()


def _expected_mix(rows, evenness=0.5, repeats=4.0):
    tokens = {i: len(t.split()) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        if tokens[i]:
            by[s].append(i)
    n = {s: sum(tokens[i] for i in x) for s, x in by.items()}
    total = sum(n.values())

    def weights(a):
        p = {s: (v / total) ** a for s, v in n.items()}
        return {s: v / sum(p.values()) for s, v in p.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    most = entropy(weights(1)) + evenness * (math.log(len(n)) - entropy(weights(1)))
    meets = lambda a: entropy(weights(a)) <= most and max(w * total / n[s] for s, w in weights(a).items()) <= repeats
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    out = []
    for s, w in weights(high).items():
        given = math.floor(w * total + 0.5)
        whole, rest = divmod(given, n[s])
        out += [(i, b) for b in range(whole) for i in by[s]]
        run = 0
        for i in sorted(by[s], key=lambda i: hashlib.md5(f"{i}|{whole}".encode()).hexdigest()[:15]):
            run += tokens[i]
            if run > rest:
                break
            out.append((i, whole))
    return sorted(out), weights(high), total


def test_mix_follows_the_weights(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i < 300 else f"s{i % 4}") for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, weights, total = _expected_mix(rows)
    got = mixing.mix(df, mixing.plan(df)).select("row.doc_id", "row.source", "block", "at", "n_tokens").collect()
    assert sorted((r.doc_id, r.block) for r in got) == want
    assert all(0 <= r["at"] <= 1 for r in got)
    for s, w in weights.items():
        assert abs(sum(r.n_tokens for r in got if r.source == s) - w * total) <= 7


def test_repetition_limit_holds(spark):
    rows = [(i, "w", "big") for i in range(1000)] + [(2000, "w w", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = {r.source: r for r in mixing.plan(df, evenness=None, max_repeats=3.0).collect()}
    assert p["small"].allotted <= 6 and p["small"].blocks <= 3


def test_mix_of_odd_tables(odd_documents, no_documents):
    got = mixing.mix(odd_documents, mixing.plan(odd_documents)).select("row.*").collect()
    assert got and all((r.text or "").strip() for r in got) and got[0].weight == "?"
    assert {r.source for r in got} >= {"b", "c"}
    assert mixing.mix(no_documents, mixing.plan(no_documents)).count() == 0


def test_sources_keep_their_tokens_whatever_the_keys(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 40)), "good") for i in range(400)]
    rows += [(None, prose(rng, 5), "keyless") for _ in range(300)] + [(7, prose(rng, rng.randint(1, 9)), "one key") for _ in range(300)]
    rows += [(3, "the same five words here", "equal") for _ in range(200)] + [(None, "keyless and equal", None) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.plan(docs, budget=9_000)
    wanted = {r["source"]: r["allotted"] for r in plan.collect()}
    drawn = mixing.mix(docs, plan).groupBy("row.source").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    assert len(drawn) == 5
    for r in drawn:
        assert wanted[r["source"]] - r["longest"] < r["t"] <= wanted[r["source"]], r
        assert 0 <= r["lo"] <= r["hi"] <= 1
