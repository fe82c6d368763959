import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from oracle import DATA
from prismgrid.llm import periodic_runs, queries


def plain_runs(w, least=6, times=4):
    """Every stretch with smallest period q and enough words that no neighbour extends."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            begin = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            smaller = any(all(w[k] == w[k - p] for k in range(start + p, start + length)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 3), (20, 3), (12, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(300):
        letters, words = rng.choice([1, 2, 2, 3, 5, 30]), []
        for _ in range(rng.randint(0, 6)):
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
            words += part * rng.randint(1, 9) + part[: rng.randint(0, len(part))]
        assert periodic_runs.periodic_runs(np.array(words, np.int64), least, times) == plain_runs(words, least, times)


def test_long_texts_of_few_words_take_few_steps():
    # 300,000 equal words, a long period, and runs that are broken again and again
    assert periodic_runs.periodic_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periodic_runs.periodic_runs(np.arange(60_000) % 7_919) == [(0, 60_000, 7_919)]
    broken = np.concatenate([np.append(np.zeros(99, np.int64), k) for k in range(1, 2_000)])
    assert periodic_runs.periodic_runs(broken) == [(100 * k, 99, 1) for k in range(1_999)]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(np.zeros(9, np.int64), 6, 2)


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())


def test_query_equals_a_plain_reading(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    for d in docs:
        if len(d["text"] or "") < 6_000:
            assert got[d["doc_id"]] == contract_row(d["doc_id"], d["text"])


def test_odd_rows(odd_documents, no_documents):
    out = periodic_runs.collapse_runs(odd_documents, collapsed="gone")
    assert set(out.columns) == {*odd_documents.columns, "runs"} and out.count() == odd_documents.count()
    rows = out.collect()
    assert all(r["runs"] == [] and r["gone"] == "" for r in rows if not (r["text"] or "").split())
    same = [(r["runs"], r["gone"]) for r in rows if r["text"] == "same row " * 30]
    assert len(same) == 3 and all([tuple(x) for x in a] == [(0, 60, 2)] and b == "same row" for a, b in same)
    assert periodic_runs.collapse_runs(no_documents).count() == 0
