import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import DATA, compare, connection
from texts import prose

from prismgrid.llm import lexical_search
from prismgrid.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    """Every document scored for every item, as the formula reads."""
    counted = [(key, Counter(plain_terms(text))) for key, text in docs]
    counted = [(key, c, c.total()) for key, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, n in counted:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, r, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_plan_gives_every_item_its_sum():
    rng = random.Random(5)
    for _ in range(40):
        letters = [f"w{k}" for k in range(rng.choice([3, 12, 60]))]
        items = [" ".join(rng.choices(letters, k=rng.randint(0, 25))).encode() for _ in range(rng.randint(0, 30))]
        plan = lexical_search.shared_plan(items)
        seen = [k for k in range(len(plan.terms)) if rng.random() < 0.8]
        grid = {(r, t): rng.randint(1, 50) for r in range(7) for t in seen if rng.random() < 0.5}
        rows, terms = (np.array([x[i] for x in grid], np.int64) for i in (0, 1))
        got = lexical_search.accumulate(plan, rows, terms, np.array(list(grid.values()), np.int64), 7)
        for text, scores in zip(items, got, strict=True):
            want = [sum(grid.get((r, plan.terms.index(t)), 0) for t in text.split()) for r in range(7)]
            assert (scores.tolist() if scores is not None else [0] * 7) == want


def test_sets_that_items_share_are_added_up_once():
    plan = lexical_search.shared_plan([b"a b c d x", b"a b c d y", b"a b c z", b"a b q"])
    assert sum(len(p) - 1 for p in plan.parts) < 4 + 4 + 3 + 2
    assert len(plan.roots) == 4


@pytest.mark.parametrize("block", [3, 1_024])
def test_search_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK", block)
    rng = random.Random(block)
    common = [prose(rng, 12) for _ in range(6)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 5))) + f" Ünï-{i % 7} {prose(rng, 5)}") for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(60)] + [(300, None), (301, ""), (302, " ,;! "), (None, docs[3][1]), (5, docs[5][1])]
    items = [(i, " ".join(rng.choices(common, k=2)) + f" ünï THE {i}") for i in range(9)] + [(20, None), (21, ""), (22, "nowhere-at-all zz9")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items + [(1, items[1][1])], "item_id long, text string")
    got = sorted(map(tuple, lexical_search.search(frame, asked, 10).collect()))
    assert got == plain_search(docs, items, 10)


def test_query_matches_sql(spark):
    got = QUERIES["op11_lexical_search"](spark, f"{DATA}/sf0.001").toPandas()
    assert len(got) and compare(got, connection(f"{DATA}/sf0.001").execute(ORACLES["op11_lexical_search"]).df()) is None


def test_odd_rows(spark, odd_documents, no_documents):
    items = odd_documents.selectExpr("doc_id AS item_id", "text", "'?' AS score", "'?' AS rank")
    plain = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    asked = {}
    for key, text in plain:
        asked[key] = min((x for x in (asked.get(key), text) if x is not None), default=None, key=lambda x: x.encode())
    got = sorted((tuple(r) for r in lexical_search.search(odd_documents, items, 3).collect()), key=str)
    assert got == sorted(plain_search_any(plain, asked.items()), key=str)
    assert lexical_search.search(no_documents, items).count() == 0
    assert lexical_search.search(odd_documents, items.where("1 = 0")).count() == 0


def plain_search_any(docs, items):
    keyed = [x for x in items if x[0] is not None]
    keyless = [(-1, text) for key, text in items if key is None]
    return [(None if r[0] == -1 else r[0], *r[1:]) for r in plain_search(docs, keyed + keyless, 3)]
