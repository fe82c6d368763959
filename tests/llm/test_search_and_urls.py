"""Exact top-k search and URL verdicts against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from prismgrid.llm import topk, url_filter
from prismgrid.llm.queries import RULES


def _best(rows, ids, k):
    q = {i: np.floor(np.array(v, float) * 256).astype(object) for i, v in rows}
    pad = lambda a, b: sum(x * y for x, y in zip(a, b))
    return {i: sorted((-int(pad(q[i], v)), j) for j, v in q.items() if j != i)[:k] for i in ids}


@pytest.mark.parametrize("shard,leaf", [(8192, 128), (40, 8)])
def test_top_k_is_exact(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk.build_tree, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(i, [0.5] * 8) for i in range(200, 300)] + [(300, [1e6] * 8), (301, [-3.0] * 5), (302, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = _best(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert dict(got) == want


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 0.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS shard")
    got = [tuple(r) for r in topk.top_k(df, df, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 65536), (0, 2, 5, 65536), (5, 1, 0, 65536)]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df, df.where("false")).count() == 0


def test_trees_and_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    df = spark.createDataFrame([(i, [0.5] * 8) for i in range(200)], "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
    # equal vectors compress to next to nothing: no size that Spark sees may make them a broadcast or one task
    assert "BroadcastExchange" not in out._jdf.queryExecution().toString()
    assert sorted(r["n"] for r in out.groupBy("query_id").count().selectExpr("count AS n").collect()) == [5] * 4


def test_boxes_are_tight_and_hold_all_rows():
    vectors = np.random.default_rng(3).integers(-100, 100, (500, 4))
    order, low, high, child, span = topk.build_tree(vectors, 16)
    assert sorted(order) == list(range(500))
    for n in range(len(child)):
        own = vectors[order[span[n][0] : span[n][1]]]
        assert (own.min(0) == low[n]).all() and (own.max(0) == high[n]).all()
        assert (len(own) <= 16) == (child[n] == 0)


def _judged(pages, rules):
    lexicon = Counter(w for _, _, html in pages for w in re.findall("[a-z]+", (html or "").lower()) if len(w) <= 20)
    total = sum(lexicon.values())
    split = {}

    # the top-level domain and what rules are made of say nothing of a page
    stop = [{n for _, r in rules for n in re.findall("[a-z]+", r.split("/", 1)[i])} for i in (0, 1)]

    def names(x, of_path=False):
        out = []
        for n in re.findall("[a-z]+", (x if of_path or "." not in x else x.rsplit(".", 1)[0]).lower()):
            if n in stop[of_path]:
                continue
            if n not in split:
                split[n] = url_filter.segment(n, lexicon, total)
            out += split[n]
        return out

    parts = []
    for key, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.split("[/?#]", rest, maxsplit=1)[0] if rest is not None else ""
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0] if rest is not None else ""
        parts.append((key, "".join(c.lower() if c.isascii() else c for c in host), path))
    counts = {True: Counter(), False: Counter()}
    pages_of = Counter()
    for _, host, path in parts:
        bad = bool(set(names(host)) & set(url_filter.UNWANTED))
        pages_of[bad] += 1
        counts[bad].update([("host", w) for w in names(host)] + [("path", w) for w in names(path, True)])
    n = len(set(counts[True]) | set(counts[False]))
    size = {b: sum(c.values()) for b, c in counts.items()}
    odds = lambda t: math.log((counts[True][t] + 1) / (size[True] + n + 1)) - math.log((counts[False][t] + 1) / (size[False] + n + 1))
    out = []
    for key, host, path in parts:
        fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        score = math.log((pages_of[True] + 1) / (pages_of[False] + 1)) + sum(odds(("host", w)) for w in names(host)) + sum(odds(("path", w)) for w in names(path, True))
        best = max(fits, default=None)
        out.append((key, host, path, best[1] if best else None, best[2] if best else ("block" if score > 0 else "allow"), round(score, 6)))
    return out


def test_verdicts_match_a_plain_reading(spark):
    rng = random.Random(4)
    words = ["news", "cheap", "pills", "garden", "house", "spam", "farm", "blue", "river", "casino"]
    pages = []
    for i in range(150):
        host = "".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice([".example.org", ".example.com", ".net"])
        pages.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.choice(words)}{rng.randint(0, 99)}?x=1", " ".join(rng.choices(words, k=30))))
    pages += [(150, None, None), (151, "no scheme", "x"), (152, "x://A.EXAMPLE.ORG", ""), (153, "http://example.org/es/?u=http://b", "y"), (153, "http://example.org/es/?u=http://b", "y"), (154, "http://www.example.org/en/17#f", None), (None, "http:///only/path", "z"), (155, "a\nb://Ünï.COM/de/é\n?", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS name", "4 AS row")
    got = [(r.page_id, r.h, r.p, r.rule, r.verdict, round(r.block_score, 6)) for r in url_filter.judge(df, RULES).selectExpr("row.page_id", "host AS h", "path AS p", "rule", "verdict", "block_score").collect()]
    order = lambda x: tuple(str(y) for y in x[:3])
    for a, b in zip(sorted(got, key=order), sorted(_judged(pages, RULES), key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5


def test_names_split_into_the_likeliest_words():
    counts = {"cheap": 50, "pills": 40, "che": 1, "a": 100, "p": 5}
    assert url_filter.segment("cheappills", counts, 1000) == ["cheap", "pills"]
    assert url_filter.segment("", counts, 10) == []
    assert "".join(url_filter.segment("qqqqcheap", counts, 1000)) == "qqqqcheap"


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(df, RULES).count() == 0


def test_words_that_occur_with_blocked_hosts_block_others(spark):
    hosts = ["casino-win.example.net", "win-bets.example.net", "bets-track.example.net", "garden.example.net"] + ["river-house.example.org"] * 6
    words = "casino win bets track garden river house "
    pages = [(i, f"http://{h}/en/x", words * 9) for i, h in enumerate(hosts)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filter.judge(df, [("allow", "river-house.example.org/")], rounds=3).collect()}
    assert [got[h] for h in hosts[1:3]] == ["block", "block"] and got["river-house.example.org"] == "allow"
    assert url_filter.judge(df.where("false"), RULES, rounds=3).count() == 0


def test_innocent_domains_without_a_rule_are_not_condemned(spark):
    # the registered rules and rounds on the given pages: at most one in twenty innocent pages of any top-level domain is blocked
    from oracle import DATA
    from prismgrid.llm.queries import QUERIES

    unwanted = ("casino", "adult", "pills", "spam")
    pages = QUERIES["op2_url_filter"](spark, f"{DATA}/sf0.1").where("rule IS NULL").collect()
    plain = [r for r in pages if not any(w in r.host for w in (*unwanted, "bets", "track"))]
    for end in {r.host.rsplit(".", 1)[-1] for r in plain}:
        own = [r for r in plain if r.host.endswith("." + end)]
        assert sum(r.verdict == "block" for r in own) <= 0.05 * len(own), end
    bad = [r for r in pages if any(w in r.host for w in unwanted)]
    assert sum(r.verdict == "block" for r in bad) >= 0.9 * len(bad)
