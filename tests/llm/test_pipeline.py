"""Stages of the corpus pipeline on odd tables and on the smallest given table; registered queries against SQL."""

import random

import pytest
from texts import prose

import corpus_pipeline
from oracle import DATA, compare, connection


def test_stages_keep_the_columns(spark, odd_documents, no_documents):
    docs, none = odd_documents, no_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, ""), stage(spark, none, "")
        assert docs.columns == none.columns == odd_documents.columns, name
        assert none.count() == 0
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert "ids" in ids.columns and ids.count() == docs.count() > 3


def test_decisions_of_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, "")
    assert known.count() == docs.count()  # every given document is written in a language
    lines = corpus_pipeline.without_copied_lines(spark, known, "")
    texts = {r.doc_id: r.text for r in lines.collect()}
    copies = docs.groupBy("text").count().where("count > 1").count()
    assert docs.count() - len(texts) >= copies and all(t for t in texts.values())
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.select("text").distinct().count() == kept.count() < docs.count()


@pytest.mark.parametrize("name", ["op1_sharding", "op3_mixing", "op9_top_k"])
def test_query_matches_sql(spark, name):
    from prismgrid.llm.queries import ORACLES, QUERIES

    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert compare(got, connection(f"{DATA}/sf0.001").execute(ORACLES[name]).df()) is None


def test_one_row_of_each_group_whatever_the_keys(spark):
    rng = random.Random(12)
    copied, other, keyless, alone = (prose(rng, 60) for _ in range(4))
    rows = [(3, copied), (7, copied), (7, other), (7, other), (9, other)]  # one key, two texts; the smallest of a group twice
    rows += [(None, keyless)] * 3 + [(None, alone), (None, copied), (12, ""), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    want = [(3, copied), (7, other), (None, keyless), (None, alone), (12, ""), (12, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


TONGUES = {
    "a": ["th", "er", "on", "an", "ing", "ou", "st"],
    "b": ["sch", "ge", "ver", "ung", "ei", "chen", "be"],
    "c": ["eau", "que", "oi", "ment", "le", "du", "aux"],
    "d": ["ado", "cion", "es", "la", "que", "os", "mi"],
}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_junk_and_unlearned_languages_leave_however_many_are_learned(spark, n):
    rng = random.Random(n)

    def text(syllables, words):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))

    rows = [(i, text(TONGUES[x], rng.randint(1, 80)), x) for i, x in enumerate(list(TONGUES)[:n] * 40)]
    good = len(rows)
    letters = "bcdfghjklmnpqrstvwxz"
    rows += [(1000 + i, " ".join("".join(rng.choices(letters, k=7)) + rng.choice(["", "#!", "%"]) for _ in range(40)), None) for i in range(10)]
    rows += [(2000 + i, " ".join("".join(rng.choices(letters, k=7)) for _ in range(40)), "a") for i in range(3)]
    rows += [(3000 + i, text(["kyl", "jää", "pöy", "tuo", "vuo", "hyv"], 40), None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect())
    assert kept == list(range(good))
