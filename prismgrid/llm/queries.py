"""Registered queries of the operators for training data, each next to its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, graph_search, jaccard_join, language_id, lexical_search, line_dedup, mixing, periodic_runs, pieces, sharding, token_counts, topk, url_filter
from .common import slices, text_bytes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a shard of the registered query: small, so that the smallest tables split too.
SHARD_LIMIT = 1 << 20


@_query("op1_sharding", f"""
    WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || left(md5('=' || doc_id), 15))::BIGINT AS address FROM documents),
    levels AS (SELECT d.*, k, address >> (60 - k) AS prefix FROM d, range(0, 31) r(k)),
    sums AS (SELECT k, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY ALL),
    taken AS (SELECT doc_id, n_bytes, k, prefix, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r
              FROM levels JOIN sums USING (k, prefix) WHERE shard_bytes <= {SHARD_LIMIT})
    SELECT doc_id, n_bytes, right(lpad(bin(prefix), 30, '0'), k::INTEGER) AS shard, k::INTEGER AS depth, shard_bytes, shard_rows, true AS fits
    FROM taken WHERE r = 1""")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), SHARD_LIMIT)


@_query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@_query("op9_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@_query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@_query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.languages(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@_query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), digest=True)


@_query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), report="lines_removed")
    return kept.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@_query("op3_mixing", r"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS tokens FROM documents),
    s AS (SELECT source, sum(tokens)::BIGINT AS n FROM d WHERE tokens > 0 GROUP BY source),
    t AS (SELECT sum(n)::BIGINT AS total, list(n / (SELECT sum(n) FROM s)::DOUBLE) AS p FROM s),
    h AS (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) AS h1, ln(len(p)) AS h0 FROM t),
    b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
          UNION ALL
          SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
          FROM (SELECT i, low, high, mid, ln(z) - mid * l / z <= h1 + 0.5 * (h0 - h1) AND r / z <= 4.0 AS ok
                FROM (SELECT b.*, (low + high) / 2 AS mid,
                             list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) AS z,
                             list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ln(x))) AS l,
                             list_max(list_transform(p, lambda x: pow(x, (low + high) / 2 - 1))) AS r
                      FROM b, t WHERE i < 40), h)),
    a AS (SELECT high AS a FROM b WHERE i = 40),
    w AS (SELECT source, n, pow(n / total::DOUBLE, a) / list_sum(list_transform(p, lambda x: pow(x, a))) AS weight, total FROM s, t, a),
    q AS (SELECT *, floor(weight * total + 0.5)::BIGINT AS allotted FROM w),
    e AS (SELECT source, weight, allotted // n AS blocks, allotted - (allotted // n) * n AS rest FROM q),
    k AS (SELECT d.*, weight, blocks, rest, ('0x' || left(md5(doc_id || '|' || blocks), 15))::BIGINT AS pk FROM d JOIN e USING (source) WHERE tokens > 0),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY pk RANGE UNBOUNDED PRECEDING) <= rest AS part FROM k)
    SELECT doc_id, source, unnest(range(0, blocks + part::BIGINT))::INTEGER AS block, tokens::BIGINT AS n_tokens, round(weight * 1e6)::BIGINT AS weight_ppm FROM c""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = mixing.mix(docs, mixing.plan(docs))
    return rows.select("row.doc_id", "row.source", "block", "n_tokens", F.round(F.col("weight") * 1e6).cast("long").alias("weight_ppm"))


#: Fixed value: the rules of the url query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@_query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(_table(spark, sf_dir, "pages"), RULES, rounds=3)
    return found.select("row.page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def planted(words: list, doc_id: int | None) -> list:
    """The words with the repeats that the runs query plants in documents whose ``crc32(doc_id)`` ends with 0."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (1 + (n - a) // p))[: n - a]


def _with_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch]):
            raw, at = text_bytes(part.column("text"))
            whole, ids = raw.tobytes(), part.column("doc_id").to_pylist()
            texts = [b" ".join(planted(whole[a:b].split(), key)) for a, b, key in zip(at[:-1].tolist(), at[1:].tolist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_with_repeats, "doc_id long, text string")
    found = periodic_runs.collapse_runs(docs)
    # the longest, then the first, then the smallest period
    found = found.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as back, -r.period as small)))"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), "best.length", (-F.col("best.small")).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query("op11_lexical_search", r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term FROM documents),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
    c AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
    l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM c) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
    v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS v
          FROM f JOIN w USING (term) JOIN l USING (doc_id), g),
    s AS (SELECT item_id, doc_id, sum(c * v)::BIGINT AS score FROM c JOIN v USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


@_query("op12_graph_search")
def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_search.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
