"""URL verdicts: listed rules first, then naive Bayes over the words that host and path names are made of."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Fixed value: host words whose pages are taken as examples of what to block.
UNWANTED = ("adult", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
#: Longest word that a name is split into, and longest piece looked up as a whole.
LONGEST_WORD = 20
#: Commonest keys that meet their values by broadcast; any other key has less than a ``HEAVY``-th of the rows.
HEAVY = 2_000
#: Words a task counts before it hands them on.
COUNTED_WORDS = 500_000

_NAME = "[a-z]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest of the ``(verdict, rule)`` that fits, or null.

    A rule is a host and a path; it fits the host and its subdomains if the path starts with its own.  The
    list is part of the plan, meant for rules that people write.  Of equally long ones the first by text wins.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, slash, rest = rule.partition("/")
        hit = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        fits = F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Inner join on ``key`` with at most one row of ``table`` for a key, without a hot key in one task.

    The ``HEAVY`` commonest keys of ``rows`` are counted and broadcast with their values (a bounded table);
    the rest meets by shuffle.
    """
    often = rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(HEAVY).select(key)
    heavy = F.broadcast(stored(table.join(F.broadcast(often), key)))
    light = rows.join(heavy.select(key), key, "left_anti").join(table, key)
    return rows.join(heavy, key).select(*light.columns).unionByName(light)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n``: lower-case words of A-Z in ``text``, counted in the scan and then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(w for w in re.findall(_NAME, (text or "").lower()) if len(w) <= LONGEST_WORD)
            if len(seen) > COUNTED_WORDS:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Most likely words of a name under a unigram model (Viterbi); an unseen word costs more with its length."""
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            seen = counts.get(name[start:end])
            cost = math.log(total) - math.log(seen) if seen else math.log(total) + (end - start - 1) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``name, words`` of distinct names.  A name meets only the lexicon entries that are parts of it."""
    total = lexicon.agg(F.sum("n")).collect()[0][0] or 1
    parts = names.select("name", F.explode(F.array_distinct(F.expr(
        f"flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({LONGEST_WORD}, length(name) - i + 1)), n -> substring(name, i, n))))"
    ))).alias("word"))
    known = parts.join(lexicon, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("name").to_pylist(), batch.column("known").to_pylist())
            words = [segment(name, {x["word"]: x["n"] for x in found or []}, total) for name, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").mapInArrow(split, "name string, words array<string>")


def _names(of: Column, without: Sequence[str]) -> Column:
    found = F.regexp_extract_all(F.lower(of), F.lit(_NAME), 0)
    return F.explode(F.filter(found, lambda n: ~n.isin(list(without))) if without else found).alias("name")


def own_names(rules: Sequence[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Names of hosts and of paths that rules are made of."""
    parts = [rule.lower().partition("/")[::2] for _, rule in rules]
    return tuple(sorted({n for p in parts for n in re.findall(_NAME, p[i])}) for i in (0, 1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), unwanted: Sequence[str] = UNWANTED, keep: Sequence[str] = ("page_id",), url: str = "url", html: str = "html", rounds: int = 0) -> DataFrame:
    """``row, host, path, rule, verdict, block_score`` of every url of ``pages`` (``row``: the columns of ``keep``).

    The word model counts the words of all pages.  Names (runs of letters) of hosts and paths are split into
    words; pages whose host has an ``unwanted`` word are the examples of naive Bayes to block, all others to
    allow.  ``block_score`` is the log odds to block; a fitting rule decides the verdict before it.  The last label of a
    host (its top-level domain) and names that rules are made of take no part in naive Bayes: labels that come from rules
    would otherwise say no more than the rules, and condemn every domain that no rule allows.

    With ``rounds`` pages outside the list are unlabelled instead: examples to allow are those that an allow
    rule decides and whose host is not flagged, and in each round the hosts of all pages are labelled anew:
    a word flags its hosts if flagged hosts have half of its pages or more and at most a tenth of its examples
    are to allow.  Words of unlabelled pages only say nothing.

    Every value is computed once for each distinct name, host and path and then looked up, so hot hosts and
    names cost no more than others.  A null url or one without ``://`` has empty host and path, no words, and
    is judged by the prior alone; null pages add no words; repeated rows repeat.
    """
    rows = pages.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")))
    hosts = stored(urls.groupBy("host").agg(F.sum("pages").alias("pages")))
    in_hosts, in_paths = own_names(rules)
    host_names = stored(hosts.select("host", _names(F.regexp_replace("host", r"\.[^.]*$", ""), in_hosts)))
    paths = urls.select("path").distinct()
    path_names = stored(paths.select("path", _names(F.col("path"), in_paths)))
    lexicon = stored(word_counts(pages.select(F.col(html).cast("string").alias("text"))))
    names = host_names.select("name").unionByName(path_names.select("name")).distinct()
    flag = F.arrays_overlap("words", F.array(*[F.lit(w) for w in unwanted])) if unwanted else F.lit(False)
    words = stored(segmented(names, lexicon).withColumn("unwanted", flag))

    flagged = looked_up(host_names, "name", words.select("name", "unwanted")).groupBy("host").agg(F.max("unwanted").alias("block"))
    labels = stored(hosts.join(flagged, "host", "left").select("host", "pages", F.coalesce("block", F.lit(False)).alias("block")))
    fits = F.coalesce(longest_rule(F.col("host"), F.col("path"), rules)["verdict"] == "allow", F.lit(False)) if rounds else F.lit(True)
    urls = urls.withColumn("fits", F.when(fits, F.col("pages")).otherwise(0))
    if rounds:
        host_words = stored(looked_up(host_names, "name", words.select("name", "words")).select("host", F.explode("words").alias("word")).distinct())
        able = stored(urls.groupBy("host").agg(F.sum("fits").alias("fits")))
        for _ in range(rounds):
            known = labels.join(able, "host").select("host", "pages", F.when(F.col("block"), F.col("pages")).otherwise(0).alias("b"), F.when(F.col("block"), 0).otherwise(F.col("fits")).alias("a"))
            bad = looked_up(host_words, "host", known).groupBy("word").agg(*[F.sum(x).alias(x) for x in ("pages", "b", "a")])
            bad = stored(bad.where("b > 0 and 2 * b >= pages and 9 * a <= b").select("word"))
            more = looked_up(host_words, "word", bad).select("host").distinct().withColumn("more", F.lit(True))
            labels = stored(labels.join(more, "host", "left").select("host", "pages", (F.col("block") | F.coalesce("more", F.lit(False))).alias("block")))

    of_url = [F.when(F.col("block"), F.col("pages")).otherwise(0).alias("b"), F.when(F.col("block"), 0).otherwise(F.col("fits")).alias("a")]
    urls = stored(looked_up(urls, "host", labels.select("host", "block")).select("host", "path", *of_url))
    both = [F.sum("b").alias("b"), F.sum("a").alias("a")]
    in_hosts = looked_up(host_names, "host", urls.groupBy("host").agg(*both)).groupBy("name").agg(*both).withColumn("part", F.lit("host"))
    of_path = urls.groupBy("path").agg(*both)
    sizes = urls.agg(*both).collect()[0]
    in_paths = looked_up(path_names, "path", of_path).groupBy("name").agg(*both).withColumn("part", F.lit("path"))
    by_name = stored(in_hosts.unionByName(in_paths).join(words.select("name", "words"), "name"))
    tokens = by_name.select("part", F.explode("words").alias("word"), "b", "a").groupBy("part", "word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    tokens = stored(tokens)
    whole = tokens.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")).collect()[0]
    b, a, n = float(whole["b"] or 0), float(whole["a"] or 0), float(whole["n"])
    odds = F.log((F.col("b") + 1) / F.lit(b + n + 1)) - F.log((F.col("a") + 1) / F.lit(a + n + 1))
    odds = F.when(F.col("b") + F.col("a") > 0, odds).otherwise(F.lit(0.0))
    each = by_name.select("part", "name", F.explode("words").alias("word"))
    parts = [looked_up(each.where(F.col("part") == x), "word", tokens.where(F.col("part") == x).select("word", odds.alias("odds"))) for x in ("host", "path")]
    weights = stored(parts[0].unionByName(parts[1]).groupBy("part", "name").agg(F.sum("odds").alias("odds")))
    of_host = looked_up(host_names, "name", weights.where("part = 'host'").select("name", "odds")).groupBy("host").agg(F.sum("odds").alias("host_odds"))
    of_path = looked_up(path_names, "name", weights.where("part = 'path'").select("name", "odds")).groupBy("path").agg(F.sum("odds").alias("path_odds"))
    prior = math.log(((sizes["b"] or 0) + 1) / ((sizes["a"] or 0) + 1))
    of_host = stored(hosts.select("host").join(of_host, "host", "left").select("host", F.coalesce("host_odds", F.lit(0.0)).alias("host_odds")))
    of_path = stored(paths.join(of_path, "path", "left").select("path", F.coalesce("path_odds", F.lit(0.0)).alias("path_odds")))
    scored = looked_up(looked_up(rows, "host", of_host), "path", of_path)
    scored = scored.withColumn("block_score", F.col("host_odds") + F.col("path_odds") + F.lit(prior))
    scored = scored.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return scored.select("row", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
