"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices, stored

#: Labelled rows of each language that are counted, languages that are learned (those with most rows), and
#: entries of the model: words, and n-grams of each length.  They bound the sample and the broadcast model.
ROWS_PER_LANGUAGE = 2_000
LANGUAGES = 256
WORDS = 50_000
NGRAMS = 20_000
LONGEST = 5
#: Words that count fully towards the confidence of a text, and words a worker remembers before it starts anew.
CERTAIN_WORDS = 8
CACHE_WORDS = 200_000
CACHE_CELLS = 1 << 23
LONGEST_KEPT = 64
#: Shortest n-grams that tell a language's words from other letters, and words that a text's familiar share is
#: smoothed by: fewer are no evidence against it.
TELLING = 3
FEW_WORDS = 2
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; superscripts, fractions and other number signs are no letters."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def ngrams(word: str, n: int) -> list[str]:
    """N-grams of the word between two blanks; single letters come without them."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequency of every known word and n-gram in each language; row 0 is for what nothing is known of.

    ``seen`` tells which of them two different labelled texts of a language have, and ``usual`` what share of
    a labelled text that is in the mean of each language; both only where ``train`` was asked for them.
    """

    languages: list[str]
    tables: dict[int, dict[str, int]]  # 0: words, n: n-grams of that length
    logs: np.ndarray
    seen: np.ndarray | None = None
    usual: np.ndarray | None = None
    cache: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None
    shares: dict[int, dict[str, float]] = field(default_factory=dict)
    flags: dict[int, bytes] = field(default_factory=dict)

    def score(self, word: str) -> np.ndarray:
        """A known word's log frequencies, or the mean of its longest known n-grams."""
        at = self.tables[0].get(word)
        if at is not None:
            return self.logs[at]
        for n in range(LONGEST, 0, -1):
            found = [i for i in map(self.tables[n].get, ngrams(word, n)) if i is not None]
            if found:
                return self.logs[found].mean(0)
        return self.logs[0]

    def share(self, word: str, at: int) -> float:
        """1 for a word seen in language number ``at``, else the share of its word and long n-grams seen there."""
        if at not in self.flags:
            self.flags[at], self.shares[at] = self.seen[:, at].astype(np.uint8).tobytes(), {}
        known, flags = self.shares[at], self.flags[at]
        own = known.get(word)
        if own is None:
            own = 1.0
            if not flags[self.tables[0].get(word, 0)]:
                padded, total, count = f" {word} ", 0, 1
                for n in range(TELLING, LONGEST + 1):
                    place = self.tables[n].get
                    for i in range(len(padded) - n + 1):
                        total += flags[place(padded[i : i + n], 0)]
                        count += 1
                own = total / count
            if len(known) >= CACHE_WORDS // max(1, len(self.shares)):
                known.clear()
            if len(word) <= LONGEST_KEPT:
                known[word] = own
        return own

    def familiar(self, text: str | None, lang: str) -> tuple[float, int]:
        """Mean share of the text's words that ``lang`` knows, and how many words there are."""
        words, at = Counter(words_of(text)), self.languages.index(lang)
        n = sum(words.values())
        return (sum(self.share(w, at) * k for w, k in words.items()) / n if n else 0.0), n

    def belongs(self, text: str | None, lang: str, least: float) -> bool:
        """Whether the text is as familiar as ``least`` times the usual of ``lang``, however many languages there are."""
        share, n = self.familiar(text, lang)
        usual = float(self.usual[self.languages.index(lang)])
        return share * n + usual * FEW_WORDS >= least * usual * (n + FEW_WORDS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        rows = [words_of(x) for x in texts]
        if not self.languages:
            return [UNDETERMINED] * len(rows), [0.0] * len(rows)
        room = min(CACHE_WORDS, CACHE_CELLS // len(self.languages))
        if self.vectors is None:
            self.vectors = np.zeros((room, len(self.languages)), np.float32)
        for word in set().union(*rows).difference(self.cache):
            if len(self.cache) >= room:
                break
            if len(word) <= LONGEST_KEPT:
                self.vectors[len(self.cache)] = self.score(word)
                self.cache[word] = len(self.cache)
        spare: dict[str, np.ndarray] = {}
        known = self.cache
        for words in rows:
            if not words:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            found = [known.get(w, -1) for w in words]
            at = np.array(found)
            total = self.vectors[at[at >= 0]].sum(0, dtype=np.float64)
            for i in np.flatnonzero(at < 0):
                w = words[i]
                if w not in spare:
                    spare[w] = self.score(w)
                total += spare[w]
            # the mean log likelihood of a word, times a bounded number of words
            weighed = total / len(words) * min(len(words), CERTAIN_WORDS)
            best = int(np.argmax(weighed))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(weighed - weighed[best]).sum()))
        if len(self.cache) >= room:
            self.cache.clear()
        return names, scores


def _counts(sample: DataFrame) -> DataFrame:
    """``n, gram, lang, count, lo, hi`` of the words (n = 0) and n-grams of the labelled rows.

    ``lo`` and ``hi`` are the smallest and largest hash of a text that has it: equal if only one text (or
    copies of it) has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = defaultdict(Counter)
        within: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
        for batch in slices(batches):
            for lang, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "hash"))):
                own, ends = Counter(words_of(text)), within[lang]
                words[lang].update(own)
                for w in own:
                    lo, hi = ends.get(w, (h, h))
                    ends[w] = (min(lo, h), max(hi, h))
        for lang, seen in words.items():
            for n in range(LONGEST + 1):
                grams: Counter[str] = Counter()
                ends = {} if n else within[lang]
                if n:
                    for word, times in seen.items():
                        first, last = within[lang][word]
                        for g in ngrams(word, n):
                            grams[g] += times
                            lo, hi = ends.get(g, (first, last))
                            ends[g] = (min(lo, first), max(hi, last))
                else:
                    grams = seen
                size = len(grams)
                lows, highs = ([ends[g][k] for g in grams] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([n] * size, pa.int32()), pa.array(list(grams.keys()), pa.string()), pa.array([lang] * size, pa.string()), pa.array(list(grams.values()), pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], ["n", "gram", "lang", "count", "lo", "hi"])

    counted = sample.select("lang", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "n int, gram string, lang string, count long, lo long, hi long")
    return counted.groupBy("n", "gram", "lang").agg(F.sum("count").alias("count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _usual(sample: DataFrame, model: Model) -> np.ndarray:
    """Mean familiar share of the labelled rows of each language; 0 where none has a letter."""
    shared = sample.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = pickle.loads(shared.value), defaultdict(lambda: [0.0, 0])
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                share, n = own.familiar(text, lang) if lang in own.languages else (0.0, 0)
                if n:
                    sums[lang][0] += share
                    sums[lang][1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x for x, _ in sums.values()], pa.float64()), pa.array([n for _, n in sums.values()], pa.int64())], ["lang", "total", "n"])

    found = sample.select("lang", "text").mapInArrow(run, "lang string, total double, n long").groupBy("lang").agg((F.sum("total") / F.sum("n")).alias("usual")).collect()
    by = {r["lang"]: r["usual"] for r in found}
    return np.array([by.get(x, 0.0) for x in model.languages])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", usual: bool = False) -> Model:
    """Learn from about ``ROWS_PER_LANGUAGE`` rows of every language, chosen by a hash.

    Words and n-grams are counted in Spark; at most ``WORDS`` words and ``NGRAMS`` n-grams of each length, the
    most frequent, reach the driver.  Rows without text or language teach nothing.  With ``usual`` the model
    also learns what is usual in each language, from the same rows.
    """
    labelled = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], {}, np.zeros((1, 0)))
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, ROWS_PER_LANGUAGE / r["count"]))])
    chosen = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))
    counts = stored(_counts(chosen))
    per_gram = counts.groupBy("n", "gram").agg(F.sum("count").alias("total"), F.collect_list(F.struct("lang", "count", (F.col("lo") < F.col("hi")).alias("twice"))).alias("by"))
    kept = [per_gram.where(F.col("n") == n).orderBy(F.desc("total"), "gram").limit(NGRAMS if n else WORDS).toArrow() for n in range(LONGEST + 1)]
    totals = {(r["n"], r["lang"]): (r["sum"], r["size"]) for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("sum"), F.count(F.lit(1)).alias("size")).collect()}
    languages = sorted({lang for _, lang in totals})
    tables: dict[int, dict[str, int]] = {}
    logs, seen = [np.zeros((1, len(languages)))], [np.zeros((1, len(languages)), bool)]
    at = 1
    for n, table in enumerate(kept):
        grams = table.column("gram").to_pylist()
        tables[n] = {g: at + i for i, g in enumerate(grams)}
        block, twice = np.zeros((len(grams), len(languages))), np.zeros((len(grams), len(languages)), bool)
        place = {x: i for i, x in enumerate(languages)}
        for i, by in enumerate(table.column("by").to_pylist()):
            for x in by:
                block[i, place[x["lang"]]] = x["count"]
                twice[i, place[x["lang"]]] = x["twice"]
        seen.append(twice)
        # additive smoothing over what each language has shown of this length
        whole = np.array([totals.get((n, x), (0, 0)) for x in languages], float)
        logs.append(np.log((block + 0.5) / (whole[:, 0] + 0.5 * (whole[:, 1] + 1))))
        at += len(grams)
    model = Model(languages, tables, np.concatenate(logs))
    if usual:
        model.seen = np.concatenate(seen)
        model.usual = _usual(chosen, model)
    return model


def languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, lang_pred, score`` of every whole text, and the columns of ``keep``.

    The model is broadcast; a worker remembers the vectors of words it has met.  ``score`` is the share of
    the best language's likelihood.  Null texts and texts without a letter are ``und`` with score 0, as
    is every text if nothing was learned.  A null key stays null and repeated rows repeat.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex
    names = [key, *[c for c in keep if c != key]]
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = remembered(name, lambda: pickle.loads(shared.value))
        for batch in slices(batches):
            found, scores = own.predict(batch.column("text").to_pylist())
            columns = [batch.column(f"k{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*(f"k{i}" for i in range(len(names))), "lang_pred", "score"])

    kinds = ", ".join(f"k{i} {plain.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(names)))
    out = plain.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are written in a learned language; all columns, whatever their names.

    A text is judged by the share of its words that its best language knows, wholly or by n-grams of
    ``TELLING`` letters or more: it goes below ``least`` times what is usual in labelled texts of that language.
    Unlike the score this does not depend on the number of languages.  Texts without a letter go.  A model
    that learned nothing rejects only those.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = remembered(name, lambda: pickle.loads(shared.value))
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            if own.languages:
                good = [best != UNDETERMINED and own.belongs(x, best, least) for x, best in zip(texts, own.predict(texts)[0])]
            else:
                good = [bool(words_of(x)) for x in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    inner = docs.toDF(*names)
    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
