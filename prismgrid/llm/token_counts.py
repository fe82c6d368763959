"""Token counts of whole texts by a two-tier table of word lengths, without moving words between tasks."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices

#: Words of the broadcast tier, and the rows whose words are counted to choose them.  Both only decide how
#: often a worker has to ask the tokenizer; counts are the same for any value.
FREQUENT_WORDS = 50_000
SAMPLE_ROWS = 5_000
#: Words a worker remembers besides the broadcast tier before it starts anew, and the longest one kept.
CACHE_WORDS = 1_000_000
LONGEST_KEPT = 64


def words_of(text: str | None) -> list[str]:
    """Pieces between blanks and line ends.

    The tokenizer drops all white space and no pre-token reaches over it, so lengths of these pieces add up
    to the length of the text; other white space stays inside a piece and is left to the tokenizer.
    """
    return text.replace("\n", " ").split(" ") if text else []


class _Lengths(dict):
    """Tokens by word: the broadcast tier, and what this worker has encoded itself."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self[""] = 0
        self.frequent = frequent
        self.encoder = Tokenizer.from_file(path)

    def learn(self, words: list[list[str]]) -> None:
        """Encode the words of these rows that neither tier knows."""
        missing = list(set().union(*words).difference(self))
        if len(self) + len(missing) > CACHE_WORDS:
            self.clear()
            self.update(self.frequent)
            self[""] = 0
            missing = list(set().union(*words).difference(self))
        for start in range(0, len(missing), 10_000):
            part = missing[start : start + 10_000]
            self.update(zip(part, (len(x) for x in self.encoder.encode_batch_fast(part, add_special_tokens=False))))

    def forget_long(self, words: list[list[str]]) -> None:
        for word in {w for row in words for w in row if len(w) > LONGEST_KEPT}:
            self.pop(word, None)


def frequent_words(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS, words: int = FREQUENT_WORDS) -> list[str]:
    """At most ``words`` frequent words of about ``rows`` rows drawn at random."""
    total = docs.count()
    share = int(min(1.0, rows / max(1, total)) * (1 << 20))
    sample = docs.where(F.rand(0) * (1 << 20) < share).select(F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in slices(batches):
            for x in batch.column("text").to_pylist():
                found.update(w for w in words_of(x) if len(w) <= LONGEST_KEPT)
        top = found.most_common(words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counts = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``key, n_bytes, n_tokens, over_limit``.

    ``tokenizer_path`` names a ``tokenizers`` file that every worker can open, with white space dropped
    before its model.  A driver-side list of at most ``FREQUENT_WORDS`` word lengths is broadcast; a worker
    encodes other words once and remembers them.  Scan and map only: nothing is shuffled.

    A null or empty text has no bytes and no tokens.  Repeated rows stay repeated rows; a null key stays
    null; other columns are ignored, whatever their names.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    words = frequent_words(docs, text)
    known = Tokenizer.from_file(tokenizer_path).encode_batch_fast(words, add_special_tokens=False)
    table = docs.sparkSession.sparkContext.broadcast({w: len(x) for w, x in zip(words, known)})
    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = remembered(name, lambda: _Lengths(tokenizer_path, table.value))
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            words = [words_of(x) for x in texts]
            lengths.learn(words)
            tokens = [sum(map(lengths.__getitem__, row)) for row in words]
            lengths.forget_long(words)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["key", "n_bytes", "n_tokens"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = plain.schema["key"].dataType.simpleString()
    counted = plain.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
