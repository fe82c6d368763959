"""Line deduplication: documents that share a rare run of lines are aligned, and the later one loses the common blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import span_hashes
from .common import let_go, slices, stored, text_bytes

#: Words of the shortest block that is deleted.
MIN_WORDS = 50


def line_table(raw: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Lines of many texts: first line of each text, hash and words of each line, and the hash of its run.

    A single short line is no evidence of a copy.  A line's run is the line and as many that follow as make
    ``min_words`` words; the hash is 0 where the text ends before, and for lines without words.
    """
    breaks = raw == 10
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    inner = np.flatnonzero(breaks)
    per_text = np.diff(np.concatenate([[0], np.cumsum(breaks)])[at]) + 1
    base = np.concatenate([[0], np.cumsum(per_text)])
    starts, stops = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
    opening = np.zeros(base[-1], bool)
    opening[base[:-1]] = True
    starts[opening], starts[~opening] = at[:-1], inner + 1
    closing = np.zeros(base[-1], bool)
    closing[base[1:] - 1] = True
    stops[closing], stops[~closing] = at[1:], inner
    letters = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = letters.copy()
    begins[1:] &= ~letters[:-1] | first[1:-1]
    seen = np.concatenate([[0], np.cumsum(begins)])
    words = seen[stops] - seen[starts]
    hashes = span_hashes(raw, starts, stops)
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    text_end = np.repeat(base[1:], per_text)
    whole = (end <= text_end) & (words > 0)
    runs = np.zeros(len(words), np.uint64)
    where = np.flatnonzero(whole)
    runs[where] = span_hashes(hashes, where, end[where]) | np.uint64(1)
    return base, hashes, words, runs


def lines_of(plain: DataFrame, min_words: int) -> DataFrame:
    """``node, hashes, words, runs`` of every text of ``plain(node, text)``."""
    kind = plain.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches):
            base, hashes, words, runs = line_table(*text_bytes(batch.column("text")), min_words)
            at = pa.array(base.astype(np.int32))
            columns = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hashes.view(np.int64), words.astype(np.int32), runs.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], ["node", "hashes", "words", "runs"])

    return plain.mapInArrow(run, f"node {kind}, hashes array<long>, words array<int>, runs array<long>")


def patience(own: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a patience alignment, in order.

    Equal ends of a range are matched; lines that are unique in both ranges and in one order (longest
    increasing subsequence) split it into smaller ranges.
    """
    pairs, todo = [], [(0, len(own), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and own[a] == other[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and own[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(own[a:b]), Counter(other[c:d])
        place = {x: k for k, x in enumerate(other[c:d], c) if right[x] == 1}
        common = [(k, place[x]) for k, x in enumerate(own[a:b], a) if left[x] == 1 and x in place]
        tails, ends, back = [], [], []
        for k, (_, j) in enumerate(common):
            at = bisect_left(tails, j)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1] = [j]
            ends[at : at + 1] = [k]
        anchors, k = [], ends[-1] if ends else -1
        while k >= 0:
            anchors.append(common[k])
            k = back[k]
        if not anchors:
            continue
        edge_a, edge_c = a, c
        for i, j in reversed(anchors):
            todo.append((edge_a, i, edge_c, j))
            pairs.append((i, j))
            edge_a, edge_c = i + 1, j + 1
        todo.append((edge_a, b, edge_c, d))
    return sorted(pairs)


def common_blocks(own: list[int], words: list[int], runs: list[int], other: list[int], other_runs: list[int], min_words: int) -> set[int]:
    """Lines of ``own`` in blocks of ``min_words`` words or more that ``other`` has too.

    The alignment gives blocks in one order.  A run that both have and the alignment leaves (moved, or
    repeated) is then matched by itself and extended as far as both agree.
    """
    gone: set[int] = set()

    def drop(i: int, n: int) -> None:
        if sum(words[i : i + n]) >= min_words:
            gone.update(range(i, i + n))

    block = None
    for i, j in patience(own, other):
        if block and i == block[0] + block[2] and j == block[1] + block[2]:
            block[2] += 1
        else:
            if block:
                drop(block[0], block[2])
            block = [i, j, 1]
    if block:
        drop(block[0], block[2])
    places = {r: k for k, r in reversed(list(enumerate(other_runs))) if r}
    for i, r in enumerate(runs):
        j = places.get(r) if r else None
        if j is None:
            continue
        if i in gone:
            # the first line may have left with another block; the run is settled when all its lines have
            stop, n = i, 0
            while n < min_words and stop in gone:
                n, stop = n + words[stop], stop + 1
            if n >= min_words:
                continue
        start, end = 0, 0
        while i - start > 0 and j - start > 0 and own[i - start - 1] == other[j - start - 1]:
            start += 1
        while i + end < len(own) and j + end < len(other) and own[i + end] == other[j + end]:
            end += 1
        drop(i - start, start + end)
    return gone


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` with the blocks of lines deleted that an earlier document (by ``key``) has as well.

    Every run of lines leads to the first document that holds it, so a passage in many documents makes one
    pair for each of them and never pairs among them: whatever a document shares with any earlier one, it
    shares with the first holder.  Pairs are aligned, and blocks of ``min_words`` words or more go from the
    later text; the first copy stays.  ``report`` names a further column with the number of lines deleted.

    Null and empty texts stay as they are; a text may become empty.  Equal rows count as one document, rows
    with one key and different texts as several, null keys as the earliest.  All columns are carried, whatever
    their names.
    """
    node = F.struct(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("sig")).alias("node")
    lines = stored(lines_of(docs.select(node, F.col(text).cast("string").alias("text")), min_words))
    runs = lines.select("node", F.explode(F.array_distinct("runs")).alias("run")).where("run <> 0")
    holders = runs.groupBy("run").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("run", "first")
    pairs = runs.join(holders, "run").where("first < node").select("node", "first").distinct()
    tables = lines.dropDuplicates(["node"])
    met = pairs.join(tables, "node").join(tables.select(F.col("node").alias("first"), F.col("hashes").alias("other"), F.col("runs").alias("other_runs")), "first")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            columns = [batch.column(c) for c in ("hashes", "words", "runs", "other", "other_runs")]
            found = [sorted(common_blocks(*(c[i].as_py() for c in columns), min_words)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], ["node", "gone"])

    kind = lines.schema["node"].dataType.simpleString()
    gone = met.select("node", "hashes", "words", "runs", "other", "other_runs").mapInArrow(align, f"node {kind}, gone array<int>")
    gone = gone.select("node", F.explode("gone").alias("line")).groupBy("node").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), node).join(gone, "node", "left")
    whole = F.split(F.col("row")[text], "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("gone"))
    cut = F.array_join(F.transform(kept, lambda i: whole[i]), "\n")
    out = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(cut)
    columns = [out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if report:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).alias(report))
    return rows.select(*columns)
