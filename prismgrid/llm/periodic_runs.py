"""Periodic runs of words: online sparse diagonal matching, and texts with the repeats of each run left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Words of the shortest run, and how many periods a run has at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4

Run = tuple[int, int, int]


def least_match(period: int, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> int:
    """Words of a run that equal the word one period before them, at least."""
    return max(least - period, (times - 1) * period)


def _repeated(names: np.ndarray, where: np.ndarray, shift: int, out_of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows joined from two that stand ``shift`` apart: names (-1: occurs once), places that occur again, nearest earlier place.

    Names are ranks of pairs of names, so equal names mean equal words; nothing is hashed.
    """
    where = where[where + shift < out_of]
    where = where[names[where + shift] >= 0]
    fresh = np.full(out_of, -1, np.int64)
    if not len(where):
        return fresh, where, where
    key = names[where] * (int(names.max()) + 1) + names[where + shift]
    order = np.argsort(key, kind="stable")
    key, place = key[order], where[order]
    same = key[1:] == key[:-1]
    again = np.concatenate([[False], same])
    kept = again | np.concatenate([same, [False]])
    earlier = np.full(out_of, -1, np.int64)
    earlier[place[1:][same]] = place[:-1][same]
    fresh[place[kept]] = np.cumsum(~again)[kept] - 1
    where = np.sort(place[kept])
    return fresh, where, earlier[where]


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no smaller period holds; a smaller one of a stretch of two periods or more divides ``period``."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        while rest % prime == 0:
            rest //= prime
        part = period // prime
        if np.array_equal(words[start : start + period], words[start + part : start + part + period]):
            return False
        prime += 1
    return True


def periodic_runs(words: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[Run]:
    """``(start, length, period)`` of every run of ``words`` (word numbers), by start and period.

    Words are read in order.  A word looks up where the window that begins with it stood before; the distance
    is a lag, i.e. a diagonal of the matrix of equal words.  If the word before had the same lag, its match length
    grows by one, else the diagonal ends, and a run is emitted if the match was long enough and no smaller
    period holds.  A lag q needs ``max(least - q, (times - 1) * q)`` matches, so windows of that many words
    are enough: windows double from scale to scale, each serves the lags that need between one and two
    windows, and words whose window occurs once are not visited.  Of the earlier places of a window only the nearest
    counts: those within reach overlap, hence lie whole multiples of the nearest lag away, inside its run.
    The state is a lag and a length for each scale; work is bounded by the words that repeat.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    found: set[Run] = set()
    n = len(words)
    window = min(least_match(q, least, times) for q in range(1, max(2, least + 1)))
    # the first window from powers of two
    size, names, where = 1, words.astype(np.int64), np.arange(n)
    earlier = where
    while size < window and len(where):
        shift = min(size, window - size)
        names, where, earlier = _repeated(names, where, shift, n)
        size += shift
    if window == 1:
        names, where, earlier = _repeated(names, where, 0, n)
    while len(where) and size <= n:
        reach = (2 * size - 1) // (times - 1)
        near = (earlier >= 0) & (where - earlier <= reach)
        lag = begin = last = -1

        def close(lag: int, begin: int, last: int, size: int = size) -> None:
            match = last - begin + size
            if lag > 0 and match >= least_match(lag, least, times) and _primitive(words, begin - lag, lag):
                found.add((begin - lag, match + lag, lag))

        for i, q in zip(where[near].tolist(), (where - earlier)[near].tolist(), strict=True):
            if q != lag or i != last + 1:
                close(lag, begin, last)
                lag, begin = q, i
            last = i
        close(lag, begin, last)
        names, where, earlier = _repeated(names, where, size, n)
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeats(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, times: int = LEAST_PERIODS, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with every row's runs (``array<struct<start,length,period>>``) and its text without their repeats.

    A run is a longest stretch of words (``[^\\x20\\x09-\\x0D]+``, numbered from 0) with smallest period q and at least
    ``max(least, times * q)`` words.  Of each run the first period stays; the words that stay are joined by one
    blank.  A map over whole texts, one at a time; nothing shuffles, and equal texts give equal results.

    Null and empty texts have no run and collapse to an empty text.  All rows and columns stay; where ``runs`` or
    ``collapsed`` names a column of ``docs``, the new one takes its place.
    """
    row, inner = "row", F.struct("*").alias("row")
    kind = docs.select(inner).schema[row].dataType
    source = docs.select(inner, F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            raw, at = text_bytes(batch.column("t"))
            whole = raw.tobytes()
            spans, kept = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = whole[a:b].split()
                own = periodic_runs(numbered(words), least, times)
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                if own:
                    gone = repeats(len(words), own).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept.append(b" ".join(words))
            made = [pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(row), *made], [row, "r", "c"])

    out = source.mapInArrow(run, f"row {kind.simpleString()}, r array<struct<start:bigint,length:bigint,period:bigint>>, c string")
    others = [F.col(row)[c].alias(c) for c in docs.columns if c not in (runs, collapsed)]
    return out.select(*others, F.col("r").alias(runs), F.col("c").alias(collapsed))
