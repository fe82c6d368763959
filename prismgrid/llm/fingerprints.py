"""Similarity digests: improbable byte windows in chained Bloom filters, compared by bit overlap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import span_hashes
from .common import shuffle_partitions, slices, text_bytes

#: Bytes of a feature, and features that compete for one vote.
WINDOW = 64
#: Votes that select a feature.
VOTES = 16
#: Entropy classes; classes outside [LEAST, MOST] are never selected (runs of one byte, random bytes).
CLASSES, LEAST, MOST = 1001, 100, 990
#: Bits and features of one filter, and bits set by a feature.
BITS, FEATURES, PER_FEATURE = 2048, 160, 5
#: Share of the range between chance and full overlap that counts as nothing.
CUTOFF = 0.3
#: Buckets of neighbouring ids for each shuffle partition, so that partitions come out even.
BUCKETS = 4

_SCALE = 1 << 20
_TERM = np.array([round(n * np.log2(n) * _SCALE) if n else 0 for n in range(WINDOW + 1)], np.int64)
_STEP = np.diff(_TERM, prepend=0)


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """Entropy class (0 to 1000) of the window at every position of ``raw``.

    A window's entropy follows from the previous one's by the counts of the byte that leaves and the byte
    that enters; these come from 63 comparisons of the whole array with itself.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(n, bool)
    for k in range(1, WINDOW):
        np.equal(raw[k:], raw[:-k], out=same[: n - k])
        part = same[: n - k].view(np.uint8)
        after[: n - k] += part
        before[k:] += part
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _TERM[np.bincount(raw[:WINDOW])].sum()
    total[1:] = _STEP[before[WINDOW:] + 1] - _STEP[after[: n - WINDOW] + 1]
    np.cumsum(total, out=total)
    full = _TERM[WINDOW]
    return ((full - total) * (CLASSES - 1) // full).astype(np.int16)


def _inside(at: np.ndarray, positions: int, width: int) -> np.ndarray:
    """Mask of the positions whose next ``width`` bytes lie in one row of the offsets ``at``."""
    lengths = np.diff(at)
    ends = np.repeat(at[1:], lengths)[:positions]
    return np.arange(len(ends)) + width <= ends


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of every entropy class, rarest first, by the windows of all texts (1001 counts reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, np.int64)
        for batch in slices(batches):
            raw, at = text_bytes(batch.column("text"))
            classes = entropy_classes(raw)
            seen += np.bincount(classes[_inside(at, len(classes), WINDOW)], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(seen, pa.int64())], ["c", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for r in docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        counts[r["c"]] = r["n"]
    order = np.lexsort((np.arange(CLASSES), counts))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    ranks[:LEAST] = ranks[MOST + 1 :] = CLASSES
    return ranks


def features(raw: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the selected features of every row, in the order of the text.

    Each run of 64 neighbouring windows gives a vote to its rarest (the first of equals); a window with
    enough votes is selected.  A row without one gives its most voted window, a row below 64 bytes all of itself.
    """
    lengths = np.diff(at)
    classes = entropy_classes(raw)
    key = (ranks[classes] << 40) | np.arange(len(classes))
    votes = np.zeros(len(raw) + 1, np.int32)
    least = key
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
    whole = _inside(at, len(least), 2 * WINDOW - 1)
    winners = least[whole]
    winners = winners[winners < (CLASSES << 40)] & ((1 << 40) - 1)
    votes[: len(raw)] += np.bincount(winners, minlength=len(raw)).astype(np.int32)[: len(raw)]
    chosen = np.flatnonzero(votes >= VOTES)
    rows = np.searchsorted(at, chosen, "right") - 1
    stops = chosen + WINDOW
    bare = np.setdiff1d(np.flatnonzero(lengths), rows)
    if len(bare):
        extra = []
        for r in bare:
            start, stop = int(at[r]), int(at[r + 1])
            if stop - start >= WINDOW:
                own = key[start : stop - WINDOW + 1]
                best = int(np.lexsort((own, -votes[start : stop - WINDOW + 1]))[0])
                start, stop = start + best, start + best + WINDOW
            extra.append((r, start, stop))
        more = np.array(extra, np.int64)
        rows, chosen, stops = (np.concatenate(x) for x in ((rows, more[:, 0]), (chosen, more[:, 1]), (stops, more[:, 2])))
        order = np.lexsort((chosen, rows))
        rows, chosen, stops = rows[order], chosen[order], stops[order]
    hashes = span_hashes(raw, chosen, stops)
    # a repeated feature counts once in its row
    order = np.lexsort((chosen, hashes, rows))
    again = np.zeros(len(order), bool)
    again[1:] = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    keep = np.sort(order[~again])
    return rows[keep], hashes[keep]


def filters(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Chain of Bloom filters of every row, as arrays ``(filters, BITS // 64)`` of 64-bit words."""
    counts = np.bincount(rows, minlength=n_rows)
    chains = -(-counts // FEATURES)
    first = np.concatenate([[0], np.cumsum(chains)])
    begin = np.concatenate([[0], np.cumsum(counts)])
    which = first[rows] + (np.arange(len(rows)) - begin[rows]) // FEATURES
    bits = np.zeros((first[-1], BITS), np.uint8)
    for k in range(PER_FEATURE):
        bits[which, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    return [packed[first[i] : first[i + 1]] for i in range(n_rows)]


def digests(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    raw, at = text_bytes(pa.array(texts, pa.large_string()))
    rows, hashes = features(raw, at, ranks)
    return filters(rows, hashes, len(texts))


def encoded(chain: np.ndarray) -> str:
    """Number of filters, a colon and their bits in Base64; empty for a text without features."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}" if len(chain) else ""


def decoded(fingerprint: str) -> np.ndarray:
    data = base64.b64decode(fingerprint.partition(":")[2])
    return np.frombuffer(data, np.uint64).reshape(-1, BITS // 64)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Mean over the shorter chain of each filter's best match: overlap between chance (0) and full (1)."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    if len(left) > len(right):
        left, right = right, left
    own, other = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left, right))
    total = 0.0
    for i in range(len(left)):  # one filter against a chain at a time bounds the memory
        shared = np.bitwise_count(left[i] & right).sum(1, dtype=np.int64)
        most = np.minimum(own[i], other)
        chance = own[i] * other / BITS
        floor = chance + CUTOFF * (most - chance)
        total += float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(left)


_OUT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, tail, key, text, digest) of the last row so far
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("bucket", "tail", "key"))
            texts = [x or "" for x in batch.column("text").to_pylist()]
            rows = list(zip(*columns, texts, digests(texts, ranks)))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
            out = []
            for (a, b), text, chain in zip(pairs, edited, digests(edited, ranks)):
                out.append((a[2], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), encoded(a[4]), encoded(chain), likeness(a[4], chain), likeness(a[4], b[4])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [c.split()[0] for c in _OUT.split(", ")])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of every whole text and of its edited text: ``key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter (code points, rounded down) replaced by the start of the next row by
    ``key``; the first row follows the last.  Rarity ranks come from the windows of all texts.  Neighbours
    meet by one shuffle: ids are cut into even buckets, and the first row of each bucket also goes to the
    end of the bucket before it.  Tasks then stream through sorted rows.

    A null text is empty, has an empty fingerprint and is like other empty ones only.  Null keys come first;
    repeated keys follow each other in the order of their texts.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = rarity(docs, text)
    least = -(1 << 63)
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("key"), F.col(text).cast("string").alias("text"))
    n = BUCKETS * shuffle_partitions(spark)
    # bounds are ids that occur, so a bucket's first row is its bound
    cuts = slim.agg(F.min("key").alias("first"), F.percentile_approx("key", [i / n for i in range(1, n)]).alias("cuts")).collect()[0]
    bounds = np.array(sorted({cuts["first"], *(cuts["cuts"] or [])} - {None}), np.int64)

    @F.pandas_udf("array<struct<bucket:int,tail:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, keys.to_numpy(), "right") - 1
        opens = bounds[own] == keys.to_numpy()
        before = (own - 1) % len(bounds)
        return pd.Series([[{"bucket": b, "tail": False}] + [{"bucket": p, "tail": True}] * o for b, p, o in zip(own.tolist(), before.tolist(), opens.tolist())])

    dealt = slim.select("key", "text", F.explode(places("key")).alias("at")).select("at.bucket", "at.tail", "key", "text")
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", "key", "text")
    out = dealt.mapInArrow(_neighbours(ranks), _OUT)
    rest = [c.split()[0] for c in _OUT.split(", ")][1:]
    return out.select(F.when(F.col("key") != least, F.col("key")).alias(key), *rest)
