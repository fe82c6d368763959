"""Shards of bounded size by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Address bits from the key, then as many from the text for rows whose keys are equal.
WORD_BITS = 60
#: Directory bits a round may add.
STEP = 8


def _address(*columns: Column) -> Column:
    """The first 60 bits of an MD5 digest; null and empty differ."""
    parts = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def _bits(high: Column, low: Column, depth: int, width: int) -> Column:
    """``width`` address bits after the first ``depth``; rounds never straddle the two words."""
    word, at = (high, depth) if depth < WORD_BITS else (low, depth - WORD_BITS)
    return F.shiftright(word, WORD_BITS - at - width).bitwiseAND(F.lit((1 << width) - 1))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``bucket, bits, shard, depth, shard_bytes, shard_rows, fits``: the entries of every round of splits.

    ``rows(high, low, n_bytes)``.  A round sums bytes by the next ``STEP`` bits of the buckets that are
    still too large (partial sums in the scan), adds the sums up to every shorter prefix and takes for each
    entry the shortest prefix within ``limit``.  An entry that is too large even with all bits of the round is
    a bucket of the next round.  Buckets at the last bit hold copies of one row and stay as they are.
    """
    entries, open_rows, depth = None, rows.withColumn("bucket", F.lit("")), 0
    while True:
        width = min(STEP, WORD_BITS - depth % WORD_BITS)
        cells = open_rows.withColumn("bits", _bits(F.col("high"), F.col("low"), depth, width))
        cells = cells.groupBy("bucket", "bits").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("k"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(bits, {width} - k)"))
        sums = levels.groupBy("bucket", "k", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = depth + width == 2 * WORD_BITS
        taken = (F.col("shard_bytes") <= limit) | (F.col("k") == width)
        chosen = levels.join(sums.where(taken), ["bucket", "k", "prefix"]).groupBy("bucket", "bits").agg(
            F.min_by(F.struct("k", "prefix", "shard_bytes", "shard_rows"), "k").alias("s"))
        name = F.concat("bucket", F.expr(f"right(lpad(bin(s.prefix), {width}, '0'), s.k)"))
        found = stored(chosen.select(
            "bucket", "bits", name.alias("shard"), (F.col("s.k") + depth).alias("depth"),
            F.col("s.shard_bytes").alias("shard_bytes"), F.col("s.shard_rows").alias("shard_rows"),
            (F.col("s.shard_bytes") <= limit).alias("fits"), F.lit(depth).alias("at")))
        entries = found if entries is None else entries.unionByName(found)
        too_large = found.where("not fits")
        if last or too_large.isEmpty():
            return entries
        nxt = too_large.select(F.col("bucket"), F.col("bits"), F.col("shard").alias("next"))
        open_rows = (open_rows.withColumn("bits", _bits(F.col("high"), F.col("low"), depth, width))
                     .join(nxt, ["bucket", "bits"]).select("high", "low", "n_bytes", F.col("next").alias("bucket")))
        depth += width


def _assigned(docs: DataFrame, limit: int, keys: Sequence[str], text: str) -> DataFrame:
    slim = stored(docs.select(
        *[F.col(k) for k in keys],
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        _address(*[F.col(k) for k in keys]).alias("high"), _address(F.col(text)).alias("low")))
    entries = directory(slim.select("high", "low", "n_bytes"), limit)
    depths = sorted(r["at"] for r in entries.select("at").distinct().collect()) or [0]
    rest, out = slim.withColumn("bucket", F.lit("")), None
    for depth in depths:
        width = min(STEP, WORD_BITS - depth % WORD_BITS)
        met = rest.withColumn("bits", _bits(F.col("high"), F.col("low"), depth, width)).join(
            entries.where(F.col("at") == depth).drop("at"), ["bucket", "bits"])
        end = F.col("fits") | F.lit(depth == depths[-1])
        ended = met.where(end).select(*slim.columns, "shard", "depth", "shard_bytes", "shard_rows", "fits")
        out = ended if out is None else out.unionByName(ended)
        rest = met.where(~end).select(*slim.columns, F.col("shard").alias("bucket"))
    return out


def shards(docs: DataFrame, limit: int = 256 << 20, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Shard of every row: the key columns, ``n_bytes, shard, depth, shard_bytes, shard_rows, fits``.

    The shard is the prefix of the row's address (MD5 of the key columns, then MD5 of the text) that the
    directory holds: only a bucket above ``limit`` bytes is split, one bit at a time.  Addresses are uniform,
    so a hot source spreads; rows with one key in common split by text.  Only exact copies of one row can
    exceed the limit together, and then carry ``fits = false``, as does a text longer than the limit.

    Null keys are a key like any other, a null text has no bytes, and an empty table has no shards.
    Rows meet the directory by address bits, without their text; other columns are ignored.
    """
    return _assigned(docs, limit, keys, text).drop("high", "low")


def write_shards(docs: DataFrame, path: str, limit: int = 256 << 20, keys: Sequence[str] = ("doc_id",), text: str = "text") -> None:
    """Write all columns of ``docs`` as Parquet under ``path``, one folder ``_shard=<bits>`` for each shard."""
    where = _assigned(docs, limit, keys, text).select("high", "low", F.concat(F.lit("b"), "shard").alias("_shard")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _address(*[F.col(k) for k in keys]).alias("high"), _address(F.col(text)).alias("low"))
    rows.join(where, ["high", "low"]).select("row.*", "_shard").repartition("_shard").write.partitionBy("_shard").parquet(path)
