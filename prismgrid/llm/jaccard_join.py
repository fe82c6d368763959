"""Near-duplicate texts by an exact Jaccard join on word shingles, with rare-first prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .bytehash import mix
from .common import let_go, slices, stored, text_bytes
from .shingles import row_shingles

#: Entries of the broadcast table of frequent shingles, and of what one task adds to it.  Both only decide
#: how well the order puts rare shingles first; any order gives the same links.
FREQUENT = 1 << 17
FREQUENT_PER_TASK = 1 << 15
#: Hashes a task sorts at once while it counts, and signatures it remembers to send copies only once.
COUNTED = 1 << 21
REMEMBERED = 1 << 17
#: Bins of a set's shape and bits of the map of rows that are verified.
SHAPE = 32
MAP_BITS = 1 << 23


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that can be hashed (maps cannot); the same in every scan."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), _row_hash(docs.select(key, text)).alias("tie"), F.col(text).cast("string").alias("text"))


def frequent_shingles(plain: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of frequent shingles: sums of what every task of the scan saw twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        def found(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            h, n = h[n > 1], n[n > 1]
            top = np.argsort(-n, kind="stable")[:FREQUENT_PER_TASK]
            return pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["h", "n"])

        parts, size = [], 0
        for batch in slices(batches):
            parts.append(row_shingles(*text_bytes(batch.column("text")), words)[1])
            size += len(parts[-1])
            if size > COUNTED:
                yield found(parts)
                parts, size = [], 0
        if parts:
            yield found(parts)

    top = plain.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    table = top.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _sets(raw: np.ndarray, at: np.ndarray, words: int):
    """Rows and hashes of the shingles, and of each row the size, signature and first shingle."""
    rows, hashes = row_shingles(raw, at, words)
    size = np.bincount(rows, minlength=len(at) - 1)
    base = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    return rows, hashes, size, mix(sums[base[1:]] - sums[base[:-1]]), base


def signatures(plain: DataFrame, words: int) -> DataFrame:
    """``doc, tie, sig, n, shape``: a row for each text; equal sets of shingles have equal ``sig``."""
    kind = plain.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches):
            rows, hashes, size, sig, _ = _sets(*text_bytes(batch.column("text")), words)
            shape = np.bincount(rows * SHAPE + (hashes >> np.uint64(59)).astype(np.int64), minlength=len(size) * SHAPE).astype(np.int32)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * SHAPE), pa.array(shape))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(sig.view(np.int64)), pa.array(size), bins], ["doc", "tie", "sig", "n", "shape"])

    return plain.mapInArrow(run, f"doc {kind}, tie long, sig long, n long, shape array<int>")


def prefixes(plain: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``shingle, sig, n, pos``: the rarest shingles of every set, as many as a partner must share one of.

    ``pos`` counts from 1 in the common order: frequency, then hash.  A task sends equal sets once.
    """
    known, counts = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sent: set[int] = set()
        for batch in slices(batches):
            rows, hashes, size, sig, base = _sets(*text_bytes(batch.column("text")), words)
            if len(sent) > REMEMBERED:
                sent.clear()
            fresh = np.zeros(len(size), bool)
            for i, s in enumerate(sig.tolist()):
                fresh[i] = s not in sent
                sent.add(s)
            often = np.zeros(len(hashes), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                often[hit] = counts[place[hit]]
            # hashes are in order inside a row, so a stable sort by frequency keeps that order
            order = np.lexsort((often, rows))
            pos = np.arange(len(rows)) - base[rows] + 1
            length = size - (size * percent + 99) // 100 + 1
            keep = (pos <= length[rows]) & fresh[rows]
            out = (hashes[order][keep].view(np.int64), sig[rows[keep]].view(np.int64), size[rows[keep]], pos[keep])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["shingle", "sig", "n", "pos"])

    return plain.select("text").mapInArrow(run, "shingle long, sig long, n long, pos long")


def _possible(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and positional filter for two sets whose first common shingle stands at ``p1`` and ``p2``."""
    lengths = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return lengths & ((F.least(n1 - p1, n2 - p2) + 1) * (100 + percent) >= (n1 + n2) * percent)


def _verified(pairs: DataFrame, nodes: DataFrame, plain: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` (signatures of ``nodes``) that reach the threshold, each tested once.

    The suffix filter compares the shapes of both sets: bins of one hash range cannot share more shingles
    than the smaller of their counts.  The texts of the remaining sets then travel to their pairs.
    """
    shape = nodes.select("sig", "shape", "n")
    near = pairs.join(shape.select(F.col("sig").alias("a"), F.col("shape").alias("sa"), F.col("n").alias("na")), "a")
    near = near.join(shape.select(F.col("sig").alias("b"), F.col("shape").alias("sb"), F.col("n").alias("nb")), "b")
    most = F.expr("aggregate(zip_with(sa, sb, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)")
    near = stored(near.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"))

    # of the rows with one set only the one of the smallest tie is marked, equal rows by one of each task
    ids = near.select(F.col("a").alias("sig")).unionByName(near.select(F.col("b").alias("sig"))).distinct()
    ids = stored(ids.join(nodes.select("sig", "tie"), "sig"))
    # a bit map of fixed size keeps most other texts out of the shuffle; the join decides
    slot = F.col("sig").bitwiseXOR(F.col("tie")).bitwiseAND(F.lit(MAP_BITS - 1))
    bits = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).toArrow()
    marked = np.zeros(MAP_BITS >> 6, np.int64)
    marked[bits.column("w").to_numpy()] = bits.column("m").to_numpy()

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sent: set[int] = set()
        for batch in slices(batches):
            sig = _sets(*text_bytes(batch.column("text")), words)[3].view(np.int64)
            s = (sig ^ batch.column("tie").to_numpy()) & (MAP_BITS - 1)
            keep = (marked[s >> 6] >> (s & 63)) & 1 == 1
            if len(sent) > REMEMBERED:
                sent.clear()
            for i in np.flatnonzero(keep).tolist():
                one = hash((int(sig[i]), batch.column("tie")[i].as_py()))
                keep[i] = one not in sent
                sent.add(one)
            out = pa.RecordBatch.from_arrays([pa.array(sig), batch.column("tie"), batch.column("text")], ["sig", "tie", "text"])
            yield out.filter(pa.array(keep))

    texts = plain.select("tie", "text").mapInArrow(involved, "sig long, tie long, text string")
    texts = texts.join(ids, ["sig", "tie"], "left_semi").select("sig", "text").dropDuplicates(["sig"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: tuple = (None, None)
        for batch in batches:
            bs, ok = batch.column("b").to_pylist(), np.zeros(batch.num_rows, bool)
            at = 0
            for part in slices(iter([batch]), "ta"):
                rows, hashes = row_shingles(*text_bytes(part.column("ta")), words)
                base = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    if held[0] != bs[at + i]:
                        held = (bs[at + i], row_shingles(*text_bytes(part.column("tb").slice(i, 1)), words)[1])
                    own = hashes[base[i] : base[i + 1]]
                    both = len(own) + len(held[1]) - len(np.union1d(own, held[1]))
                    ok[at + i] = both * (100 + percent) >= (len(own) + len(held[1])) * percent
                at += part.num_rows
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    met = near.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    met = met.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return stored(met.mapInArrow(test, "a long, b long"))


def _grouped(plain: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc, tie, sig, n``), and ``sig, best, root`` of every set of shingles that is not empty.

    A node is a set, whatever the keys of its rows; equal sets are one node.  ``best`` is the first row of the
    set by ``(doc is null, doc, tie)``, ``root`` the component's smallest signature.

    Any two sets that link share one of their rarest shingles, and the links are found in two steps that
    never pair all members of a group: every set meets the set in which a shared shingle stands earliest
    (mostly the original of a group of copies), verified pairs become components, and then only sets of
    different components that still share a prefix shingle meet.  Length, positional and suffix filters come
    before each test.
    """
    table = frequent_shingles(plain, words)
    rows = stored(signatures(plain, words))
    best = F.min(F.struct(F.col("doc").isNull().alias("keyless"), "doc", "tie")).alias("best")
    nodes = stored(rows.where("n > 0").groupBy("sig").agg(F.min("n").alias("n"), F.min("tie").alias("tie"), F.min("shape").alias("shape"), best))

    # read twice and hashed twice: cheaper than keeping the prefixes of all sets, most of which are alone
    prefix = prefixes(plain, words, percent, table)
    again = prefix.groupBy("shingle").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("shingle")
    shared = stored(prefix.join(again, "shingle").dropDuplicates(["shingle", "sig"]))
    pivots = shared.groupBy("shingle").agg(F.min(F.struct("pos", "n", "sig")).alias("p"))
    c = F.col
    star = shared.join(pivots, "shingle").where(c("sig") != c("p.sig")).where(_possible(percent, c("n"), c("pos"), c("p.n"), c("p.pos")))
    star = star.select(F.least(c("sig"), c("p.sig")).alias("a"), F.greatest(c("sig"), c("p.sig")).alias("b"), (c("sig") > c("p.sig")).alias("later")).dropDuplicates(["a", "b"])
    # the pivot goes to the right, where its text is read once for all its partners
    star = stored(star.select(F.when(c("later"), c("b")).otherwise(c("a")).alias("a"), F.when(c("later"), c("a")).otherwise(c("b")).alias("b")))
    links = _verified(star, nodes, plain, words, percent)

    def rooted(edges: DataFrame) -> DataFrame:
        return components(edges, "a", "b").select(c("node").alias("sig"), "root")

    roots = stored(rooted(links))
    placed = stored(shared.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    heads = placed.groupBy("shingle").agg(F.min(F.struct("pos", "n", "sig", "root")).alias("p")).select("shingle", c("p.root").alias("head"))
    apart = placed.join(heads, "shingle").where("root <> head").drop("head")
    # a shingle all of whose sets are in one component has nothing left to do
    left = apart.select("shingle", *[c(x).alias(f"{x}1") for x in ("sig", "n", "pos", "root")], F.lit(True).alias("out1"))
    right = placed.join(heads, "shingle").select("shingle", *[c(x).alias(f"{x}2") for x in ("sig", "n", "pos", "root")], (c("root") != c("head")).alias("out2"))
    other = left.join(right, "shingle").where("root1 <> root2 and (not out2 or sig1 < sig2)")
    other = other.where(_possible(percent, c("n1"), c("pos1"), c("n2"), c("pos2")))
    other = other.select(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(stored(other.join(tried, ["a", "b"], "left_anti")), nodes, plain, words, percent)
    if not more.isEmpty():
        roots = stored(rooted(links.unionByName(more)))
    final = nodes.select("sig", "best").join(roots, "sig", "left").select("sig", "best", F.coalesce("root", "sig").alias("root"))
    return rows.select("doc", "tie", "sig", "n"), stored(final)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Connected near duplicates: ``key, n_shingles, component_id``, one row for each row of ``docs``.

    Texts link when ``100 * shared >= percent * union`` of their distinct ``words``-word shingles; a
    component's id is its smallest key.  Every row goes by its own text, also where a key repeats.

    Texts without words have no shingles and link with nothing; fewer words than a shingle count as one
    shingle.  Rows with a null key link like others, but have a null component.  Other columns are ignored.
    """
    c = F.col
    rows, sets = _grouped(_plain(docs, key, text), words, percent)
    ids = sets.groupBy("root").agg(F.min("best.doc").alias("least"))
    out = rows.join(sets.join(ids, "root").select("sig", "least"), "sig", "left")
    least = F.when(c("n") > 0, c("least")).otherwise(c("doc"))
    return out.select(c("doc").alias(key), c("n").alias("n_shingles"), F.when(c("doc").isNotNull(), least).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of every component of near duplicates, with all columns: the first by key (null keys
    last), then by a hash of the row.  Rows whose text has no words link with nothing and stay.
    """
    c, names = F.col, [f"c{i}" for i in range(len(docs.columns))]
    hashed = docs.toDF(*names).withColumn("tie", _row_hash(docs.toDF(*names)))
    at = names[docs.columns.index(text)]
    plain = hashed.select(c(names[docs.columns.index(key)]).alias("doc"), "tie", c(at).cast("string").alias("text"))
    _, sets = _grouped(plain, words, percent)
    kept = sets.groupBy("root").agg(F.min(F.struct("best", "sig")).alias("p")).select(c("p.sig").alias("sig"), c("p.best.tie").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sent: set[int] = set()
        for batch in slices(batches, at):
            _, _, size, sig, _ = _sets(*text_bytes(batch.column(at)), words)
            sig, tie = sig.view(np.int64), batch.column("tie").to_pylist()
            if len(sent) > REMEMBERED:
                sent.clear()
            fresh = np.zeros(len(size), bool)
            for i in np.flatnonzero(size).tolist():
                one = hash((int(sig[i]), tie[i]))
                fresh[i] = one not in sent
                sent.add(one)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig)], [*batch.schema.names, "sig"])
            yield out.filter(pa.array(fresh))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema)
    # equal rows leave a task once, so that one row repeated many times is no hot key of the join
    worded = F.coalesce(c(at).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met = hashed.where(worded).mapInArrow(run, f"{kinds}, sig long").join(kept, ["sig", "tie"], "left_semi").dropDuplicates(["sig", "tie"])
    return met.select(*names).unionByName(hashed.where(~worded).select(*names)).toDF(*docs.columns)
