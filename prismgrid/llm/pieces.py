"""SentencePiece encoding and decoding of whole texts by suffix-array matching and a relaxation over the matches."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices

SPACE = "▁"
#: Text bytes whose unseen words are gathered, characters of them that are indexed together (a longer word is
#: a lot of its own), and words and ids a worker remembers before it starts anew.
LOT_BYTES = 1 << 21
LOT_CHARS = 1 << 18
CACHE_WORDS = 200_000
CACHE_IDS = 1 << 21
#: Pairs below this number are judged one by one instead of as arrays.
FEW = 16
_NEVER = 1 << 40


class Vocabulary:
    """Pieces of a BPE model with byte fallback, laid out as arrays for matching.

    ``rank`` orders the merges (best score first; single characters -1), ``left`` and ``right`` are the last
    merge that makes a piece from smaller ones.  Runs of blanks are kept apart: no piece may hold a blank
    after another character, nor two blanks before one.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        self.output = [bytes([int(x[3:-1], 16)]) if model.is_byte(i) else b"" if special[i] else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        plain = {x: i for i, x in enumerate(names) if not special[i]}
        self.runs = {len(x): i for x, i in plain.items() if set(x) == {SPACE}}
        words = {x: i for x, i in plain.items() if x == SPACE or set(x) != {SPACE}}
        if any(SPACE in x[1:] for x in words):
            raise ValueError("a piece holds a blank after its start")
        self.space = words.get(SPACE, -1)
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted(set("".join(words))))}
        self.breaks_lines = "\n" not in self.alphabet
        merges = sorted((i for x, i in words.items() if len(x) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(n, -1, np.int64)
        self.rank[merges] = np.arange(len(merges))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs = {(words[x[:k]], words[x[k:]]): i for x, i in words.items() for k in range(1, len(x)) if x[:k] in words and x[k:] in words}
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank, self.size = keys[order], self.rank[np.array(list(pairs.values()), np.int64)][order], n
        reached = [i for x, i in words.items() if len(x) == 1 or self._derive(x, i, words, pairs)]
        codes = [[self.alphabet[c] for c in names[i]] for i in reached]
        self.ids = np.array(reached, np.int64)
        self.lengths = np.array([len(x) for x in codes], np.int64)
        self.length_of = np.zeros(n, np.int64)
        self.length_of[self.ids] = self.lengths
        self.longest = int(self.lengths.max(initial=1))
        self.codes = np.array([x + [0] * (self.longest - len(x)) for x in codes], np.int64)

    def _derive(self, text: str, piece: int, words: dict, pairs: dict) -> bool:
        """Merge the characters of a piece best first; keep its last merge if they end as the piece."""
        parts = [words.get(c) for c in text]
        if None in parts:
            return False
        while len(parts) > 1:
            found = [(self.rank[pairs[p]], k) for k, p in enumerate(zip(parts, parts[1:])) if p in pairs]
            if not found:
                return False
            k = min(found)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [pairs[last]]
        if parts[0] != piece:
            return False
        self.left[piece], self.right[piece] = last
        return True

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NEVER)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging best first leaves the border between two pieces as it is.

        The merges inside both pieces are undone, latest first (of equal ones the right, as merging goes from
        the left).  Whenever the symbols that then touch have a merge of their own that comes before
        the one just undone, it would have joined the pieces.
        """
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER, np.int64)
        while len(live):
            joined = self._merge_rank(x, y) < limit
            result[live[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joined & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            limit = np.where(undo, rx, ry + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return result

    def blanks(self, n: int) -> list[int]:
        """Ids of a run of blanks: equal scores merge from the left, so each piece grows as long as it can."""
        most = max(self.runs)
        out = []
        while n:
            k = min(n, most)
            while k not in self.runs:
                k -= 1
            out.append(self.runs[k])
            n -= k
        return out


class _Words:
    """Ids of the words this worker has met, as one array with a place for each word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.apart = lru_cache(1 << 16)(lambda a, b: bool(vocabulary.stay_apart(np.array([a]), np.array([b]))[0]))
        line = r"\n" if vocabulary.breaks_lines else ""
        self.pattern = re.compile(rf" ?[^ {line}]+|{line or '(?!)'}| +(?= [^ {line}])| +")
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        total, n = self.used + len(ids), len(self.places) + len(words)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.int32)])
        if n > len(self.begin):
            more = np.zeros(max(n, len(self.begin)), np.int64)
            self.begin, self.count = np.concatenate([self.begin, more]), np.concatenate([self.count, more])
        self.ids[self.used : total] = ids
        self.begin[len(self.places) : n] = self.used + np.cumsum(counts) - counts
        self.count[len(self.places) : n] = counts
        self.places.update(zip(words, range(len(self.places), n)))
        self.used = total

    def learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.places]
        runs = [w for w in missing if not w.strip(" ")]
        for w in runs:
            ids = self.v.blanks(len(w))
            self._add([w], np.array(ids, np.int32), np.array([len(ids)]))
        missing = [w for w in missing if w.strip(" ")]
        lots = np.cumsum([len(w) for w in missing]) // LOT_CHARS
        for lot in np.split(np.arange(len(missing)), np.flatnonzero(np.diff(lots)) + 1) if missing else ():
            words_of_lot = [missing[k] for k in lot]
            self._add(words_of_lot, *encode_words(self.v, words_of_lot, self.apart))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and the offsets of the texts."""
        if len(self.places) > CACHE_WORDS or self.used > CACHE_IDS:
            self.clear()
        rows = [self.pattern.findall(" " + x.replace(SPACE, " ")) if x else [] for x in texts]
        self.learn(set().union(*rows))
        where = [np.array([self.places[w] for w in row], np.int64) for row in rows]
        for i, row in enumerate(rows):
            again = self._touching(row, where[i])
            if again is not None:
                self.learn(set(again))
                where[i] = np.array([self.places[w] for w in again], np.int64)
        at = np.concatenate(where) if where else np.zeros(0, np.int64)
        counts = self.count[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[at] - ends + counts, counts) + np.arange(total)]
        per_row = np.concatenate([[0], np.cumsum([len(x) for x in where])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[per_row]

    def _touching(self, row: list[str], at: np.ndarray) -> list[str] | None:
        """The words anew where a run of blanks meets a word whose own blank stays alone and so joins the run."""
        bare = (self.ids[self.begin[at]] == self.v.space) & (self.count[at] > 0)
        meet = [k for k in np.flatnonzero(bare[1:]) + 1 if row[k][0] == " " and not row[k - 1].strip(" ") and row[k].strip(" ")]
        if not meet:
            return None
        row = list(row)
        for k in meet:
            row[k - 1] += " "
            row[k] = row[k][1:]
        return row


class _Index:
    """Suffix array of a text of character codes, as far as a piece can reach, and the pieces that can occur.

    Characters are numbered anew by those that occur, so that one 64-bit key holds as many as possible.
    """

    def __init__(self, v: Vocabulary, codes: np.ndarray):
        present = np.unique(codes)
        anew = np.zeros(len(v.alphabet) + 1, np.int64)
        anew[present[present > 0]] = np.arange(1, int((present > 0).sum()) + 1)
        bits = (int(anew.max()) + 1).bit_length()
        per_key = min(62 // bits, v.longest)
        n_keys = -(-v.longest // per_key)
        rows = anew[v.codes]
        usable = ((v.codes == 0) | (rows > 0)).all(1)
        rows = rows[usable]
        self.ids = v.ids[usable]
        wide = np.zeros((len(rows), per_key * n_keys), np.int64)
        wide[:, : v.longest] = rows
        shift = bits * np.arange(per_key - 1, -1, -1)

        def keys_of(x: np.ndarray) -> list[np.ndarray]:
            return [(x[:, k * per_key : (k + 1) * per_key] << shift).sum(1) for k in range(n_keys)]

        self.low, self.high = keys_of(wide), keys_of(np.where(wide > 0, wide, (1 << bits) - 1))
        n = len(codes)
        single = np.zeros(n + per_key * n_keys, np.int64)
        renumbered = anew[codes]
        for t in range(min(per_key, n)):
            single[: n - t] |= renumbered[t:] << int(shift[t])
        keys = [single[k * per_key : k * per_key + n] for k in range(n_keys)]
        order = np.lexsort(keys[::-1])
        self.order = order[renumbered[order] > 0]
        self.keys = [k[self.order] for k in keys]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For every usable piece, where its occurrences begin and stop in the order of the suffixes."""
        return _first_not_below(self.keys, self.low, False), _first_not_below(self.keys, self.high, True)


def _first_not_below(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """By binary search, for each wanted key the first suffix not before it (or the first one after it)."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, max(0, len(keys[0]) - 1))
        below, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, w in zip(keys, wanted):
            own = k[mid]
            below |= equal & (own < w)
            equal &= own == w
        below |= equal & after
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def encode_words(v: Vocabulary, words: list[str], apart=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words behind one another, and how many each has.

    All words form one text with breaks between them.  Its suffixes are sorted, every piece's occurrences are
    found by binary search, and these edges are sorted by where they end.  A prefix of a word has one
    encoding, whose last piece is the only edge ending there that stays apart from the last piece of the
    prefix before it; so the edges are relaxed by their end, over all words at once.
    """
    apart = apart or (lambda a, b: bool(v.stay_apart(np.array([a]), np.array([b]))[0]))
    text = "\n".join(w.replace(" ", SPACE) for w in words) if v.breaks_lines else None
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    chars = np.zeros(int(begin[-1] + lengths[-1]) + 1, np.int64)
    if text is not None and "\n" not in words:
        chars[:-1] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    else:
        for b, w in zip(begin, words):
            chars[b : b + len(w)] = np.frombuffer(w.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, inverse = np.unique(chars, return_inverse=True)
    codes = np.array([v.alphabet.get(chr(c), 0) for c in known], np.int64)[inverse]
    inside = np.zeros(len(chars) + 1, np.int64)
    inside[begin] = 1
    word_of = np.cumsum(inside[:-1]) - 1
    in_word = np.arange(len(chars)) < (begin + lengths)[word_of]
    codes[~in_word] = 0

    index = _Index(v, codes)
    first, stop = index.ranges()
    found = stop - first
    ends = np.cumsum(found)
    start = index.order[np.repeat(first - ends + found, found) + np.arange(int(ends[-1]) if len(ends) else 0)]
    piece = np.repeat(index.ids, found)
    strange = np.flatnonzero(in_word & (codes == 0))
    start, piece = np.concatenate([start, strange]), np.concatenate([piece, np.full(len(strange), -1)])
    length = np.where(piece < 0, 1, v.length_of[piece])
    end = start + length
    depth = end - begin[word_of[start]]
    # by depth in the word, then end, then longest first, in one key (lots are far below these widths)
    by = np.argsort((depth << 36) | (end << 8) | (255 - np.minimum(length, 255)))
    start, piece, end, depth = start[by], piece[by], end[by], depth[by]

    last, came = np.full(len(chars) + 1, -2, np.int64), np.zeros(len(chars) + 1, np.int64)
    fresh = np.ones(len(end), bool)
    fresh[1:] = end[1:] != end[:-1]
    heads = np.flatnonzero(fresh)
    steps = np.flatnonzero(np.diff(depth[heads], prepend=-1))
    opens = np.zeros(len(chars) + 1, bool)
    opens[begin] = True
    for lo, hi in zip(steps, np.append(steps[1:], len(heads))):
        trial = heads[lo:hi]
        while len(trial):
            s, p = start[trial], piece[trial]
            before = np.where(opens[s], -1, last[s])
            ok = (before == -1) | ((p == -1) & (before != -2))
            ask = np.flatnonzero(~ok & (before >= 0))
            if len(ask) <= FEW:
                for k in ask:
                    ok[k] = apart(int(before[k]), int(p[k]))
            else:
                ok[ask] = v.stay_apart(before[ask], p[ask])
            won = trial[ok]
            last[end[won]], came[end[won]] = piece[won], start[won]
            trial = trial[~ok] + 1
            trial = trial[(trial < len(end))]
            trial = trial[~fresh[trial]]

    taken = np.full(len(chars), -3, np.int64)
    at, home = begin + lengths, begin.copy()
    while len(at):
        taken[came[at]] = last[at]
        at = came[at]
        more = at > home
        at, home = at[more], home[more]
    place = np.flatnonzero(taken > -3)
    chosen = taken[place]
    sizes = np.ones(len(place), np.int64)
    raw = np.flatnonzero(chosen < 0)
    coded = [chr(c).encode("utf-8", "replace") for c in chars[place[raw]]]
    sizes[raw] = [len(x) for x in coded]
    ids = np.repeat(chosen, sizes)
    if len(raw):
        offsets = np.cumsum(sizes) - sizes
        spots = np.repeat(offsets[raw] - (np.cumsum(sizes[raw]) - sizes[raw]), sizes[raw]) + np.arange(int(sizes[raw].sum()))
        ids[spots] = v.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
    counts = np.bincount(word_of[place], weights=sizes, minlength=len(words)).astype(np.int64)
    return ids.astype(np.int32), counts


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """Text of the ids, without the blank that encoding puts before it."""
    text = b"".join(map(v.output.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _carried(docs: DataFrame, keep: tuple[str, ...]) -> tuple[list, str, list]:
    """Columns to carry through a map under names of their own, their types, and the way back."""
    inward = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return inward, kinds, [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", digest: bool = False) -> DataFrame:
    """Ids of every whole text: the columns of ``keep`` and ``ids array<int>``.

    ``model_path`` names a SentencePiece BPE model with byte fallback, read on the driver; its arrays (bounded
    by the vocabulary) are broadcast.  Words between blanks are encoded once for each lot of texts in a task and
    remembered by the worker.  With ``digest``, ``n_tokens``, ``ids_sha256`` (of 32-bit little-endian ids) and
    ``round_trip`` (decoding gives the text) come instead of the ids.

    A null or empty text has no ids and is read back as empty; U+2581 counts as a blank and comes back as one.
    Repeated rows repeat; null values in kept columns stay.
    """
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path)), uuid.uuid4().hex
    inward, kinds, outward = _carried(docs, keep)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(name, lambda: _Words(vocabulary.value))
        for batch in slices(batches, limit=LOT_BYTES):
            texts = batch.column("text").to_pylist()
            ids, at = words.encode(texts)
            carried = [batch.column(n) for n in names]
            if not digest:
                yield pa.RecordBatch.from_arrays([*carried, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], [*names, "ids"])
                continue
            shas, same = [], []
            for i, x in enumerate(texts):
                own = ids[at[i] : at[i + 1]]
                shas.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                same.append(decode_ids(words.v, own.tolist()) == (x or "").replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([*carried, pa.array(np.diff(at)), pa.array(shas), pa.array(same)], [*names, "n_tokens", "ids_sha256", "round_trip"])

    plain = docs.select(*inward, F.col(text).cast("string").alias("text"))
    shape = "n_tokens long, ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    out = plain.mapInArrow(run, kinds + shape)
    return out.select(*outward, *[c.split()[0] for c in shape.split(", ")])


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Texts of ``ids``: the columns of ``keep`` and ``text``.  No ids (or null) give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    inward, kinds, outward = _carried(encoded, keep)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(vocabulary.value, x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    plain = encoded.select(*inward, F.col(ids).alias("ids"))
    return plain.mapInArrow(run, kinds + "text string").select(*outward, "text")
