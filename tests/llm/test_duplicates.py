"""Line dedup, Jaccard join and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import prose

from prismgrid.llm import fingerprints, jaccard_join, line_dedup
from prismgrid.llm.common import text_bytes
from prismgrid.llm.shingles import row_shingles


def _runs(text, least=50):
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        words = 0
        for j in range(i, len(lines)) if line.split() else ():
            words += len(lines[j].split())
            if words >= least:
                out.append("\n".join(lines[i : j + 1]))
                break
    return out


@pytest.fixture(scope="module")
def copied(spark):
    rng = random.Random(5)
    passages = ["\n".join(prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(3, 6))) for _ in range(6)]
    passages = [p for p in passages if len(p.split()) >= 55]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6))]
        for p in rng.sample(passages, rng.randint(0, min(3, len(passages)))):
            parts.insert(rng.randint(0, len(parts)), p)
        if rng.random() < 0.3:
            parts.insert(0, "a short line that many documents share")
        rows.append((i, "\n".join(parts)))
    rows += [(90, rows[3][1]), (91, rows[4][1] + "\nand more")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_every_shared_run_leaves_the_later_document(copied):
    rows, df = copied
    new = {r.doc_id: r for r in line_dedup.dedup_lines(df, report="gone").collect()}
    held = set()
    for i, text in rows:
        own = _runs(text)
        assert not held & set(_runs(new[i].text))
        if not held & set(own):
            assert new[i].text == text and new[i].gone == 0
        lines = iter(text.split("\n"))
        assert all(any(x == y for y in lines) for x in new[i].text.split("\n") if new[i].text)  # a subsequence
        held |= set(own)
    assert new[90].text == ""
    short = "a short line that many documents share"
    # by itself it is no block; it leaves only as part of a longer one
    assert sum(short in new[i].text for i, _ in rows if i < 80) > 10


def test_patience_anchors_on_unique_lines():
    own, other = [1, 2, 9, 3, 4, 9], [9, 1, 2, 5, 3, 4]
    assert line_dedup.patience(own, other) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([7, 7], [7, 7]) == [(0, 0), (1, 1)]


def test_moved_blocks_leave_too(spark):
    rng = random.Random(6)
    a, b = prose(rng, 60), prose(rng, 70)
    df = spark.createDataFrame([(1, f"{a}\nmiddle\n{b}"), (2, f"{b}\nother\n{a}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}[2] == "other"


def test_a_run_whose_first_line_is_gone_leaves_whole():
    # own A B C, earlier A B X B C, 30 words a line: the alignment takes A B, and B C is common as well
    assert line_dedup.common_blocks([1, 2, 3], [30] * 3, [12, 23, 0], [1, 2, 9, 2, 3], [12, 29, 92, 23, 0], 50) == {0, 1, 2}


def test_line_dedup_of_odd_tables(odd_documents, no_documents):
    got = line_dedup.dedup_lines(odd_documents, min_words=20, report="lines")
    assert got.columns == [*odd_documents.columns, "lines"]
    rows = got.collect()
    assert len(rows) == odd_documents.count()
    assert Counter(r.text is None for r in rows)[True] == 2
    assert [r.text for r in rows if r.doc_id == 7] == ["same row " * 30] * 2  # equal rows are one document
    assert [r.text for r in rows if r.doc_id == 8] == [""]
    assert line_dedup.dedup_lines(no_documents).count() == 0


def _sets(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def _components(rows, words, percent):
    sets = [_sets(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def _family(rng, base, copies, most):
    words = base.split()
    for _ in range(copies):
        own = list(words)
        for k in rng.sample(range(len(own)), rng.randint(0, most)):
            own[k] = prose(rng, 1)
        yield " ".join(own)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, words, percent):
    rng = random.Random(words)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    for size in (40, 80, 120):
        texts += _family(rng, prose(rng, size), 40, 6)
    texts += [texts[50], texts[50].upper(), "", " \n", "one", "ONE", "two words", "one two three", "ab cd ef gh"]
    # a chain: each links with the next only
    chain = prose(rng, 100).split()
    texts += [" ".join(chain[i * 3 : i * 3 + 60]) for i in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, words, percent).collect()}
    assert got == _components(rows, words, percent)


def test_jaccard_join_of_odd_tables(odd_documents, no_documents):
    got = jaccard_join.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {(r.doc_id, r.component_id, r.n_shingles) for r in got}
    assert (8, 7, 4) in {(d, c, n) for d, c, n in by if d == 8} or any(d == 8 and c == 7 for d, c, _ in by)
    assert all(c is None for d, c, _ in by if d is None) and (2, 2, 0) in by and (3, 3, 0) in by and (10, 10, 0) in by
    assert jaccard_join.near_duplicates(no_documents).count() == 0


def test_shingle_counts_hold_at_every_border():
    texts = ["a", "", "A b  c d e", "a b c d", "\ta b c d\x0b", "x y\x0cz w v", "a b c d a b c d"]
    rows, _ = row_shingles(*text_bytes(pa.array(texts)), 4)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(_sets(t, 4)) for t in texts]


def test_entropy_classes_match_counting():
    rng = np.random.default_rng(8)
    raw = np.concatenate([rng.integers(97, 105, 300), np.full(100, 65), rng.integers(0, 256, 200)]).astype(np.uint8)
    got = fingerprints.entropy_classes(raw)
    for i in range(len(raw) - 63):
        p = np.bincount(raw[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(int(got[i]) - 1000 * float(-(p * np.log2(p)).sum()) / 6) < 1.01


def _features(text, ranks):
    raw = text.encode()
    if len(raw) < 64:
        return [raw] if raw else []
    classes = fingerprints.entropy_classes(np.frombuffer(raw, np.uint8))
    order = [int(ranks[c]) for c in classes]
    votes = Counter()
    for w in range(len(order) - 63):
        best = min(range(w, w + 64), key=lambda i: (order[i], i))
        if order[best] < fingerprints.CLASSES:
            votes[best] += 1
    chosen = sorted(i for i, v in votes.items() if v >= fingerprints.VOTES)
    chosen = chosen or [min(range(len(order)), key=lambda i: (-votes[i], order[i], i))]
    return list(dict.fromkeys(raw[i : i + 64] for i in chosen))


def test_selected_features_match_voting():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 5, 12, 20, 40, 200, 900)] + ["", "ab" * 400]
    ranks = np.random.default_rng(1).permutation(fingerprints.CLASSES)
    ranks[:100] = ranks[991:] = fingerprints.CLASSES
    rows, hashes = fingerprints.features(*text_bytes(pa.array(texts)), ranks)
    from prismgrid.llm.bytehash import span_hashes

    for i, t in enumerate(texts):
        want = [int(span_hashes(np.frombuffer(f, np.uint8), np.array([0]), np.array([len(f)]))[0]) for f in _features(t, ranks)]
        assert hashes[rows == i].tolist() == want


def test_fingerprints_follow_their_neighbours(spark, monkeypatch):
    rng = random.Random(10)
    texts = {i * 3: prose(rng, rng.randint(0, 400)) for i in range(60)} | {500: "é" * 50 + prose(rng, 90), 600: "", 700: prose(rng, 3000)}
    texts[33] = texts[30]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    keys = sorted(texts)
    assert sorted(got) == keys
    for k, nxt in zip(keys, keys[1:] + keys[:1]):
        t, n = texts[k], len(texts[k])
        edited = t[: n - n // 4] + texts[nxt][: n // 4]
        r = got[k]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = fingerprints.decoded(r.fingerprint), fingerprints.decoded(r.edited_fingerprint)
        assert abs(r.near_edited - fingerprints.likeness(own, other)) < 1e-12
        assert abs(r.near_next - fingerprints.likeness(own, fingerprints.decoded(got[nxt].fingerprint))) < 1e-12
    assert got[30].fingerprint == got[33].fingerprint and got[30].near_next == 1.0
    assert got[700].near_edited > 0.3 > got[700].near_next


def test_fingerprints_of_odd_tables(odd_documents, no_documents):
    got = fingerprints.fingerprints(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all((r.fingerprint == "") == (r.n_chars == 0) for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert fingerprints.fingerprints(no_documents).count() == 0
    one = odd_documents.where("doc_id = 4")
    assert [r.near_next for r in fingerprints.fingerprints(one).collect()] == [1.0]


def test_words_that_collide_modulo_powers_of_two_are_told_apart():
    # the Thue-Morse word of 4,096 letters and its complement have one polynomial hash modulo 2**64, whatever the base
    import numpy as np

    from prismgrid.llm.bytehash import span_hashes

    bits = np.array([bin(i).count("1") % 2 for i in range(4_096)], np.uint8)
    raw = np.concatenate([bits + 97, 98 - bits, bits + 97]).astype(np.uint8)
    at = np.array([0, 4_096, 8_192])
    a, b, c = span_hashes(raw, at, at + 4_096).tolist()
    assert a == c != b


def test_number_signs_are_no_letters(spark):
    from prismgrid.llm import language_id

    assert language_id.words_of("² ½ ① x² Straße ⅷ 中文") == ["x", "straße", "中文"]
    model = language_id.train(spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string"))
    got = language_id.languages(spark.createDataFrame([(1, "² ½ ①"), (2, "some")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0), ("en", 1.0)]
