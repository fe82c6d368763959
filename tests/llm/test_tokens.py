"""Token counts and SentencePiece ids against the libraries, and language ID on held-out text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismgrid.llm import language_id, pieces, token_counts

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
VOCABULARY = pieces.Vocabulary(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_are_the_library_s(spark):
    rng = random.Random(1)
    texts = [prose(rng, 50), "It's <|endoftext|>we'll  don't<|startoftext|>", "İstanbul ΣΑΣ é é 1234 --- \x1c x", None, "", "a\tb\r\nc", "word" * 50, "日本語 テキスト"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tool = Tokenizer.from_file(WORDS)
    for r in token_counts.token_counts(df, WORDS, limit=40).collect():
        want = len(tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 40)


def test_counts_of_odd_tables(odd_documents, no_documents, monkeypatch):
    got = token_counts.token_counts(odd_documents, WORDS).collect()
    assert len(got) == odd_documents.count() and sum(r.n_tokens == 0 for r in got) == 4
    assert token_counts.token_counts(no_documents, WORDS).count() == 0


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    lengths = token_counts._Lengths(WORDS, {"the": 1})
    for text in ("one two three", "four five six seven", "the one"):
        words = [token_counts.words_of(text)]
        lengths.learn(words)
        assert sum(map(lengths.__getitem__, words[0])) == len(lengths.encoder.encode(text).ids)


def _ids(texts):
    ids, at = pieces._Words(VOCABULARY).encode(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def test_ids_are_the_library_s():
    rng = random.Random(2)
    texts = ["", " ", "  a\nb  c ", "x▁y", "   中", "  中 中  中", "a" * 300, " " * 40 + "x", "\n\n \n", "🙂🙂 é é", "<s> </s> <0x41>", "\x00 z", "2024-01-01 10:00", prose(rng, 400)]
    assert _ids(texts) == LIBRARY.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdefghinorstu  \n.,'1éß中🙂▁ABTH"), max_size=60), max_size=6))
def test_any_text_goes_there_and_back(texts):
    got = _ids(texts)
    assert got == LIBRARY.encode(texts)
    assert [pieces.decode_ids(VOCABULARY, x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_encode_and_decode_odd_tables(odd_documents, no_documents):
    encoded = pieces.encode(odd_documents, PIECES, ("doc_id", "n_chars", "k0"))
    texts = sorted(r.text.replace("▁", " ") if r.text else "" for r in odd_documents.collect())
    assert sorted(r.text for r in pieces.decode(encoded, PIECES, ("doc_id",)).collect()) == texts
    facts = pieces.encode(odd_documents, PIECES, digest=True).collect()
    assert all(r.round_trip for r in facts)
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r.ids_sha256 == empty for r in facts) == 3
    assert pieces.encode(no_documents, PIECES).count() == 0


def test_pairs_stay_apart_as_merging_says():
    rng = np.random.default_rng(3)
    some = rng.choice(VOCABULARY.ids, 400)
    a, b = some[:200], some[200:]
    names = [LIBRARY.id_to_piece(int(i)) for i in some]
    apart = VOCABULARY.stay_apart(a, b)
    for k in range(200):
        if names[200 + k].startswith("▁") or not names[k].startswith("▁"):
            continue
        text = (names[k] + names[200 + k])[1:].replace("▁", " ")
        assert apart[k] == (LIBRARY.encode(text) == [int(a[k]), int(b[k])])


def _labelled(spark, n=240):
    rng = random.Random(4)
    marks = {"en": "the and of", "fr": "le les une", "de": "der und ein"}
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        words = prose(rng, 20).split() + marks[lang].split() * 3
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_texts(spark):
    df = _labelled(spark)
    model = language_id.train(df.where(~language_id.held_out()))
    got = language_id.languages(df, model).join(df, "doc_id").where(language_id.held_out()).collect()
    assert len(got) > 50 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_fall_back_to_shorter_ngrams():
    logs = np.array([[-9.0, -9.0], [-1.0, -5.0], [-6.0, -2.0], [-3.0, -4.0]])
    model = language_id.Model(["a", "b"], {0: {"cat": 1}, 5: {}, 4: {"cats": 2}, 3: {" do": 3}, 2: {}, 1: {}}, logs)
    assert model.score("cat").tolist() == [-1.0, -5.0]
    assert model.score("cats").tolist() == [-6.0, -2.0]
    assert model.score("dog").tolist() == [-3.0, -4.0]
    assert model.score("zzz").tolist() == [-9.0, -9.0]


def test_languages_of_odd_tables(spark, odd_documents, no_documents):
    model = language_id.train(_labelled(spark))
    got = language_id.languages(odd_documents, model).collect()
    assert len(got) == odd_documents.count()
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0} and sum(r.lang_pred == "und" for r in got) == 5
    assert language_id.languages(no_documents, model).count() == 0
    nothing = language_id.train(no_documents)
    assert {r.lang_pred for r in language_id.languages(odd_documents, nothing).collect()} == {"und"}
    kept = language_id.accepted(odd_documents, nothing)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 5
