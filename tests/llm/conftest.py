import random

import pytest
from texts import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like inner ones."""
    rng = random.Random(7)
    long = prose(rng, 40_000)
    rows = [
        (1, "plain text of a few words\n" + prose(rng, 80), "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, long, "en", "b", len(long)),
        (5, "12345 67890 ... !!!", "de", "b", 3),
        (6, prose(rng, 120), "de", None, 7),
        (6, prose(rng, 120), "de", "b", 7),
        (7, "same row " * 30, "en", "a", 9),
        (7, "same row " * 30, "en", "a", 9),
        (8, "same row " * 30, "fr", "a", 9),
        (None, "no key at all " + prose(rng, 60), "fr", "c", 1),
        (None, None, None, None, None),
        (9, "Ünïcode ßtraße 中文字符 🙂 ▁ tab\there\r\nline", "de", "c", 4),
        (10, " \n\n \t ", "en", "a", 4),
        (11, "x" * 300, "en", "a", 300),
    ]
    clashing = ["key", "node", "doc", "row", "block", "weight", "shard", "tail", "sig", "n", "n_tokens", "n_bytes", "k0", "c0", "_of", "_removed", "gone", "component_id", "lang_pred", "bucket"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame([r + tuple("?" for _ in clashing) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("1 = 0")
