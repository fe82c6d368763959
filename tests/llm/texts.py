"""Invented prose for the tests of the training-data operators."""

SYLLABLES = ["th", "er", "on", "an", "re", "ti", "es", "or", "ha", "nd", "ing", "ou", "st", "le", "va"]


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))
