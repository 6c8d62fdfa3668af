"""Texts for the tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and sun moon river stone bread light water cloud forest mountain winter summer letter garden window"


def prose(seed: int, words: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS.split()) + str(rng.randint(0, 999)) for _ in range(words))
