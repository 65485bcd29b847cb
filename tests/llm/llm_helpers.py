"""Small inputs with everything that can go wrong in a row."""

from __future__ import annotations

import random

SYLLABLES = ["ban", "do", "ki", "lur", "mes", "na", "pol", "ri", "su", "ta", "vé", "zü"]


def prose(seed: int, words: int) -> str:
    """Made-up prose; the same seed gives the same text."""
    rng = random.Random(seed)
    made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)]
    return "".join(w + rng.choice([" ", " ", " ", ", ", ".\n"]) for w in made)


def documents(spark, texts, **more):
    """(doc_id, text) rows with further columns, some named like those that operators add."""
    rows = [(k, t, 1, "x") for k, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, size int, spans string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, size int, spans string")


def odd_texts():
    """By id: empty, null, blank, one word, repeated, very long, and others."""
    return {1: "", 2: None, 3: " \t\n ", 4: "word", 5: prose(5, 60), 6: prose(5, 60), 7: prose(7, 30_000), 8: "a  b \n\n c\td",
            9: "ünï çödé 😀 text <|endoftext|> with marks [INST] # $ %", 10: prose(10, 200) + prose(10, 200), 11: "one two"}
