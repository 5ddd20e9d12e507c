"""Small tables for the tests of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank long, kept string"
VOWELS, ENDS = "aeiou", {"en": ["th", "ing", "ed", "er"], "fr": ["eau", "oux", "é", "ette"], "de": ["ung", "keit", "sch", "ß"]}


def word(rng: random.Random, lang: str) -> str:
    return "".join(rng.choice("bdfglmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) + rng.choice(ENDS[lang])


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    out = []
    for i in range(words):
        out.append(word(rng, lang) + rng.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(word(rng, "en") if rng.random() < share else w for w in text.split(" "))


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source); the further columns clash with what operators add."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, 7, "x") for i, t, lang, s in rows], SCHEMA)


def corpus(seed: int = 1, n: int = 60):
    """Ids, texts, languages and sources: with copies, near copies, odd and empty texts, nulls and a very long one."""
    rng = random.Random(seed)
    rows, langs = [], ["en", "fr", "de"]
    for i in range(n):
        lang = langs[i % 3]
        rows.append((3 * i, prose(rng, rng.choice([4, 30, 80, 150]), lang), lang, f"s{i % 4}"))
    base = prose(rng, 200)
    for i in range(14):
        rows.append((1000 + i, edited(rng, base, [0.0, 0.0, 0.01, 0.02, 0.05, 0.1][i % 6]), "en", "s1"))
    rows += [(2000, "", "en", "s0"), (2001, None, "en", None), (2002, " \t\n ", None, None), (2003, "one", "en", "s2"), (2004, "One two", "en", "s2"), (2005, "one two", None, "s2")]
    rows += [(2006, "\U0001f600 É\x1cx\x0by " + "12 34 " * 5, "fr", "s9"), (2007, prose(rng, 20_000), "en", "s1"), (None, "no id at all, alas", "en", "s0")]
    rng.shuffle(rows)
    return rows
