"""Small documents that the tests of this folder share."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, b string, `cls` int, `key` string, `n` string"
VOCABULARY = [f"w{i}" for i in range(4000)]


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def frame(spark, texts, ids=None, langs=None, sources=None):
    """documents with extra columns whose names clash with those that operators use inside."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "web", len(t or ""), "x", 1, "k", "n"))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


ODD = [None, "", "   \t\n ", "a", "one two three four", "one two three four five", "ä ö ü ß 漢字 🙂 ~!@#", "same text here", "same text here", "x" * 70_000, "word " * 30_000]
