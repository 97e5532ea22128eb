"""Small documents with what operators must bear: nulls, blanks, long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """Invented words, a full stop every ten."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ka", "lo", "mi", "ren", "tu", "sha", "vo", "ni"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 10 == 9 else "") for i, w in enumerate(words)) + "."


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    """Nulls in any column, blank, repeated and very long texts, ties, odd characters."""
    long_word, long_text = "ab" * 20_000, prose(1, 30_000)
    rows = [(1, None), (None, "some text here"), (2, ""), (3, " \t\n "), (4, prose(2, 80)), (4, prose(2, 80)), (5, prose(2, 80))]
    rows += [(6, long_word), (7, long_text), (8, "a"), (9, " 　퟿😀 é'll 12\r\n\x0b!"), (10, "\n\n\n"), (11, "A " * 300), (None, None)]
    return documents(spark, rows)
