"""Quality rules: counts of whole texts, and cleaning line by line before a verdict on the document.

Every line is judged by rules on its end punctuation, its share of signs and capitals, its look as a menu and its
boilerplate phrases. Failing lines are removed; a document that loses too much of its text so is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import other_columns, slices, text_arrays, tidy

#: Signs counted by the base rules.
SYMBOLS = "#*$%&|<>"
SYMBOL_CODES = str.maketrans("", "", SYMBOLS)
END_MARKS = tuple(".!?…:;\"'”’»)]。！？؟।")
MENU_MARKS = re.compile(r"[|»›•·>]")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
#: Phrases of legal and site boilerplate, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "accept cookies", "sign up for our newsletter", "subscribe to our newsletter", "log in to comment",
    "share this article", "read more", "click here", "lorem ipsum", "enable javascript", "skip to content",
)
#: Longest menu entry, in words; a line of at least two separated entries, all so short, is navigation.
MENU_WORDS = 4
#: Highest number of ASCII punctuation characters a word, and lowest number of such words for the rule to speak.
PUNCTUATION_A_WORD, SPEAKING_WORDS = 0.8, 3
#: Highest share of capitals among cased letters, from so many letters on.
CAPITALS, CAPITAL_LETTERS = 0.6, 20
#: Lines without an end mark pass up to so many words (titles); longer ones fail.
TITLE_WORDS = 12

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
CLEANED = ["kept", "n_kept_words", "n_failed_lines", "cleaned"]


def line_fails(line: str, n_words: int, last: bool = False) -> bool:
    """Whether a line with words fails a rule. The last line needs no end mark: texts are cut off."""
    entries = MENU_MARKS.split(line)
    if len(entries) >= 2 and all(len(e.split()) <= MENU_WORDS for e in entries):
        return True
    if n_words >= SPEAKING_WORDS and len(PUNCTUATION.findall(line)) > PUNCTUATION_A_WORD * n_words:
        return True
    small, upper = 0, 0
    if not line.islower():
        cased = [c for c in line if c.isalpha()]
        upper = sum(c.isupper() for c in cased)
        small = len(cased) - upper
        if upper + small >= CAPITAL_LETTERS and upper > CAPITALS * (upper + small):
            return True
    if n_words > TITLE_WORDS and not last and not line.rstrip().endswith(END_MARKS):
        return True
    folded = line.lower()
    return any(p in folded for p in BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has twice or more, the first one included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(numbers)
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[which] > 1)
    if not len(twice):
        return 0
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[twice + k] = True
    return int(inside.sum())


def judge(text: str, most_lost: float) -> tuple:
    """Base counts, verdict and cleaned text of one document."""
    words = text.encode().split()
    n_words = len(words)
    n_symbols = len(text) - len(text.translate(SYMBOL_CODES)) if any(c in text for c in SYMBOLS) else 0
    word_chars = sum(map(len, text.encode().decode().translate(_BLANKS).split(" "))) if n_words else 0
    repeats = repeated_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    seen: set[str] = set()
    duplicates = failed = kept_words = 0
    kept_lines = []
    verdicts: dict[str, bool] = {}
    lines = text.split("\n")
    end = max((i for i, line in enumerate(lines) if line.strip()), default=0)
    for i, line in enumerate(lines):
        n = len(line.encode().split())
        if not n:
            kept_lines.append(line)
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        if (bad := verdicts.get(line)) is None or i == end:
            bad = verdicts[line] = line_fails(line, n, i == end)
        if bad:
            failed += 1
        else:
            kept_words += n
            kept_lines.append(line)
    kept = not base_failed and kept_words >= (1 - most_lost) * n_words
    return n_words, word_chars, n_symbols, duplicates, repeats, base_failed, kept, kept_words, failed, "\n".join(kept_lines)


_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def quality(df: DataFrame, text: str = "text", most_lost: float = 0.4, cleaned: bool = True) -> DataFrame:
    """Add the base counts, the verdict and (with ``cleaned``) the text without the lines that fail.

    ``kept`` is false if the base rules fail (under 50 words, or over half of the words in repeated windows of three)
    or if the lines removed hold more than ``most_lost`` of the words. A null text counts as empty: no words, base
    failed, not kept, cleaned empty. Blank lines stay. Columns of these names are replaced, others stay.
    """
    names = BASE + CLEANED[: 4 if cleaned else 3]
    inner = df.select(*other_columns(df, names), F.col(f"`{text}`").alias("__text"))
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_arrays(batch.column(batch.num_columns - 1))
            for start, end in slices(texts):
                found = [judge(t, most_lost) for t in texts.slice(start, end - start).to_pylist()]
                added = [pa.array(c, k) for c, k, _ in zip(zip(*found), kinds, names)]
                before = [c.slice(start, end - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(before + added, [*batch.schema.names[:-1], *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]
    types = ["bigint"] * 5 + ["boolean"] * 2 + ["bigint"] * 2 + ["string"]
    return inner.mapInArrow(tidy(run), ", ".join(kept + [f"{n} {t}" for n, t in zip(names, types)]))
