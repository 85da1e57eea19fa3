"""Counts over whole texts that the quality operators use, in one pass in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = b".,;:!?"

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
         "n_upper", "n_digits", "n_stops")
SCHEMA = ", ".join(f"{name} long" for name in NAMES)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return sum(covered)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of NAMES for one text; a null text has none of anything."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: ASCII white space only
    lines = [line for line in data.split(b"\n") if line.strip()]

    def of(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return (len(words), len(text) - of(SPACES), of(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
            len(lines), len(set(words)), of(UPPER), of(DIGITS), of(STOPS))


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_counts(t) for t in texts], columns=list(NAMES), dtype="int64")


def text_statistics(text: Column) -> Column:
    """A struct column with the counts of NAMES."""
    # not to be worked out again for each field or filter that uses it
    return F.pandas_udf(_counts, SCHEMA).asNondeterministic()(text.cast("string"))
