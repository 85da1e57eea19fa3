"""T2 ``stopword_set``: the word list the noise filter removes.

The base list is a parameter; by default it is the plain English list in
``fixed.py``, so neither the queries nor the oracle SQL need a file, a jar or
a JVM.
"""

from __future__ import annotations

from ..fixed import ENGLISH_STOPWORDS, NOISE_SYMBOLS


def stopword_set(words: tuple[str, ...] | list[str] | None = None,
                 symbols: tuple[str, ...] | list[str] = NOISE_SYMBOLS) -> tuple[str, ...]:
    """Lower-case words to drop: base list (or ``words``) plus the symbols.

    Sorted and de-duplicated so the literal ``IN`` list is stable.
    """
    base = ENGLISH_STOPWORDS if words is None else tuple(words)
    return tuple(sorted({w.lower() for w in base} | set(symbols)))
