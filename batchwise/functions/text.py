"""Text preprocessing as native Spark column expressions.

Everything here returns a ``Column``; nothing leaves the JVM and nothing
shuffles.  The reference ran these steps as a row-at-a-time Python UDF plus a
driver-side hasher.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_N_FEATURES, TOKEN_PATTERN  # noqa: F401 (re-exported)
from .stopwords import stopword_set

# Python's ``str.split()`` splits on Unicode white space; Java needs (?U) for it.
UNICODE_WHITESPACE = r"(?U)\s+"
ASCII_WHITESPACE = r"\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_noise_tokens(c: Column | str, stopwords: Iterable[str] | None = None,
                       split_pattern: str = UNICODE_WHITESPACE) -> Column:
    """Drop whole tokens whose lower-case form is a stop word or symbol.

    Tokens are white-space separated; kept tokens keep their case and are
    re-joined with a single space.  A null input becomes the empty string.
    The stop list becomes an ``INSET`` hash test after Catalyst's OptimizeIn.
    """
    words = list(stopword_set() if stopwords is None else stopwords)
    parts = F.split(F.coalesce(_col(c), F.lit("")), split_pattern)
    kept = F.filter(parts, lambda w: (w != F.lit("")) & ~F.lower(w).isin(words))
    return F.array_join(kept, " ")


def clean_columns(df: DataFrame, cols: Iterable[str] = ("feature1", "feature0"),
                  stopwords: Iterable[str] | None = None,
                  split_pattern: str = UNICODE_WHITESPACE) -> DataFrame:
    """Apply T1 to each named column in one projection."""
    words = list(stopword_set() if stopwords is None else stopwords)
    return df.withColumns({c: strip_noise_tokens(c, words, split_pattern) for c in cols})


def concat_text(first: Column | str = "feature0", second: Column | str = "feature1") -> Column:
    """T4: ``first + ' ' + second`` with nulls read as empty strings."""
    return F.concat_ws(" ", F.coalesce(_col(first), F.lit("")), F.coalesce(_col(second), F.lit("")))


def tokenize(c: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """T5: lower-case, then all maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(pattern), 0)


def bucket_of(token: Column, n_features: int = DEFAULT_N_FEATURES, hash_name: str = "md5") -> Column:
    """Token -> bucket in [0, n_features).

    ``md5``: first 8 hex digits of the MD5 of the UTF-8 bytes, mod n_features
    (portable: DuckDB and Python compute the same bucket).
    ``murmur3``: Spark SQL ``hash`` (Murmur3, seed 42), non-negative modulo.
    ``xxhash64``: Spark SQL ``xxhash64``, non-negative modulo.
    """
    if hash_name == "md5":
        digits = (n_features.bit_length() - 1) // 4
        if 1 <= digits <= 7 and n_features == 16 ** digits:  # the remainder is the last of the eight digits
            return F.conv(F.substring(F.md5(token), 9 - digits, digits), 16, 10).cast("int")
        head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
        return (head % F.lit(n_features)).cast("int")
    if hash_name == "murmur3":
        return F.pmod(F.hash(token), F.lit(n_features)).cast("int")
    if hash_name == "xxhash64":
        return F.pmod(F.xxhash64(token), F.lit(n_features)).cast("int")
    raise ValueError(f"unknown hash {hash_name!r}")
