"""Operator 10, URL filters: literal rules first, then a listing held in a Bloom filter cascade.

The listing is exact for every key of the corpus.  Level 1 of the cascade holds
the listed keys; level 2 the corpus keys that level 1 lets through by mistake;
level 3 the listed keys that level 2 lets through; and so on until a level makes
no mistake over the corpus's complete key universe.  A key is listed if the
first level that rejects it has an even number, or if the last level accepts it
and has an odd one.  The levels are small byte strings inside the expression,
so judging a URL needs no join.

Keys of a URL are its host, every parent domain, and host with path.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits
no rule and is not listed.  Repeated rows are judged alike.  An empty table or
an empty listing works.  Judged columns replace input columns of their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .bloom import filter_of, filter_words, mask_of, word_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 3
MAX_LEVEL_BYTES = 32 << 20
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(host)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(path)


def keys_of(host: Column, path: Column) -> Column:
    """The host and its parent domains, and host with path; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    keys = F.array_distinct(F.array_append(domains, F.concat(host, path)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(keys, lambda k: k != ""))


@dataclass(frozen=True)
class Level:
    words: int
    seed: int
    data: bytes

    def holds(self, key: Column) -> Column:
        at = word_of(key, self.words, self.seed) * 8 + 1
        # the word's eight bytes as a signed number
        word = F.conv(F.hex(F.substring(F.lit(self.data), at.cast("int"), F.lit(8))), 16, -10).cast("long")
        mask = mask_of(key, HASHES, self.seed)
        return word.bitwiseAND(mask) == mask


def member(levels: Sequence[Level], key: Column) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(levels[i - 1].holds(key), out).otherwise(F.lit(i % 2 == 0))
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_LEVEL_BYTES) -> list[Level] | None:
    """The levels for the ``key`` column of ``listed`` over all keys of ``universe``.

    Returns None if a level would be larger than ``max_bytes``: the caller then
    has to join.  What reaches the driver is one level's words, within that bound.
    """
    # one pass over the universe marks the listed keys; both sides are distinct
    marked = materialize(universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
                         .select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "cascade-keys")
    levels: list[Level] = []
    encode = marked.where("listed")
    while (n := encode.count()) > 0:
        words = filter_words(n, max_bytes=2 * max_bytes)
        if words * 8 > max_bytes or len(levels) == MAX_LEVELS:
            return None
        seed = len(levels) + 1
        data = bytearray(8 * words)
        for word, bits in filter_of(encode, F.col("key"), words, HASHES, seed).collect():
            data[8 * word:8 * word + 8] = bits.to_bytes(8, "big", signed=True)
        levels.append(Level(words, seed, bytes(data)))
        # of the other side, what passes every level so far
        passes = F.lit(True)
        for level in levels:
            passes = passes & level.holds(F.col("key"))
        encode = marked.where((F.col("listed") == F.lit(len(levels) % 2 == 0)) & passes)
    return levels


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url_col: str = "url",
               max_bytes: int = MAX_LEVEL_BYTES) -> DataFrame:
    """The input columns, host, path, rule (or null) and verdict (``allow`` or ``block``).

    ``listed`` has a column ``key``: domains (their subdomains are meant too) or
    hosts with a path (that page only).
    """
    added = ("host", "path", "rule", "verdict")
    url = F.col("_url")
    rows = (pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                         F.col(url_col).cast("string").alias("_url"))
            .withColumns({"host": host_of(url), "path": path_of(url)}))
    keys = keys_of(F.col("host"), F.col("path"))
    universe = materialize(rows.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    levels = build_cascade(universe, listed, max_bytes)
    if levels is not None:
        is_listed = F.exists("_keys", lambda k: member(levels, k)) if levels else F.lit(False)
        rows = rows.withColumn("_keys", keys).withColumn("_listed", is_listed)
    else:  # the listing is too long for filters in an expression: an exact join of the distinct URLs
        urls = rows.select("_url", F.explode(keys).alias("key")).where("_url is not null").distinct()
        hits = urls.join(listed.select("key").distinct(), "key").select("_url", F.lit(True).alias("_listed")).distinct()
        rows = rows.join(hits, "_url", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))

    rule, verdict = F.lit(None).cast("string"), F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the longest is tried first
        fits = (((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host)))
                & F.startswith(F.col("path"), F.lit(r.path)))
        rule = F.when(fits, F.lit(r.name)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in added]
    return rows.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
