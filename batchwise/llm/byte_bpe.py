"""Operator 7, byte-level BPE encoding and decoding by ranked merges.

A text is cut by the vocabulary's pattern; each word's bytes are merged, the
adjacent pair of lowest rank first, until no pair has a rank.  Ids are packed as
little-endian unsigned 32-bit integers; decoding concatenates the pieces.

The fold over ranked merges is written as Spark higher-order functions
(``merged``) over byte arrays with a map of the ranks, a broadcast row.  It is applied to the
corpus's most frequent distinct words, a dictionary bounded by DICTIONARY, which
is broadcast; all other words go through the same fold inside the task that
reads them (``fold``), so no word is left out and no occurrence is shuffled.
Cutting uses the ``regex`` package, whose classes are those of the pattern.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to nothing.  A text, and a word in it, may be of any length: merging a word of n
bytes takes n log n steps.  Repeated rows are encoded alike; an empty table gives an empty
result.  Input columns named n_tokens or ids are replaced.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import materialize
from .common import short_batches

# Words of the dictionary, at most; each has up to WORD_BYTES bytes, which bounds what is broadcast.
DICTIONARY = 1 << 15
WORD_BYTES = 32
# Other words whose ids a task keeps at hand before it starts anew.
MEMO = 200_000
SLOTS = 1 << 14
NO_RANK = 1 << 32
# Rows that a task hands back at a time.
ROWS = 512
# Groups of the dictionary's words, each folded by one task.
TASKS = 48
LONG_TEXT = 1 << 20
# Bytes of a word beyond which its pairs are kept in a heap.
LONG_WORD = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word: the adjacent pair of lowest rank is merged, the leftmost of equals, until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) > LONG_WORD:
        return fold_long(word, ranks)
    rank = ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [rank(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < NO_RANK:
        at = pairs.index(best)
        pair = parts[at] + parts[at + 1]
        parts[at:at + 2] = (pair,)
        del pairs[at]
        if at:
            pairs[at - 1] = rank(parts[at - 1] + pair, NO_RANK)
        if at < len(pairs):
            pairs[at] = rank(pair + parts[at + 1], NO_RANK)
    return tuple(ranks[p] for p in parts)


def fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """``fold`` in n log n steps: pairs wait in a heap by rank and place, parts are a linked list."""
    end, rank = len(word), ranks.get
    parts: list[bytes | None] = [word[i:i + 1] for i in range(end)]
    before, after = list(range(-1, end - 1)), list(range(1, end + 1))
    heap = [(r, i) for i in range(end - 1) if (r := rank(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        found, i = heappop(heap)
        j = after[i]
        # a pair that has changed since it was put there
        if parts[i] is None or j == end or rank(parts[i] + parts[j]) != found:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if (r := rank(parts[i] + parts[k])) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank(parts[h] + parts[i])) is not None:
            heappush(heap, (r, h))
    return tuple(ranks[p] for p in parts if p is not None)


class Encoder(dict):
    """Packed ids by word: what is not at hand is folded, and kept while there is room."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]) -> None:
        super().__init__(known)
        self.known, self.ranks = known, ranks

    def __missing__(self, word: str) -> bytes:
        packed = pack(fold(word.encode("utf-8", "surrogatepass"), self.ranks))
        if len(word) <= WORD_BYTES:
            if len(self) >= MEMO + len(self.known):
                self.clear()
                self.update(self.known)
            self[word] = packed
        return packed


def pack(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def unpack(data: bytes | None) -> array:
    ids = array("I", data or b"")
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row ``ranks``: a map looks its keys up one after another, so the ranks are cut into small maps by a hash.

    A row and no literal: every plan and its text in the driver would carry the literal.
    """
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        slots[zlib.crc32(piece) % SLOTS][piece.hex().upper()] = rank
    row = spark.createDataFrame([(json.dumps(slots),)], "ranks string")
    return row.select(F.from_json("ranks", "array<map<string,int>>").alias("ranks"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(word: Column, rank_of) -> Column:
    """The pieces of a binary word, by higher-order functions; ``rank_of`` gives the rank of a piece or null."""
    length = F.length(word)
    parts = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(word, i, F.lit(1)))

    def once(state: Column, _: Column) -> Column:
        ranks = F.transform(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))),
                            lambda p, i: rank_of(F.concat(p, F.get(state, i + 1))))

        def merge(at: Column) -> Column:
            pair = F.concat(F.get(state, at - 1), F.get(state, at))
            after = F.slice(state, at + 2, F.greatest(F.size(state) - at - 1, F.lit(0)))
            # no pair has a rank: at is null or 0
            return F.when(at > 0, F.concat(F.slice(state, 1, at - 1), F.array(pair), after)).otherwise(state)

        return _let(_let(ranks, lambda r: F.array_position(r, F.array_min(r)).cast("int")), merge)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), parts, once)


def frequent_words(docs: DataFrame, text_col: str, pattern: str, size: int = DICTIONARY) -> DataFrame:
    """The ``size`` most frequent distinct words (as binary ``word``) of all texts."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    words = docs.select(F.explode(found).alias("w")).where(
        (F.octet_length("w") > 0) & (F.octet_length("w") <= WORD_BYTES))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.orderBy(F.col("n").desc(), "w").limit(size).select(F.col("w").cast("binary").alias("word"))


def dictionary(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word and pieces for each word, by the merges as higher-order functions.

    The words, a bounded number, are folded in TASKS groups: the ranks stand beside a group and not beside a word.
    """
    def rank_of(piece: Column) -> Column:
        slot = F.element_at("ranks", (F.pmod(F.crc32(piece), F.lit(SLOTS)) + 1).cast("int"))
        return F.try_element_at(slot, F.hex(piece))

    groups = (words.select("word", F.pmod(F.xxhash64("word"), F.lit(TASKS)).alias("task")).repartition(TASKS, "task")
              .groupBy("task").agg(F.collect_list("word").alias("words")))
    groups = groups.crossJoin(F.broadcast(rank_table(words.sparkSession, ranks)))
    folded = F.transform("words", lambda w: F.struct(w.alias("word"), merged(w, rank_of).alias("pieces")))
    return groups.select(F.explode(folded).alias("f")).select("f.word", "f.pieces")


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The piece of each id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def known_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, size: int) -> dict[str, bytes]:
    """Packed ids of the most frequent words; at most ``size`` small rows reach the driver."""
    words = materialize(frequent_words(docs, text_col, pattern, size), "bpe-words")
    known = {}
    for word, pieces in dictionary(words, ranks).collect():
        # a word that is a piece itself is not merged
        whole = ranks.get(bytes(word))
        known[bytes(word).decode("utf-8")] = pack((whole,) if whole is not None else (ranks[bytes(p)] for p in pieces))
    return known


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
           size: int = DICTIONARY, decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids (binary: little-endian unsigned 32-bit integers).

    ``decoded`` adds what the ids decode to, in the same pass.
    """
    short_batches(docs.sparkSession)
    known = known_words(docs, ranks, pattern, text_col, size)
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks, pieces_of(ranks) if decoded else []))
    names = ["n_tokens", "ids", "decoded"] if decoded else ["n_tokens", "ids"]

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, own, pieces = shared.value
        cut, encoder = regex.compile(pattern), Encoder(common, own)
        ids_of, piece = encoder.__getitem__, pieces.__getitem__
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                rows = []
                for text in texts.iloc[at:at + ROWS]:
                    text = text or ""
                    words = cut.findall(text) if len(text) < LONG_TEXT else (m[0] for m in cut.finditer(text))
                    ids = b"".join(map(ids_of, words))
                    rows.append((len(ids) // 4, ids, b"".join(map(piece, unpack(ids)))) if decoded
                                else (len(ids) // 4, ids))
                yield pd.DataFrame(rows, columns=names)

    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    schema = "n_tokens long, ids binary" + ", decoded binary" * decoded
    struct = F.pandas_udf(coded, schema).asNondeterministic()(F.col(text_col).cast("string"))
    return docs.select(*others, struct.alias("_coded")).select(*others, "_coded.*")


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded (binary): the pieces of the ids one after another."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = shared.value.__getitem__
        for packed in batches:
            yield pd.Series([b"".join(map(piece, unpack(data))) for data in packed], dtype=object)

    others = [F.col(f"`{c}`") for c in rows.columns if c != "decoded"]
    return rows.select(*others, F.pandas_udf(bytes_of, "binary")(F.col(ids_col)).alias("decoded"))


def digests(rows: DataFrame) -> DataFrame:
    """ids and decoded replaced by ids_sha256 and decoded_sha256 (lower-case hex)."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in ("ids", "decoded")]
    return rows.select(*others, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
