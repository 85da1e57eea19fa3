"""Operator 8, token counts: greedy longest-match lengths by an automaton, without building pieces.

The vocabulary is a trie.  Every node has a failure link and the number of
tokens popped on the way: from a node whose string cannot be extended by the
next byte, the greedy longest matches of its string are popped and the link
leads to the node of what is left.  So each byte of a word is read once, and its
token count is a sum of precomputed numbers.

A word (a run without ASCII white space) is read with one leading space, as the
vocabulary's word-initial pieces have it.  The vocabulary is a parameter; it
must hold all 256 single bytes, so that every word has a tokenisation.

Defined cases: a null or blank text has no words and no tokens.  Repeated rows
are counted alike; an empty table gives an empty result.  Only id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# Distinct words whose counts a task keeps at hand before it starts anew.
MEMO = 300_000
SCHEMA = "n_words long, n_tokens long"


@dataclass(frozen=True)
class Automaton:
    """``goto`` maps node * 256 + byte to a node; ``link`` and ``popped`` are per node; node 0 is the root."""

    goto: dict[int, int]
    link: list[int]
    popped: list[int]

    def count(self, data: bytes) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        node = tokens = 0
        for byte in data:
            while (after := goto.get(node << 8 | byte)) is None:
                tokens += popped[node]
                node = link[node]
            node = after
        while node:
            tokens += popped[node]
            node = link[node]
        return tokens


def build(pieces: Iterable[bytes]) -> Automaton:
    goto: dict[int, int] = {}
    final, parent = [False], [(0, 0)]
    for piece in pieces:
        node = 0
        for byte in piece:
            after = goto.get(node << 8 | byte)
            if after is None:
                after = goto[node << 8 | byte] = len(final)
                final.append(False)
                parent.append((node, byte))
            node = after
        final[node] = node != 0
    if not all(byte in goto and final[goto[byte]] for byte in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    link, popped = [0] * len(final), [0] * len(final)
    # shorter strings first: a link always leads to a shorter one
    depth = [0] * len(final)
    for v in range(1, len(final)):
        depth[v] = depth[parent[v][0]] + 1
    for v in sorted(range(1, len(final)), key=depth.__getitem__):
        u, byte = parent[v]
        if final[v]:
            link[v], popped[v] = 0, 1
            continue
        z, n = link[u], popped[u]
        while (after := goto.get(z << 8 | byte)) is None:
            z, n = link[z], n + popped[z]
        link[v], popped[v] = after, n
    return Automaton(goto, link, popped)


def count_tokens(docs: DataFrame, pieces: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_tokens."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build(pieces))

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count, memo = shared.value.count, {}
        for texts in batches:
            rows = []
            for data in texts:
                words = (data or b"").split()  # bytes: ASCII white space only
                total = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        n = count(b" " + w)
                        if len(w) < 64:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[w] = n
                    total += n
                rows.append((len(words), total))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    data = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).alias(id_col), F.pandas_udf(counts, SCHEMA).asNondeterministic()(data).alias("_c")).select(id_col, "_c.*")
