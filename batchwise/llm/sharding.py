"""Operator 13, sharding: fixed virtual slots and a versioned map from slots to shards.

A record's id is hashed into one of SLOTS virtual slots, for good.  Bytes and
records are summed by slot; only these sums, at most SLOTS rows, reach the driver.
A map says which shard holds each slot.  Its first version deals the slots out by
their number; ``rebalance`` edits the newest version, moving or swapping single
slots between the fullest and the emptiest shard until their bytes are near equal,
and the edited map is stored as the next version.  Versions are tables in the shared
folder, so a reader may stay with the one it knows.  A record's place in its shard
is the number of records in the shard's slots before its own and its rank in its slot.

The law kept is ``bytes``: shards differ by at most TOLERANCE of their mean size, or
by no more than single slots allow (a slot holds at least one whole record).

Defined cases: a null text has no bytes and a null checksum; its record has the
size of its frame only.  Null ids are hashed by their size and checksum.  Rows that
repeat an id share a slot.  Fewer slots in use than shards leave shards empty.
An empty table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..store import materialize, write_table
from .ranks import ranked

SLOTS = 8192
FRAME = 8
TOLERANCE = 0.001


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows id, size, text_crc32, vslot."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + FRAME).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    number = F.when(F.col("id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("id"))
    return rows.withColumn("vslot", F.pmod(number, F.lit(slots)).cast("int"))


def slot_totals(records: DataFrame) -> DataFrame:
    """vslot, bytes, records: one row for each slot in use."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: the shard of each slot by the slot's number."""
    return [slot % shards for slot in range(slots)]


def rebalance(shard_of: Sequence[int], weights: Sequence[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map after edits; new shards (numbers not in the map yet) are empty at first.

    Each shard gives up slots, the largest first, while it stays above the mean; the
    given ones go to the emptiest shard, the largest first.  Then the fullest
    and the emptiest shard move a slot, or swap two, while that brings them
    closer; a shard that no edit can lighten is left as it is.
    """
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if weights[slot]:
            held[shard].append((weights[slot], slot))
    for own in held:
        own.sort()
    load = [sum(w for w, _ in own) for own in held]
    mean = sum(load) / max(1, shards)
    near = tolerance * mean

    def best_edit(full: int, empty: int) -> tuple[int, tuple[int, int] | None, tuple[int, int] | None]:
        """(what is left of the gap, entry to give, entry to take back)."""
        gap = load[full] - load[empty]
        found = (gap, None, None)
        at = bisect_left(held[full], (gap // 2, -1))
        for entry in held[full][max(0, at - 1):at + 1]:
            found = min(found, (abs(gap - 2 * entry[0]), entry, None), key=lambda f: f[0])
        if found[0] <= near:
            return found
        j = 0
        for entry in held[full]:
            # the entry to take back that leaves the least: half the gap lighter
            while j < len(held[empty]) and 2 * (entry[0] - held[empty][j][0]) > gap:
                j += 1
            for back in held[empty][max(0, j - 1):j + 1]:
                left = abs(gap - 2 * (entry[0] - back[0]))
                if left < found[0]:
                    found = (left, entry, back)
        return found

    def carry(entry: tuple[int, int], source: int, target: int) -> None:
        held[source].remove(entry)
        insort(held[target], entry)
        load[source] -= entry[0]
        load[target] += entry[0]
        shard_of[entry[1]] = target

    given = []
    for shard in range(shards):
        rest = load[shard]
        for entry in reversed(held[shard]):
            if rest - entry[0] >= mean:
                rest -= entry[0]
                given.append((entry, shard))
    emptiest = [(load[s] - sum(e[0] for e, home in given if home == s), s) for s in range(shards)]
    heapify(emptiest)
    for entry, home in sorted(given, reverse=True):
        least, shard = emptiest[0]
        heapreplace(emptiest, (least + entry[0], shard))
        if shard != home:
            carry(entry, home, shard)

    fixed: set[int] = set()
    while len(fixed) < shards:
        empty = min(range(shards), key=lambda s: (load[s], s))
        full = max((s for s in range(shards) if s not in fixed), key=lambda s: (load[s], -s))
        if load[full] - load[empty] <= near:
            break
        left, give, back = best_edit(full, empty)
        if give is None or left >= load[full] - load[empty]:
            fixed.add(full)
            continue
        carry(give, full, empty)
        if back:
            carry(back, empty, full)
        fixed.clear()
    return shard_of


def store_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int]) -> None:
    """Writes one version of a map: vslot, shard (as many rows as slots)."""
    rows = spark.createDataFrame(list(enumerate(shard_of)), "vslot int, shard int")
    write_table(rows.coalesce(1), f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def shard_records(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  slots: int = SLOTS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, vslot."""
    spark = docs.sparkSession
    records = materialize(records_of(docs, id_col, text_col, slots), "sharding-records")
    totals = {r["vslot"]: r for r in slot_totals(records).collect()}
    weights = [totals[s]["bytes"] if s in totals else 0 for s in range(slots)]
    path = scratch_path(spark, "sharding-map")
    store_map(spark, path, 1, first_map(slots, shards))
    newest = {r["vslot"]: r["shard"] for r in read_map(spark, path, 1).collect()}
    store_map(spark, path, 2, rebalance([newest[s] for s in range(slots)], weights, shards))

    # where each slot starts in its shard: as many rows as slots
    placed, starts = [0] * shards, []
    for r in sorted(read_map(spark, path, 2).collect()):
        starts.append((r["vslot"], r["shard"], placed[r["shard"]]))
        placed[r["shard"]] += totals[r["vslot"]]["records"] if r["vslot"] in totals else 0
    starts = spark.createDataFrame(starts, "vslot int, shard int, start long")
    rows = records.withColumn("_row", F.monotonically_increasing_id())
    rows = ranked(rows, ["vslot"], ["id", "text_crc32", "size", "_row"], "sharding-order")
    return rows.join(F.broadcast(starts), "vslot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
