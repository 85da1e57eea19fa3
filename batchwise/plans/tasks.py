"""Preparing a replay task: the email rows, numbered into batches, cleaned,
hashed, and written once as a row table partitioned by ``batch_no``.

The written row table is the hand-off point to every model: it cuts the
lineage (tokenising is the most expensive step and is done once), survives
lost executors, and lets per-batch jobs prune to one ``batch_no`` partition.
"""

from __future__ import annotations

import math

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_N_FEATURES, UNICODE_WHITESPACE, clean_columns, concat_text
from ..operators.features import class_values, dense_rows, encode_labels, hashed_rows, long_features
from ..sources.batches import assign_batches, batch_size_for, batch_table, with_schedule
from ..sources.tables import email_rows, embedding_rows, labelled_email_rows
from ..store import materialize

ROW_KEYS = ("batch_no", "cycle", "phase", "label")
SCORE_KEYS = ("batch_no", "cycle", "label", "sum_x", "sq_x", "nnz")


@dataclass(frozen=True)
class Schedule:
    """Replay schedule: ``n_batches`` equal batches in arrival order; each
    cycle has ``n_total`` batches of which the first ``n_train`` train."""

    n_batches: int = 8
    n_train: int = 6
    n_total: int = 8


@dataclass
class Prepared:
    rows: DataFrame                 # row table (row_id, batch_no, cycle, phase, label, features, ...)
    classes: list[str]              # sorted class list; label j = classes[j]
    n_features: int
    schedule: Schedule = field(default_factory=Schedule)
    n_rows: int | None = None       # rows numbered (known from batching; saves a distinct job)
    batch_size: int | None = None   # rows of a batch; by default n_rows / schedule.n_batches

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    def long(self, rows: DataFrame | None = None, keep: Sequence[str] = SCORE_KEYS) -> DataFrame:
        return long_features(self.rows if rows is None else rows, keep)

    def train_rows(self) -> DataFrame:
        return self.rows.where(F.col("phase") == "train")

    def test_rows(self) -> DataFrame:
        return self.rows.where(F.col("phase") == "test")

    def batches(self) -> list[int]:
        """Batch ordinals present, in order (arithmetic when the row count is known)."""
        if self.n_rows is not None:
            size = self.batch_size or batch_size_for(self.n_rows, self.schedule.n_batches)
            return list(range(1, math.ceil(self.n_rows / size) + 1)) if self.n_rows else []
        return [r[0] for r in self.rows.select("batch_no").distinct().orderBy("batch_no").collect()]

    def cycles(self) -> list[int]:
        """Cycle numbers that hold test batches (a handful of scalars)."""
        n_total, n_train = self.schedule.n_total, self.schedule.n_train
        return sorted({(b - 1) // n_total + 1 for b in self.batches() if (b - 1) % n_total >= n_train})


def schedule_table(emails: DataFrame, schedule: Schedule = Schedule(), row_id: str = "row_id",
                   n_rows: int | None = None) -> DataFrame:
    """S7 + E5 + E6, narrow: (row_id, ord, batch_no, phase, cycle)."""
    n = emails.count() if n_rows is None else n_rows
    narrow = batch_table(emails, row_id, size=batch_size_for(n, schedule.n_batches), row_id=row_id, ordinal="ord")
    return with_schedule(narrow, schedule.n_train, schedule.n_total)


def scheduled_emails(emails: DataFrame, schedule: Schedule = Schedule(),
                     classes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """S7 + E5 + E6 + T8: email rows with label, ord, batch_no, phase and cycle."""
    classes = classes if classes is not None else class_values(emails, "feature2")
    labelled = encode_labels(emails, classes, "feature2", "label")
    return labelled.join(schedule_table(labelled, schedule), "row_id"), classes


def cleaned_emails(batched: DataFrame, stopwords: Sequence[str] | None = None,
                   split_pattern: str = UNICODE_WHITESPACE) -> DataFrame:
    """T1 + T3 + T4: both text parts cleaned, then joined into ``text``."""
    cleaned = clean_columns(batched, ("feature1", "feature0"), stopwords, split_pattern)
    return cleaned.withColumn("text", concat_text("feature0", "feature1"))


def prepare_email_task(emails: DataFrame, schedule: Schedule = Schedule(),
                       n_features: int = DEFAULT_N_FEATURES, hash_name: str = "md5",
                       stopwords: Sequence[str] | None = None, split_pattern: str = UNICODE_WHITESPACE,
                       classes: list[str] | None = None, write: bool = True) -> Prepared:
    """Email rows (row_id, feature0, feature1, feature2) -> Prepared row table.

    The narrow schedule table is joined on row_id while the rows are still
    text (one shuffle); cleaning and hashing follow in the tasks that write the
    row table, so the feature arrays, some times as wide, are never shuffled.
    The wide rows are never copied for numbering.
    """
    classes = classes if classes is not None else class_values(emails, "feature2")
    labelled = encode_labels(emails, classes, "feature2", "label")
    n_rows = labelled.count()
    sched = schedule_table(labelled, schedule, n_rows=n_rows).drop("ord")
    batched = labelled.join(sched, "row_id")
    rows = hashed_rows(cleaned_emails(batched, stopwords, split_pattern), "text", ROW_KEYS,
                       n_features=n_features, hash_name=hash_name)
    if write:
        rows = materialize(rows, "rows", partition_by=("batch_no",))
    return Prepared(rows, classes, n_features, schedule, n_rows)


def language_task(spark: SparkSession, sf_dir: str, schedule: Schedule = Schedule(),
                  n_features: int = DEFAULT_N_FEATURES, label_mode: str = "binary", **kw) -> Prepared:
    """Main task: documents, label 'en' vs 'other' (or the language itself)."""
    return prepare_email_task(email_rows(spark, sf_dir, label_mode), schedule, n_features, **kw)


def labels_task(spark: SparkSession, sf_dir: str, target: str = "quality", schedule: Schedule = Schedule(),
                n_features: int = 4096, **kw) -> Prepared:
    """Second, unbalanced task: documents joined with labels."""
    return prepare_email_task(labelled_email_rows(spark, sf_dir, target), schedule, n_features, **kw)


def embedding_task(spark: SparkSession, sf_dir: str, schedule: Schedule = Schedule(), write: bool = True) -> Prepared:
    """Dense task: embeddings (64 dims) with their 0-9 labels, bucket = dimension."""
    emb = embedding_rows(spark, sf_dir)
    n_rows = emb.count()
    batched = with_schedule(assign_batches(emb, "row_id", size=batch_size_for(n_rows, schedule.n_batches)),
                            schedule.n_train, schedule.n_total)
    rows = dense_rows(batched, "vec", ROW_KEYS)  # label here is the given 0..9 int
    if write:
        rows = materialize(rows, "emb-rows", partition_by=("batch_no",))
    stats = rows.agg(F.max("nnz").alias("dims"), F.max("label").alias("top")).first()
    classes = [str(i) for i in range(int(stats["top"]) + 1)]
    return Prepared(rows, classes, int(stats["dims"]), schedule, n_rows)
