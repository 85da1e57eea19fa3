"""Routing batches to train or test, and cycles, as expressions.

A cycle is ``n_total`` consecutive batches; the first ``n_train`` of each cycle
train the models, the rest are scored.  Models stay warm across cycles, as in
the reference; the ``cycle`` column keeps the metric series apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAIN = "train"
TEST = "test"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def position_in_cycle(batch_no: Column | str, n_total: int) -> Column:
    """0-based position of a batch inside its cycle."""
    return F.pmod(_col(batch_no) - 1, F.lit(n_total))


def phase(batch_no: Column | str, n_train: int, n_total: int) -> Column:
    """E5: 'train' for the first ``n_train`` batches of each cycle, else 'test'."""
    if not 0 < n_train <= n_total:
        raise ValueError("need 0 < n_train <= n_total")
    return F.when(position_in_cycle(batch_no, n_total) < n_train, F.lit(TRAIN)).otherwise(F.lit(TEST))


def cycle(batch_no: Column | str, n_total: int) -> Column:
    """1-based cycle number."""
    return (F.floor((_col(batch_no) - 1) / F.lit(n_total)) + 1).cast("int")
