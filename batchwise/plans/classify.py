"""Replay runs for the classifiers: train on the train batches, score the
test batches, report metrics per test batch and model.

Naive Bayes state is additive, so a whole cycle of training batches is one
aggregate; models stay warm across cycles (test batches of cycle c are scored
with everything trained in cycles 1..c), as in the reference.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import binary_metrics
from ..operators.linear import (DEFAULT_LAMBDA, LinearState, linear_init, linear_predict, linear_terms,
                                linear_update)
from ..operators.linear_mixing import linear_mix_update
from ..operators.naive_bayes import (DEFAULT_ALPHA, NBState, batch_statistics, bnb_predict, bnb_terms, class_scalars,
                                     mnb_predict, mnb_terms, nb_update)
from ..operators.scoring import Terms
from ..store import materialize
from .tasks import SCORE_KEYS, Prepared

MNB = "multinomial_nb"
BNB = "bernoulli_nb"
LINEAR = "linear_sgd"
KMEANS = "kmeans"
CLASSIFIERS = (MNB, LINEAR, BNB)

_PREDICTORS = {MNB: mnb_predict, BNB: bnb_predict}

NB_PRED_SCHEMA = ("row_id bigint, batch_no int, cycle int, actual int, predicted int, scores array<double>, "
                  "model string")
LINEAR_PRED_SCHEMA = "row_id bigint, batch_no int, cycle int, actual int, predicted int, score double, model string"


def union_all(parts: list[DataFrame], spark, empty_schema: str) -> DataFrame:
    """Union of per-batch parts; a typed empty frame when a schedule has no such batch."""
    if not parts:
        return spark.createDataFrame([], empty_schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nb_state_through(prep: Prepared, cycle_no: int | None = None) -> NBState:
    """NB state from all training rows of cycles <= cycle_no (all when None)."""
    train = prep.train_rows()
    if cycle_no is not None:
        train = train.where(F.col("cycle") <= cycle_no)
    stats, docs = batch_statistics(prep.long(train, ("label",)), train)
    # the state is small (<= k * n_features rows): write it once, every later
    # use (class scalars, scoring joins) reads the table instead of re-aggregating
    return NBState(materialize(stats, "nb-stats"), materialize(docs, "nb-docs"), prep.n_classes, prep.n_features)


def nb_states(prep: Prepared) -> Iterator[tuple[int, NBState]]:
    """(cycle, state after its training batches) for every cycle with test batches.

    The state is carried: each cycle adds its own training rows to the state
    before it and is written once, so no training row is aggregated twice.
    """
    state, done = None, 0
    for c in prep.cycles():
        train = prep.train_rows().where((F.col("cycle") > done) & (F.col("cycle") <= c))
        new = nb_update(state, prep.long(train, ("label",)), train, prep.n_classes, prep.n_features)
        state = NBState(materialize(new.stats, "nb-stats"), materialize(new.docs, "nb-docs"),
                        prep.n_classes, prep.n_features)
        done = c
        yield c, state


def nb_predictions(prep: Prepared, models: str | Sequence[str] = MNB, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """(row_id, batch_no, cycle, actual, predicted, scores, model) for every test row and model.

    The models share one state and its class scalars.
    """
    parts = []
    for c, state in nb_states(prep):
        test = prep.test_rows().where(F.col("cycle") == c)
        scalars = class_scalars(state, alpha)
        for model in (models,) if isinstance(models, str) else models:
            scored = _PREDICTORS[model](state, prep.long(test, SCORE_KEYS), SCORE_KEYS, alpha, scalars=scalars)
            parts.append(scored.select("row_id", "batch_no", "cycle", F.col("label").alias("actual"), "predicted",
                                       "scores", F.lit(model).alias("model")))
    return union_all(parts, prep.rows.sparkSession, NB_PRED_SCHEMA)


def nb_metrics(prep: Prepared, models: str | Sequence[str] = MNB, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Metrics per (cycle, batch_no, model) over the test batches."""
    return binary_metrics(nb_predictions(prep, models, alpha), by=("cycle", "batch_no", "model"))


def classifier_predictions(prep: Prepared, lam: float = DEFAULT_LAMBDA) -> DataFrame:
    """(batch_no, cycle, model, actual, predicted) of the three classifiers for every test row."""
    cols = ("batch_no", "cycle", "model", "actual", "predicted")
    return nb_predictions(prep, (MNB, BNB)).select(*cols).unionByName(linear_replay(prep, lam)[1].select(*cols))


def batch_numbers(prep: Prepared) -> list[int]:
    """Batch ordinals present, in order (scalars; the row table is partitioned by them)."""
    return prep.batches()


def linear_replay(prep: Prepared, lam: float = DEFAULT_LAMBDA, mixing: bool = False) -> tuple[LinearState, DataFrame]:
    """M5 + M6 over the replay: one step per training batch in order (``mixing``: a pass
    over its rows, in parts); each test batch is scored with the weights trained on every
    earlier training batch."""
    sched = prep.schedule
    size = -(-prep.n_rows // sched.n_batches) if mixing else 0
    state = linear_init(prep.rows.sparkSession, prep.n_features, lam)
    tested: list[tuple[LinearState, list[int]]] = []  # test batches in a row share their weights
    for b in batch_numbers(prep):
        if (b - 1) % sched.n_total < sched.n_train:
            batch = prep.rows.where(F.col("batch_no") == b)
            state = linear_mix_update(state, batch, size) if mixing else linear_update(state, batch)
        elif tested and tested[-1][0] is state:
            tested[-1][1].append(b)
        else:
            tested.append((state, [b]))
    parts = []
    for own, batches in tested:
        scored = linear_predict(own, prep.rows.where(F.col("batch_no").isin(batches)), ("batch_no", "cycle", "label"))
        parts.append(scored.select("row_id", "batch_no", "cycle", F.col("label").alias("actual"), "predicted",
                                   "score", F.lit(LINEAR).alias("model")))
    return state, union_all(parts, prep.rows.sparkSession, LINEAR_PRED_SCHEMA)


def linear_metrics(prep: Prepared, lam: float = DEFAULT_LAMBDA, mixing: bool = False) -> DataFrame:
    return binary_metrics(linear_replay(prep, lam, mixing)[1], by=("cycle", "batch_no", "model"))


def model_versions(prep: Prepared, lam: float = DEFAULT_LAMBDA, alpha: float = DEFAULT_ALPHA) -> Iterator[
        tuple[int, dict[str, Terms]]]:
    """(cycle, the three classifiers as terms) with what they know when the cycle's test batches come."""
    sched, linear, done = prep.schedule, linear_init(prep.rows.sparkSession, prep.n_features, lam), 0
    for c, state in nb_states(prep):
        for b in batch_numbers(prep):
            if done < b <= c * sched.n_total and (b - 1) % sched.n_total < sched.n_train:
                linear, done = linear_update(linear, prep.rows.where(F.col("batch_no") == b)), b
        scalars = class_scalars(state, alpha)
        yield c, {MNB: mnb_terms(state, alpha, scalars), BNB: bnb_terms(state, alpha, scalars),
                  LINEAR: linear_terms(linear)}
