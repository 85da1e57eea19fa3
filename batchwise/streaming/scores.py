"""M2, M4 and M6 as a stream: test records scored by a published model version, written by the file sink.

``publish`` writes a version of the models: one row per bucket with the weights of
all models and classes, and one row of scalars.  A stream of wire lines is decoded,
hashed and joined with these static tables; a record's cycle names the version that
scores it.  All models share one pass over the record's buckets.  There is no
``foreachBatch``: Spark's file sink logs the files of each micro-batch, so a replayed
micro-batch adds nothing, and readers see whole micro-batches only.

The sum over a record's buckets is a streaming aggregation.  Its event time is the
arrival, the time of the micro-batch as the checkpoint recorded it, with no delay: a
micro-batch's scores come out with the next one, or with the empty one that follows
when nothing else comes, and the state holds the records of one micro-batch.  Should
the driver's clock go back, Spark would drop records as late; ``run_scores`` raises then.

A line that arrives twice is scored once; damaged lines are left to the quarantine.
A record whose version was not published when the stream started is kept, without scores.
An unknown label gives a null ``actual``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phases import TEST, cycle, phase
from ..functions.text import DEFAULT_N_FEATURES
from ..operators.features import encode_labels, hashed_rows
from ..operators.joins import broadcast_if_bounded
from ..operators.scoring import Terms, argmax
from ..plans.tasks import Schedule, cleaned_emails
from ..sources.wire import explode_records, line_table
from ..store import write_table

# bytes of a bucket's row beside its weights, in the broadcast hash relation
KEY_BYTES = 48
# Weights up to this size are broadcast.  Each micro-batch sends them anew through the driver, so the limit is far
# below that of a join that runs once; larger weights stay where they are and the records' buckets go to them.
MAX_WEIGHTS_BYTES = 64 << 20
SCORES_SCHEMA = ("batch_no int, cycle int, line_no int, pos int, model string, version int, actual int, "
                 "predicted int, scores array<double>")
RECORD = ("batch_no", "line_no", "pos")


def _weight(model: str, label: int) -> str:
    return f"{model}_w{label}"


def publish(spark: SparkSession, path: str, version: int, models: Mapping[str, Terms], n_classes: int) -> None:
    """Writes (or writes again) version ``version`` of ``models`` under ``path``.

    The scalars come last: a version is there when they are.
    """
    parts = None
    for model, terms in models.items():
        part = terms.weights.select("bucket", F.lit(model).alias("model"), "label", "w")
        parts = part if parts is None else parts.unionByName(part)
    weights = parts.groupBy("bucket").agg(*[
        F.max(F.when((F.col("model") == model) & (F.col("label") == j), F.col("w"))).alias(_weight(model, j))
        for model in models for j in range(n_classes)])
    write_table(weights, f"{path}/weights/version={version}")
    rows = [(model, t.a, t.b, t.per_row, t.binary) for model, t in models.items()]
    scalars = spark.createDataFrame(rows, "model string, a array<double>, b array<double>, per_row string, binary boolean")
    write_table(scalars.coalesce(1), f"{path}/scalars/version={version}")


def scored(lines: DataFrame, path: str, classes: Sequence[str], schedule: Schedule = Schedule(),
           n_features: int = DEFAULT_N_FEATURES, limit: int = MAX_WEIGHTS_BYTES) -> DataFrame:
    """Test records of ``lines`` (batch or streaming) with the scores of every model, in SCORES_SCHEMA."""
    spark, k = lines.sparkSession, len(classes)
    # a few rows for each model and version
    published = spark.read.parquet(f"{path}/scalars").orderBy("version", "model").collect()
    versions = sorted({r["version"] for r in published})
    kinds = {r["model"]: (r["per_row"], r["binary"]) for r in published}
    columns = [_weight(m, j) for m in kinds for j in range(k)]
    weights = spark.read.parquet(f"{path}/weights").where(F.col("version").isin(versions))
    weights = weights.select("version", "bucket", *columns)
    # the weights are written: their rows are counted, not estimated
    weights = broadcast_if_bounded(weights, weights.count(), KEY_BYTES + 8 * len(columns), limit)

    whole = line_table(lines).where(F.col("problem").isNull()).dropDuplicates(["batch_no", "line_no"])
    test = explode_records(whole).where(phase("batch_no", schedule.n_train, schedule.n_total) == TEST)
    test = encode_labels(test, classes, "feature2", "label").withColumns({
        "record": F.struct(*RECORD), "version": cycle("batch_no", schedule.n_total)})
    rows = hashed_rows(cleaned_emails(test), "text", ("label", "version"), row_id="record", n_features=n_features)
    rows = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    keep = ("label", "version", "sum_x", "nnz")
    long = rows.select("arrived", "record", *keep, "norm", F.explode_outer("features").alias("f")).select(
        "arrived", "record", *keep, F.col("f.bucket").alias("bucket"), (F.col("f.cnt") / F.col("norm")).alias("x"))
    sums = [F.coalesce(F.sum(F.col(_weight(m, j)) * (F.lit(1.0) if kinds[m][1] else F.col("x"))), F.lit(0.0))
            .alias(_weight(m, j)) for m in kinds for j in range(k)]
    found = long.join(weights, ["version", "bucket"], "left").groupBy("arrived", "record").agg(
        *[F.first(c).alias(c) for c in keep], *sums)
    return _with_scores(found, published, kinds, k)


def _with_scores(found: DataFrame, published: list, kinds: Mapping[str, tuple[str, bool]], k: int) -> DataFrame:
    """One row per record and model: score = a + b * s + dot, as ``operators.scoring`` has it."""
    def of_version(model: str, term: str, j: int):
        """The scalar of the record's version; null where that version is not published."""
        out = F.lit(None).cast("double")
        for r in published:
            if r["model"] == model:
                out = F.when(F.col("version") == r["version"], F.lit(r[term][j])).otherwise(out)
        return out

    models = []
    for model, (per_row, _) in kinds.items():
        scores = [of_version(model, "a", j) + F.col(per_row).cast("double") * of_version(model, "b", j)
                  + F.col(_weight(model, j)) for j in range(k)]
        models.append(F.struct(F.lit(model).alias("model"),
                               F.when(scores[0].isNotNull(), F.array(*scores)).alias("scores")))
    out = found.select("record", "version", F.col("label").alias("actual"), F.explode(F.array(*models)).alias("m"))
    return out.select("record.batch_no", F.col("version").alias("cycle"), "record.line_no", "record.pos", "m.model",
                      "version", "actual", argmax(F.col("m.scores")).alias("predicted"), "m.scores")


def run_scores(lines: DataFrame, path: str, classes: Sequence[str], out: str, checkpoint: str,
               schedule: Schedule = Schedule(), n_features: int = DEFAULT_N_FEATURES) -> None:
    """Drains the stream ``lines`` into the parquet sink ``out``; a later call goes on from the checkpoint
    with the versions published by then."""
    query = scored(lines, path, classes, schedule, n_features).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if late:
        raise RuntimeError(f"{late} partial sums came too late: the driver's clock went back")


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the sink's completed micro-batches."""
    return spark.read.schema(SCORES_SCHEMA).parquet(out)
