"""
driver's tables in full, plus their DuckDB oracle SQL.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal the oracle's.  Float outputs are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import concat_text, tokenize
from .operators.evaluate import (binary_metrics, compare_models, confusion, dense_confusion, metric_history,
                                 multiclass_accuracy, summary)
from .operators.features import (assemble_vectors, class_list, class_values, hashing_tf_vectors, label_dictionary,
                                 long_features)
from .operators.labels import dictionary_of_batches
from .operators.naive_bayes import NBState, batch_statistics, mnb_predict
from .operators.stoplist import strip_listed_words, token_rows, word_counts
from .operators.vocabulary import count_vectors, holdout_split, idf, vocabulary
from .operators.scoring import explode_scores
from .plans import oracle as O
from .plans.classify import (BNB, CLASSIFIERS, KMEANS, MNB, classifier_predictions, linear_metrics, linear_replay,
                             model_versions, nb_metrics, nb_predictions, nb_state_through)
from .plans.asof import asof_metrics
from .plans.cluster import (kmeans_aligned_metrics, kmeans_blocks_assignments, kmeans_euclidean_report, kmeans_euclidean_samples,
                            kmeans_raw_metrics, kmeans_replay, kmeans_train_report)
from .plans.sweep import sweep_classifier_metrics, sweep_cycle_metrics, sweep_mnb_metrics
from .plans.tasks import (Schedule, cleaned_emails, embedding_task, labels_task, language_task, schedule_table,
                          scheduled_emails)
from .session import scratch_path
from .sources.batches import batch_row_count, batch_size_for, batch_table
from .sources.tables import email_rows, read_table
from .sources.wire import decode_lines, encode_bare_lines, encode_wire_lines, quarantine
from .store import materialize
from .streaming.counts import run_counts, state_of
from .streaming.learner import StreamLearner, read_stream, run_stream, write_stream_files
from .streaming.scores import publish, read_scores, run_scores
from .streaming.slices import heartbeat, run_slices, stamped, with_late
from .session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in _SQL.items()}


# --------------------------------------------------------------------------- naive Bayes

@register("flagship_mnb_metrics", lambda: O.nb_metrics_sql(MNB))
def flagship_mnb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 -> E5 -> T1, T3-T7 -> T8 -> M1 -> M2 -> E1-E4 on the language task."""
    ensure_checkpoint_dir(spark)
    return nb_metrics(language_task(spark, sf_dir), MNB)


@register("bnb_metrics", lambda: O.nb_metrics_sql(BNB))
def bnb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 -> M4 -> E1-E4."""
    ensure_checkpoint_dir(spark)
    return nb_metrics(language_task(spark, sf_dir), BNB)


@register("mnb_scores", lambda: O.nb_scores_sql(MNB))
def mnb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 scores per (test row, class)."""
    ensure_checkpoint_dir(spark)
    pred = nb_predictions(language_task(spark, sf_dir), MNB)
    return explode_scores(pred, ("row_id", "batch_no"))


@register("bnb_scores", lambda: O.nb_scores_sql(BNB))
def bnb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 scores per (test row, class)."""
    ensure_checkpoint_dir(spark)
    pred = nb_predictions(language_task(spark, sf_dir), BNB)
    return explode_scores(pred, ("row_id", "batch_no"))


# --------------------------------------------------------------------------- linear model

@register("linear_metrics", lambda: O.linear_metrics_sql())
def linear_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 -> M6 -> E1-E4: one Pegasos step per training batch (chain)."""
    ensure_checkpoint_dir(spark)
    return linear_metrics(language_task(spark, sf_dir))


@register("linear_scores", lambda: O.linear_scores_sql())
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 decision values per test row."""
    ensure_checkpoint_dir(spark)
    _, pred = linear_replay(language_task(spark, sf_dir))
    return pred.select("row_id", "batch_no", "predicted", F.round("score", 6).alias("score"))


@register("linear_mixing_metrics")
def linear_mixing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 (a pass over the rows of each batch, in parts whose weights are averaged) -> M6 -> E1-E4."""
    ensure_checkpoint_dir(spark)
    return linear_metrics(language_task(spark, sf_dir), mixing=True)


# --------------------------------------------------------------------------- k-means

@register("kmeans_metrics", lambda: O.kmeans_metrics_sql(k=2))
def kmeans_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 (first-k init) -> M8 per training batch -> M9 on test -> E1-E4, raw ids."""
    ensure_checkpoint_dir(spark)
    run = kmeans_replay(language_task(spark, sf_dir), k=2, with_silhouette=False)
    return kmeans_raw_metrics(run)


@register("kmeans_train_report", lambda: O.kmeans_train_report_sql(k=2))
def kmeans_train_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 inertia and M11 mean silhouette per training batch (hashed text, k = 2)."""
    ensure_checkpoint_dir(spark)
    return kmeans_train_report(kmeans_replay(language_task(spark, sf_dir), k=2))


@register("silhouette_samples", lambda: O.silhouette_samples_sql(k=2))
def silhouette_samples_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row silhouette in every training batch."""
    ensure_checkpoint_dir(spark)
    run = kmeans_replay(language_task(spark, sf_dir), k=2)
    return run.silhouettes.select("row_id", "batch_no", "cluster", F.round("s", 6).alias("s"))


@register("kmeans_embeddings_report", lambda: O.kmeans_train_report_sql(k=10, dense=True))
def kmeans_embeddings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M10, M11 on the dense embeddings, k = 10."""
    ensure_checkpoint_dir(spark)
    return kmeans_train_report(kmeans_replay(embedding_task(spark, sf_dir), k=10))


@register("kmeans_euclidean_report", lambda: O.kmeans_euclidean_report_sql(k=2))
def kmeans_euclidean_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 inertia and M11 mean silhouette by Euclidean distance per training batch (hashed text, k = 2)."""
    ensure_checkpoint_dir(spark)
    return kmeans_euclidean_report(language_task(spark, sf_dir), k=2)


@register("kmeans_euclidean_embeddings", lambda: O.euclidean_samples_sql(k=10, dense=True))
def kmeans_euclidean_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 by Euclidean distance, per row, on the dense embeddings, k = 10."""
    ensure_checkpoint_dir(spark)
    samples = kmeans_euclidean_samples(embedding_task(spark, sf_dir), k=10)[1]
    return samples.select("row_id", "batch_no", "cluster", F.round("s", 6).alias("s"))


@register("kmeans_aligned_metrics", lambda: O.kmeans_aligned_sql(k=10))
def kmeans_aligned_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority-label alignment of clusters on the embeddings, accuracy per test batch."""
    ensure_checkpoint_dir(spark)
    return kmeans_aligned_metrics(kmeans_replay(embedding_task(spark, sf_dir), k=10, with_silhouette=False))


@register("kmeans_text_aligned_metrics", lambda: O.kmeans_aligned_sql(k=2, dense=False))
def kmeans_text_aligned_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 on the hashed text: majority-label alignment, accuracy per test batch."""
    ensure_checkpoint_dir(spark)
    return kmeans_aligned_metrics(kmeans_replay(language_task(spark, sf_dir), k=2, with_silhouette=False))


# --------------------------------------------------------------------------- sources, text, features

def _language_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow: row_id, ord, batch_no, phase, cycle."""
    ensure_checkpoint_dir(spark)
    return schedule_table(email_rows(spark, sf_dir).select("row_id"))


def _language_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows straight from the scan: text operators need no batch number."""
    return cleaned_emails(email_rows(spark, sf_dir))


@register("batch_assign", lambda: O.batch_assign_sql())
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + E5 + E6: batch ordinal, phase and cycle per row (8 batches, 6 train)."""
    return _language_schedule(spark, sf_dir).select("row_id", "batch_no", "cycle", "phase")


@register("batch_row_count", lambda: O.batch_row_count_sql())
def batch_row_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per batch."""
    return batch_row_count(_language_schedule(spark, sf_dir))


@register("clean_text", lambda: O.clean_text_sql())
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T2 + T3 + T4: noise tokens stripped from both parts, parts joined."""
    return _language_cleaned(spark, sf_dir).select("row_id", "feature0", "feature1", "text")


@register("clean_rare_words", lambda: O.clean_rare_words_sql())
def clean_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4 with a list that grows with the data: every word that occurs once in all texts goes."""
    ensure_checkpoint_dir(spark)
    emails, parts = email_rows(spark, sf_dir), ("feature0", "feature1")
    rare = word_counts(token_rows(emails, parts)).where(F.col("n") == 1).select(F.col("key").alias("word"))
    cleaned = strip_listed_words(emails, parts, rare)
    return cleaned.select("row_id", *parts, concat_text("feature0", "feature1").alias("text"))


@register("token_counts", lambda: O.token_counts_sql())
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: tokens and distinct tokens per row after cleaning."""
    toks = tokenize(F.col("text"))
    return _language_cleaned(spark, sf_dir).select(
        "row_id", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_distinct"))


@register("hashed_features", lambda: O.hashed_features_sql())
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 + T7: (row, bucket) counts and L2-scaled values, md5 buckets mod 2^20."""
    ensure_checkpoint_dir(spark)
    rows = language_task(spark, sf_dir).rows
    return rows.select("row_id", "norm", F.explode("features").alias("f")).select(
        "row_id", F.col("f.bucket").alias("bucket"), F.col("f.cnt").alias("cnt"),
        F.round(F.col("f.cnt") / F.col("norm"), 6).alias("x"))


@register("label_dictionary", lambda: O.label_dictionary_sql())
def label_dictionary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct label -> 0..k-1 (four-language labels)."""
    return label_dictionary(email_rows(spark, sf_dir, "lang"), "feature2")


@register("class_list", lambda: O.class_list_sql())
def class_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels present (four-language labels)."""
    return class_list(email_rows(spark, sf_dir, "lang"), "feature2")


@register("feature_vectors", lambda: O.feature_vectors_sql())
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vector per row; the arrays as their indices in text form and the sum of the values."""
    ensure_checkpoint_dir(spark)
    vectors = assemble_vectors(language_task(spark, sf_dir).rows, keep=("batch_no", "label"))
    return vectors.select(
        "row_id", "batch_no", "label", "size",
        F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("indices"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("value_sum"))


@register("hashing_tf_vectors")
def hashing_tf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLlib HashingTF + Normalizer twin of T6/T7 (Murmur3 buckets; rows-only)."""
    ensure_checkpoint_dir(spark)
    return hashing_tf_vectors(_language_tokens(spark, sf_dir), "tokens")


# --------------------------------------------------------------------------- model state

@register("nb_state", lambda: O.nb_state_sql())
def nb_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M3: per (class, bucket) sum of x and document count over the training batches."""
    prep = language_task(spark, sf_dir)
    state = nb_state_through(prep)
    return state.stats.select("label", "bucket", F.round("sum_x", 6).alias("sum_x"), "n_present")


@register("nb_class_docs", lambda: O.nb_class_docs_sql())
def nb_class_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: documents per class over the training batches."""
    prep = language_task(spark, sf_dir)
    return nb_state_through(prep).docs


# --------------------------------------------------------------------------- reports

def _all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_metrics(classifier_predictions(language_task(spark, sf_dir)), by=("cycle", "batch_no", "model"))


@register("confusion", lambda: O.confusion_sql())
def confusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per (test batch, model, actual, predicted) for the three classifiers."""
    ensure_checkpoint_dir(spark)
    return confusion(classifier_predictions(language_task(spark, sf_dir)), by=("cycle", "batch_no", "model"))


@register("confusion_matrix", lambda: O.dense_confusion_sql())
def confusion_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class x class matrix of each test batch and model, zeros included."""
    ensure_checkpoint_dir(spark)
    prep = language_task(spark, sf_dir)
    return dense_confusion(classifier_predictions(prep), prep.n_classes, by=("cycle", "batch_no", "model"))


@register("label_growth", lambda: O.label_growth_sql())
def label_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and source as label, 200 batches; labels first seen in a later batch get the next ids."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat_ws("/", "lang", "source").alias("feature2"))
    docs = docs.join(batch_table(docs, "row_id", n_batches=200), "row_id")
    return dictionary_of_batches(docs)


@register("two_cycle_metrics", lambda: O.all_metrics_sql(8, 3, 4))
def two_cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 batches as two cycles of 4 (3 train); the models of cycle 1 stay warm in cycle 2.

    Naive Bayes takes all cycles in one job, the linear model its steps in order.
    """
    ensure_checkpoint_dir(spark)
    prep = language_task(spark, sf_dir, Schedule(8, 3, 4))
    bayes = asof_metrics(prep.rows.withColumn("plan", F.lit(0)), prep.n_classes, prep.n_features).drop("plan")
    return bayes.unionByName(linear_metrics(prep))


@register("metric_history", lambda: O.metric_history_sql())
def metric_history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and metric, the ordered series (idx from 1) of test-batch values."""
    ensure_checkpoint_dir(spark)
    return metric_history(_all_metrics(spark, sf_dir))


@register("compare_models", lambda: O.compare_models_sql())
def compare_models_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the three classifiers side by side per test batch."""
    ensure_checkpoint_dir(spark)
    return compare_models(_all_metrics(spark, sf_dir), CLASSIFIERS, "accuracy")


@register("metrics_summary", lambda: O.metrics_summary_sql())
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean / min / max of accuracy, precision, recall per model."""
    ensure_checkpoint_dir(spark)
    return summary(_all_metrics(spark, sf_dir))


# --------------------------------------------------------------------------- wire format and streaming

def _wire_lines(spark: SparkSession, sf_dir: str, line_size: int = 500):
    batched, classes = scheduled_emails(email_rows(spark, sf_dir))
    return encode_wire_lines(batched, line_size=line_size, ordinal="ord"), classes


@register("wire_roundtrip", lambda: O.wire_roundtrip_sql())
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S5: documents -> JSON wire lines (<= 500 records each) -> decoded rows."""
    ensure_checkpoint_dir(spark)
    lines, _ = _wire_lines(spark, sf_dir)
    return decode_lines(lines).select("batch_no", "feature0", "feature1", "feature2")


@register("wire_quarantine", lambda: O.wire_quarantine_sql())
def wire_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire lines plus raw web pages offered as lines; the pages fail the
    fixed schema and are quarantined, the wire lines decode."""
    ensure_checkpoint_dir(spark)
    lines, _ = _wire_lines(spark, sf_dir)
    pages = read_table(spark, sf_dir, "pages").select(F.col("html").alias("value"))
    offered = lines.select("value").unionByName(pages)
    good = decode_lines(offered).groupBy().agg(F.countDistinct("batch_no", "line_no").alias("n_lines"),
                                               F.count(F.lit(1)).alias("n_records"))
    bad = quarantine(offered).groupBy().agg(F.count(F.lit(1)).alias("n_lines"))
    return good.select(F.lit("decoded").alias("status"), "n_lines", "n_records").unionByName(
        bad.select(F.lit("quarantined").alias("status"), "n_lines", F.lit(0).cast("long").alias("n_records")))


@register("stream_metrics", lambda: O.stream_metrics_sql())
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire lines as a file stream, learned with foreachBatch
    (availableNow trigger); metrics read back from the metrics table.  Equals
    the replay of the same batches (streaming = batch)."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream")
    lines, classes = _wire_lines(spark, sf_dir)
    write_stream_files(lines, f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", classes)
    run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow")
    return learner.metrics().select("cycle", "batch_no", "model", "tp", "fp", "fn", "tn", "accuracy", "precision",
                                    "recall")


@register("stream_empty_batches", lambda: O.nb_metrics_sql(MNB))
def stream_empty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty files before, between and after the full ones; their micro-batches change nothing."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-empty")
    lines, classes = _wire_lines(spark, sf_dir)
    lines = materialize(lines, "stream-empty-lines")
    learner = StreamLearner(spark, f"{root}/state", classes, models=(MNB,))
    for part, full in enumerate((None, "batch_no <= 4", None, "batch_no > 4", None)):
        if full:
            write_stream_files(lines.where(full), f"{root}/in/{part}")
        else:
            lines.select("value").limit(0).coalesce(1).write.text(f"{root}/in/{part}")
        run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow")
    return learner.metrics().select("cycle", "batch_no", "model", "tp", "fp", "fn", "tn", "accuracy", "precision",
                                    "recall")


@register("stream_nb_state", lambda: O.nb_state_sql())
def stream_nb_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M3 in Spark's state store: the counts of a file stream over several micro-batches equal ``nb_state``."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-counts")
    lines, classes = _wire_lines(spark, sf_dir)
    write_stream_files(lines, f"{root}/in")
    run_counts(read_stream(spark, f"{root}/in", 3), classes, f"{root}/counts", f"{root}/checkpoint")
    stats = state_of(spark, f"{root}/counts", len(classes)).stats
    return stats.select("label", "bucket", F.round("sum_x", 6).alias("sum_x"), "n_present")


@register("stream_scores", lambda: O.all_metrics_sql(8, 3, 4))
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M4 + M6 as a stream without foreachBatch: the records of a file stream joined with the model
    version of their cycle (8 batches, two cycles), kept by the file sink; metrics from the sink."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-scores")
    schedule = Schedule(8, 3, 4)
    emails = email_rows(spark, sf_dir)
    prep = language_task(spark, sf_dir, schedule)
    for version, models in model_versions(prep):
        publish(spark, f"{root}/models", version, models, prep.n_classes)
    batched, _ = scheduled_emails(emails, schedule, prep.classes)
    write_stream_files(encode_wire_lines(batched, ordinal="ord"), f"{root}/in")
    run_scores(read_stream(spark, f"{root}/in", 3), f"{root}/models", prep.classes, f"{root}/scores",
               f"{root}/checkpoint", schedule)
    return binary_metrics(read_scores(spark, f"{root}/scores"), by=("cycle", "batch_no", "model"))


# the first record of the stream is sent at SLICE_BASE (unix seconds), each further one SLICE_STEP milliseconds later
SLICE_BASE, SLICE_STEP, SLICE_LINE = 1_704_067_200, 100, 5


@register("stream_slices", lambda: O.stream_slices_sql(SLICE_BASE, SLICE_STEP, SLICE_LINE))
def stream_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 in event time: lines of five records, one record each 100 ms, counted by slice of 5 s with a watermark.

    The lines arrive in four parts.  Of each three one is held back until the next part (late where its slice is
    closed by then), one is sent again with the next part, and one of the odd batches is cut in half.  A heartbeat
    closes the last slices."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-slices")
    emails = email_rows(spark, sf_dir)
    size = batch_size_for(emails.count(), 8)
    lines, _ = _wire_lines(spark, sf_dir, SLICE_LINE)
    first = (F.col("batch_no") - 1) * size + F.col("line_no") * SLICE_LINE
    sent = F.timestamp_millis(F.lit(SLICE_BASE * 1000) + first * SLICE_STEP)
    lines = stamped(lines, sent).withColumns({"_third": F.col("line_no") % 3, "_part": F.expr("div(batch_no - 1, 2)")})
    cut = (F.col("_third") == 2) & (F.col("batch_no") % 2 == 1)
    parts = F.when(F.col("_third") == 1, F.array(F.col("_part") + 1)).when(
        F.col("_third") == 0, F.array(F.col("_part"), F.col("_part") + 1)).otherwise(F.array("_part"))
    lines = materialize(lines.select(
        F.when(cut, F.expr("left(value, div(length(value), 2))")).otherwise(F.col("value")).alias("value"),
        F.explode(parts).alias("part")), "slice-lines", ("part",))
    beat = spark.range(1).select(heartbeat(F.timestamp_seconds(F.lit(SLICE_BASE + 10) + size * 8 * SLICE_STEP // 1000)))
    for part in range(5):
        lines.where(F.col("part") == part).select("value").write.text(f"{root}/in/{part}")
        run_slices(read_stream(spark, f"{root}/in", None), root)
    beat.write.text(f"{root}/in/5")
    run_slices(read_stream(spark, f"{root}/in", None), root)
    return with_late(spark, root).withColumn("slice_start", F.unix_seconds("slice_start"))


@register("stream_quarantine", lambda: O.stream_quarantine_sql())
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 in the stream: the second line of every batch is cut in half and raw pages arrive as
    lines.  Per batch: lines seen, bad ones, records learned; batch 0: the lines that name none."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-quarantine")
    lines, classes = _wire_lines(spark, sf_dir, line_size=20)
    cut = F.when(F.col("line_no") == 1, F.expr("left(value, div(length(value), 2))")).otherwise(F.col("value"))
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit(0).alias("batch_no"), F.regexp_replace("html", r"\s+", " ").alias("value"))
    write_stream_files(lines.select("batch_no", cut.alias("value")).unionByName(pages), f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", classes, models=(MNB,))
    run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow", files_per_batch=None)
    unnamed = learner.quarantined().where("batch_no = 0").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(F.lit(1)).alias("n_bad"),
        F.lit(0).cast("long").alias("n_records"))
    return learner.batch_log().drop("n_lost").unionByName(unnamed)


@register("stream_bare_lines", lambda: O.nb_metrics_sql(MNB, n_train=1, n_total=2, batch_size=500))
def stream_bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 in the stream on the reference's own format: a line is a batch of 500 records, every
    second batch is scored; multinomial NB metrics per scored batch and cycle."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-bare")
    emails = email_rows(spark, sf_dir)
    batched = emails.join(batch_table(emails, "row_id", size=500, ordinal="ord"), "row_id")
    write_stream_files(encode_bare_lines(batched, 500), f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", class_values(emails), Schedule(n_train=1, n_total=2),
                            models=(MNB,), wire="bare")
    run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow", files_per_batch=None)
    return learner.metrics().select("cycle", "batch_no", "model", "tp", "fp", "fn", "tn", "accuracy", "precision",
                                    "recall")


# --------------------------------------------------------------------------- batch-size sweep

@register("batch_size_sweep", lambda: O.sweep_mnb_sql())
def batch_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial NB under the reference's four batch schedules, one job."""
    ensure_checkpoint_dir(spark)
    return sweep_mnb_metrics(email_rows(spark, sf_dir))


# (batch size, n_train, n_total): the published batch sizes, in cycles short enough for small tables
SIZE_PLANS = ((100, 2, 3), (500, 1, 2), (1000, 1, 2), (1500, 1, 2))


@register("batch_size_cycles", lambda: O.sweep_cycles_sql(SIZE_PLANS))
def batch_size_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both naive Bayes models at batch sizes of 100, 500, 1000 and 1500 rows over all cycles, one job."""
    ensure_checkpoint_dir(spark)
    return sweep_cycle_metrics(email_rows(spark, sf_dir), SIZE_PLANS)


# (batches of the run, those that train): the batch size is that share of the rows
SWEEP_SCHEDULES = ((4, 3), (8, 6), (12, 9))


@register("batch_size_sweep_classifiers", lambda: O.sweep_classifiers_sql(SWEEP_SCHEDULES))
def batch_size_sweep_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three classifiers at three batch sizes, over features hashed once."""
    ensure_checkpoint_dir(spark)
    emails = email_rows(spark, sf_dir)
    n_rows = emails.count()
    sizes = [(batch_size_for(n_rows, n), n_train, n) for n, n_train in SWEEP_SCHEDULES]
    return sweep_classifier_metrics(emails, sizes)


# --------------------------------------------------------------------------- X1-X3

def _language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return _language_cleaned(spark, sf_dir).withColumn("tokens", tokenize(F.col("text")))


@register("holdout_mnb_metrics", lambda: O.holdout_mnb_sql())
def holdout_mnb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial NB on a repeatable 67/33 hash split of all rows, metrics per batch."""
    ensure_checkpoint_dir(spark)
    prep = language_task(spark, sf_dir)
    rows = holdout_split(prep.rows, 0.33)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    stats, docs = batch_statistics(long_features(train, ("label",)), train)
    state = NBState(stats, docs, prep.n_classes, prep.n_features)
    keep = ("batch_no", "label", "sum_x")
    pred = mnb_predict(state, long_features(test, keep), keep).select(
        "batch_no", F.col("label").alias("actual"), "predicted", F.lit(MNB).alias("model"))
    return binary_metrics(pred, by=("batch_no", "model"))


@register("vocabulary", lambda: O.vocabulary_sql())
def vocabulary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token by document frequency, indexed."""
    return vocabulary(_language_tokens(spark, sf_dir))


@register("count_vectors", lambda: O.count_vectors_sql())
def count_vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row term counts over that vocabulary."""
    # the vocabulary and the counts read the same tokens: cleaned and split once
    toks = materialize(_language_tokens(spark, sf_dir).select("row_id", "tokens"), "tokens")
    return count_vectors(toks, vocabulary(toks))


@register("idf", lambda: O.idf_sql())
def idf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse document frequency of every token."""
    out = idf(_language_tokens(spark, sf_dir))
    return out.select("token", "df", F.round("idf", 6).alias("idf"))


# --------------------------------------------------------------------------- second and third tasks

@register("quality_bnb_metrics", lambda: O.nb_metrics_sql(BNB, task="quality", n_features=4096))
def quality_bnb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced task (labels.quality, documents inner join labels), Bernoulli NB, 4096 buckets."""
    ensure_checkpoint_dir(spark)
    return nb_metrics(labels_task(spark, sf_dir, "quality"), BNB)


@register("toxic_mnb_metrics", lambda: O.nb_metrics_sql(MNB, task="toxic", n_features=4096))
def toxic_mnb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced task (labels.toxic), multinomial NB, 4096 buckets."""
    ensure_checkpoint_dir(spark)
    return nb_metrics(labels_task(spark, sf_dir, "toxic"), MNB)


@register("lang4_nb_accuracy", lambda: O.lang4_accuracy_sql())
def lang4_nb_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-class variant (label = language): accuracy of both NB models per test batch."""
    ensure_checkpoint_dir(spark)
    prep = language_task(spark, sf_dir, label_mode="lang")
    pred = nb_predictions(prep, (MNB, BNB))
    return multiclass_accuracy(pred, by=("cycle", "batch_no", "model"))


@register("kmeans_plusplus_report", lambda: O.kmeans_train_report_sql(k=10, dense=True, init="kmeans++"))
def kmeans_plusplus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 (k-means++ by a seeded exponential race) -> M8, M10, M11 on the embeddings, k = 10."""
    ensure_checkpoint_dir(spark)
    return kmeans_train_report(kmeans_replay(embedding_task(spark, sf_dir), k=10, init="kmeans++"))


@register("kmeans_reseeded_report", lambda: O.kmeans_train_report_sql(k=24, dense=True, reseed=0.2))
def kmeans_reseeded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 with re-seeding: clusters below a fifth of the largest are drawn anew from the batch, embeddings, k = 24."""
    ensure_checkpoint_dir(spark)
    return kmeans_train_report(kmeans_replay(embedding_task(spark, sf_dir), k=24, reseed_ratio=0.2))


@register("kmeans_parallel_report", lambda: O.kmeans_train_report_sql(k=10, dense=True, init="kmeans||"))
def kmeans_parallel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 (k-means||: five rounds whatever k) -> M8, M10, M11 on the embeddings, k = 10."""
    ensure_checkpoint_dir(spark)
    return kmeans_train_report(kmeans_replay(embedding_task(spark, sf_dir), k=10, init="kmeans||"))


@register("kmeans_many_clusters", lambda: O.kmeans_assignments_sql(k=200, n_batches=2))
def kmeans_many_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7-M9 with centers in tables, blocks of rows against blocks of centers: k = 200, two batches of all embeddings."""
    ensure_checkpoint_dir(spark)
    prep = embedding_task(spark, sf_dir, Schedule(2, 2, 2))
    return kmeans_blocks_assignments(prep, 200, row_block=128, center_block=64).withColumn(
        "d2", F.round("d2", 6) + F.lit(0.0))


@register("stream_kmeans_metrics", lambda: O.kmeans_metrics_sql(k=2))
def stream_kmeans_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S3 for the clustering run: the file stream learned by mini-batch
    k-means inside foreachBatch (centers versioned per batch); raw-id metrics
    on the test batches.  Equals the replay's kmeans_metrics."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-kmeans")
    lines, classes = _wire_lines(spark, sf_dir)
    write_stream_files(lines, f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", classes, models=(KMEANS,), k=2)
    run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow")
    return learner.metrics().select("cycle", "batch_no", "model", "tp", "fp", "fn", "tn", "accuracy", "precision",
                                    "recall")


@register("stream_kmeans_report", lambda: O.kmeans_train_report_sql(k=2))
def stream_kmeans_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + M11 per training batch, produced by the streaming k-means learner."""
    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-kmeans-report")
    lines, classes = _wire_lines(spark, sf_dir)
    write_stream_files(lines, f"{root}/in")
    learner = StreamLearner(spark, f"{root}/state", classes, models=(KMEANS,), k=2)
    run_stream(spark, f"{root}/in", learner, f"{root}/checkpoint", trigger="availableNow")
    return learner.cluster_report().select("batch_no", "n_rows", "inertia", "silhouette")
