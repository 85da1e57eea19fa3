"""The growing label dictionary: ids stay, replays change nothing, batch after batch equals one aggregate."""

from pyspark.sql import functions as F

from batchwise.operators.labels import dictionary_of_batches, known_labels, learn_labels
from batchwise.session import scratch_path

ROWS = [(1, "spam"), (1, "ham"), (1, None), (2, "ham"), (3, "zebra"), (3, "alert"), (3, "spam"), (5, "bulk"), (5, "")]


def bag(df):
    return sorted(map(tuple, df.select("name", "label", "version").collect()))


def test_labels_of_later_batches_get_the_next_ids(spark):
    rows = spark.createDataFrame(ROWS, "batch_no int, feature2 string")
    want = [("", 4, 5), ("alert", 2, 3), ("bulk", 5, 5), ("ham", 0, 1), ("spam", 1, 1), ("zebra", 3, 3)]
    assert bag(dictionary_of_batches(rows)) == want
    path = scratch_path(spark, "t-labels")
    for batch in (1, 2, 3, 2, 3, 4, 5, 5):  # a restart brings batches again
        learn_labels(rows.where(F.col("batch_no") == batch), path, batch)
    assert bag(known_labels(spark, path)) == want
    assert bag(known_labels(spark, path, 3)) == [("ham", 0, 1), ("spam", 1, 1)]


def test_no_labels(spark):
    rows = spark.createDataFrame([(1, None)], "batch_no int, feature2 string")
    assert dictionary_of_batches(rows).collect() == []
    path = scratch_path(spark, "t-no-labels")
    learn_labels(rows, path, 1)
    assert known_labels(spark, path).collect() == []
