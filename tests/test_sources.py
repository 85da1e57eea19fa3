"""S4-S7, S9, T8/T9, E5/E6 on hand fixtures."""

import json

from pyspark.sql import functions as F

from batchwise.functions.phases import cycle, phase
from batchwise.operators.features import class_values, encode_labels, label_dictionary
from batchwise.sources.batches import assign_batches, batch_row_count, with_ordinals
from batchwise.sources.wire import decode_lines, decode_reference_lines, encode_wire_lines, quarantine


def _rec(i):
    return {"feature0": f"s{i}", "feature1": f"body {i}", "feature2": "spam" if i % 2 else "ham"}


def test_two_lines_one_microbatch_all_decoded(spark):
    lines = [json.dumps({"batch_no": 1, "line_no": j, "n_lines": 2,
                         "records": {str(i): _rec(3 * j + i) for i in range(3)}}) for j in range(2)]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = decode_lines(df)
    assert rows.count() == 6
    first = rows.where("line_no = 0").orderBy("pos").select("feature0").collect()
    assert [r[0] for r in first] == ["s0", "s1", "s2"]


def test_bad_json_is_quarantined(spark):
    df = spark.createDataFrame([("{oops",)], "value string")
    assert decode_lines(df).count() == 0
    assert quarantine(df).count() == 1


def test_reference_bare_format(spark):
    line = json.dumps({"0": _rec(0), "1": _rec(1)})
    df = spark.createDataFrame([(line,)], "value string")
    got = decode_reference_lines(df).orderBy("pos").collect()
    assert [r["feature2"] for r in got] == ["ham", "spam"]


def test_wire_roundtrip_bounded_lines(spark):
    rows = spark.createDataFrame([(i, (i - 1) // 5 + 1, i, f"s{i}", f"t{i}", "ham") for i in range(1, 13)],
                                 "row_id long, batch_no int, ord long, feature0 string, feature1 string, feature2 string")
    lines = encode_wire_lines(rows, line_size=2)
    assert lines.groupBy("batch_no").count().orderBy("batch_no").collect()[0]["count"] == 3
    back = decode_lines(lines)
    assert back.count() == 12
    assert sorted(r[0] for r in back.select("feature0").collect()) == sorted(f"s{i}" for i in range(1, 13))


def test_labels_sorted_dictionary(spark):
    df = spark.createDataFrame([("spam",), ("ham",), ("spam",)], "feature2 string")
    classes = class_values(df)
    assert classes == ["ham", "spam"]
    assert [r["label"] for r in encode_labels(df, classes).collect()] == [1, 0, 1]
    assert {r["feature2"]: r["label"] for r in label_dictionary(df).collect()} == {"ham": 0, "spam": 1}


def test_one_class_batch_uses_fixed_dictionary(spark):
    df = spark.createDataFrame([("spam",), ("spam",)], "feature2 string")
    assert [r["label"] for r in encode_labels(df, ["ham", "spam"]).collect()] == [1, 1]


def test_phases_and_cycles(spark):
    df = spark.range(1, 6).select(F.col("id").cast("int").alias("batch_no"))
    got = df.select(phase("batch_no", 3, 4).alias("p"), cycle("batch_no", 4).alias("c")).collect()
    assert [r["p"] for r in got] == ["train", "train", "train", "test", "train"]
    assert [r["c"] for r in got] == [1, 1, 1, 1, 2]


def test_ordinals_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").alias("v"))
    got = with_ordinals(df.repartition(5), "k", row_id="v").orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(1, 1001))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_ordinals_with_a_hot_order_value(spark):
    # one order value holds a third of all rows: ordinals stay a permutation of 1..N
    n = 900
    df = spark.range(0, n).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("v"))
    got = with_ordinals(df, "k", row_id="v").collect()
    assert sorted(r["ord"] for r in got) == list(range(1, n + 1))
    by_ord = sorted(got, key=lambda r: r["ord"])
    assert [r["k"] for r in by_ord] == sorted(r["k"] for r in got)


def test_assign_batches_sizes(spark):
    df = spark.range(0, 20).select(F.col("id").alias("row_id"))
    got = batch_row_count(assign_batches(df, "row_id", n_batches=8)).orderBy("batch_no").collect()
    assert [r["n_rows"] for r in got] == [3, 3, 3, 3, 3, 3, 2]


def test_lines_of_a_batch_are_made_in_few_tasks(spark):
    """The files of a batch follow its records, not the number of tasks."""
    import glob

    from batchwise.session import scratch_path
    from batchwise.streaming.learner import write_stream_files

    rows = spark.range(0, 4000, 1, 8).select(
        (F.col("id") + 1).alias("ord"), (F.floor(F.col("id") / 1000) + 1).cast("int").alias("batch_no"),
        F.lit("a").alias("feature0"), F.lit("b").alias("feature1"), F.lit("c").alias("feature2"))
    path = scratch_path(spark, "t-few-files")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_stream_files(encode_wire_lines(rows, line_size=10), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(glob.glob(f"{path.removeprefix('file:')}/batch=*/part-*")) == 4
    assert decode_lines(spark.read.option("recursiveFileLookup", "true").text(path)).count() == 4000
