"""Operator 7: the ranks are a row of a table, not a literal in every plan."""

from pyspark.sql import functions as F

from batchwise.llm.byte_bpe import dictionary, fold, known_words, pack, read_ranks
from batchwise.llm.parameters import BPE_FILE, pattern, vocabulary


def test_the_plan_does_not_carry_the_ranks(spark):
    ranks = read_ranks(vocabulary(BPE_FILE))
    texts = [" unbelievable", "Straße", "x", "zzzzqqqq", "1234567", "\t\t\n", "😀é", " the"]
    words = spark.createDataFrame([(w,) for w in texts], "w string").select(F.col("w").cast("binary").alias("word"))
    found = dictionary(words, ranks)
    assert len(found._jdf.queryExecution().toString()) < 200_000        # 50,000 ranks take over a million
    # a word that has a rank is merged here too, where its pairs lead to it
    own = {bytes(w): [ranks[bytes(p)] for p in pieces] for w, pieces in found.collect()}
    assert own.keys() == {w.encode() for w in texts}
    for word, ids in own.items():
        if word not in ranks:
            assert tuple(ids) == fold(word, ranks)


def test_known_words_equal_the_fold(spark):
    ranks = read_ranks(vocabulary(BPE_FILE))
    docs = spark.createDataFrame([(" ".join(f"w{i} unbelievable{i % 7} Straße" for i in range(300)),), (None,), ("",)] * 2,
                                 "text string")
    known = known_words(docs, ranks, pattern(), "text", 200)
    assert len(known) == 200
    assert all(ids == pack(fold(word.encode(), ranks)) for word, ids in known.items())
