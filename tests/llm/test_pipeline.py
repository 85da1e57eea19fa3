"""The pipeline on a small folder of tables, against the plain Python versions one after another."""

import hashlib
from array import array

import pytest

import corpus_pipeline as C
from batchwise.llm import parameters as P
from batchwise.llm.byte_bpe import read_ranks
from tests.llm import brute
from tests.llm.test_operators import ROWS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in ROWS[:20]], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def expected(rows):
    import tiktoken

    rows = [r for r in rows if not brute.base(r[1])[-1]]
    lines = brute.dedup_lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], lines[r[0], r[1]][0], r[2], r[3]) for r in rows if not lines[r[0], r[1]][-1]]
    groups = brute.simhash([(r[0], r[1]) for r in rows])
    stay = {}
    for r, (_, first) in zip(rows, groups):
        if r[0] == first:
            stay.setdefault(first, r)
    rows = list(stay.values())
    counts = brute.copies([(r[0], r[3]) for r in rows])
    ranks = read_ranks(P.vocabulary(P.BPE_FILE))
    library = tiktoken.Encoding("own", pat_str=P.pattern(), mergeable_ranks=ranks, special_tokens={})
    out = []
    for (i, t, _, source), n in zip(rows, counts):
        ids = library.encode_ordinary(t)
        out += [(i, source, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                 hashlib.sha256(t.encode()).hexdigest())] * n
    return out


def test_pipeline_equals_plain_python(spark, folder):
    got = C.run(spark, folder).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = expected(ROWS)
    assert len(want) > 5
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    assert C.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0
