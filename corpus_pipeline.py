"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared checkpoint folder and read again as the next stage's
documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwise.llm.byte_bpe import encode, read_ranks
from batchwise.llm.line_dedup import line_dedup
from batchwise.llm.mixing import mix_sources
from batchwise.llm.parameters import BPE_FILE, pattern, vocabulary
from batchwise.llm.quality_rules import keep_good
from batchwise.llm.simhash import keep_one_of_each
from batchwise.store import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the cutoffs are calibrated on the labels of these documents."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines alike to an earlier one go, and documents of which no word is left."""
    rows = line_dedup(docs).where("not emptied").withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated towards the sources' target weights and shuffled."""
    return mix_sources(docs).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to."""
    ranks = read_ranks(vocabulary(BPE_FILE))
    rows = encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern(), decoded=True)
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix),
    ("byte_bpe", encode_stage),
]

# SimHash components and BPE merges are not for SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
