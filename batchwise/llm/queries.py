"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .byte_bpe import digests, encode, read_ranks
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .merkle import verify
from .mixing import mix_sources
from .parameters import BPE_FILE, LISTED_DOMAINS, SHARDS, URL_RULES, pattern, vocabulary
from .quality_rules import quality_rules
from .rule_ensemble import classify_quality
from .sharding import shard_records
from .simhash import simhash_dedup
from .token_counts import count_tokens
from .toxicity_fm import score_toxicity
from .url_filter import judge_urls
from .whitening import whiten

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_rules", O.quality_rules_sql)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept")


@register("op2_rule_ensemble")
def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_toxicity_fm")
def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_exact_dedup", O.exact_dedup_sql)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@register("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


@register("op6_line_dedup", O.line_dedup_sql)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_exact", "n_near", "emptied", "text")


@register("op6_line_dedup_whole")
def op6_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repeats of every line with a word, and near lines up to one edit in 20 words (at least one)."""
    return line_dedup(table(spark, sf_dir, "documents"), exact_words=1, edit_every=20).select(
        "doc_id", "n_lines", "n_exact", "n_near", "emptied", "text")


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(vocabulary(BPE_FILE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, ranks, pattern(), decoded=True)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_ranks(vocabulary(BPE_FILE)))


@register("op9_mix_sources", O.mix_sources_sql)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@register("op10_url_filter", O.url_filter_sql)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return judge_urls(table(spark, sf_dir, "pages"), listed, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@register("op12_merkle_manifest", O.merkle_sql)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 is divisible by 3 are seen with their text's A-Z lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return verify(table(spark, sf_dir, "documents"), seen={"text": F.when(hit, lowered).otherwise(F.col("text"))})


@register("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), SHARDS)
