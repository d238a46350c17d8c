"""The dealt operators on the given tables, with SQL texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from avsync.llm import circulant_minhash, conversation_repair, decontamination, exact_dedup, hmm_score, mixing, ngram_join, quality, secret_scan, separator_scan, sharding, spelling, token_output
from avsync.llm.common import documents, table
from avsync.session import new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


ORACLE["op3_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, folder))


ORACLE["op4_mix_sources"] = mixing.SQL


@query
def op10_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder))


@query
def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_output(documents(spark, folder))


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(documents(spark, folder), table(spark, folder, "benchmark"))


ORACLE["op7_decontaminate"] = decontamination.SQL


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.fit(docs, quality.ratings_of(table(spark, folder, "labels")))
    return quality.grade_documents(docs, model)


@query
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, folder))


@query
def op1_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_score.score_texts(documents(spark, folder))


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return separator_scan.token_counts(docs, new_dir(spark, "flat"))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, folder))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, folder, "conversations"))


ORACLE["op11_conversation_repair"] = conversation_repair.SQL


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


ORACLE["op13_spelling_variants"] = spelling.SQL


@query
def op12_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return circulant_minhash.near_duplicates(documents(spark, folder))


ORACLE["op12_circulant_minhash"] = circulant_minhash.SQL
