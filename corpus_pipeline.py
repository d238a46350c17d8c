"""A corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all documents the stage before kept. All
but the last return the columns of documents; n_chars follows the text. Stages are written
as Parquet in the shared folder and read again, so a lost executor costs one task and a
stopped run can go on from the last stage written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avsync.llm import decontamination, mixing, ngram_join, quality, token_output
from avsync.llm.common import table
from avsync.session import new_dir, tune


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose chance of the highest grade is one half or more."""
    model = quality.fit(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id."""
    tune(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; a document of nothing else goes."""
    clean = decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark"), drop_emptied=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their targets."""
    tune(spark)
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and reads it back: doc_id, start, n_tokens, ids_crc32 of each copy."""
    tune(spark)
    return token_output.token_output(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: no stage but mixing can be said in SQL; tests hold the others against plain loops
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = new_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
