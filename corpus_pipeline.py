"""A corpus pipeline of five stages over ``documents``: language, near duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
``docs``; all but the last return the columns of ``documents``. Stages read no other table than what they are given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspend.llm import langid, mixing, ngram_join, packing, pii
from larkspend.llm._store import shared_folder

#: A language is rejected as unclear below this pooled probability.
LEAST_SCORE = 0.4
#: Near duplicates: words in a shingle, and the Jaccard similarity in percent from which documents are linked.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80

#: Rows of whole texts that move between Spark and Python at once; Spark's default of 10,000 holds too much of a corpus
#: in an executor's memory outside its heap.
BATCH_ROWS = 1000

#: No SQL can express the network, the span classifier or the dynamic program; tests compare with brute force.
ORACLE_SQL = None


BATCH_OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Spark reads the option when a stage's result is written, after the stage has returned; ``run`` sets it back."""
    spark.conf.set(BATCH_OPTION, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; a missing ``lang`` is filled with it."""
    _small_batches(spark)
    found = langid.predict(docs, *langid.fit(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; every row takes part, also where rows share a
    doc_id or have none."""
    _small_batches(spark)
    return ngram_join.without_repeats(docs, SHINGLE_WORDS, LEAST_PERCENT, 100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    _small_batches(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each repeat."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in windows."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, written in the folder that executors share."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_OPTION, None)
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    finally:
        spark.conf.unset(BATCH_OPTION) if before is None else spark.conf.set(BATCH_OPTION, before)
    return docs
