"""A corpus pipeline: stages of the corpus operators, each over all rows that the one before kept.

Quality rules, near-duplicates, benchmark passages, mixing, token output.  Every
stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm.op1_mixing import fit_mix, halved, label_domains, mixed
from voxelmill.llm.op2_token_output import token_output
from voxelmill.llm.op4_jaccard_join import deduplicated
from voxelmill.llm.op5_quality import accepted
from voxelmill.llm.op6_decontaminate import decontaminate
from voxelmill.llm.tables import BATCH_BYTES, read, written


def _session(spark: SparkSession) -> None:
    """What this application asks of its session, for the actions that its caller starts: small Arrow batches, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; rows with a null, empty or short text go, repeated rows are judged alike."""
    _session(spark)
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links, five-word shingles and a similarity of 0.8 or more; nulls and repeats as deduplicated() says."""
    _session(spark)
    return deduplicated(docs, 5, 80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; an empty benchmark keeps all, and so do null and empty texts; repeated rows share their fate."""
    _session(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that halve the tokens of the toxic domain and keep the others'; no rate is above 1; without labels all stay.

    Null and empty texts are judged by the domains' offsets; repeated rows are drawn alike, and rows without doc_id share one draw.
    """
    _session(spark)
    labelled = label_domains(read(spark, sf_dir, "labels"))
    return mixed(docs, fit_mix(docs, labelled, halved("toxic"), max_rate=1.0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written and read back, a row for each document; a null text is the end id alone, repeated rows count each, an empty table gives no rows."""
    _session(spark)
    return token_output(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("mixing", mixing), ("token output", tokens)]

#: Mixing and token output have no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
