"""Staged corpus pipeline: quality rules, exact and near deduplication, secret masking, packing.

Every stage judges each row of its input by its own text, so rows that repeat an id, or are equal in all columns, are
told apart; nulls in any column, empty and very long texts and an empty table give what the stage's operator says of them. Stages
take documents with more columns than COLUMNS and read those alone, so names of others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from tidecube.llm.common import Scratch, delete_path, is_written, materialise, shared_dir
from tidecube.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The tables of the last stage on each input folder of an application; a stage's rows are stored when the next one begins.
_before: dict[tuple[str, str], Scratch] = {}


def _scratch(spark: SparkSession, sf_dir: str) -> Scratch:
    """Where this stage's tables are noted; those of the stage before it on the same input are deleted, and no others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _before:
        _before.pop(key).release()
    _before[key] = Scratch(spark)
    return _before[key]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language and source's robust ellipsoid; null and empty texts fail the base."""
    with _scratch(spark, sf_dir):
        return quality.drop_low_quality(docs.select(*COLUMNS))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, one with the smallest id; null and empty texts are equal."""
    with _scratch(spark, sf_dir):
        return exact_dedup.drop_exact_duplicates(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one with the smallest id; texts without words stay."""
    with _scratch(spark, sf_dir):
        return near_dedup.drop_near_duplicates(docs.select(*COLUMNS), width=5, percent=80)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text, and null texts keep theirs."""
    with _scratch(spark, sf_dir):
        masked = secret_scan.mask_secrets(docs.select(*COLUMNS))
        return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 1024; null and empty texts are the end token alone."""
    with _scratch(spark, sf_dir):
        return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secret_masking),
    ("best_fit_packing", sequence_packing),
]

#: Estimates by concentration steps, signatures and a tokenizer are not expressible in SQL; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def _stage_path(spark: SparkSession, run_id: str, name: str) -> str:
    return f"{shared_dir(spark)}/tidecube-run-{run_id}-{name}"


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Apply all stages to documents, each stage's rows written as Parquet and read again by the next.

    With a run_id, stage tables have names of their own in the shared folder: a run that was stopped goes on from its last
    whole table when it is started again with the same run_id on the same input, and forget() deletes them. Without one, a
    stage's table is deleted when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = _stage_path(spark, run_id, name) if run_id else None
        if path and is_written(spark, path):
            docs = spark.read.parquet(path)
        else:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", path)
    return STAGES[-1][1](spark, docs, sf_dir)


def forget(spark: SparkSession, run_id: str) -> None:
    """Delete the stage tables of a run, once its result is stored."""
    for name, _ in STAGES[:-1]:
        delete_path(spark, _stage_path(spark, run_id, name))
