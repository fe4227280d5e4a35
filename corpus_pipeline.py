"""From documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import hashlib
import json
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import completed, scratch, shared_dir, table
from millrace.llm.language_id import keep_identified
from millrace.llm.mixing import mix_documents
from millrace.llm.packing import pack_documents
from millrace.llm.secrets import redact
from millrace.llm.similarity import keep_dissimilar
from millrace.session import spread

#: What decides the stages' rows, besides their input.
SETTINGS = {"width": 5, "similarity": 0.8, "tokenizer": "byte_bpe_50k.json", "capacity": 2048}
#: SQL can't express the learned stages and the packing; tests/llm hold them against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) the document of the smallest id stays."""
    return keep_dissimilar(docs, width=SETTINGS["width"], similarity=SETTINGS["similarity"])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; their documents stay."""
    return _measured(redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a row for each time that a document is taken."""
    return _measured(mix_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of each document."""
    return pack_documents(docs, public_tokenizers.path(SETTINGS["tokenizer"]), capacity=SETTINGS["capacity"])


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("best_fit_packing", packing)]


def state_of(docs: DataFrame, sf_dir: str) -> str:
    """A digest of what a run's rows follow from: the folder, the files with their sizes and times, the stages and settings."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = docs.select(file.alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    told = [sf_dir, files.n, files.h, files.s, [name for name, _ in STAGES], SETTINGS]
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again.

    A run of a name finds the stages that an earlier one of that name, over the same files and with the same settings, has
    completed, and goes on after them; without a name every run is a new one. What the operators stage on their way is
    removed once a stage is written; what others have staged stays.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-" + (f"{name}-{state_of(docs, sf_dir)}" if name else uuid.uuid4().hex)
    docs = spread(docs)
    for place, (stage_name, stage) in enumerate(STAGES):
        path = f"{root}/{place}-{stage_name}"
        if not completed(spark, path):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
