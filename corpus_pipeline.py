"""Corpus pipeline: from raw documents to packed sequences of tokens.

Each stage reads what the one before it has written, works on all of it, and returns the
columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import decontamination, line_dedup, packing, simhash, toxicity
from signalspark.llm.common import checkpoint_folder, read_spread, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, doesn't reject."""
    model = toxicity.fitted(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without line runs that stand earlier in the corpus; ``n_chars``, where there
    is such a column, follows."""
    cleaned = line_dedup.remove_repeated_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return decontamination.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents; few words are kept, as the stages' workers
    are the same and keep what each stage has learnt."""
    return packing.pack(docs, packing.tokenizer_path(), kept_words=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has no dictionary compression, so the first stage can't be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared checkpoint folder.

    ``documents`` needs ``doc_id`` and ``text``; any other columns stay as they are up to the last
    stage. Null texts count as empty, rows that repeat and rows without an id are kept by the
    stages that can't tell them apart, and an empty table gives no pieces.
    """
    docs = read_spread(spark, sf_dir, "documents", "doc_id")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
