"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the
rows are written as Parquet in the folder that the cluster shares, so a lost executor costs one stage.
A stage's folder is removed when the next one has been written.

Edge cases.  Null and empty texts, and texts without a letter, go in the language stage.  Very long texts
are read whole in every stage.  Rows with a null doc_id are compared with all others as near copies, and
neither mark passages nor lose any.  Rows that share a doc_id are judged each by its own text; of rows that
agree in both one stays.  Of near copies the smallest doc_id stays, ties cannot occur between rows that
differ.  Columns beyond those of documents are carried along whatever their names, as far as the packing,
whose rows are pieces.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelforge.llm import jaccard, langid, packing, pii, substring
from voxelforge.llm.common import shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.keep_known(docs, docs.where("lang is not null").select("lang", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return jaccard.keep_one(docs, 5, 80, 100)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a smaller document has go."""
    return _sized(substring.dedupe_texts(docs, 13))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind."""
    return _sized(pii.mask_pii(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, in sequences of 2048."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]

#: The stages' decisions (trained prototypes, tokenisation) have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs
