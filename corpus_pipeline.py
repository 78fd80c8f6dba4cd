"""A training corpus from documents: five stages, each a table in and a table out.

``run`` writes each stage's rows as Parquet into the session's checkpoint folder and reads them again for the next,
so a stage that fails or loses executors starts from files. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm.common import checkpoint, few
from pagemill.llm.decontaminate import benchmark_hits
from pagemill.llm.jaccard import jaccard_groups
from pagemill.llm.language import UNKNOWN, identify, learn
from pagemill.llm.pieces import encode_pieces
from pagemill.llm.secrets import redact

TOKENIZER = "piece_bpe_32k.model"
#: A near-duplicate shares five-word shingles with a similarity of 80 of 100.
SHINGLE_WORDS, SIMILARITY = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: rejected are null texts, texts without a letter, and texts of no learned n-gram."""
    found = identify(docs, learn(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Documents without words are groups of their own. Rows that share a doc_id (null is one, too) stay if one of them is
    the first of its group, and of those that also share the text one row stays.
    """
    groups = jaccard_groups(docs, SHINGLE_WORDS, SIMILARITY)
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    ids = checkpoint(groups.groupBy(F.col("doc_id").alias("id")).agg(first, F.count("*").alias("rows")))
    gone = few(checkpoint(ids.where("not stays").select("id")))
    rest = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")
    repeated = ids.where("stays and rows > 1").select("id")
    if repeated.isEmpty():
        return rest
    repeated = few(checkpoint(repeated))
    same = rest["doc_id"].eqNullSafe(repeated["id"])
    return rest.join(repeated, same, "left_anti").union(rest.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_hits(docs, items).where(F.size("hit_words") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    encoded = encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]

#: Filters that are learned, and the ids of a tokenizer, are beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpoint(spark.range(0))  # sets the folder
    folder = f"{sc.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
