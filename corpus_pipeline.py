"""A training-data pipeline over ``documents``: toxic documents go, repeated chunks of lines go, of near-duplicates one stays, sources
are mixed to target weights, and the mix is tokenised."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import linededup, mixing, piece_bpe, queries, simhash, toxicity
from marlstone.llm.common import documents, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` brought up to date where a text was changed."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic. It learns from the labels that aren't held out and looks at texts alone."""
    model = toxicity.learn(docs, documents(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand elsewhere before. Copies of one line go in the next stage, as rows."""
    return _sized(linededup.without_repeats(docs, copies=False))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row of the smallest id, rows told apart by all their columns."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=4, distance=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, one document of a source cut to the words that are left."""
    return _sized(mixing.mixed(docs.select(*COLUMNS)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and what they decode to."""
    found = piece_bpe.encode(docs, queries.piece_model())
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: The classifier and the encoder are beyond SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each but the last written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    top = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
    return docs
