"""From raw documents to pieces: language, near copies, benchmark passages, personal data, tokens.

Each stage reads what the stage before wrote as Parquet, and keeps the columns of documents, up to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, langid, pieces, pii, simhash
from loomtext.llm.common import spill, table

#: A document whose best language has less than this mean probability is rejected, like one without a letter.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; the model learns from the labelled documents that aren't held out. Without any label, those with a letter stay."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    if not model:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with entities named by kind and disclosing terms removed."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, and whether they decode to the text."""
    found = pieces.encode(docs.select("doc_id", "lang", "source", "text"), decoded="_decoded")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("_decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: Trained models, fingerprints and sub-word pieces are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
