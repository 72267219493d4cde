"""From raw documents to a training mixture, each stage a Parquet table.

Stages: language ID (texts without a letter go; without any labelled row to learn
from, the others keep their ``lang`` as it is), near duplicates (five-word
shingles, Jaccard 0.8; the smallest id of each group stays), benchmark
decontamination (documents with a hit go), pseudonyms for personal data, and the
mix of sources (rows are repeated or left out by their source's rate).

Stages keep the columns of ``documents``; ``lang`` is filled in where it was null
and ``n_chars`` follows a changed text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm import decontamination, langid, mixing, pii, shingle_join
from twinproof.llm.tables import table
from twinproof.session import shared_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if model is None:  # nothing labelled to learn from: only texts without a letter go
        return langid.with_letters(docs)
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.without_near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars"))) if "n_chars" in docs.columns else done


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonyms),
    ("mix", mix),
]

# The language model and the shingle hashes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
