"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes each result as Parquet below
``spark.checkpoint.dir`` and hands the reread copy to the next stage. All but the
last return the columns of ``documents``. Rows with a null id are kept and treated
like others; a null text has no language and is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm import decontam, fuzzy_lines, language, packing, simhash
from sievespark.sources.stage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those with no letter are rejected."""
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.learn_languages(docs), *COLUMNS)
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line nearly or exactly; emptied ones go."""
    return fuzzy_lines.keep_first_lines(docs.select(*COLUMNS)).select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_first_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.keep_clean(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents cut and packed into windows of up to 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

# Learned languages, hashed bands and token ids have no counterpart in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
