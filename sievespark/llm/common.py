"""Reading and text helpers that several operators share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns of ``documents``; a null text is empty."""
    return with_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), *cols)


def with_text(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the columns that are used, so that extra ones can't clash; a null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *cols)


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def id_remainder_py(doc_id: int | None, modulus: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % modulus
