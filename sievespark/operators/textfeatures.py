"""Features of strings: hashed fingerprints, vocabularies, token pools, descriptors.

Features stay in long, sparse form (key, position, value) as long as possible:
a text becomes rows that are counted within its task before anything is
shuffled. Dense lists are built only where a model needs them.
"""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    explode_words, filled, hash_number, inline_computed, ratio, tokens, value_counts, word_counts,
)
from .keys import build_dictionary

# Fingerprint width, neighbourhood radius, value for unusable input.
FINGERPRINT_BITS = 2048
FINGERPRINT_RADIUS = 2
INVALID = -1
VECTOR_SIZE = 300


def grams(words: Column, size: int) -> Column:
    """Runs of ``size`` consecutive words."""
    joined = F.transform(
        words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, size)])
    )
    return F.slice(joined, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))


def hashed_grams(df: DataFrame, key: str, text: str, bits: int, radius: int, out: str) -> DataFrame:
    """Buckets of all word runs of length 1 to radius + 1 per text, with repeats.

    Words become a column first: inside the lambdas they are looked up by position.
    """
    words = df.select(key, tokens(text).alias("_w"))
    runs = F.concat(*[grams(F.col("_w"), s) for s in range(1, radius + 2)])
    return words.select(
        key, F.transform(runs, lambda g: F.pmod(hash_number(F.md5(g)), F.lit(bits)).cast("int")).alias(out))


def bucket_counts(df: DataFrame, key: str, text: str, bits: int, radius: int) -> DataFrame:
    """Per text, an array of (bucket, n); counted within the row."""
    hashed = hashed_grams(df, key, text, bits, radius, "_g").select(key, F.sort_array("_g").alias("_b"))
    return hashed.select(key, value_counts(F.col("_b"), "bucket", "n").alias("counts"))


def fingerprint(
    df: DataFrame, key: str, text: str, bits: int = FINGERPRINT_BITS, radius: int = FINGERPRINT_RADIUS
) -> DataFrame:
    """Hashed counts of word runs, as (key, bucket, n); one text per key, nothing is shuffled."""
    return inline_computed(bucket_counts(df, key, text, bits, radius), "counts", key, required="bucket")


def fingerprint_dense(df: DataFrame, key: str, text: str, bits: int = FINGERPRINT_BITS,
                      radius: int = FINGERPRINT_RADIUS) -> DataFrame:
    """Presence bits followed by counts; a list of -1 for a text without words."""
    counted = bucket_counts(df, key, text, bits, radius)
    counts = filled("counts", bits, "bucket", "n", F.lit(0).cast("bigint"))
    dense = counted.select(key, F.when(F.size("counts") > 0, counts.cast("array<int>")).alias("_c"))
    present = F.transform("_c", lambda n: (n > 0).cast("int"))
    unusable = F.array_repeat(F.lit(INVALID), 2 * bits)
    return dense.select(key, F.coalesce(F.concat(present, F.col("_c")), unusable).alias("fingerprint"))


def bit_sets(df: DataFrame, key: str, text: str, bits: int = FINGERPRINT_BITS, radius: int = FINGERPRINT_RADIUS) -> DataFrame:
    """The set bits of each text's fingerprint, at most its width; empty without words."""
    return hashed_grams(df, key, text, bits, radius, "_g").select(key, F.array_distinct("_g").alias("bits"))


def run_sets(df: DataFrame, key: str, text: str, radius: int = FINGERPRINT_RADIUS) -> DataFrame:
    """The distinct hashed word runs of each text as 64-bit numbers: sets for comparing texts with each other."""
    words = df.select(key, tokens(text).alias("_w"))
    n = F.size("_w")

    def runs(size: int) -> Column:
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)]))

    return words.select(key, F.array_distinct(F.concat(*[runs(s) for s in range(1, radius + 2)])).alias("bits"))


def vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """Distinct words with dense ids in word order."""
    words = explode_words(df, text, name="value")
    if min_count > 1:
        words = words.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    return build_dictionary(words.select("value"))


def token_pools(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Pooled one-hot encoding in long form: mean, max and sum per known word.

    Words are counted per text before the dictionary join, so a word in every
    text meets its dictionary row once per text; lengths count all words.
    """
    per = word_counts(df, key, text, "value", "sum", keep_length="_len")
    return per.join(vocab, "value").select(
        key, "idx", (F.col("sum") / F.col("_len")).alias("mean"), F.lit(1).alias("max"), "sum")


def token_pools_dense(df: DataFrame, key: str, text: str, vocab: DataFrame, width: int) -> DataFrame:
    """Mean, max and sum of the one-hot encoding over a vocabulary of ``width`` words in one list; -1 without a known word."""
    pools = token_pools(df, key, text, vocab)
    per = pools.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "idx", "mean", F.col("max").cast("double").alias("max"), F.col("sum").cast("double").alias("sum")))).alias("_p"))
    lists = F.concat(*[filled("_p", width, "idx", part, F.lit(0.0)) for part in ("mean", "max", "sum")])
    unusable = F.array_repeat(F.lit(float(INVALID)), 3 * width)
    return df.select(key).join(per.select(key, lists.alias("pools")), key, "left").withColumn("pools", F.coalesce("pools", unusable))


def descriptors(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numeric descriptors of each text, a column each; -1 for a text without words. The text is split once."""
    df = df.select(key, text, tokens(text).alias("_w"))
    t, words = F.col(text), F.col("_w")
    n = F.length(t)
    kept = {cls: F.length(F.regexp_replace(t, f"[^{cls}]", "")) for cls in ("0-9", "A-Z", ".,;:!?")}
    values = {
        "n_chars": n,
        "n_words": F.size(words),
        "n_distinct_words": F.size(F.array_distinct(words)),
        "digit_share": ratio(kept["0-9"], n),
        "upper_share": ratio(kept["A-Z"], n),
        "punctuation_share": ratio(kept[".,;:!?"], n),
        "words_per_char": ratio(F.size(words), n),
    }
    usable = F.size(words) > 0
    return df.select(key, *[F.when(usable, v.cast("double")).otherwise(float(INVALID)).alias(k) for k, v in values.items()])


def fit_word_vectors(df: DataFrame, text: str, size: int = VECTOR_SIZE, min_count: int = 1, seed: int = 253,
                     partitions: int = 8, rounds: int = 1) -> Word2VecModel:
    """Word vectors of a text column.

    Spark's trainer holds the vocabulary on the driver: for one that outgrows it,
    ``min_count`` is the way to bound it, at the price of unknown words.
    """
    words = df.select(tokens(text).alias("words"))
    return Word2Vec(inputCol="words", outputCol="v", vectorSize=size, minCount=min_count, seed=seed,
                    numPartitions=partitions, maxIter=rounds).fit(words)


def sentence_vectors(df: DataFrame, key: str, text: str, model: Word2VecModel) -> DataFrame:
    """Mean, max and sum of the word vectors of every text; unknown words are skipped, -1 throughout if none is known."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    per = word_counts(df, key, text, "word", "_n").withColumn("_n", F.col("_n").cast("double"))
    found = per.join(model.getVectors(), "word")
    metrics = ("mean", "max", "sum")
    pooled = found.groupBy(key).agg(Summarizer.metrics(*metrics).summary(F.col("vector"), F.col("_n")).alias("_s"))
    features = pooled.select(key, F.concat(*[vector_to_array(f"_s.{m}") for m in metrics]).alias("features"))
    unusable = F.array_repeat(F.lit(float(INVALID)), len(metrics) * model.getVectorSize())
    return df.select(key).join(features, key, "left").withColumn("features", F.coalesce("features", unusable))


__all__ = [
    "bit_sets", "descriptors", "fingerprint", "fingerprint_dense", "fit_word_vectors", "grams", "hashed_grams",
    "run_sets", "sentence_vectors", "token_pools", "token_pools_dense", "vocabulary",
]
