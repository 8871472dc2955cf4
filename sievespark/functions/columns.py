"""Small column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The widths and limits the stored formats have.
INT8_MAX = 127
INT8_MIN = -128
SPLIT_SEED = 253
SCORE_DIGITS = 3
CLASS_THRESHOLD = 0.5


def key_hash(*keys: str | Column, seed: int | str = 0) -> Column:
    """32 hex digits of the keys and a seed: a reproducible random order. A missing key counts as a value of its own."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols], F.lit(str(seed))))


def hash_number(hashed: Column) -> Column:
    """The first 32 bits of a hex hash as a number."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")


def any_true(cols: Sequence[str]) -> Column:
    """True if any flag is set; a missing flag counts as not set."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in cols])


def to_class(score: str | Column, threshold: float = CLASS_THRESHOLD) -> Column:
    """1 above the threshold, 0 at or below it."""
    return (F.col(score) if isinstance(score, str) else score).__gt__(threshold).cast("int")


def round_score(score: str | Column, digits: int = SCORE_DIGITS) -> Column:
    """Round half to even after scaling, as array libraries do for doubles."""
    scale = float(10**digits)
    return F.rint((F.col(score) if isinstance(score, str) else score) * scale) / scale


def zero_pad(value: str | Column, width: int = 3) -> Column:
    """A number as text with leading zeros; wider numbers stay whole."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def matches(text: str, pattern: str) -> Column:
    """Regular expression test; a missing text does not match."""
    return F.coalesce(F.col(text).rlike(pattern), F.lit(False))


def output_tag(prefix: str, day: Column, score: Column) -> Column:
    """Name of an output: prefix, day, and score in whole percent."""
    return F.concat_ws(
        "-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), zero_pad((score * 100).cast("int"))
    )


def one_hot(col: str, values: Sequence[str], prefix: str = "is_") -> list[Column]:
    """One 0/1 column per listed value."""
    return [(F.col(col) == v).cast("int").alias(f"{prefix}{v}") for v in values]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def with_default(df, col: str, value):
    """Add a constant column where the input lacks it."""
    return df if col in df.columns else df.withColumn(col, F.lit(value))


def tokens(text: str | Column) -> Column:
    """Words of a text: split at blanks, no empty words; none for a missing text."""
    words = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[ \n\r\t]+")
    return F.filter(words, lambda w: w != "")


def value_counts(values: Column, name: str = "value", count: str = "n") -> Column:
    """Distinct values of an array with their counts, as an array of structs.

    Works within the row: sort, find where the value changes, take differences.
    Counting what one row holds therefore needs no shuffle. Pass a plain column;
    an expression would be evaluated once per use.
    """
    size = F.size(values)
    slots = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(slots, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))
    # Each entry: (start, next start); the last one ends at the size.
    ends = F.slice(F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(size)), 1, F.size(starts))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(F.get(values, a).alias(name), (b - a).cast("bigint").alias(count)))


def filled(entries: str, width: int, position: str, value: str, default: Column) -> Column:
    """A list of ``width`` values from entries sorted by position, ``default`` between them; linear in the width."""
    last = F.coalesce(F.element_at(entries, -1)[position], F.lit(-1))

    # Each entry brings the defaults since the one before it.
    def upto(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(entries, i - 1)[position], F.lit(-1))
        return F.concat(F.array_repeat(default, (entry[position] - before - 1).cast("int")), F.array(entry[value]))

    return F.concat(F.flatten(F.transform(entries, upto)), F.array_repeat(default, (F.lit(width - 1) - last).cast("int")))


def explode_words(df, text: str, *keep: str, name: str = "word"):
    """One row per word of a text.

    An outer explode with a null test: for a plain explode the optimizer adds a
    non-empty test below it, which would split every text a second time.
    """
    return df.select(*keep, F.explode_outer(tokens(text)).alias(name)).where(F.col(name).isNotNull())


def inline_computed(df, structs: str | Column, *keep: str, required: str):
    """One row per struct of a computed array; outer, for the same reason."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(required).isNotNull())


def word_counts(df, key: str, text: str, name: str = "value", count: str = "n", keep_length: str | None = None):
    """Rows (key, word, count) of a table with one text per key; nothing is shuffled."""
    words = df.select(key, F.sort_array(tokens(text)).alias("_w"))
    if keep_length:
        words = words.withColumn(keep_length, F.size("_w"))
    keep = [key, keep_length] if keep_length else [key]
    counted = words.select(*keep, value_counts(F.col("_w"), name, count).alias("_c"))
    return inline_computed(counted, "_c", *keep, required=name)
