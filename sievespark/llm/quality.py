"""Quality rules from line frequencies across documents (DataFrame functions only).

Method: every line is normalised (lower case, digits to 0, white space collapsed)
and hashed. For each host (``source``) the documents that hold a line are counted;
a line found in more than ``min_docs`` documents and more than 1 in ``per_docs`` of
the host's documents, or in more than ``max_docs`` whatever the host's size, is
boilerplate and is removed. A document is depleted, and rejected, if fewer than
``min_words`` words or less than half of its words are left.

Scale: the text is read once. All figures of one document are computed within its
row; what is shuffled is one (host, line hash) pair for each distinct line of a
document, summed before the shuffle, and then the lines against the boilerplate
lines, a join that adaptive execution splits where one line is very common. The
limits are ratios or constants, so they mean the same at every size.

Cases: a null text is empty (0 words, base_failed); a null host is a host of its
own, apart from the host ``""``; repeated rows each get a row and each count as a document; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text, words_of

MIN_DOCS = 10
PER_DOCS = 50
MAX_DOCS = 1000
MIN_WORDS = 50

# Positions share a long with the upper bits of a window's hash. A string of 2 GB, the
# longest there can be, has at most 2^30 words.
_POSITION_BITS = 30
_POSITION = (1 << _POSITION_BITS) - 1


def normalised_lines(text: Column) -> Column:
    """Lines that hold a word: lower case, digits to 0, one space between words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 3-word windows that the ``words`` array has twice or more.

    Windows are hashed. Sorting longs of hash prefix and position puts equal
    prefixes side by side; only those few are sorted again by their whole hash.
    """
    n = F.size("words")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("words", i + k) for k in range(3)])

    def beside(col: str, part) -> Column:
        """Elements whose neighbour in the sorted array agrees in ``part``."""
        return F.filter(
            col,
            lambda x, i: F.coalesce(part(F.get(col, i - 1)) == part(x), F.lit(False))
            | F.coalesce(part(F.get(col, i + 1)) == part(x), F.lit(False)),
        )

    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(none))
    df = df.withColumn(
        "_p", F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))))
    )
    df = df.withColumn("_c", beside("_p", lambda x: F.shiftright(x, _POSITION_BITS)))
    df = df.withColumn(
        "_d",
        F.sort_array(
            F.transform(
                "_c",
                lambda x: F.struct(
                    F.get("_h", x.bitwiseAND(F.lit(_POSITION)).cast("int")).alias("h"),
                    x.bitwiseAND(F.lit(_POSITION)).alias("i"),
                ),
            )
        ),
    )
    df = df.withColumn("_at", F.sort_array(F.transform(beside("_d", lambda x: x["h"]), lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("_h", "_p", "_c", "_d", "_at")


def document_figures(docs: DataFrame) -> DataFrame:
    """One row per document: its counts and its normalised lines as (hash, words)."""
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    df = docs.select("doc_id", host.alias("host"), "text")
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_normal", normalised_lines(F.col("text")))
    df = df.select(
        "doc_id",
        "host",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "_normal",
            lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("w")),
        ).alias("lines"),
    )
    return with_repeat_words(df).drop("words").withColumn("row", F.monotonically_increasing_id())


def common_lines(
    figures: DataFrame, min_docs: int = MIN_DOCS, per_docs: int = PER_DOCS, max_docs: int = MAX_DOCS
) -> DataFrame:
    """(host, h) of the lines that too many documents of a host hold."""
    held = figures.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = held.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    sizes = figures.groupBy("host").agg(F.count("*").alias("docs"))
    many = (F.col("n") * per_docs > F.col("docs")) | (F.col("n") > max_docs)
    return counted.join(sizes, "host").where(many).select("host", "h")


def line_frequency_rules(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    per_docs: int = PER_DOCS,
    min_words: int = MIN_WORDS,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """One row per document with its counts, the words left after line removal, and the verdict."""
    figures = materialize(document_figures(with_text(docs, "source")), "quality")
    lines = figures.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    common = common_lines(figures, min_docs, per_docs, max_docs)
    removed = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("cut"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("cut", F.lit(0))
    return figures.drop("lines").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (left >= min_words) & (2 * left >= F.col("n_words"))).alias("kept"),
        left.alias("n_words_left"),
    )


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents."""
    return line_frequency_rules(documents(spark, sf_dir, "source"))


OP6_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text from documents),
w as (select r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
tri as (select r, unnest(generate_series(1, len(words) - 2)) as i, words from w where len(words) >= 3),
win as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as s from tri),
rep as (select r, i from (select r, i, count(*) over (partition by r, s) as c from win) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
raw as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (select r, sum(c - 1) as n from (select r, line, count(*) as c from raw
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line) group by r),
norm as (select r, host, trim(l, ' ') as line from (select r, host, unnest(string_split(regexp_replace(regexp_replace(lower(text),
  '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) as l from d) where trim(l, ' ') <> ''),
freq as (select host, line, count(distinct r) as n from norm group by host, line),
size as (select host, count(*) as docs from d group by host),
common as (select f.host, line from freq f join size s on f.host = s.host where n > 10 and (n * 50 > docs or n > 1000)),
cut as (select r, sum(len(string_split(n.line, ' '))) as n from norm n join common c on n.host = c.host and n.line = c.line group by r),
f as (select w.doc_id, len(words)::bigint as n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  (len(words) - coalesce(cut.n, 0))::bigint as n_words_left
  from w left join dup using (r) left join cov using (r) left join cut using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words_left >= 50 and 2 * n_words_left >= n_words as kept,
  n_words_left
from f
"""
