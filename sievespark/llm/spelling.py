"""Spelling variants of words: one edit apart, one much more frequent than the other.

Method: sorted-list dynamic programming. A list of words is sorted; for a word, the list
is scanned from top to bottom with the rows of the banded edit matrix (three cells, as
one edit is allowed). A row belongs to a beginning of the entry, so an entry reuses the
rows of the one before it as far as their longest common prefix goes. Where a row has
no cell below two, every entry that shares this beginning is skipped: the scan goes on
at the first whose common prefix with its forerunner is shorter.

Spark cuts the vocabulary into such lists. One edit leaves the first or the last half
of a word unchanged, so two near words share a list: that of their beginning, or that of
their ending (for both lengths the shorter of the two may have). The lists hold what is
left of the words between the equal parts. A list of over ``GROUP`` words is cut again in
the same way, by half of what is left, until the rest is a character: no list grows with
the vocabulary, however many words begin alike, and no pair is lost.

Scale: occurrences are counted before the shuffle. Lists are streamed one by one through
Arrow batches of sorted partitions. Forms reach their last one by joins that double the
way they have gone; a chain is short, for each step has five times the occurrences.

Cases: a null text has no words; a null id is written ``null``; repeated rows count again;
words of any length are compared (the memory of a scan is a list and its longest word);
ties between forms go to the smallest word by code points; an empty table, or one without
frequent words, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text

#: Words are runs of these characters, of at least MIN_LENGTH, found at least MIN_COUNT times.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form has at least so many times the occurrences of the word.
RATIO = 5
#: One run in so many (by the crc32 of document and run) is misspelt by a letter left out.
MISSPELT = 199
#: Lists of more words are cut again; a task scans about so many rows of lists.
GROUP, TASK_ROWS = 2_000, 25_000


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one of its characters if the hash of document and run says so."""
    at = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    place = (at % F.length(run)).cast("int")
    left_out = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(at % MISSPELT == 0, left_out).otherwise(run)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n``, the occurrences, of the words that are long and frequent enough.

    Shorter runs can't become long enough, so the pattern leaves them out.
    """
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    # The run holds only letters of the pattern; lower() changes others than A-Z only among these.
    runs = with_text(docs).select("doc_id", F.explode(found).alias("run"))
    low = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = runs.select("doc_id", low.otherwise(F.lower("run")).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(lists: DataFrame) -> DataFrame:
    """Add the key of a list: the shorter length, and the equal beginning and ending."""
    return lists.select(
        "word", "m", "left", "right",
        F.substring("word", F.lit(1), F.col("left")).alias("head"),
        F.expr("right(word, right)").alias("tail"))


_KEY = ["m", "left", "right", "head", "tail"]


def _halved(lists: DataFrame) -> DataFrame:
    """Both ways to cut a list: the first half of what is left is equal, or the last one is."""
    free = F.col("m") - F.col("left") - F.col("right")
    half = F.floor(free / 2).cast("int")
    return lists.select("word", "m", F.explode(F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right")),
        F.struct(F.col("left").alias("left"), (F.col("right") + free - half).alias("right")))).alias("c")).select("word", "m", "c.*")


def sorted_lists(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Words with the keys of the lists they are in; lists of one word are left out.

    A word of length n meets those of n or n + 1 in lists of shorter length n, and those of
    n - 1 in lists of shorter length n - 1.
    """
    n = F.length("word")
    both = words.select("word", F.explode(F.array(n, n - 1)).alias("m"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    open_, done = _keyed(_halved(both)), None
    while True:
        open_ = materialize(open_, "lists")
        # A list without a word of the shorter length holds no pair of its own.
        sizes = open_.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short")
        ).where((F.col("size") > 1) & (F.col("short") > 0))
        sizes = materialize(sizes, "list-sizes")
        large = (F.col("size") > group) & (F.col("m") - F.col("left") - F.col("right") > 1)
        fits = open_.join(sizes.where(~large), _KEY).select("word", *_KEY)
        done = fits if done is None else done.union(fits)
        over = sizes.where(large)
        if over.isEmpty():
            return done
        # Both halves may name one list twice, for words that are cut in different ways.
        open_ = _keyed(_halved(open_.join(over.select(*_KEY), _KEY))).distinct()


def _next_row(row: tuple, c: str, i: int, word: str) -> tuple:
    """Cells (i, i-1), (i, i), (i, i+1) of the edit matrix from those of row i - 1; 2 stands for more than one edit."""
    n = len(word)
    a, b, d = row
    # Columns j = i - 1, i, i + 1; the diagonal forerunner of column j is cell j - 1 of the row before.
    left = min(a + (c != word[i - 2]), b + 1) if 2 <= i <= n + 1 else (b + 1 if i == 1 else 2)
    mid = min(b + (c != word[i - 1]), d + 1, left + 1) if i <= n else 2
    right = min(d + (c != word[i]), mid + 1) if i + 1 <= n else 2
    return min(left, 2), min(mid, 2), min(right, 2)


def near_in_list(entries: list[str], query: str) -> Iterator[int]:
    """Places of the entries of a sorted list that are one edit or less from the query."""
    return scan(entries, common_prefixes(entries), query)


def common_prefixes(entries: list[str]) -> list[int]:
    """Of every entry the length of the prefix it shares with the one before it."""
    out = [0] * len(entries)
    for k in range(1, len(entries)):
        a, b = entries[k - 1], entries[k]
        top = min(len(a), len(b))
        i = 0
        while i < top and a[i] == b[i]:
            i += 1
        out[k] = i
    return out


def scan(entries: list[str], lcp: list[int], query: str) -> Iterator[int]:
    """One pass over a sorted list; ``rows[i]`` is the band of the current entry's first i characters."""
    n = len(query)
    # Row 0: no column -1, then 0 and 1 insertions.
    rows = [(2, 0, 1 if n else 2)]
    k, size = 0, len(entries)
    while k < size:
        entry = entries[k]
        del rows[lcp[k] + 1 :]
        dead = False
        for i in range(len(rows), len(entry) + 1):
            row = _next_row(rows[-1], entry[i - 1], i, query)
            if row == (2, 2, 2):
                dead = True
                break
            rows.append(row)
        if dead:
            # Entries that share the beginning whose row has no cell below two.
            i = len(rows)
            k += 1
            while k < size and lcp[k] >= i:
                k += 1
            continue
        at = n - len(entry)
        if -1 <= at <= 1 and rows[-1][at + 1] < 2:
            yield k
        k += 1


def _pairs(words: list[str], m: int, left: int, right: int) -> Iterator[tuple[str, str]]:
    """The near pairs of a list of which one at least has the shorter length."""
    inner = sorted((w[left : len(w) - right], w) for w in set(words))
    entries = [x for x, _ in inner]
    lcp = common_prefixes(entries)
    for k, (query, word) in enumerate(inner):
        if len(word) == m:
            for at in scan(entries, lcp, query):
                other = inner[at][1]
                if len(other) > m or at > k:
                    yield word, other


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): the pairs of words that differ by one inserted, deleted or replaced character."""
    lists = materialize(sorted_lists(words, group).select("word", *_KEY), "list-rows")
    # Scanning costs far more than its rows' bytes tell, so tasks are cut by rows.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.count() // TASK_ROWS)
    lists = lists.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            found = []
            for word, *at in b.itertuples(index=False, name=None):
                if at != key:
                    if len(held) > 1:
                        found += _pairs(held, *key[:3])
                    key, held = at, []
                held.append(word)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=object)
        if len(held) > 1:
            yield pd.DataFrame(list(_pairs(held, *key[:3])), columns=["a", "b"], dtype=object)

    return lists.mapInPandas(find, "a string, b string").distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words with their near-word count and their form, the most frequent near word if it is frequent enough."""
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    # The smallest of (-n, word) is the largest n, then the first word.
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b"))).alias("best"))
    top = -F.col("best.n")
    good = top >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.b")).alias("form"), F.when(good, top).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last one that forms lead to."""
    at = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(onward, "root", "left")
        if step.where("next is not null").isEmpty():
            return at
        at = materialize(step.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Every frequent word with its form and the root that forms lead to."""
    words = materialize(vocabulary(docs), "vocabulary")
    found = materialize(forms(words, near_pairs(words, group)), "forms")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_sorted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over the words of all documents."""
    return spelling_variants(documents(spark, sf_dir))
