"""Fuzzy line deduplication by MinHash (DataFrame functions only).

Method: a line is normalised (lower case, white space collapsed). Its signature
comes from hashed shingles: of up to 9 characters that begin at word starts, or of 5
characters at every place if the line has few word starts, as addresses, ids and texts
without spaces have; lines with a number between get both. A band is three hashes that follow or precede one of three points on the circle of sorted
hashes, three minima of one order. Lines that share a band are candidates; pairs are
verified by the exact Jaccard similarity, 0.8 or more, of all their 5-character shingles.
Linked lines form components by distributed union-find, and the first line of a component
(smallest document id, then place) stays; all others are removed. Lines without a word
always stay.

Candidates are checked in two steps: first by their sketches, the smallest hashes of
each signature, of which similar lines share most; then by the sets of all shingles. Where
a line has many pairs, its set is built once, in 16 bits a shingle, which rules out most of them exactly.
They don't grow with the square of a group. Every line of a band is compared with the band's most frequent
line, to which variants of a line mostly link. What is left unlinked in a band of up to
``LARGE`` lines is compared pair by pair; in a larger one, lines are joined without loss by band and
rarest shingles, bands that share lines as one: similar lines share one of the first fifth in an order by frequency there, at places
that leave room for the overlap they need. Pairs within a component are not compared.

Scale: what is shuffled per line are a few longs. Equal lines are one node. Texts are
shuffled once, to fetch the candidates, of which one copy each is taken. Hot bands
and lines are summed before the shuffle or meet in joins that adaptive execution splits.
One window isn't split: lines of a cluster of bands that hold one shingle are counted in one task.

Cases: a null text is one line without words; a null id counts as the largest; rows that
repeat id and text are the same document and keep the same lines; an empty table gives
no rows; extra columns pass through ``keep_first_lines`` and are not read otherwise.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text
from .components import components

SIMILARITY = 0.8
SIGNED, COMPARED = 9, 5
#: Lines of fewer word starts than SPARSE are signed by every shingle, those of DENSE or more by word starts.
DENSE, SPARSE = 8, 12
#: Hashes of a sketch, and the share of them that lines must have in common to be compared (similar ones share 0.8 and more).
SKETCH, PLAUSIBLE = 16, 0.4
#: Bands of more lines are joined by rare shingles.
LARGE = 64
_SPACE = " \t\x0b\x0c\r"
# A match takes the whole word and the space after it, so that the next one begins at the next word.
_STARTS = r"(?s)(?=(.{1,%d}))[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+" % SIGNED
_EVERY = r"(?s)(?=(.{%d}))" % COMPARED
_LAST = (1 << 63) - 1
# Points on the circle of signed hashes; each gives the band after it and the band before it.
_POINTS = (-(1 << 63), -(1 << 62), 1 << 61)


def normal_lines(docs: DataFrame, *cols: str) -> DataFrame:
    """``lines``, those of the text, normalised but for white space at their ends, beside the columns ``cols``; line n is line n of the text.

    In steps, since a lambda or a generator over the whole expression evaluates each mention of the lower-cased text again.
    """
    low = docs.select(*cols, F.lower("text").alias("low"))
    uneven = functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(x)) for x in ("  ", *_SPACE[1:])])
    plain = F.when(uneven, F.regexp_replace("low", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("low"))
    return low.select(*cols, F.split(plain, "\n").alias("lines"))


def _hashed(line: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda s: F.xxhash64(s)))


def word_starts(line: Column) -> Column:
    """The distinct hashed shingles at word starts."""
    return _hashed(line, _STARTS)


def shingles(line: Column) -> Column:
    """The distinct hashed shingles at every place of a line; a shorter line is its own."""
    return F.when(F.length(line) < COMPARED, F.array(F.xxhash64(line))).otherwise(_hashed(line, _EVERY))


def below(hashes: str, name: str) -> list[Column]:
    """How many of an array's hashes are below each point but the lowest: ``name``1, ``name``2."""

    def count(point: int) -> Column:
        return F.size(F.filter(hashes, lambda x: x < F.lit(point)))

    return [count(point).alias(f"{name}{i}") for i, point in enumerate(_POINTS) if i]


def bands(hashes: str, name: str) -> Column:
    """The bands of a sorted array of distinct hashes, whose columns ``below`` are there; small arrays repeat some."""
    n = F.size(hashes)
    after = [F.col(f"{name}{point}") if point else F.lit(0) for point in range(len(_POINTS))]

    def band(first: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, F.pmod(first + i, n)) for i in range(3)])

    return F.transform(F.array(*[first for k in after for first in (k, k - 3)]), band)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` and ``check`` identify a document: its id, nulls last, and a hash of its text."""
    return with_text(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("check")
    )


def sketch(hashes: str) -> Column:
    """The smallest of the sorted hashes, four bytes each."""
    return F.transform(F.slice(hashes, 1, SKETCH), lambda x: F.shiftright(x, 32).cast("int"))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line that isn't empty: where it is, its hash, its bands, and a sketch of each signature it has.

    An outer generator: below a plain one, the optimizer tests that there is a line, for which it normalises the text several times more.
    """
    lines = normal_lines(docs, "doc", "check").select("doc", "check", F.posexplode_outer("lines").alias("place", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    hashed = lines.select(
        "doc", "check", "place", F.xxhash64("line").alias("h"),
        F.sort_array(word_starts(F.col("line"))).alias("starts"), "line",
    )
    few, both = F.size("starts") < SPARSE, (F.size("starts") >= DENSE) & (F.size("starts") < SPARSE)
    hashed = hashed.withColumn("signed", F.when(few, F.sort_array(shingles(F.col("line")))).otherwise(F.col("starts"))).drop("line")
    hashed = hashed.select("*", *below("signed", "k"), *[F.when(both, k).alias(f"s{i + 1}") for i, k in enumerate(below("starts", "s"))])
    none = F.array().cast("array<long>")
    return hashed.select(
        "doc", "check", "place", "h",
        F.array_distinct(F.concat(bands("signed", "k"), F.when(both, bands("starts", "s")).otherwise(none))).alias("bands"),
        F.when(few, sketch("signed")).alias("by_place"), F.when(F.size("starts") >= DENSE, sketch("starts")).alias("by_word"),
    )


SKETCHES = ["by_place", "by_word"]


def plausible(a: str, b: str) -> Column:
    """Whether two lines may be similar, by the signatures that both have."""

    def alike(name: str) -> Column:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        return F.coalesce(F.size(F.array_intersect(x, y)) >= F.lit(PLAUSIBLE) * F.least(F.size(x), F.size(y)), F.lit(False))

    return alike("by_place") | alike("by_word")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough.

    The sets of a pair are a generator's columns, which a condition isn't moved below: it would build them for every mention.
    In a lambda, they would be compared member by member as objects.
    """
    a = lines.select(F.col("h").alias("a"), F.col("line").alias("x"))
    b = lines.select(F.col("h").alias("b"), F.col("line").alias("y"))
    sets = F.array(F.struct(shingles(F.col("x")).alias("p"), shingles(F.col("y")).alias("q")))
    # Of as many in common, and the sizes: common >= SIMILARITY * (sizes - common).
    common, sizes = F.size(F.array_intersect("p", "q")), F.size("p") + F.size("q")
    similar = F.lit(1 + SIMILARITY) * common >= F.lit(SIMILARITY) * sizes - F.lit(1e-9)
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.inline_outer(sets)).where(similar).select("a", "b")


def compact_sets(lines: DataFrame) -> DataFrame:
    """(h, n, s): how many shingles a line has, and the distinct first 16 bits of their hashes, about twice the text in size."""
    own = lines.select("h", shingles(F.col("line")).alias("all"))
    return own.select("h", F.size("all").alias("n"), F.array_distinct(F.transform("all", lambda x: F.shiftright(x, 48).cast("short"))).alias("s"))


def possible(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) but those that can't be similar by the compact sets of their lines, each built once however many pairs it has.

    No similar pair is left out: shingles in common are in common in 16 bits too, but
    for those that fall together there, at most as many as in the whole of either line.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    sets = materialize(compact_sets(lines.join(wanted, "h")), "sets")
    sizes = (sets.select(F.col("h").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    for size in sizes:
        pairs = pairs.join(size, size.columns[0])
    alike = pairs.where(F.least("n_a", "n_b") >= F.lit(SIMILARITY) * F.greatest("n_a", "n_b") - F.lit(1e-9))
    for k in "ab":
        alike = alike.join(sets.select(F.col("h").alias(k), F.col("s").alias(f"s_{k}")), k)
    common = F.size(F.array_intersect("s_a", "s_b")) + F.least(F.col("n_a") - F.size("s_a"), F.col("n_b") - F.size("s_b"))
    return alike.where(F.lit(1 + SIMILARITY) * common >= F.lit(SIMILARITY) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)).select("a", "b")


def candidate_lines(docs: DataFrame, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted hashes, each read from one document."""
    first = table.join(wanted, "h").groupBy("h").agg(F.min(F.struct("doc", "check", "place")).alias("at"))
    by_doc = first.groupBy("at.doc", "at.check").agg(F.collect_list(F.struct("h", "at.place")).alias("wanted"))
    rows = normal_lines(docs.join(by_doc, ["doc", "check"]), "wanted")
    found = rows.select(F.explode_outer(F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), F.get("lines", w["place"]).alias("line")))).alias("c"))
    return found.select("c.h", F.trim("c.line").alias("line"))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each line of a key with the key's most frequent line, if plausible; the smaller hash first."""
    line = F.struct("h", *SKETCHES)
    rep = members.groupBy("key").agg(F.max_by(line, F.struct("copies", "h")).alias("rep"))
    pairs = members.select("key", line.alias("own")).join(rep, "key").where((F.col("own.h") != F.col("rep.h")) & plausible("own", "rep"))
    return pairs.select(F.least("own.h", "rep.h").alias("a"), F.greatest("own.h", "rep.h").alias("b")).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b): all plausible pairs of different labels in keys of at most LARGE lines."""
    line = F.struct("h", "label", *SKETCHES)
    a, b = (members.select("key", line.alias(name)) for name in "ab")
    both = a.join(b, "key").where((F.col("a.h") < F.col("b.h")) & (F.col("a.label") != F.col("b.label")) & plausible("a", "b"))
    return both.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()


def rare_shingles(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, h, label, n, at, shingle): of each line's n shingles those of which similar lines share one, rarest in the key first.

    Of two sets whose Jaccard coefficient is SIMILARITY or more, each holds at least
    SIMILARITY of its own members in common, so the rarest common one is among these.
    What lines of a key have in common, as a template's words, comes last in its order;
    what only lines of one label have can link none and is left out, but counts as a place.
    """
    own = materialize(lines.join(members.select("h").distinct(), "h").select("h", shingles(F.col("line")).alias("s")), "shingles")
    each = members.join(own, "h").select("key", "h", "label", F.explode("s").alias("shingle"))
    same = Window.partitionBy("key", "shingle")
    counted = each.select(
        "key", "h", "label", "shingle", F.count("*").over(same).alias("c"), (F.min("label").over(same) < F.max("label").over(same)).alias("mixed")
    )
    ordered = counted.groupBy("key", "h", "label").agg(F.sort_array(F.collect_list(F.struct("c", "shingle", "mixed"))).alias("s")).withColumn("n", F.size("s"))
    first = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    placed = F.transform(F.slice("s", F.lit(1), first), lambda x, i: F.struct(i.alias("at"), x["shingle"].alias("shingle"), x["mixed"].alias("mixed")))
    return ordered.select("key", "h", "label", "n", F.explode_outer(F.filter(placed, lambda x: x["mixed"])).alias("x")).select(
        "key", "h", "label", "n", "x.at", "x.shingle"
    ).where("at is not null")


def close_lines(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members (key, h, label) of a key and of different labels that hold all similar ones.

    Lines meet by key, shingle and size: the sizes of similar lines are at most one class apart.
    """
    entries = rare_shingles(members, lines).withColumn("size", F.floor(F.log("n") / F.lit(-math.log(SIMILARITY))).cast("int"))
    entries = materialize(entries, "rare")
    x, y = (entries.select("key", "shingle", "size", *[F.col(c).alias(f"{c}_{k}") for c in ("h", "label", "n", "at")]) for k in "ab")
    y = y.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    # The common members from this one on, at most, if it is the first: they must reach the similarity.
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    need = F.lit(SIMILARITY) * (F.col("n_a") + F.col("n_b")) - F.lit(SIMILARITY) * room - F.lit(1e-9)
    both = x.join(y, ["key", "shingle", "size"]).where((F.col("h_a") < F.col("h_b")) & (F.col("label_a") != F.col("label_b")) & (room >= need))
    return both.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")).distinct()


def band_clusters(members: DataFrame) -> DataFrame:
    """The members with bands that share lines put together under one key, so that each line is met once."""
    labels = materialize(components(members.select(F.xxhash64("key").alias("a"), F.col("h").alias("b"))), "clusters")
    return members.select("h", "label").distinct().join(labels.withColumnRenamed("label", "key").withColumnRenamed("node", "h"), "h").select("key", "h", "label")


def similar_lines(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Verified links (a, b) between hashes of lines."""
    banded = table.select("h", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("top")).where("low <> top").select("key")
    bands_of = materialize(banded.join(shared, "key").groupBy("key", "h").agg(F.count("*").alias("copies")), "bands")
    wanted = bands_of.select("h").distinct()
    sketches = table.select("h", *SKETCHES).join(wanted, "h").dropDuplicates(["h"])
    members = materialize(bands_of.join(sketches, "h"), "members")
    stars = materialize(_stars(members), "stars")
    lines = materialize(candidate_lines(docs, table, wanted).dropDuplicates(["h"]), "candidates")
    links = materialize(_verified(stars, lines), "links")
    labels = materialize(components(links), "star-labels")
    placed = members.join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("top"), F.count("*").alias("n"))
    mixed = materialize(mixed.where("low <> top").select("key", "n"), "mixed")
    left = materialize(placed.join(mixed, "key").select("key", "n", "h", "label", *SKETCHES), "unlinked")
    pairs = _pairs(left.where(F.col("n") <= LARGE)).union(close_lines(band_clusters(left.where(F.col("n") > LARGE)), lines))
    pairs = materialize(pairs.distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    return links.union(materialize(_verified(materialize(possible(pairs, lines), "possible"), lines), "links"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, check, removed): places of the lines to remove, for documents that have any."""
    table = materialize(line_table(docs), "lines")
    labels = materialize(components(similar_lines(docs, table)), "line-labels")
    placed = table.drop("bands").join(labels.withColumnRenamed("node", "h"), "h", "left").select(
        "doc", "check", "place", F.coalesce("label", "h").alias("label")
    )
    placed = materialize(placed, "placed")
    first = (
        placed.groupBy("label").agg(F.min(F.struct("doc", "check", "place")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("label", "first")
    )
    gone = placed.join(first, "label").where(F.struct("doc", "check", "place") != F.col("first"))
    return gone.groupBy("doc", "check").agg(F.collect_set("place").alias("removed"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with their fuzzy repeated lines cut out; those with no word left although they had some are dropped."""
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(
        "_check", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    cut = removed_lines(keyed(docs)).select(F.col("doc").alias("_doc"), F.col("check").alias("_check"), F.col("removed").alias("_removed"))
    left = F.array_join(
        F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n"
    )
    out = own.join(cut, ["_doc", "_check"], "left").withColumn(
        "text", F.when(F.col("_removed").isNotNull(), left).otherwise(F.col("text"))
    )
    return out.where(F.col("_removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("_doc", "_check", "_removed")


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many lines it has, and which of them (from 0) are removed."""
    docs = keyed(documents(spark, sf_dir))
    counts = docs.select("doc_id", "doc", "check", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counts.join(removed_lines(docs), ["doc", "check"], "left").select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"),
        F.array_join(F.transform(F.sort_array(removed), lambda x: x.cast("string")), ",").alias("removed_lines"),
    )
