"""Personal data by boosted trees over candidate spans (DataFrame functions only).

Method: high-recall generators propose overlapping spans (anything with an ``@`` or
written-out at and dot, and every number-like run of seven digits or more, once as
ip, card and phone each). Spans that the strict patterns confirm are found for
certain and stay. Gradient-boosted trees learn from format and context features
which proposals look like confirmed ones once the marks that confirm them are taken
away: a phone loses its plus and its country code, an address has its marks written
out, a card or ip other separators. Against them stand proposals that fail their
kind's check, belong to another kind, or are numbers of no announced kind. Numbers
that a word announces and written-out addresses have no label; they are what the
trees decide on. A threshold per kind, calibrated on held-out rows to a stated
precision, selects further spans to redact.

Scale: the text is read once and never shuffled. Candidates are found and described
within the row; later steps see one small row per candidate. Trees and thresholds
learn from every labelled candidate: those of equal features are one row, weighted by
their number, which Spark sums before the shuffle. Scoring covers every candidate. Patterns use possessive quantifiers and
anchors, so a text of one endless word or number stays linear.

Cases: a null text is empty and has no spans; repeated rows each get a row; an empty
table, or one whose candidates are of one class only, adds no spans; extra columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import materialize
from .common import documents, with_text

KINDS = ["email", "ip", "card", "phone"]

# The strict patterns, each written so that no input makes it backtrack: a match
# starts where the run of its first characters starts, or where the last match ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NUMBER = r"(?<![0-9])[+(]?[0-9](?:[\x20().:-]{0,2}[0-9]){6,}+"
_MARKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
_WRITTEN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]?(?:at|AT)[)\]]?\x20?[A-Za-z0-9-]++"
    r"(?:\x20[(\[]?(?:dot|DOT)[)\]]?\x20[A-Za-z0-9-]++)++"
)
_MAIL = f"{_MARKED}|{_WRITTEN}"

PRECISION = 0.98
SUPPORT = 20
ROUNDS = 10
DEPTH = 4
BINS = 32
CONTEXT = 30

# Words that announce a kind, in the languages at hand.
CUES = {
    "email": "(?i)mail|contact|kontakt|correo|courriel|write",
    "ip": r"(?i)\bip|server|host|address|adress|direcci|addr",
    "card": "(?i)card|karte|carte|tarjeta|visa|credit|pay",
    "phone": "(?i)phone|call|tel|fax|mobil|anruf",
}

_SPAN = "struct<s:int,e:int,m:string>"


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), in code points."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).alias("g"), m.alias("m")),
    )
    placed = F.aggregate(
        F.filter(pieces, lambda p: p["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + p["g"] + F.length(p["m"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + p["g"]).alias("s"), (a["at"] + p["g"] + F.length(p["m"])).alias("e"), p["m"].alias("m")
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def confirmed(kind: str, m: Column) -> Column:
    """The check that a strict match must pass besides its pattern."""
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _only_confirmed(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: confirmed(kind, x["m"]))


def strict_spans(docs: DataFrame) -> DataFrame:
    """Adds the confirmed spans of each kind, columns named by kind."""
    for kind, pattern in STRICT.items():
        docs = docs.withColumn(kind, _only_confirmed(kind, found(F.col("text"), pattern)))
    return docs


def proposals(docs: DataFrame) -> DataFrame:
    """Adds ``candidates``: proposed spans with the text around them."""
    docs = docs.withColumn("_number", found(F.col("text"), _NUMBER)).withColumn("_mail", found(F.col("text"), _MAIL))

    def around(x: Column) -> Column:
        first = F.greatest(x["s"] - CONTEXT, F.lit(0))
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["m"].alias("m"),
            F.substring("text", first + 1, x["s"] - first).alias("before"),
            F.substring("text", x["e"] + 1, F.lit(CONTEXT)).alias("after"),
        )

    return docs.withColumn("_number", F.transform("_number", around)).withColumn("_mail", F.transform("_mail", around))


def spans_text(arrays: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, comma-joined, in the order given."""

    def part(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*[part(*a) for a in arrays]), ",")


def masked(kind: str, m: Column) -> Column:
    """A proposal without the marks by which the strict pattern tells its kind."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r"[.,;:!?)\]>\"']+$", ""), r"\x20?[(\[](?:at|AT)[)\]]\x20?|\x20(?:at|AT)\x20|@", " at ")
        local, domain = F.substring_index(plain, " at ", 1), F.substring_index(plain, " at ", -1)
        return F.concat(local, F.lit(" at "), F.regexp_replace(domain, r"\x20[(\[]?(?:dot|DOT)[)\]]?\x20|\.", " dot "))
    if kind == "phone":
        return F.ltrim(F.regexp_replace(m, r"\+", ""))
    return F.regexp_replace(m, r"[\x20.-]+", ".")


def national(m: Column) -> Column:
    """A confirmed phone number as it is written within its country."""
    rest = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", "")
    return F.when(rest.startswith("("), rest).otherwise(F.concat(F.lit("0"), rest))


def possible(kind: str, m: Column) -> Column:
    """Whether a proposal passes its kind's check, whatever its marks."""
    if kind == "email":
        return masked(kind, m).rlike(r"^[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+$")
    if kind == "phone":
        return confirmed(kind, m) & ~m.rlike(r"^\(?(?:19|20)[0-9]{2}[-./\x20][0-9]{1,2}[-./\x20][0-9]{1,2}(?![0-9])") & ~m.rlike(r"^[0-9]+\.[0-9]+$|:")
    return confirmed(kind, masked(kind, m)) if kind == "ip" else confirmed(kind, m)


def candidate_rows(stage: DataFrame) -> DataFrame:
    """One row per proposal, kind and masked form, with its features.

    ``label`` is 1 for a confirmed proposal, 0 for one that is none of its kind, and
    null for one that the trees decide on.
    """
    one = stage.select(
        "row",
        *KINDS,
        F.explode(
            F.concat(
                F.transform("_mail", lambda x: F.struct(F.array(F.lit("email")).alias("kinds"), x.alias("x"))),
                F.transform(
                    "_number", lambda x: F.struct(F.array(*[F.lit(k) for k in KINDS[1:]]).alias("kinds"), x.alias("x"))
                ),
            )
        ).alias("c"),
    ).select("row", *KINDS, F.explode("c.kinds").alias("kind"), "c.x.*")
    same = F.lit(False)
    overlaps = F.lit(False)
    passes = form = cued = F.lit(None)
    m = F.col("m")
    for kind in KINDS:
        near = F.exists(kind, lambda y: (y["s"] < F.col("e")) & (y["e"] > F.col("s")))
        overlaps = overlaps | near
        same = same | ((F.col("kind") == kind) & near)
        own = F.col("kind") == kind
        passes = F.when(own, possible(kind, m)).otherwise(passes)
        form = F.when(own, masked(kind, m)).otherwise(form)
        cued = F.when(own, F.col("before").rlike(CUES[kind])).otherwise(cued)
    open_ = passes & ~overlaps & (cued | (F.col("kind") == "email"))
    label = F.when(same, F.lit(1.0)).when(~open_, F.lit(0.0))
    forms = F.when(same & (F.col("kind") == "phone"), F.array(form, national(m))).otherwise(F.array(form))
    one = one.select(
        "row", "kind", "s", "e", "before", "after", label.alias("label"),
        (passes & ~overlaps).alias("free"), F.explode(forms).alias("m"),
    )
    number = digits(m)
    last = F.substring("before", -1, 1)
    next_ = F.substring("after", 1, 1)
    features = {
        "f_kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")),
        "f_digits": F.length(number),
        "f_length": F.length(m),
        "f_zero": m.startswith("0"),
        "f_paren": m.contains("("),
        "f_dots": F.regexp_count(m, F.lit(r"\.")),
        "f_spaces": F.regexp_count(m, F.lit(" ")),
        "f_dashes": F.regexp_count(m, F.lit("-")),
        "f_colons": F.regexp_count(m, F.lit(":")),
        "f_letters": F.regexp_count(m, F.lit(r"\p{L}")),
        "f_word_dots": F.regexp_count(m, F.lit(" dot ")),
        "f_letters_end": m.rlike(r"\x20[A-Za-z]{2,}$"),
        "f_after_letter": last.rlike(r"[\p{L}_]"),
        "f_after_mark": last.rlike(r"[=:\"'#$/.,-]"),
        "f_before_letter": next_.rlike(r"[\p{L}_]"),
        "f_before_mark": next_.rlike(r"[%\"'#$/-]"),
        "f_first": F.length("before") == 0,
        **{f"f_cue_{k}": F.col("before").rlike(v) for k, v in CUES.items()},
    }
    return one.select(
        "row", "kind", "s", "e", "label", "free",
        *[c.cast("double").alias(n) for n, c in features.items()],
    )


def fit_trees(rows: DataFrame, precision: float = PRECISION, support: int = SUPPORT):
    """(assembler, model, threshold by kind) fitted on all rows with a label; None if a class is absent.

    Four fifths of the rows, by hash, fit the trees. On the rest, the threshold of a kind is
    the lowest score at and above which at least ``precision`` of ``support`` or more
    rows are positive; a kind without one adds no spans.
    """
    names = [c for c in rows.columns if c.startswith("f_")]
    split = F.pmod(F.xxhash64("row", "kind", "s"), F.lit(5))
    labelled = rows.where("label is not null").groupBy("kind", "label", (split == 0).alias("held"), *names)
    table = materialize(labelled.agg(F.count("*").cast("double").alias("copies")), "pii-labelled")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    train = assembler.transform(table.where("not held")).select("features", "label", "copies")
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if set(classes) != {0.0, 1.0}:
        return None
    # Spark finds the bins' edges from maxBins squared rows: with so many bins, from every row.
    bins_ = max(BINS, math.isqrt(sum(classes.values())) + 1)
    model = GBTClassifier(
        maxIter=ROUNDS, maxDepth=DEPTH, maxBins=bins_, seed=7, featuresCol="features", labelCol="label", weightCol="copies"
    ).fit(train)
    held = scored(assembler, model, table.where("held")).groupBy("kind", F.floor(F.col("p") * 100).alias("bin")).agg(
        F.sum("copies").alias("n"), F.sum(F.col("label") * F.col("copies")).alias("pos")
    )
    thresholds: dict[str, float] = {}
    bins: dict[str, list] = {}
    for r in held.collect():  # at most 101 bins for each kind
        bins.setdefault(r["kind"], []).append((r["bin"], r["n"], r["pos"]))
    for kind, rows_ in bins.items():
        n = pos = 0
        for at, k, p in sorted(rows_, reverse=True):
            n, pos = n + k, pos + p
            if n >= support and pos >= precision * n:
                thresholds[kind] = at / 100
    return assembler, model, thresholds


def scored(assembler: VectorAssembler, model, rows: DataFrame) -> DataFrame:
    """Adds the trees' probability ``p``."""
    return model.transform(assembler.transform(rows)).withColumn("p", vector_to_array("probability")[1])


def personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per document: the confirmed spans by kind, and ``added``, spans the trees select, as (kind, start, end)."""
    plain = with_text(docs).withColumn("row", F.monotonically_increasing_id())
    stage = materialize(proposals(strict_spans(plain)).drop("text"), "pii")
    rows = candidate_rows(stage)
    fitted = fit_trees(rows, precision)
    base = stage.drop("_number", "_mail")
    empty = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if fitted is None:
        return base.withColumn("added", empty)
    assembler, model, thresholds = fitted
    wanted = F.lit(False)
    for kind, t in thresholds.items():
        wanted = wanted | ((F.col("kind") == kind) & (F.col("p") >= t))
    free = rows.where("free")
    added = (
        scored(assembler, model, free).where(wanted)
        # A proposal belongs to one kind: the likeliest, then the first listed.
        .groupBy("row", "s", "e").agg(F.max_by("kind", F.struct("p", -F.col("f_kind"))).alias("kind"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "s", "e"))).alias("added"))
    )
    return base.join(added, "row", "left").withColumn("added", F.coalesce("added", empty))


def redact(docs: DataFrame, spans: DataFrame, mask: str = "[PII]") -> DataFrame:
    """The texts with every span replaced by ``mask``; overlapping spans are masked once.

    ``spans`` is the result of ``personal_data`` on ``docs``; ids must be unique.
    """
    every = F.concat(
        *[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS],
        F.transform("added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))),
    )
    joined = docs.join(spans.select("doc_id", F.sort_array(every).alias("_spans")), "doc_id", "left")
    cut = F.aggregate(
        F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), F.lit(mask)))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text"))).drop("_spans")


def op2_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the confirmed spans, and all spans."""
    spans = personal_data(documents(spark, sf_dir))

    def numbered(spans: Column, o: Column | None = None) -> Column:
        at = lambda x: o if o is not None else F.array_position(label, x["kind"]).cast("int") - 1
        return F.transform(spans, lambda x: F.struct(at(x).alias("o"), x["s"].alias("s"), x["e"].alias("e")))

    label = F.array(*[F.lit(k) for k in KINDS])
    every = F.sort_array(
        F.concat(*[numbered(F.col(k), F.lit(i)) for i, k in enumerate(KINDS)], numbered(F.col("added")))
    )
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spans_text([(k, F.col(k)) for k in KINDS]).cast("binary"), 256).alias("base_sha256"),
        F.array_join(
            F.transform(every, lambda x: F.concat_ws(":", F.get(label, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ","
        ).alias("spans"),
    )
