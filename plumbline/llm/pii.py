"""Personal data by weak supervision, in DataFrame functions only.

Fixed shapes give base spans; wider shapes give further candidates. Labelers (shape, word
lists, context) vote on every candidate. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, without any labelled example. The
resulting probabilities train a span classifier (naive Bayes over features of the span and
its surroundings), which decides on the further candidates.

One pass over the texts writes the candidates, a narrow table; what is gathered from it is
bounded by the number of vote patterns and of features, not by the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.lineage import written
from plumbline.llm.columns import documents, let, texts

#: The base kinds in their order, then the kinds that the method may add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "national_phone", "id_number", "account")
KINDS = BASE + ADDED

#: Shapes. A possessive run with a look-behind finds what the plain shape finds, in linear time.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
    "national_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "id_number": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
}
#: A cheap test that a text without such spans fails.
HINTS = {"email": "@", "phone": "+", "masked_email": "at"}

PERSONAL = r"\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|iban|account|host|client|from|ssn|id|address|name|user)\b"
TECHNICAL = r"\b(?:version|isbn|issn|doi|order|invoice|page|figure|sha|hash|build|release|chapter|item)\b"
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|co|us|uk|de|fr|es|it|nl|eu|ch|at)$"
LABELERS = 5
VOTES = (-1, 0, 1)
ITERATIONS = 25


@dataclass(frozen=True)
class Reliabilities:
    """The share of personal data and, for each labeler and vote, how likely the vote is on
    personal data (``yes``) and on others (``no``)."""

    prior: float
    yes: list[float]
    no: list[float]


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array, by doubling: k log k steps instead of k squared."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths).cast("double"))).cast("int"))

    def shifted(a: Column, step: Column) -> Column:
        return let(F.pow(F.lit(2), step).cast("int"), lambda by: F.transform(
            a, lambda x, i: x + F.when(i >= by, F.get(a, i - by)).otherwise(F.lit(0))))

    return F.aggregate(rounds, lengths, shifted)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            short = F.ltrim(part, F.lit("0"))
            return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, value: Column, before: Column, after: Column) -> Column:
    """-1, 0 or 1 from each labeler: shape, word list, personal context, technical context, edges."""
    digits = _digits(value)
    shape = {
        "email": value.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@.*\.[A-Za-z]{2,}$") & ~value.contains(".."),
        "ip": ~value.rlike(r"(?:^|\.)0[0-9]"), "card": digits.rlike("^[3-6]") & (F.length(digits) == 16),
        "phone": F.length(digits).between(10, 13), "masked_email": value.rlike(r"(?:\.|dot[\])] ?)[A-Za-z]{2,}$"),
        "national_phone": ~digits.rlike("^[01]"), "id_number": ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^...00|0000$"),
        "account": F.length(F.regexp_replace(value, " ", "")).between(15, 34)}[kind]
    listed = {
        "email": F.lower(value).rlike(DOMAINS), "ip": ~value.rlike(r"^(?:0|127|255)\."),
        "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|34|37|6011|65|35)"), "phone": value.rlike(r"^\+(?:1|33|34|44|49)\b|^\+(?:1|33|34|44|49)"),
        "masked_email": F.lower(value).rlike(r"(?:com|org|net|edu|de|fr|es|uk)$"), "national_phone": digits.rlike("^[2-9]..[2-9]"),
        "id_number": F.lit(False), "account": value.rlike("^(?:DE|FR|ES|GB|IT|NL|AT|BE|CH|PT)")}[kind]
    inside = before.rlike(r"[\p{L}\p{N}_./:-]$") | after.rlike(r"^(?:[\p{L}\p{N}_/:@-]|\.[\p{L}\p{N}])")
    return F.array(
        F.when(shape, 1).otherwise(-1), F.when(listed, 1).otherwise(0), F.when(F.lower(before).rlike(PERSONAL), 1).otherwise(0),
        F.when(F.lower(before).rlike(TECHNICAL), -1).otherwise(0), F.when(inside, -1).otherwise(1))


def _features(kind: str, value: Column, before: Column, after: Column) -> Column:
    def char_class(c: Column) -> Column:
        return (F.when(c == "", "none").when(c.rlike(r"^\s"), "space").when(c.rlike(r"^\p{L}"), "letter")
                .when(c.rlike(r"^\p{N}"), "digit").otherwise("mark"))

    parts = [
        F.concat(F.lit("length "), F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("digits "), F.floor(8 * F.length(_digits(value)) / F.length(value)).cast("string")),
        F.concat(F.lit("left "), char_class(F.right(before, F.lit(1)))), F.concat(F.lit("right "), char_class(F.left(after, F.lit(1)))),
        F.concat(F.lit("personal "), F.lower(before).rlike(PERSONAL).cast("string")),
        F.concat(F.lit("technical "), F.lower(before).rlike(TECHNICAL).cast("string"))]
    return F.array(*[F.concat(F.lit(f"{kind} "), p) for p in parts])


def _found(kind: str, text: Column) -> Column:
    """The valid matches of a shape: kind (its number), start, end, votes, features."""
    shape, number = F.lit(SHAPES[kind]), KINDS.index(kind)

    def spans(pieces: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: (F.length(v) + F.length(F.get(pieces, i))).cast("long"))

        def span(ends: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                before, after = F.right(F.get(pieces, i), F.lit(40)), F.left(F.get(pieces, i + 1), F.lit(20))
                end = F.get(ends, i)
                return F.when(_valid(kind, v), F.struct(
                    F.lit(number).alias("kind"), (end - F.length(v)).alias("start"), end.alias("end"),
                    _votes(kind, v, before, after).alias("votes"), _features(kind, v, before, after).alias("features")))
            return F.filter(F.transform(values, one), lambda x: x.isNotNull())

        return let(prefix_sums(lengths), span)

    nothing = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,votes:array<int>,features:array<string>>>)")
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]{2}|[0-9][ .-][0-9]")
    hit = hint & text.rlike(SHAPES[kind])
    matched = let(F.split(text, SHAPES[kind], -1), lambda p: let(F.regexp_extract_all(text, shape, F.lit(0)), lambda v: spans(p, v)))
    return F.when(hit, matched).otherwise(nothing)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: all base spans and further candidates of every row."""
    found = [_found(kind, F.col("text")) for kind in KINDS]
    return texts(docs).select("doc_id", F.concat(*found).alias("found"))


def _likelihood(votes: Column, chances: Column) -> Column:
    """The product over the labelers; ``chances`` lies flat, three votes for each labeler."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.lit(1.0),
                       lambda a, j: a * F.get(chances, (j * 3 + F.get(votes, j) + 1).cast("int")))


def _posterior(votes: Column, prior: Column, yes: Column, no: Column) -> Column:
    up, down = prior * _likelihood(votes, yes), (1 - prior) * _likelihood(votes, no)
    return up / (up + down)


def reliabilities(spans: DataFrame) -> Reliabilities:
    """Expectation-maximisation over vote patterns (at most 3 to the number of labelers).

    It starts from labelers that are right more often than wrong. Counts are smoothed, so a
    table without candidates gives the start values.
    """
    patterns = spans.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    start = F.struct(F.lit(0.7).alias("prior"), F.array(*[F.lit(x) for x in (0.15, 0.25, 0.6) * LABELERS]).alias("yes"),
                     F.array(*[F.lit(x) for x in (0.55, 0.3, 0.15) * LABELERS]).alias("no"))

    def step(state: Column, _: Column) -> Column:
        def with_weights(weighted: Column) -> Column:
            def total(of) -> Column:
                return F.aggregate(weighted, F.lit(0.0), lambda a, w: a + of(w))

            def chances(side) -> Column:
                whole = total(side)
                return F.transform(F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)), lambda j: (1.0 + total(
                    lambda w: F.when(F.get(w.votes, (j / 3).cast("int")) + 1 == j % 3, side(w)).otherwise(0.0))) / (3.0 + whole))

            yes, no = total(lambda w: w.up), total(lambda w: w.down)
            return F.struct(((yes + 1.0) / (yes + no + 2.0)).alias("prior"), chances(lambda w: w.up).alias("yes"), chances(lambda w: w.down).alias("no"))

        weighted = F.transform("patterns", lambda p: let(
            _posterior(p.votes, state.prior, state.yes, state.no),
            lambda r: F.struct(p.votes.alias("votes"), (p.n * r).alias("up"), (p.n * (1 - r)).alias("down"))))
        return let(weighted, with_weights)

    row = gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step).alias("m")).first().m
    return Reliabilities(row.prior, list(row.yes), list(row.no))


def classifier(spans: DataFrame, model: Reliabilities) -> tuple[float, dict[str, float]]:
    """Log odds of the features, from the soft labels of the labeler model, and of the prior."""
    chance = _posterior(F.col("votes"), F.lit(model.prior), F.array(*map(F.lit, model.yes)), F.array(*map(F.lit, model.no)))
    labelled = spans.select(chance.alias("p"), F.explode("features").alias("feature"))
    totals = spans.agg(F.sum(chance).alias("yes"), F.sum(1 - chance).alias("no")).first()
    yes, no = (totals.yes or 0.0) + 2.0, (totals.no or 0.0) + 2.0
    counted = labelled.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    weighed = counted.select("feature", F.log((F.col("yes") + 1) / yes) - F.log((F.col("no") + 1) / no))
    weighed = weighed.orderBy("feature").limit(1000)  # their number is bounded by the kinds and classes: under 300
    return math.log(yes) - math.log(no), {r[0]: float(r[1]) for r in weighed.collect()}


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, end exclusive), by kind and
    start, for every row. Base spans always stay; a further candidate stays if the
    classifier gives it ``threshold`` or more and it overlaps no base span. A missing or
    empty text has none; repeated rows and missing ids are rows like others."""
    stored = written(candidates(docs), "personal")
    spans = stored.select(F.explode("found").alias("s")).select("s.votes", "s.features")
    prior, odds = classifier(spans, reliabilities(spans))
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair]) if odds else F.expr("cast(map() as map<string,double>)")

    def score(span: Column) -> Column:
        total = F.aggregate(span.features, F.lit(prior), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return 1 / (1 + F.exp(-total))

    base = F.filter("found", lambda x: x.kind < len(BASE))
    more = F.filter("found", lambda x: (x.kind >= len(BASE)) & (score(x) >= threshold) & ~F.exists(
        "base", lambda b: (b.start < x.end) & (x.start < b.end)))

    def plain(spans: Column) -> Column:
        return F.sort_array(F.transform(spans, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))

    names = F.array(*map(F.lit, KINDS))
    rows = stored.withColumn("base", base)
    return rows.select("doc_id", F.transform(plain(F.concat("base", more)), lambda x: F.struct(
        F.get(names, x.kind).alias("kind"), x.start.alias("start"), x.end.alias("end"))).alias("spans"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", *map(counted, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
