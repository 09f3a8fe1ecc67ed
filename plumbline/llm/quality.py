"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Everything is one projection: no shuffle, no Python function. A document costs time in
proportion to its length (times a logarithm where windows repeat).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.columns import SPACE, WORD, documents, let, renewed

#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

#: Phrases of lines that belong to a site rather than to a text.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "cookie settings", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to our newsletter", "sign in to", "click here", "skip to content",
    "licensed under", "released under the", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """A line fails if one of these holds; blank lines pass.

    ``symbol_percent``: more than this share of its visible characters are symbols or braces.
    ``navigation_words``: separators (| » › · •) cut it into parts of at most so many words on
    average. ``bare_words``: from so many words on it has no punctuation mark at all.
    ``shout_words``: from so many words on it is in capitals only. ``phrases``: it contains
    one of them, whatever the case, and at most ``phrase_chars`` characters.
    A document is rejected if over ``lost_percent`` of its visible characters stand in
    failing lines or fewer than ``left_words`` words remain.
    """

    symbol_percent: int = 10
    navigation_words: int = 3
    bare_words: int = 20
    shout_words: int = 4
    phrases: tuple[str, ...] = BOILERPLATE
    phrase_chars: int = 300
    lost_percent: int = 30
    left_words: int = LEAST_WORDS


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more in the list.

    Windows are compared by a hash of their word hashes; equal neighbours in hash order are
    then compared word by word, so a hash collision counts nothing.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        def same(s: Column, a: Column, b: Column) -> Column:
            left, right = F.get(s, a), F.get(s, b)
            equal = F.forall(F.sequence(F.lit(0), F.lit(WINDOW - 1)),
                             lambda j: F.get(words, left.p + j) == F.get(words, right.p + j))
            return (left.h == right.h) & equal

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            again = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(s, k, k - 1)) | ((k < last) & same(s, k, k + 1)))
            return F.array_sort(F.transform(again, lambda k: F.get(s, k).p))

        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return let(ordered, lambda s: F.aggregate(
            positions(s), start,
            lambda a, p: F.struct((a.n + p + WINDOW - F.greatest(p, a.end)).alias("n"), (p + WINDOW).alias("end")), lambda a: a.n))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0))))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0)).cast("long")


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """The rules of one line. Each starts with a cheap test that ordinary lines end, and
    words are counted only for lines that a rule may concern."""
    marks, separators = r"[#*$%&<>{}~^=\\]", "[|»›·•]"

    def judged(n_words: Column) -> Column:
        symbols = line.rlike(marks) & (100 * F.regexp_count(line, F.lit(marks)) > rules.symbol_percent * visible(line))
        cut = let(F.regexp_count(line, F.lit(separators)), lambda n: (n > 0) & (n_words - n <= rules.navigation_words * (n + 1)))
        bare = (n_words >= rules.bare_words) & ~line.rlike(r"[.!?:;,…。]")
        shout = (n_words >= rules.shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
        return symbols | (line.rlike(separators) & cut) | bare | shout

    odd = line.rlike(r"[#*$%&<>{}~^=\\|»›·•]") | ~line.rlike(r"[.!?:;,…。]") | ~line.rlike(r"\p{Ll}")
    fails = odd & let(F.regexp_count(line, F.lit(WORD)), lambda n: (n > 0) & judged(n))
    if rules.phrases:
        fails = fails | ((F.length(line) <= rules.phrase_chars) & F.lower(line).rlike("|".join(rules.phrases)))
    return fails


def judged(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed``, ``kept``,
    ``n_failed_lines``, ``cleaned`` (the text without failing lines) and ``input`` (all
    columns of the row as a struct, so that no name can clash).

    A missing or empty text has no words and one empty line: all counts are 0, it fails the
    base rule. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), columns)
    rows = rows.withColumns({
        "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        "lines": F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), line_fails(x, rules).alias("fails")))})
    worded = F.filter(F.transform("lines", lambda x: x.line), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    passing = F.array_join(F.transform(F.filter("lines", lambda x: ~x.fails), lambda x: x.line), "\n")
    rows = rows.select(
        "doc_id", "input", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("lines", lambda x: x.fails)).cast("long").alias("n_failed_lines"),
        F.when(F.exists("lines", lambda x: x.fails), passing).otherwise(F.col("text")).alias("cleaned"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    lost = F.col("word_chars") - F.length(F.regexp_replace("cleaned", SPACE, ""))
    left = F.regexp_count("cleaned", F.lit(WORD))
    enough = (100 * lost <= rules.lost_percent * F.col("word_chars")) & (left >= rules.left_words)
    return rows.withColumn("kept", ~F.col("base_failed") & ((F.col("n_failed_lines") == 0) | enough))


def clean(docs: DataFrame, rules: LineRules = LineRules(), *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept rows with the columns of ``docs``; the text has lost its failing lines and
    ``length_col``, if there is such a column, is its new length in code points."""
    rows = judged(docs, rules, text_col=text_col)
    # A plain filter would be pushed below the projection that it reads and repeat all its work
    # inside other expressions; exploding the kept rows is evaluated once.
    kept = F.filter(F.array(F.struct("input", "cleaned", "kept")), lambda x: x.kept)
    rows = rows.select(F.explode_outer(kept).alias("row")).where("row is not null").select("row.*")
    values = {text_col: F.col("cleaned")}
    if length_col in docs.columns:
        values[length_col] = F.length("cleaned")
    return renewed(rows, docs, values)


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")
