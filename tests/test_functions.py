import random

import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.functions.numbers import percentage, round2
from plumbline.functions.text import WHITESPACE, fold_sql, is_number_sql, quoted_sql, strip_sql


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_fold_equals_casefold_on_every_changing_character(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF
              and (chr(c).casefold() != chr(c) or chr(c).lower() != chr(c) or chr(c).isspace())]
    words = [f" {chr(c)}x{chr(c)}" for c in points]
    words += ["ΑΣ Σ", "Straße", "İx", "  A b ", "𐐀𐐁x", "ﬃ ß ΐ", ""]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select(
        "s", F.expr(fold_sql(strip_sql("s"))).alias("f"), F.expr(strip_sql("s")).alias("t")).collect()
    assert [r.s for r in rows if r.f != r.s.strip().casefold() or r.t != r.s.strip()] == []


def test_round2_equals_python_round(spark):
    values = [k / 800 for k in range(80001)]
    values += [i / t * 100 for t in range(1, 120) for i in range(t + 1)]
    rng = random.Random(1)
    values += [rng.random() * 100 for _ in range(5000)] + [281.26 / 4, 2.675, 3.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", F.expr(round2("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in rows if r.r != round(r.v, 2)] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**6)), min_size=1, max_size=40))
def test_percentage_equals_python(spark, pairs):
    rows = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a bigint, b bigint").select(
        "a", "b", F.expr(percentage("a", "b")).alias("p")).collect()
    assert all(r.p == round(float(r.a) / r.b * 100, 2) for r in rows)


def test_percentage_of_nothing(spark):
    row = spark.range(1).select(F.expr(percentage("0", "0", 0.0)).alias("a"),
                                F.expr(percentage("0", "0")).alias("b")).first()
    assert (row.a, row.b) == (0.0, 100.0)


def test_number_texts_agree_with_pandas(spark):
    words = ["1", "1.", "1.5", ".5", " 5 ", "1e5", "1e400", "1d", "1f", "1.5D", "nan", "inf",
             "-Infinity", "", "abc", "1,5", "+3", "1e-400", "0x10", "\t7\n", "1 2"]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select(
        "s", F.expr(is_number_sql("s")).alias("n"), F.expr(is_number_sql("s", ",")).alias("c")).collect()
    expected = pd.to_numeric(pd.Series(words), errors="coerce").notna()
    assert {r.s: bool(r.n) for r in rows} == dict(zip(words, map(bool, expected)))
    comma = {r.s: bool(r.c) for r in rows}
    assert comma["1,5"] and not comma["1.5"]


def test_padded_labels_are_quoted(spark):
    rows = spark.createDataFrame([(" SP ",), ("SP",)], "s string").select(F.expr(quoted_sql("s")).alias("q"))
    assert [r.q for r in rows.collect()] == ["' SP '", "SP"]
