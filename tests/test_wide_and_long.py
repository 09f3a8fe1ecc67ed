"""Many columns, long labels, instants: nothing is cut, no digest stands for a value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import comoments
from plumbline.operators.frequencies import distinct_counts, frequencies
from plumbline.operators.inspection import missing_by_column
from plumbline.operators.profile import correlations, histograms
from plumbline.plans.context import UsageContext
from plumbline.plans.dimensions import class_distribution, rare_classes


def test_thirty_numeric_columns(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 31).alias(f"c{i}") for i in range(30)])
    assert histograms(df).select("column").distinct().count() == 30
    assert correlations(df).count() == 30 * 29 // 2
    assert histograms(df, names=["c3"]).select("column").distinct().count() == 1


def test_five_hundred_columns_with_missing_cells(spark):
    draw = np.random.default_rng(4)
    data = pd.DataFrame(draw.normal(size=(90, 500)) * 10.0 ** draw.integers(-5, 6, 500) + draw.integers(-3, 4, 500)).mask(draw.random((90, 500)) < 0.4)
    data[7] = data[7].where(data[7].isna(), 3.0).where(data[8].notna(), 9.0)  # varies, but not where column 8 is present
    data[9] = [1.0, 2.0] + [None] * 88
    data.columns = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(data).repartition(5)
    expected, present = data.corr(min_periods=3).to_numpy(), data.notna().to_numpy().astype(int)
    common = present.T @ present
    found = correlations(df).toPandas()
    assert len(found) == 500 * 499 // 2
    a, b = (found[c].str[1:].astype(int).to_numpy() for c in "ab")
    assert (found["pairs"].to_numpy() == common[a, b]).all()
    assert np.allclose(found["r"].to_numpy(float), expected[a, b], rtol=0, atol=1e-9, equal_nan=True)
    assert np.isnan(found["r"][((a == 7) & (b == 8)) | (a == 9)]).all()


def test_correlations_strip_by_strip(spark):
    draw = np.random.default_rng(6)
    data = pd.DataFrame(draw.normal(size=(200, 23))).mask(draw.random((200, 23)) < 0.2)
    data.columns = [f"c{i}" for i in range(23)]
    df = spark.createDataFrame(data).repartition(3)
    values = {c: f"nanvl({c}, null)" for c in data.columns}
    found = comoments.pair_correlations(df, values, 3, strip=10, group=3).toPandas()
    expected = data.corr(min_periods=3)
    assert len(found) == 23 * 22 // 2 and all(data.columns.get_loc(r.a) < data.columns.get_loc(r.b) for r in found.itertuples())
    assert all(abs(expected.loc[r.a, r.b] - r.r) < 1e-9 for r in found.itertuples())


def test_long_labels(table):
    long = "x" * 100
    df = table("label string", [(long,)] * 30 + [("a",)] * 2 + [("b" * 70,)])
    shown = {r.label: r["count"] for r in class_distribution(df, "label").where("slot = 'class'").collect()}
    assert shown == {long: 30, "a": 2, "b" * 70: 1}
    assert [r.label for r in rare_classes(df, "label").collect()] == ["b" * 70]


def test_instants_of_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(2).select((F.lit(1730611800) + F.col("id") * 3600).cast("timestamp").alias("at"))
        assert distinct_counts(df).first().distinct_count == 2
        assert sorted(r.key for r in frequencies(df).collect()) == ["2024-11-03T01:30:00-04:00", "2024-11-03T01:30:00-05:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_table_without_data_columns(table):
    assert missing_by_column(table("a int", [(1,)]).drop("a"), row_id="_row").collect() == []


@pytest.mark.parametrize("answers", [{}, {"origin": True}, {"unknown": True}])
def test_checklists_are_whole(answers):
    with pytest.raises(ValueError):
        UsageContext(provenance=answers)


def test_frequencies_of_every_type(spark):
    df = spark.sql("""
        select * from values
          (1Y, true, date'2024-02-29', timestamp'2024-02-29 01:02:03.000004', 0.1F, -0.0D, 1.50BD, 'a', X'0a', array(1, null)),
          (1Y, false, date'1969-12-31', timestamp'1969-12-31 23:59:59', 0.1F, 0.0D, 1.50BD, 'a', X'0a', array(1, null)),
          (null, null, null, null, float('NaN'), double('NaN'), null, null, null, null)
        as t(i, b, d, t, f, r, n, s, x, a)""").selectExpr("*", "cast(t as timestamp_ntz) as z", "repeat('é', 100) as l")
    found = {(r.column, r.key): r.n for r in frequencies(df, whole_texts=True).collect()}
    assert found == {
        ("i", "1"): 2, ("b", "true"): 1, ("b", "false"): 1, ("d", "2024-02-29"): 1, ("d", "1969-12-31"): 1,
        ("t", "2024-02-29T01:02:03.000004"): 1, ("t", "1969-12-31T23:59:59"): 1, ("f", "0.1"): 2, ("r", "0.0"): 2, ("n", "1.50"): 2,
        ("s", "a"): 2, ("x", "0a"): 2, ("a", "[1,null]"): 2, ("z", "2024-02-29T01:02:03.000004"): 1, ("z", "1969-12-31T23:59:59"): 1, ("l", "é" * 100): 3}
    assert {r.column: r.distinct_count for r in distinct_counts(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)
