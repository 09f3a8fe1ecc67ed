import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from plumbline.operators import duplicates, facts, frequencies, inspection, outliers, profile, sampling
from plumbline.operators.quantiles import quantiles, quantiles_and, quantiles_of_many

NAN, INF = float("nan"), float("inf")


def by_column(frame):
    return {r["column"]: r for r in frame.collect()}


@pytest.fixture
def smoke(table):
    return table("Age double, Cabin string, Embarked string, Survived int",
                 [(22.0, None, "S", 0), (None, None, "C", 0), (35.0, "E46", "Q", 1), (35.0, "E46", "Q", 1)])


def test_smoke_profile(smoke):
    row = profile.dataset_profile(smoke).first()
    assert (row.rows, row.columns, row.missing_percentage, row.duplicate_rows) == (4, 4, 18.75, 1)
    columns = by_column(profile.column_profile(smoke))
    assert columns["Age"].missing_percentage == 25 and columns["Age"].unique_count == 2
    assert columns["Cabin"].missing_percentage == 50 and columns["Cabin"].unique_count == 1
    age = by_column(profile.numeric_describe(smoke))["Age"]
    assert age["count"] == 3 and round(age["mean"], 3) == 30.667 and round(age["std"], 4) == 7.5056
    assert (age.q25, age.q50, age.q75, age["min"], age["max"]) == (28.5, 35, 35, 22, 35)


def test_results_do_not_depend_on_partitioning(smoke):
    def results(df):
        return (sorted(map(tuple, profile.column_profile(df).collect())),
                sorted(map(tuple, frequencies.top_values(df).collect())),
                sorted(map(tuple, duplicates.drop_duplicates(df).collect()), key=str))
    expected = results(smoke)
    for n in (1, 7, 50):
        assert results(smoke.repartition(n)) == expected


@pytest.mark.parametrize("kind", ["uniform", "heavy", "mixed", "constant", "extreme"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = random.Random(kind)
    values = {
        "uniform": [rng.random() for _ in range(5000)],
        "heavy": [rng.choice([1.0, 2.0]) for _ in range(4000)],
        "mixed": [1.0] * 2000 + [rng.gauss(0, 1e6) for _ in range(2500)] + [5.0] * 700,
        "constant": [3.5] * 1000,
        "extreme": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    expected = np.quantile(values, probabilities)
    # The default, a coarse sketch with wide brackets, and brackets so narrow that they miss.
    for options in ({}, {"sketch_size": 16, "margin": 0.2}, {"sketch_size": 8, "margin": 0.0}):
        assert np.allclose(quantiles(df, {"v": F.col("v")}, probabilities, **options)["v"], expected, rtol=1e-12, atol=0), options


def test_quantiles_of_several_columns_with_infinities(spark):
    rng = random.Random(5)
    rows = [(rng.choice([INF, -INF, rng.random()]), i % 3, None if i % 4 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(5)
    columns, probabilities = {c: F.col(c) for c in "abc"}, [0.0, 0.5, 1.0]
    for options in ({}, {"sketch_size": 8, "margin": 0.01}):
        got, beside = quantiles_and(df, columns, probabilities, [F.sum("b"), F.lit("x")], **options)
        for k, c in enumerate("abc"):
            values = sorted(r[k] for r in rows if r[k] is not None)
            low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
            assert got[c] == [values[0], low if low == high else (low + high) / 2, values[-1]]
        assert tuple(beside) == (sum(r[1] for r in rows), "x")


def test_quantiles_of_many_tables(spark):
    rng = random.Random(8)
    frames = [spark.createDataFrame([(rng.gauss(0, 10.0 ** k), None if i % 3 else i) for i in range(900 + k)], "x double, y int").repartition(3) for k in range(3)]
    tables = [(df, {c: F.col(c) for c in names}) for df, names in zip([*frames, frames[0]], ["xy", "x", "y", ""])]
    for options in ({}, {"sketch_size": 8, "margin": 0.0}):
        got = quantiles_of_many(tables, [0.25, 0.5, 0.9], **options)
        assert got == [quantiles(df, columns, [0.25, 0.5, 0.9]) for df, columns in tables]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, {"v": F.col("v")}, [0.5])["v"] is None


def test_infinity_is_an_outlier_and_missing_is_not(table):
    df = table("x double", [(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0, INF, NAN, None)])
    fences = outliers.fit_fences(df, ["x"])
    row = outliers.outlier_counts(df, fences).first()
    assert (row.outliers, row.present) == (2, 6)
    records = inspection.outlier_records(df, "x", fences["x"]).collect()
    assert [(r.source_row, r.value) for r in records] == [(6, "100.0"), (7, "Infinity")]


def test_fence_bounds_and_tolerance(table):
    values = (2200.0, 2700.0, 3000.0, 3200.0, 3500.0, 4000.0, 4200.0, 4500.0, 5000.0, 5200.0, 25000.0)
    df = table("income double", [(v,) for v in values] + [(NAN,)])
    fences = outliers.fit_fences(df, ["income"])
    row = outliers.outlier_counts(df, fences).first()
    assert (row.outliers, row.present) == (1, 11)
    all_inf = table("x double", [(INF,), (NAN,)])
    assert outliers.outlier_counts(all_inf, outliers.fit_fences(all_inf, ["x"])).first().outliers == 1
    huge = outliers.fences_from_quartiles(-1.7e308, 1.7e308)
    assert math.isfinite(huge["lower"]) and math.isfinite(huge["upper"])


def test_histogram_matches_numpy(table):
    rng = random.Random(3)
    values = [float(rng.randint(1, 50)) for _ in range(2000)] + [rng.random() * 7 for _ in range(500)]
    df = table("v double, i int", [(v, int(v)) for v in values])
    rows = profile.histograms(df).orderBy("column", "bin").collect()
    for name, data in (("v", np.array(values)), ("i", np.array([float(int(v)) for v in values]))):
        scale = max(abs(data).max(), 1.0)
        counts, edges = np.histogram(data / scale, bins=24, range=((data / scale).min(), (data / scale).max()))
        mine = [r for r in rows if r["column"] == name]
        assert [r["count"] for r in mine] == counts.tolist()
        assert np.allclose([r.low for r in mine], edges[:-1] * scale)


def test_visual_summary_fixture(table):
    rows = list(zip((-2.0, -1.0, 0.0, 1.0, 2.0, INF, NAN), (4.0, 2.0, 0.0, -2.0, -4.0, 100.0, INF),
                    [3.0] * 7, (True, False, True, False, True, False, True)))
    df = table("a double, b double, constant double, flag boolean", rows)
    histogram = [r for r in profile.histograms(df).orderBy("bin").collect() if r["column"] == "a"]
    assert sum(r["count"] for r in histogram) == 5
    assert [r.bin for r in histogram if r["count"]] == [0, 6, 12, 18, 23]
    assert (histogram[0].low, histogram[-1].high) == (-2, 2)
    names = {r["column"] for r in profile.histograms(df).collect()}
    assert names == {"a", "b", "constant"}
    pairs = {(r.a, r.b): r for r in profile.correlations(df).collect()}
    assert math.isclose(pairs[("a", "b")].r, -1) and pairs[("a", "b")].pairs == 5
    assert not any("constant" in p for p in pairs) and ("a", "flag") in pairs


def test_correlation_matches_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    data["b"] += data["a"]
    data.loc[::7, "c"] = np.nan
    expected = data.corr(min_periods=3)
    data["d"] *= 1e200
    df = spark.createDataFrame(data)
    for r in profile.correlations(df).collect():
        assert math.isclose(r.r, expected.loc[r.a, r.b], rel_tol=1e-9, abs_tol=1e-12)
        assert r.pairs == (data[r.a].notna() & data[r.b].notna()).sum()


def test_all_rows_and_all_columns(spark):
    """26 columns: the former cut after the 24th lost columns without a word."""
    df = spark.range(10_021).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(26)])
    sums = profile.histograms(df).groupBy("column").agg(F.sum("count").alias("n")).collect()
    assert len(sums) == 26 and {r.n for r in sums} == {10_021}


@pytest.mark.parametrize("schema,rows", [
    ("x int, y int", [(1, None), (None, 2), (3, 4)]),
    ("x double, y double", []),
    ("x string, y string", [("a", "b")]),
    ("x double, y double", [(INF, NAN), (-INF, None)]),
    ("x double, y double", [(1.7976931348623157e308, 1.0), (1.7976931348623157e308, 2.0)]),
])
def test_edge_inputs_do_not_fail(table, schema, rows):
    df = table(schema, rows)
    for r in profile.histograms(df).collect():
        assert math.isfinite(r.low) and math.isfinite(r.high)
    profile.correlations(df).collect()
    profile.numeric_describe(df).collect()
    profile.column_profile(df).collect()
    profile.dataset_profile(df).collect()


def test_names_survive_quoting(table):
    name = "<script>$\\unknown{value}$</script>"
    df = table(f"`{name}` string, `a.b` double, `back``tick` int", [(name, 1.0, 1), (name, 2.0, 2), (name, 0.0, 0)])
    assert {r["column"] for r in profile.column_profile(df).collect()} == {name, "a.b", "back`tick"}
    assert by_column(frequencies.top_values(df))[name].value == name
    assert by_column(profile.numeric_describe(df))["a.b"]["mean"] == 1
    assert profile.correlations(df).first().r == pytest.approx(1)


def test_plot_choices(table):
    df = table("amount int, volume int, `group` string, other string, row_id int",
               [(10 * i, 20 * i, "ab"[i % 2], "xyz"[i % 3], i) for i in range(1, 7)])
    columns = profile.column_profile(df)
    assert [r["column"] for r in profile.numeric_plot_columns(columns, None, ["volume"]).collect()] == ["volume", "amount"]
    assert [r["column"] for r in profile.category_plot_columns(columns).collect()] == ["group", "other"]
    best = profile.strongest_pair(profile.correlations(df.drop("row_id"))).first()
    assert best.r == pytest.approx(1) and best.pairs == 6
    shown = profile.correlation_plot_columns(columns, "volume")
    assert [r["column"] for r in shown.collect()] == ["volume", "amount"]
    assert profile.strongest_pair(profile.correlations(df), shown).first().a == "amount"


def test_json_values(table):
    import datetime
    from plumbline.functions.columns import field_of, json_value
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = table("d double, b binary, t timestamp_ntz, a array<double>, m map<string,double>, s struct<b:binary,t:timestamp_ntz>",
               [(INF, b"\x0f", moment, [1.0, NAN, None], {"k": INF}, (b"\xff", moment.replace(microsecond=7))),
                (2.5, None, None, None, None, None)])
    first, second = df.orderBy("_row").select(
        *[json_value(c, field_of(df, c).dataType).alias(c) for c in df.columns[:-1]]).collect()
    assert tuple(first) == (None, "0f", "2024-01-02T03:04:05", "[1.0,null,null]", '{"k":null}',
                            '{"b":"ff","t":"2024-01-02T03:04:05.000007"}')
    assert tuple(second) == ("2.5", None, None, None, None, None)


NESTED = T.StructType([
    T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("l", T.ArrayType(T.DoubleType())),
    T.StructField("s", T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])),
    T.StructField("_row", T.LongType()),
])


def test_nested_equality(spark):
    rows = [
        ({"a": 1, "b": 2}, [1.0, NAN], (1, "q"), 0),
        ({"a": 1, "b": 2}, [1.0, NAN], (1, "q"), 1),
        ({"a": 1, "b": 2}, [1.0, NAN], (1, "q"), 2),     # gets another entry order below
        ({"a": 1, "b": 2}, [1.0, None], (1, "q"), 3),    # NaN is not null inside
        ({}, [], (None, None), 4),
        (None, None, None, 5),                            # null is not empty
        (None, None, None, 6),
    ]
    df = spark.createDataFrame(rows, NESTED)
    df = df.withColumn("m", F.when(F.col("_row") == 2, F.expr("map('b', 2, 'a', 1)")).when(
        F.col("_row") < 4, F.expr("map('a', 1, 'b', 2)")).otherwise(F.col("m")))
    counts = duplicates.duplicate_count(df).first()
    assert (counts.rows, counts.duplicate_rows) == (7, 2)
    kept = duplicates.drop_duplicates(df)
    assert kept.schema["m"].dataType == NESTED["m"].dataType
    assert sorted(r._row for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert {r._row: r.m for r in kept.collect()}[0] == {"a": 1, "b": 2}
    pairs = {(r.removed_row, r.kept_row) for r in duplicates.duplicate_pairs(df).collect()}
    assert pairs == {(1, 0), (6, 5)}
    assert by_column(frequencies.distinct_counts(df))["m"].distinct_count == 3
    assert by_column(frequencies.distinct_counts(df))["s"].distinct_count == 2


def test_nested_duplicate_fixture(table):
    df = table("nested array<bigint>, x int", [([1, 2], 1), ([1, 2], 1), (None, 2), (None, 2)])
    pairs = duplicates.duplicate_pairs(df).orderBy("removed_row").collect()
    assert [(r.removed_row + 2, r.kept_row + 2) for r in pairs] == [(3, 2), (5, 4)]


@pytest.mark.parametrize("salts", [1, 50])
def test_duplicate_pairs_hot_and_cold(spark, monkeypatch, salts):
    monkeypatch.setattr(duplicates, "SALTS_PER_TASK", salts)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("x" * 80)).alias("t"),
        F.col("id").alias("_row"))
    first, expected = {}, set()
    for r in df.orderBy("_row").collect():
        kept = first.setdefault((r.k, r.t), r._row)
        if kept != r._row:
            expected.add((r._row, kept))
    pairs = [(r.removed_row, r.kept_row) for r in duplicates.duplicate_pairs(df).collect()]
    assert len(pairs) == len(expected) and set(pairs) == expected
    assert duplicates.duplicate_count(df).first().duplicate_rows == len(expected)


def test_pair_values(table):
    df = table("city string, value int", [(" SP ", 10), ("sp", None), (" SP ", 10)])
    pairs = duplicates.duplicate_pairs(df)
    rows = {r["column"]: (r.kept, r.removed) for r in duplicates.pair_values(df, pairs).collect()}
    assert rows == {"city": ("' SP '", "' SP '"), "value": ("10", "10")}


def test_long_texts_come_back_whole(table):
    long = "lorem " * 50
    df = table("t string", [(long,), (long,), ("b",), (long + "x",)])
    rows = frequencies.top_values(df, ["t"]).orderBy("rank").collect()
    assert (rows[0].value, rows[0].n) == (long, 2) and {r.value for r in rows[1:]} == {"b", long + "x"}
    assert by_column(frequencies.distinct_counts(df))["t"].distinct_count == 3


def test_ties_by_first_appearance_or_value(table):
    df = table("t string", [("z",), ("a",), ("z",), ("a",), ("m",)])
    assert [r.value for r in frequencies.top_values(df, ["t"], 3, "_row").orderBy("rank").collect()] == ["z", "a", "m"]
    assert [r.value for r in frequencies.top_values(df, ["t"]).orderBy("rank").collect()] == ["a", "z", "m"]


def test_mode(table):
    df = table("v int, d double, t string", [(3, NAN, None), (1, NAN, "b"), (1, NAN, "a"), (3, None, "a"), (9, None, "b")])
    assert frequencies.most_frequent(df, "v") == 1
    assert frequencies.most_frequent(df, "d") is None
    assert frequencies.most_frequent(df, "t") == "a"


def test_text_variants_and_number_texts(table):
    df = table("v string, n string, clean string",
               [(" SP ", "1", "a"), ("sp", "2.5", "b"), ("SP", "x", "c"), (None, None, None)] + [("q", "7", "d")] * 8)
    assert by_column(facts.text_variant_columns(df)).keys() == {"v"}
    columns = by_column(facts.column_facts(df).withColumn("text_numbers", profile.numbers_as_text()))
    assert columns["n"].text_numbers and not columns["v"].text_numbers
    assert columns["n"].numeric_texts == 10


def test_mixed_variants(spark):
    df = spark.createDataFrame(
        [(json.dumps(v), json.dumps(w)) for v, w in ((1, 1), (2.5, "x"), (None, True), (3, {"a": 1}))],
        "a string, b string").select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    rows = by_column(facts.column_facts(df))
    assert (rows["a"].mixed, rows["b"].mixed, rows["a"].missing) == (False, True, 1)
    assert {r["column"]: r.kinds for r in facts.mixed_type_columns(df).collect()} == {"b": 4}


def test_constant_columns(table):
    df = table("a int, b string, c double, d array<int>", [(1, None, NAN, [1]), (1, None, 2.0, [1]), (None, None, 2.0, [2])])
    rows = by_column(facts.column_facts(df))
    assert [rows[c].constant for c in "abcd"] == [True, True, True, False]


def test_category_share(table):
    df = table("city string, x string", [("SP", "a"), ("SP", "b"), ("RJ", "c"), (None, "d")])
    rows = {r.label: r["count"] for r in inspection.category_share(df, "city").collect()}
    assert rows == {"SP": 2, "RJ": 1, "Missing values": 1}
    many = table("x string", [(c,) for c in "abcdefgh"])
    assert inspection.category_share(many, "x").collect() == []
    floats = table("x double", [(1.0,), (NAN,), (None,), (1.0,)])
    assert {r.label: r["count"] for r in inspection.category_share(floats, "x").collect()} == {"1.0": 2, "Missing values": 2}


def test_large_inspection(spark):
    df = spark.range(12_001).select(
        F.when(F.col("id") == 12_000, 1e6).otherwise(F.col("id").cast("double")).alias("x"), F.col("id").alias("_row"))
    box = inspection.box_statistics(df, ["x"]).first()
    assert box.outliers == 1 and box.finite_count == 12_001 and box.whisker_high == 11_999
    sample = [r.row for r in sampling.sample_values(df, "x").collect()]
    assert len(sample) == 10_000 and sample == [r.row for r in sampling.sample_values(df.repartition(50), "x").collect()]
    assert sample == sorted(sample)


def test_sample_cut_is_exact(spark):
    df = spark.range(50_000).select(F.col("id").alias("_row"))
    picked = {r._row for r in sampling.sample_rows(df, size=500).collect()}
    key = sampling.sample_key()
    expected = {r._row for r in df.withColumn("k", key).orderBy("k").limit(500).collect()}
    assert picked == expected


def test_records_and_positions(table):
    df = table("x double", [(NAN,), (1.0,), (None,), (2.0,)])
    records = inspection.missing_records(df, "x")
    assert [r.source_row for r in records.collect()] == [2, 4]
    later = df.where("_row > 0")
    placed = inspection.positions(later, inspection.missing_records(later, "x")).first()
    assert (placed.source_row, placed.row) == (4, 2)
    assert inspection.most_missing(df).first().missing == 2
    assert profile.missing_ranking(facts.column_facts(df)).first().missing_percentage == 50


def test_before_and_after(table):
    df = table("city string", [(" SP ",), ("sp",)])
    from plumbline.plans.preparation import Operation, apply
    after = apply(df, Operation("casefold", "city"))
    rows = inspection.before_and_after(lambda d: inspection.category_counts(d, "city"), df, after).collect()
    assert {(r.version, r.label, r["count"]) for r in rows} == {
        ("before", "' SP '", 1), ("before", "sp", 1), ("after", "sp", 2)}


def test_variants_are_kept_as_they_are(spark):
    df = spark.sql("""
        select cast(date'2024-01-01' as variant) as v, 0 as _row union all select parse_json('"2024-01-01"'), 1
        union all select parse_json('{"a": 1, "b": "x 1.0"}'), 2 union all select parse_json('{"b": "x 1.0", "a": 1.0}'), 3
        union all select parse_json('{"b": "x 1", "a": 1.0}'), 4 union all select cast(array(double('-0.0'), 2D) as variant), 5
        union all select parse_json('[0, 2]'), 6 union all select cast(timestamp'2024-01-01 00:00:00.000001' as variant), 7
        union all select cast(timestamp'2024-01-01 00:00:00.000002' as variant), 8 union all select null, 9 union all select parse_json('null'), 10""")
    kept = {r._row: r.kind for r in duplicates.drop_duplicates(df).selectExpr("_row", "schema_of_variant(v) as kind").collect()}
    assert {i: k for i, k in kept.items() if i in (0, 1, 7, 8)} == {0: "DATE", 1: "STRING", 7: "TIMESTAMP", 8: "TIMESTAMP"}
    assert sorted(kept) == [0, 1, 2, 4, 5, 7, 8, 9]
    assert {(r.removed_row, r.kept_row) for r in duplicates.duplicate_pairs(df).collect()} == {(3, 2), (6, 5), (10, 9)}


def test_nested_floats_are_compared_by_value_and_kept(spark):
    df = spark.sql("""
        select array(named_struct('x', double('-0.0'), 'm', map('k', float('NaN')))) as n, 0 as _row
        union all select array(named_struct('x', 0D, 'm', map('k', float('NaN')))), 1 union all select array(named_struct('x', 0D, 'm', map('k', null))), 2""")
    kept = {r._row: r for r in duplicates.drop_duplicates(df).select("_row", F.col("n")[0]["x"].cast("string").alias("x"), F.col("n")[0]["m"]["k"].alias("k")).collect()}
    assert sorted(kept) == [0, 2] and kept[0].x == "-0.0" and kept[0].k != kept[0].k and kept[2].k is None
    assert frequencies.distinct_counts(df, row_id="_row").first().distinct_count == 2
    assert duplicates.duplicate_count(df, "_row").first().distinct_rows == 2


def test_missing_cells_are_in_no_bin(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (NAN,), (INF,), (10.0,)], "x double")
    assert {r.bin: r["count"] for r in profile.histograms(df).where("count > 0").collect()} == {0: 1, 2: 1, 23: 1}
