import math

import pytest
from pyspark.sql import functions as F

from plumbline.plans.evaluate import compare
from plumbline.plans.context import UsageContext
from plumbline.plans.preparation import ACTIONS, Operation, apply, audit, examples, fit
from plumbline.plans.recipe import NoChange, Recipe

NAN, INF = float("nan"), float("inf")


def column(df, name):
    return [r[name] for r in df.orderBy("_row").collect()]


@pytest.fixture
def base(table):
    return table("age double, city string, target int",
                 [(20.0, " SP ", 0), (30.0, "sp", 1), (40.0, None, 0), (NAN, "RJ", 1)])


def fitted(df, action, name=None, **parameters):
    return fit(df, Operation(action, name, parameters))


def test_median_then_minmax(base):
    step = fitted(base, "fill_median", "age")
    assert step.parameters == {"value": 30}
    filled = apply(base, step)
    assert column(filled, "age") == [20, 30, 40, 30]
    assert audit(base, step).first().changed_cells == 1
    assert column(apply(filled, fitted(filled, "minmax", "age")), "age") == [0, 0.5, 1, 0.5]


def test_text_and_missing(base):
    step = fitted(base, "casefold", "city")
    assert column(apply(base, step), "city") == ["sp", "sp", None, "rj"]
    assert audit(base, step).first().changed_cells == 2
    assert column(apply(base, fitted(base, "trim", "city")), "city") == ["SP", "sp", None, "RJ"]
    dropped = fitted(base, "drop_missing", "age")
    assert audit(base, dropped).first().removed_rows == 1 and apply(base, dropped).count() == 3
    assert audit(base, fitted(base, "fill_mode", "target")).first().changed_cells == 0


def test_mode_fills_text(table):
    df = table("city string", [("b",), (None,), ("a",), ("b",), (None,)])
    assert column(apply(df, fitted(df, "fill_mode", "city")), "city") == ["b", "b", "a", "b", "b"]


def test_outliers(table):
    df = table("x double, y int", [(v, i) for i, v in enumerate((1.0, 2.0, 3.0, 4.0, 100.0, NAN))])
    clip = fitted(df, "clip_outliers", "x")
    assert audit(df, clip).first().changed_cells == 1
    assert column(apply(df, clip), "x") == [1, 2, 3, 4, 7, None]
    shown = examples(df, clip).collect()
    assert [(r.source_row, r.before, r.after) for r in shown] == [(6, "100.0", "7.0")]
    drop = fitted(df, "drop_outliers", "x")
    assert column(apply(df, drop), "y") == [0, 1, 2, 3, 5]
    assert examples(df, drop).first().after == "Row removed"


def test_clipped_values_are_no_outliers_again(table):
    values = (2200.0, 2700.0, 3000.0, 3200.0, 3500.0, 4000.0, 4200.0, 4500.0, 5000.0, 5200.0, 25000.0, NAN)
    df = table("income double", [(v,) for v in values])
    from plumbline.operators.outliers import fit_fences, outlier_counts
    clipped = apply(df, fitted(df, "clip_outliers", "income"))
    for prepared in (clipped, apply(clipped, fitted(clipped, "minmax", "income")),
                     apply(clipped, fitted(clipped, "standardize", "income"))):
        assert outlier_counts(prepared, fit_fences(prepared)).first().outliers == 0


def test_fitted_parameters_apply_to_new_data(table, base):
    train = table("x double", [(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0)])
    new = table("x double", [(1.0,), (10.0,), (1e308,)])
    assert column(apply(new, fitted(train, "drop_outliers", "x")), "x") == [1]
    scale = fitted(base, "minmax", "age")
    ages = table("age double", [(25.0,), (50.0,), (NAN,)])
    assert column(apply(ages, scale), "age") == [0.25, 1.5, None]
    standard = [v for v in column(apply(base, fitted(base, "standardize", "age")), "age") if v is not None]
    assert sum(standard) == pytest.approx(0) and sum(v * v for v in standard) / 3 == pytest.approx(1)


@pytest.mark.parametrize("values", [(-1e308, 0.0, 1e308), (1e-300, 2e-300, 3e-300)])
def test_extreme_magnitudes(table, values):
    df = table("x double", [(v,) for v in values])
    assert column(apply(df, fitted(df, "minmax", "x")), "x") == pytest.approx([0, 0.5, 1])
    assert all(math.isfinite(v) for v in column(apply(df, fitted(df, "standardize", "x")), "x"))
    assert fitted(df, "fill_median", "x").parameters["value"] == values[1]


@pytest.mark.parametrize("kind,values", [
    ("double", (1.0, INF)), ("double", (1.0, 1.0)), ("double", (NAN, NAN)),
    ("boolean", (True, False)), ("string", ("1", "2"))])
@pytest.mark.parametrize("action", ["minmax", "standardize"])
def test_scaling_refuses(table, kind, values, action):
    df = table(f"x {kind}", [(v,) for v in values])
    with pytest.raises(ValueError):
        fitted(df, action, "x")


def test_integer_median_is_a_double(table):
    df = table("x bigint", [(1,), (2,), (None,)])
    assert column(apply(df, fitted(df, "fill_median", "x")), "x") == [1.0, 2.0, 1.5]


def test_guards(table, base):
    nested = table("n array<int>, v double", [([1], None)])
    for df, operation in (
            (base, Operation("sort", "age")), (base, Operation("trim", "nope")), (base, Operation("trim", "age")),
            (nested, Operation("fill_mode", "n")), (nested, Operation("trim", "n")),
            (nested, Operation("fill_median", "v")), (nested, Operation("fill_mode", "v")),
            (base, Operation("fill_median", "city")),
            (base, Operation("minmax", "age", {"magnitude": 1.0, "offset": 0.0, "divisor": 0.0}))):
        with pytest.raises(ValueError):
            fit(df, operation)
    for action in ACTIONS:
        if action != "duplicates":
            with pytest.raises(ValueError, match="protected|text|numerical"):
                fit(base, Operation(action, "target"), target="target")
    fit(base, Operation("duplicates"), target="target")
    with pytest.raises(ValueError, match="every row"):
        gone = table("x double, y int", [(NAN, 1), (None, 2)])
        Recipe.fit(gone, [Operation("drop_missing", "x")])
    with pytest.raises(Exception, match="infinity"):
        apply(table("x double", [(INF,)]), Operation("clip_outliers", "x", {"lower": 0.0, "upper": 1.0})).collect()
    with pytest.raises(Exception, match="numerical range"):
        apply(table("x double", [(1e308,)]),
              Operation("minmax", "x", {"magnitude": 1e-5, "offset": 0.0, "divisor": 1.0})).collect()


def test_duplicate_examples(table):
    df = table("x int, label int", [(10, 0), (20, 1), (10, 0), (10, 0)])
    rows = examples(df, fitted(df, "duplicates")).orderBy("source_row").collect()
    assert [(r.source_row, r.matched_source_row) for r in rows] == [(4, 2), (5, 2)]
    assert rows[0].before == "x=10; label=0"


def test_lineage_undo_and_reset(table):
    df = table("x double, city string", [(1.0, "a"), (NAN, "gone"), (2.0, "b"), (1.0, "a"), (1.0, "a")])

    def source_rows(recipe):
        return [v + 2 for v in column(recipe.apply(df), "_row")]

    recipe = Recipe.fit(df, [Operation("drop_missing", "x")])
    assert source_rows(recipe) == [2, 4, 5, 6]
    recipe = recipe.add(df, Operation("duplicates"))
    assert source_rows(recipe) == [2, 4]
    assert [s.removed_rows for s in recipe.steps] == [1, 2]
    assert source_rows(recipe.undo()) == [2, 4, 5, 6]
    assert source_rows(recipe.reset()) == [2, 3, 4, 5, 6]


def test_text_then_duplicates(table):
    df = table("city string, value int", [(" SP ", 10), ("sp", 10)])
    recipe = Recipe.fit(df, [Operation("casefold", "city"), Operation("duplicates")])
    assert recipe.apply(df).count() == 1
    assert column(df, "city") == [" SP ", "sp"]


def test_recipe_rules(base):
    with pytest.raises(NoChange):
        Recipe.fit(base, [Operation("fill_mode", "target")])
    skipped = Recipe.fit(base, [Operation("fill_mode", "target"), Operation("trim", "city")], skip_unchanged=True)
    assert [s.operation.action for s in skipped.steps] == ["trim"]
    assert skipped.with_target("age").steps == () and skipped.with_target(None) is skipped
    with pytest.raises(ValueError, match="target"):
        Recipe(skipped.steps, "city")


def test_recipe_round_trip(base):
    recipe = Recipe.fit(base, [Operation("fill_median", "age"), Operation("standardize", "age"),
                               Operation("casefold", "city")], target="target")
    again = Recipe.from_json(recipe.to_json())
    assert again == recipe
    assert column(again.apply(base), "age") == column(recipe.apply(base), "age")


@pytest.mark.parametrize("action,name", [("trim", "city"), ("casefold", "city"), ("clip_outliers", "age"), ("duplicates", None)])
def test_applying_twice_changes_nothing(base, action, name):
    step = fitted(base, action, name)
    once = apply(base, step)
    assert audit(once, step).first().affected_rows == 0


def test_partitioning_does_not_matter(base):
    operations = [Operation("fill_median", "age"), Operation("casefold", "city"), Operation("minmax", "age")]
    expected = Recipe.fit(base, operations)
    for n in (1, 7, 50):
        again = Recipe.fit(base.repartition(n), operations)
        assert again == expected
        assert column(again.apply(base.repartition(n)), "age") == column(expected.apply(base), "age")


def test_compare(base):
    recipe = Recipe.fit(base, [Operation("fill_median", "age"), Operation("casefold", "city")])
    rows = {r.dimension: r for r in compare(base, recipe.apply(base), UsageContext("x")).collect()}
    assert rows["Completeness"].delta > 0 and rows["Consistency"].prepared > rows["Consistency"].original
    assert rows["Provenance"].delta == 0 and rows["Class Balance"].original is None
    assert rows["Overall"].prepared > rows["Overall"].original


def test_stream_equals_batch(spark, base, tmp_path):
    from plumbline.streaming import apply_to_stream, write_prepared
    recipe = Recipe.fit(base, [
        Operation("fill_median", "age"), Operation("clip_outliers", "age", {"lower": 25.0, "upper": 35.0}),
        Operation("casefold", "city"), Operation("drop_missing", "city")])
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_prepared(stream, recipe, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out")).orderBy("_row").collect()
    assert written == recipe.apply(base).orderBy("_row").collect()
    with pytest.raises(ValueError):
        apply_to_stream(base, recipe)
    for refuse in (lambda: apply(stream, Operation("duplicates")), lambda: fit(stream, Operation("trim", "city")),
                   lambda: audit(stream, recipe.steps[0].operation), lambda: examples(stream, recipe.steps[0].operation)):
        with pytest.raises(ValueError):
            refuse()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_fitted_values_come_back_from_json(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("""
            select * from values
              (timestamp'2024-11-03 01:30:00.000007', timestamp_ntz'2024-11-03 01:30:00', date'2024-02-29', 1.10BD, X'00ff', interval '1' day, 'a', 0L),
              (timestamp'2024-11-03 01:30:00.000007', timestamp_ntz'2024-11-03 01:30:00', date'2024-02-29', 1.10BD, X'00ff', interval '1' day, 'a', 1L),
              (null, null, null, null, null, null, null, 2L) as t(ts, ntz, d, n, b, i, s, _row)""")
        recipe = Recipe.fit(df, [Operation("fill_mode", c) for c in ("ts", "ntz", "d", "n", "b", "i", "s")])
        again = Recipe.from_json(recipe.to_json())
        assert again == recipe
        for r in (recipe, again):
            filled = r.apply(df)
            assert filled.schema.simpleString() == df.schema.simpleString()
            assert filled.drop("_row").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_examples_name_rows_and_their_matches(table):
    df = table("a string, b int", [("x", 1), ("y", 2), ("x", 1), ("z", 3), ("x", 1)]).where("b <> 2")
    shown = [(r.row, r.source_row, r.before, r.after, r.matched_row, r.matched_source_row) for r in examples(df, Operation("duplicates")).collect()]
    assert shown == [(2, 4, "a=x; b=1", "Row removed", 1, 2), (4, 6, "a=x; b=1", "Row removed", 1, 2)]
    assert examples(df.where("a = 'z'"), Operation("duplicates")).count() == 0
