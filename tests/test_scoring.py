import pytest

from plumbline.plans import metadata_audit
from plumbline.plans import dimensions as D
from plumbline.plans.context import UsageContext
from plumbline.plans.evaluate import evaluate, ordered_dimensions, score_many
from plumbline.plans.scoring import check_overrides, dimension_scores, scorecard, task_weights, weighted_dimensions

INF = float("inf")
ALL_DOCUMENTED = dict(
    documentation=dict.fromkeys(UsageContext().documentation, True),
    provenance=dict.fromkeys(UsageContext().provenance, True))


def indicator_frame(spark, scores):
    return spark.createDataFrame(
        [("d", name, 0, "i", 0, 1, float(value), 1.0, True) for name, value in scores.items()],
        "dataset_id string, dimension string, position int, indicator string, numerator bigint, "
        "denominator bigint, value double, weight double, applicable boolean")


def card(spark, scores, task="classification", weights=None):
    return scorecard(dimension_scores(indicator_frame(spark, scores)), task_weights(spark, task, weights)).first()


@pytest.fixture
def smoke(table):
    return table("Age double, Cabin string, Embarked string, Survived int",
                 [(22.0, None, "S", 0), (None, None, "C", 0), (35.0, "E46", "Q", 1), (35.0, "E46", "Q", 1)])


def test_smoke_sample(smoke):
    context = UsageContext("Predict survival", "classification", "Survived", ["Survived"])
    result = evaluate(smoke, context)
    scores = [r.score for r in ordered_dimensions(result.dimensions).collect()]
    assert scores == [70.31, 91.67, 100, 0, 0, 87.5]
    row = result.scorecard.first()
    assert (row.score, row.classification, row.weight_source) == (70.97, "Requires preparation", "study_defaults")
    codes = {(r.dimension, r.column, r.code) for r in result.findings.collect()}
    assert {("Completeness", "Age", "missing"), ("Consistency", None, "duplicates"),
            ("Data Quality", "Cabin", "constant"), ("Provenance", None, "origin")} <= codes
    assert all(r.problem and r.recommendation for r in result.findings.collect())


@pytest.mark.parametrize("labels,ratio,overall", [("aaab", 33.33, 69.37), ("aa", 0, 61.78)])
def test_class_balance(spark, table, labels, ratio, overall):
    df = table("t string, x int", [(label, i) for i, label in enumerate(labels)])
    facts = D.class_facts(df, "t")
    value = D.class_balance(facts).first().value
    assert value == ratio
    assert card(spark, {"Completeness": 80, "Class Balance": value}).score == overall
    problems = {r.code for r in D.class_balance_findings(facts, "t").collect()}
    assert ("single_class" in problems) == (labels == "aa")


@pytest.mark.parametrize("task", ["regression", "other"])
def test_balance_not_applicable(spark, smoke, task):
    result = evaluate(smoke, UsageContext("x", task, "Survived"))
    row = [r for r in result.dimensions.collect() if r.dimension == "Class Balance"][0]
    assert (row.applicable, row.score, row.weight, row.weight_percentage) == (False, None, None, None)
    assert card(spark, {"Completeness": 80}, task).score == 80


def test_everything_documented(table):
    df = table("feature int, target double", [(i, i * 1.5) for i in range(4)])
    result = evaluate(df, UsageContext("x", "regression", "target", **ALL_DOCUMENTED))
    row = result.scorecard.first()
    assert (row.score, row.classification) == (100, "Ready")
    assert {r.status for r in result.items.collect()} == {"self_reported"}


def test_custom_weights(spark):
    scores = dimension_scores(indicator_frame(spark, {"Completeness": 80, "Documentation": 0}))
    weights = task_weights(spark, "other", {"Completeness": 1, "Documentation": 3})
    row = scorecard(scores, weights).first()
    assert (row.score, row.weight_source) == (20, "custom")
    shares = {r.dimension: r.weight_percentage for r in weighted_dimensions(scores, weights).collect()}
    assert shares == {"Completeness": 25, "Documentation": 75}
    zero = task_weights(spark, "other", {"Documentation": 0})
    assert scorecard(scores, zero).first().score == 80
    row = [r for r in weighted_dimensions(scores, zero).collect() if r.dimension == "Documentation"][0]
    assert row.applicable and row.weight_percentage == 0
    same = task_weights(spark, "other", {"Completeness": 14.5})
    assert scorecard(scores, same).first().weight_source == "study_defaults"


@pytest.mark.parametrize("weights", [{"Completeness": w} for w in (-1, float("nan"), float("inf"), "10", True)]
                         + [{"Beauty": 1}, {"Class Balance": 1}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        check_overrides("other", weights)


def test_zero_total_weight(spark):
    with pytest.raises(Exception, match="positive weight"):
        card(spark, {"Completeness": 80}, "other", {"Completeness": 0})
    with pytest.raises(Exception, match="0-100"):
        card(spark, {"Completeness": 180}, "other")


@pytest.mark.parametrize("score,label", [(0, "Not ready"), (49.99, "Not ready"), (50, "Requires preparation"),
                                         (75, "Almost ready"), (89.99, "Almost ready"), (90, "Ready")])
def test_bands(spark, score, label):
    assert card(spark, {"Completeness": score}, "other").classification == label


def test_reweighting_keeps_the_measurements(smoke):
    result = evaluate(smoke, UsageContext("x"))
    first = result.scorecard.first()
    assert result.reweight(None).scorecard.first() == first
    heavier = result.reweight({"Completeness": 100})
    assert heavier.scorecard.first().weight_source == "custom"
    assert heavier.reweight(None).scorecard.first() == first


def test_class_distribution(table):
    labels = [0] * 20 + list(range(1, 12)) + [None] * 3
    df = table("t int", [(v,) for v in labels])
    rows = D.class_distribution(df, "t").orderBy("rank").collect()
    assert [r["count"] for r in rows if r.slot == "class"] == [20] + [1] * 7
    assert {r.slot: r["count"] for r in rows if r.slot != "class"} == {"other": 4, "missing": 3}
    assert rows[0].percentage == round(20 / 31 * 100, 2)
    assert D.rare_classes(df, "t").count() == 11


def test_target_without_labels(spark, table):
    for rows in ([(None, 1), (None, 2)], []):
        df = table("t string, x int", rows)
        result = evaluate(df, UsageContext("x", "classification", "t"))
        balance = [r for r in result.dimensions.collect() if r.dimension == "Class Balance"][0]
        assert balance.applicable and balance.score == 0
        D.class_distribution(df, "t").collect()


def test_context_checks():
    with pytest.raises(ValueError):
        UsageContext(task_type="ranking")
    with pytest.raises(ValueError):
        UsageContext(documentation={"origin": True})
    with pytest.raises(TypeError):
        UsageContext(provenance=dict.fromkeys(UsageContext().provenance, "yes"))


def test_unknown_columns(smoke):
    with pytest.raises(ValueError, match="nope"):
        evaluate(smoke, UsageContext(important_columns=["nope"]))
    with pytest.raises(ValueError, match="nope"):
        evaluate(smoke, UsageContext(task_type="classification", target_column="nope"))


def test_batch_goes_on_after_a_failure(smoke):
    def broken():
        raise OSError("cannot read")

    rows = {r.dataset_id: r for r in score_many({"a": smoke, "b": broken, "c": smoke}, repeat=True).collect()}
    assert rows["b"].error == "cannot read" and rows["b"].score is None
    assert rows["a"].score == rows["c"].score and rows["a"].error is None


def test_batch_scores_as_single_tables_do(spark, table, smoke):
    """Tasks, metadata claims, important columns, empty tables and tables without numbers; one fails while it is read."""
    tables = {
        "numbers": table("a double, b string, c int", [(float(i % 17), ["x", " X", "y"][i % 3], i) for i in range(300)] + [(1e9, None, None)] * 2),
        "classes": smoke, "empty": table("a double, b string", []),
        "texts": table("b string, c string", [("1", "u"), ("2", "v"), ("2", "v")]),
        "it's odd": table("`a b` double, d double", [(INF, 1.0), (2.0, None), (3.0, 1.0)])}
    contexts = {
        "numbers": UsageContext("x", "regression", "c", ["a"], **ALL_DOCUMENTED),
        "classes": UsageContext("x", "classification", "Survived", ["Age", "Cabin"]),
        "it's odd": UsageContext("x", important_columns=["a b"])}
    failing = table("a int, b int", [(1, 2), (3, 4)]).selectExpr("a", "case when b > 3 then raise_error('bad row') else b end as b")
    unknown = {"target": UsageContext("x", "classification", "nope")}
    got = {r.dataset_id: r for r in score_many({**tables, "failing": failing, "target": smoke}, {**contexts, **unknown}).collect()}
    assert "bad row" in got.pop("failing").error and "nope" in got.pop("target").error
    assert set(got) == set(tables)
    for name, df in tables.items():
        card = evaluate(df, contexts.get(name, UsageContext("x")), dataset_id=name).scorecard.first()
        assert tuple(got[name]) == (*card, None), name
    with pytest.raises(AttributeError):  # faults of the program are not rows
        score_many({"a": lambda: None.columns})
    assert score_many({}).collect() == []


def test_rare_classes_are_named(table):
    df = table("t string", [("common",)] * 400 + [(f"rare{i}",) for i in range(10)] + [("seldom",)] * 3)
    finding = {r.code: r.problem for r in D.class_balance_findings(D.class_facts(df, "t"), "t").collect()}["rare_class"]
    assert finding.startswith("'t': 11 class(es)") and finding.endswith("rare0, rare1, rare2, rare3, rare4, rare5, rare6, rare7, ...")


def test_assessments_carry_the_warnings(spark):
    metadata = spark.sql("select 'a' as dataset_id, parse_json('{}') as body, 'a.json' as source, 'x' as sha256, array('a.json: odd') as warnings")
    contexts = spark.sql("select * from values ('a', 't', map('origin', true)), ('b', null, map('origin', false)) as c(dataset_id, target_column, claims)")
    rows = {(r.dataset_id, r.dimension): (r.source, r.warnings) for r in metadata_audit.assessments(metadata, contexts).collect()}
    assert rows == {("a", d): ("a.json", ["a.json: odd"]) for d in metadata_audit.LABELS} | {("b", d): (None, []) for d in metadata_audit.LABELS}
    columns = spark.sql("select 'a' as dataset_id, 't' as column")
    items = {(r.dataset_id, r.item): (r.status, r.evidence) for r in metadata_audit.audit(metadata, columns, contexts).collect()}
    assert items[("a", "origin")] == ("self_reported", "true") and items[("b", "target_definition")] == ("not_applicable", None)
    assert items[("a", "variable_descriptions")] == ("missing", "[]") and len(items) == 22
