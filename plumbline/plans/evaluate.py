"""Score one table, many tables, or two versions of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from plumbline.functions.columns import data_fields
from plumbline.functions.local import local_frame
from plumbline.operators.duplicates import duplicate_count
from plumbline.operators.facts import facts_of_many, scan_facts, text_variant_columns
from plumbline.operators.outliers import fit_fences, fit_fences_of_many, outlier_counts
from plumbline.plans import dimensions as D
from plumbline.plans.constants import DIMENSIONS
from plumbline.plans.context import UsageContext
from plumbline.plans.metadata_audit import audit, audit_findings, audit_indicators
from plumbline.plans.scoring import (
    check_overrides, dimension_scores, scorecard, task_weights, weighted_dimensions,
)

CONTEXT_SCHEMA = "dataset_id string, target_column string, claims map<string,boolean>"


@dataclass
class Evaluation:
    """Small result frames; ``reweight`` runs on them without touching the data."""

    indicators: DataFrame
    findings: DataFrame
    items: DataFrame
    scores: DataFrame
    dimensions: DataFrame
    scorecard: DataFrame
    task_type: str

    def reweight(self, weights: dict[str, float] | None) -> Evaluation:
        return _scored(self.indicators, self.findings, self.items, self.scores, self.task_type, weights)


def _local(frame: DataFrame) -> DataFrame:
    """Run a frame with a few rows per table column and keep its rows as a local
    relation, so that what reads it does not scan the table again."""
    return local_frame(frame.sparkSession, frame.collect(), frame.schema)


def _together(spark: SparkSession, *tasks: Callable) -> list:
    """Run independent Spark jobs at the same time, so that the short ones fill the gaps
    of the long ones."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def no_metadata(spark: SparkSession) -> DataFrame:
    return spark.range(0).selectExpr(
        "cast(null as string) dataset_id", "cast(null as variant) body", "cast(null as string) source",
        "cast(null as string) sha256", "cast(null as array<string>) warnings")


def metadata_items(df: DataFrame, context: UsageContext, metadata: DataFrame | None = None,
                   dataset_id: str = "dataset", row_id: str | None = None) -> DataFrame:
    """Documentation and provenance items of one table. ``metadata``: rows of the
    metadata source; those of other datasets are ignored."""
    spark = df.sparkSession
    columns = local_frame(
        spark, [(dataset_id, f.name) for f in data_fields(df, row_id)], "dataset_id string, column string")
    contexts = local_frame(
        spark, [(dataset_id, context.target_column, {**context.documentation, **context.provenance})],
        CONTEXT_SCHEMA)
    rows = no_metadata(spark) if metadata is None else metadata.where(F.col("dataset_id") == dataset_id)
    return audit(rows, columns, contexts)


def _scored(indicators, findings, items, scores, task_type, overrides) -> Evaluation:
    weights = task_weights(indicators.sparkSession, task_type, overrides)
    return Evaluation(
        indicators, findings, items, scores, weighted_dimensions(scores, weights),
        scorecard(scores, weights), task_type)


def evaluate(df: DataFrame, context: UsageContext, metadata: DataFrame | None = None,
             weights: dict[str, float] | None = None, dataset_id: str = "dataset",
             row_id: str | None = None) -> Evaluation:
    """Measure the six dimensions and combine them.

    Jobs over the data: one aggregation for all counters, one or two to fit quartiles,
    one to count outliers, one grouping of whole rows, one of folded texts, and for
    classification one of the target; they run concurrently. What comes back has one row per table column or
    class, and every score is a query over that.
    """
    check_overrides(context.task_type, weights)
    important = D.check_important(df, context.important_columns)
    balanced = D.balance_applies(df, context)

    (columns, tables), duplicates, variants, outliers, items, classes = _together(
        df.sparkSession,
        lambda: scan_facts(df, dataset_id, row_id),
        lambda: _local(duplicate_count(df, row_id).select(
            F.lit(dataset_id).alias("dataset_id"), "rows", "duplicate_rows")),
        lambda: _local(text_variant_columns(df, row_id=row_id)),
        lambda: _local(outlier_counts(df, fit_fences(df, row_id=row_id))),
        lambda: _local(metadata_items(df, context, metadata, dataset_id, row_id)),
        lambda: _local(D.class_facts(df, context.target_column, dataset_id)) if balanced else None,
    )

    indicators = [
        D.completeness(columns, tables, important), D.consistency(columns, duplicates, variants),
        audit_indicators(items), D.data_quality(columns, outliers),
    ]
    findings = [
        D.completeness_findings(columns), D.consistency_findings(columns, duplicates, variants),
        audit_findings(items), D.data_quality_findings(columns, outliers),
    ]
    if balanced:
        indicators.append(D.class_balance(classes))
        findings.append(D.class_balance_findings(classes, context.target_column))
    indicator_frame = _local(D.union(indicators))
    scores = dimension_scores(indicator_frame)
    if not balanced:
        scores = scores.unionByName(local_frame(
            df.sparkSession, [(dataset_id, "Class Balance", False, None)],
            "dataset_id string, dimension string, applicable boolean, score double"))
    return _scored(indicator_frame, D.union(findings), items, scores, context.task_type, weights)


def ordered_dimensions(dimensions: DataFrame) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    return dimensions.orderBy("dataset_id", position)


def compare(original: DataFrame, prepared: DataFrame, context: UsageContext,
            metadata: DataFrame | None = None, weights: dict[str, float] | None = None,
            row_id: str | None = None) -> DataFrame:
    """(dimension, original, prepared, delta), with the overall score as a row of its own.

    Both versions are judged with the same context, weights and source metadata.
    """
    def scores(df: DataFrame, label: str) -> DataFrame:
        result = evaluate(df, context, metadata, weights, row_id=row_id)
        rows = result.dimensions.select("dimension", F.col("score").alias(label))
        return rows.unionByName(result.scorecard.select(
            F.lit("Overall").alias("dimension"), F.col("score").alias(label)))

    joined = scores(original, "original").join(scores(prepared, "prepared"), "dimension", "full")
    return joined.withColumn("delta", F.round(F.col("prepared") - F.col("original"), 2))


def score_many(datasets: Mapping[str, DataFrame | Callable[[], DataFrame]],
               contexts: Mapping[str, UsageContext] | None = None,
               metadata: DataFrame | None = None, repeat: bool = False) -> DataFrame:
    """(dataset_id, score, classification, weight_source, error), one row per dataset.

    All datasets are measured by the same few jobs, each a union over the tables whose rows carry the dataset's id.
    A dataset that cannot be read or scored gets an error row and the others continue: what fails when it is
    opened is left out, and a job that fails is repeated with half of its datasets until the failing ones stand alone.
    With ``repeat`` all are scored twice and a difference is an error.
    """
    spark, given, tables, failed = SparkSession.active(), contexts or {}, {}, {}
    contexts = {i: given.get(i, UsageContext("Evaluate dataset readiness")) for i in datasets}
    for dataset_id, source in datasets.items():
        try:
            df = source() if callable(source) else source
            D.check_important(df, contexts[dataset_id].important_columns)
            D.balance_applies(df, contexts[dataset_id])
            tables[dataset_id] = df
        except READ_ERRORS as error:
            failed[dataset_id] = _first_line(error)
    cards = _cards(spark, tables, contexts, metadata, failed)
    if repeat:
        again = _cards(spark, {i: tables[i] for i in cards}, contexts, metadata, failed)
        for dataset_id in [i for i in cards if i in again and again[i] != cards[i]]:
            failed[dataset_id] = "Two evaluations of this dataset differ"
    rows = [(i, None, None, None, failed[i]) if i in failed else (*cards[i], None) for i in datasets]
    return local_frame(
        spark, rows, "dataset_id string, score double, classification string, weight_source string, error string")


# What a dataset that cannot be read or scored raises; other errors are faults of the program.
READ_ERRORS = (PySparkException, Py4JError, OSError, ValueError)


def _first_line(error: Exception) -> str:
    return str(error).split("\n")[0]


def _cards(spark: SparkSession, tables: dict[str, DataFrame], contexts: dict[str, UsageContext], metadata: DataFrame | None,
           failed: dict[str, str]) -> dict[str, Row]:
    """The scorecards by dataset; the failing ones go to ``failed``."""
    if not tables:
        return {}
    try:
        return {r.dataset_id: r for r in _scorecards(spark, tables, contexts, metadata).collect()}
    except (PySparkException, Py4JError) as error:
        ids = list(tables)
        if len(ids) == 1:
            failed[ids[0]] = _first_line(error)
            return {}
        halves = ids[:len(ids) // 2], ids[len(ids) // 2:]
        first, second = [_cards(spark, {i: tables[i] for i in half}, contexts, metadata, failed) for half in halves]
        return first | second


def _scorecards(spark: SparkSession, tables: dict[str, DataFrame], contexts: dict[str, UsageContext],
                metadata: DataFrame | None) -> DataFrame:
    def over(measure: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        frames = [measure(i, df) for i, df in tables.items()]
        return _local(D.union([f.withColumn("dataset_id", F.lit(i)) for i, f in zip(tables, frames)]))

    def counted_outliers() -> DataFrame:
        fences = dict(zip(tables, fit_fences_of_many(list(tables.values()))))
        return over(lambda i, df: outlier_counts(df, fences[i]))

    def items() -> DataFrame:
        columns = local_frame(spark, [(i, f.name) for i, df in tables.items() for f in data_fields(df)], "dataset_id string, column string")
        claims = local_frame(spark, [(i, contexts[i].target_column, {**contexts[i].documentation, **contexts[i].provenance}) for i in tables],
                             CONTEXT_SCHEMA)
        rows = no_metadata(spark) if metadata is None else metadata.where(F.col("dataset_id").isin(*tables))
        return _local(audit(rows, columns, claims))

    balanced = [i for i, df in tables.items() if D.balance_applies(df, contexts[i])]
    (columns, totals), duplicates, variants, outliers, judged, classes = _together(
        spark,
        lambda: facts_of_many(tables),
        lambda: over(lambda i, df: duplicate_count(df).select("rows", "duplicate_rows")),
        lambda: over(lambda i, df: text_variant_columns(df)),
        counted_outliers,
        items,
        lambda: _local(D.union([D.class_facts(tables[i], contexts[i].target_column, i) for i in balanced])) if balanced else None)
    indicators = [
        D.completeness(columns, totals, {i: contexts[i].important_columns for i in tables}),
        D.consistency(columns, duplicates, variants), audit_indicators(judged), D.data_quality(columns, outliers),
    ] + ([D.class_balance(classes)] if balanced else [])
    scores = dimension_scores(_local(D.union(indicators)))
    by_task = {task: [i for i in tables if contexts[i].task_type == task] for task in sorted({contexts[i].task_type for i in tables})}
    return D.union([scorecard(scores.where(F.col("dataset_id").isin(*ids)), task_weights(spark, task)) for task, ids in by_task.items()])
