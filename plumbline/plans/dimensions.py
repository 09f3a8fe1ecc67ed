"""The four data-driven dimensions as indicators and findings.

Indicators are long: dataset_id, dimension, position, indicator, numerator, denominator,
value (0-100, two decimals), weight, applicable. Every function takes frames of facts
(one row per column or per table), so it works for one dataset or for many at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import field_of, literal, missing_sql
from plumbline.functions.numbers import percentage
from plumbline.operators.frequencies import top_k, value_counts, with_texts
from plumbline.operators.profile import NUMBERS_AS_TEXT
from plumbline.plans import constants as K


def _indicators(counters: DataFrame, dimension: str, *entries: tuple[str, str, str, float]) -> DataFrame:
    """Indicator rows from one row of counters per dataset: (name, part, total, value if
    the total is 0), the counters as SQL text."""
    rows = [
        f"struct({literal(dimension)} as dimension, {i} as position, {literal(name)} as indicator, "
        f"cast({part} as bigint) as numerator, cast({total} as bigint) as denominator, "
        f"{float(empty)}D as empty)"
        for i, (name, part, total, empty) in enumerate(entries)]
    return counters.selectExpr("dataset_id", f"inline(array({', '.join(rows)}))").selectExpr(
        "dataset_id", "dimension", "position", "indicator", "numerator", "denominator",
        f"{percentage('numerator', 'denominator', 'empty')} as value", "1D as weight",
        "true as applicable")


def finding(source: DataFrame, dimension: str, column: str, code: str, problem: str,
            recommendation: str) -> DataFrame:
    """Finding rows. In the texts, ``{expression}`` is filled in from the source row."""
    def filled(text: str) -> str:
        parts = []
        for i, part in enumerate(text.replace("}", "{").split("{")):
            parts.append(f"cast({part} as string)" if i % 2 else literal(part))
        return f"concat({', '.join(parts)})"

    return source.selectExpr(
        "dataset_id", f"{literal(dimension)} as dimension", f"cast({column} as string) as column",
        f"{literal(code)} as code", f"{filled(problem)} as problem",
        f"{filled(recommendation)} as recommendation")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- Completeness -----------------------------------------------------------------

def check_important(df: DataFrame, important: list[str]) -> list[str]:
    important = list(dict.fromkeys(important))
    unknown = [name for name in important if name not in df.columns]
    if unknown:
        raise ValueError(f"Important columns not found: {', '.join(map(str, unknown))}")
    return important


def completeness(columns: DataFrame, tables: DataFrame, important: list[str] | dict[str, list[str]] = ()) -> DataFrame:
    """``important``: columns of the one dataset, or of each by its id."""
    if isinstance(important, dict):
        chosen = " or ".join(f"dataset_id = {literal(i)} and column in ({', '.join(map(literal, names))})"
                             for i, names in important.items() if names) or "false"
    else:
        chosen = f"column in ({', '.join(map(literal, important))})" if important else "false"
    per_column = columns.groupBy("dataset_id").agg(
        F.expr("sum(rows) as cells"), F.expr("sum(rows - missing) as filled"),
        F.expr(f"count_if(try_divide(missing, rows) < {K.ACCEPTABLE_MISSING_SHARE}D) as acceptable"),
        F.expr(f"sum(case when {chosen} then rows else 0 end) as important_cells"),
        F.expr(f"sum(case when {chosen} then rows - missing else 0 end) as important_filled"))
    return _indicators(
        tables.join(per_column, "dataset_id", "left"), "Completeness",
        (K.FILLED_CELLS, "coalesce(filled, 0)", "coalesce(cells, 0)", 0),
        (K.FILLED_COLUMNS, "coalesce(acceptable, 0)", "columns", 100),
        (K.COMPLETE_ROWS, "complete_rows", "rows", 0),
        (K.FILLED_IMPORTANT, "coalesce(important_filled, 0)", "coalesce(important_cells, 0)", 100))


def completeness_findings(columns: DataFrame) -> DataFrame:
    share = percentage("missing", "rows", 0.0)
    return finding(columns.where("missing > 0"), "Completeness", "column", "missing",
                   f"'{{column}}': {{missing}} of {{rows}} cells empty ({{{share}}}%)",
                   "fill_median or fill_mode keep the rows of '{column}', drop_missing gives them up")


# --- Consistency ------------------------------------------------------------------

CATEGORICAL = "kind not in ('measurement', 'boolean')"
INCONSISTENT = f"(mixed or {NUMBERS_AS_TEXT})"


def _joined(columns: DataFrame, found: DataFrame) -> DataFrame:
    keys = ["dataset_id", "column"] if "dataset_id" in found.columns else ["column"]
    return columns.join(F.broadcast(found), keys, "left")


def consistency(columns: DataFrame, duplicates: DataFrame, variants: DataFrame) -> DataFrame:
    """``duplicates``: dataset_id, rows, duplicate_rows. ``variants``: column(, dataset_id),
    variant_groups for the affected columns only."""
    per_column = _joined(columns, variants).groupBy("dataset_id").agg(
        F.expr("count(1) as columns"), F.expr(f"count_if({INCONSISTENT}) as inconsistent"),
        F.expr(f"count_if({CATEGORICAL}) as categorical"),
        F.expr(f"count_if({CATEGORICAL} and variant_groups > 0) as varying"))
    return _indicators(
        duplicates.join(per_column, "dataset_id"), "Consistency",
        (K.UNIQUE_ROWS, "rows - duplicate_rows", "rows", 0),
        (K.CONSISTENT_TYPES, "columns - inconsistent", "columns", 100),
        (K.UNIFORM_TEXT, "categorical - varying", "categorical", 100))


def consistency_findings(columns: DataFrame, duplicates: DataFrame, variants: DataFrame) -> DataFrame:
    name, joined = "Consistency", _joined(columns, variants)
    reasons = (f"concat_ws(', ', case when mixed then 'values of several kinds' end, "
               f"case when {NUMBERS_AS_TEXT} then 'numbers spelt out' end)")
    return union([
        finding(duplicates.where("duplicate_rows > 0"), name, "null", "duplicates",
                "{duplicate_rows} of {rows} rows repeat an earlier one", "duplicates keeps the first of equal rows"),
        finding(joined.where(INCONSISTENT), name, "column", "inconsistent_type",
                f"'{{column}}': {{{reasons}}}", "cast '{column}' to the kind that most of its values have"),
        finding(joined.where("variant_groups > 0"), name, "column", "text_variants",
                "'{column}': {variant_groups} value(s) spelt in more than one way", "trim, then casefold '{column}'")])


# --- Class balance ----------------------------------------------------------------

def balance_applies(df: DataFrame, context) -> bool:
    """Classification with a target; an unknown target is an error."""
    if context.task_type != "classification" or not context.target_column:
        return False
    if context.target_column not in df.columns:
        raise ValueError(f"Target column not found: {context.target_column}")
    return True


def class_facts(df: DataFrame, target: str, dataset_id: str = "dataset") -> DataFrame:
    """One row: rows, labelled rows, classes, smallest, largest, rare classes, and the labels of the rarest of
    them (as many as are shown of the most frequent)."""
    # A class is rare by its share of all rows, missing labels included.
    counts = value_counts(df, target).withColumn("rows", row_count(df))
    few = with_texts(counts.where(RARE).orderBy("n", "key").limit(K.SHOWN_CLASSES), df, target)
    rarest = few.agg(F.expr("transform(array_sort(collect_list(struct(n, key))), x -> x.key)"))  # a fixed number of labels
    return counts.agg(
        F.expr("coalesce(sum(n), 0L) as labelled"), F.expr("count(1) as classes"),
        F.expr("min(n) as smallest"), F.expr("max(n) as largest"),
        F.expr(f"count_if({RARE}) as rare_classes"),
    ).select(F.lit(dataset_id).alias("dataset_id"), row_count(df).alias("rows"), "*", rarest.scalar().alias("rare_labels"))


RARE = f"({percentage('n', 'rows', 0.0)} < {K.RARE_CLASS_PERCENTAGE})"


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery; it reads no column."""
    return df.agg(F.count(F.lit(1))).scalar()


def class_balance(facts: DataFrame) -> DataFrame:
    return _indicators(facts, "Class Balance", (
        K.CLASS_RATIO, "case when classes >= 2 then smallest else 0 end",
        "case when classes >= 2 then largest else 0 end", 0))


def rare_classes(df: DataFrame, target: str) -> DataFrame:
    """(label, count, percentage) of every class below 5% of all rows, missing targets
    included in the total."""
    rare = value_counts(df, target).withColumn("rows", row_count(df)).where(RARE)
    return with_texts(rare, df, target).selectExpr(
        "key as label", "n as count", f"{percentage('n', 'rows', 0.0)} as percentage")


def class_balance_findings(facts: DataFrame, target: str) -> DataFrame:
    name, column = "Class Balance", literal(target)
    return union([
        finding(facts.where("classes < 2"), name, column, "single_class",
                f"'{{{column}}}': {{classes}} class(es) among {{labelled}} labels", "label rows of another class"),
        finding(facts.where("rare_classes > 0"), name, column, "rare_class",
                f"'{{{column}}}': {{rare_classes}} class(es) below {K.RARE_CLASS_PERCENTAGE}% of the rows: "
                "{concat_ws(', ', rare_labels)}{case when rare_classes > size(rare_labels) then ', ...' else '' end}",
                "label more rows of these classes, or weight them when training")])


def class_distribution(df: DataFrame, target: str, shown: int = K.SHOWN_CLASSES) -> DataFrame:
    """(slot, label, count, percentage): the most frequent classes, the remaining ones
    combined, and the missing labels. Percentages are of the labelled rows."""
    counted = value_counts(df, target).withColumn("column", F.lit(target))
    # Ties are decided by the labels themselves, so whoever may be shown gets its text first.
    least = counted.orderBy(F.desc("n")).limit(shown).agg(F.min("n").alias("n")).scalar()
    top = top_k(with_texts(counted.where(F.col("n") >= least), df, target), shown).select(
        F.lit("class").alias("slot"), F.col("rank"), F.col("key").alias("label"),
        F.col("n").alias("count"))
    present = f"count_if(not {missing_sql(target, field_of(df, target).dataType)})"
    rest = top.agg(F.expr("coalesce(sum(count), 0L) as shown")).select(
        "shown", df.agg(F.expr(present)).scalar().alias("labelled"), row_count(df).alias("rows")
    ).selectExpr(
        "labelled",
        f"inline(array(struct('other' as slot, {shown + 1} as rank, labelled - shown as count), "
        f"struct('missing' as slot, {shown + 2} as rank, rows - labelled as count)))")
    top = top.select("*", df.agg(F.expr(present)).scalar().alias("labelled"))
    return top.unionByName(rest.selectExpr("*", "cast(null as string) as label")).selectExpr(
        "slot", "rank", "label", "count",
        f"case when slot <> 'missing' then {percentage('count', 'labelled', 0.0)} end as percentage")


# --- Data quality -----------------------------------------------------------------

def data_quality(columns: DataFrame, outliers: DataFrame) -> DataFrame:
    """``outliers``: column(, dataset_id), outliers, present of every measurement."""
    counters = _joined(columns, outliers).groupBy("dataset_id").agg(
        F.expr("coalesce(sum(present), 0L) as values"), F.expr("coalesce(sum(outliers), 0L) as outliers"),
        F.expr("count(1) as columns"), F.expr("count_if(constant) as constants"))
    return _indicators(
        counters, "Data Quality",
        (K.WITHOUT_OUTLIERS, "values - outliers", "values", 100),
        (K.VARYING_COLUMNS, "columns - constants", "columns", 100))


def data_quality_findings(columns: DataFrame, outliers: DataFrame) -> DataFrame:
    name, joined = "Data Quality", _joined(columns, outliers)
    return union([
        finding(joined.where("outliers > 0"), name, "column", "outliers",
                "'{column}': {outliers} of {present} values lie outside the quartile fences",
                "clip_outliers or drop_outliers, if '{column}' should not reach that far"),
        finding(joined.where("constant"), name, "column", "constant",
                "'{column}': no two different values", "leave '{column}' out of what is learnt from")])
