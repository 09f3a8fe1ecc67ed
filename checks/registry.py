"""name -> (query on Spark, equivalent SQL or None)."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from checks import views as V
from plumbline.functions.columns import field_of
from plumbline.functions.lineage import shared_folder
from plumbline.operators import duplicates, facts, frequencies, inspection, outliers, profile, sampling
from plumbline.plans import constants as K
from plumbline.plans import dimensions as D
from plumbline.plans import metadata_audit, preparation, scoring
from plumbline.plans.context import UsageContext
from plumbline.plans.evaluate import compare, evaluate, score_many
from plumbline.plans.preparation import Operation
from plumbline.plans.recipe import Recipe, Step
from plumbline.sources.csv import read_csv
from plumbline.sources.files import dataset_fingerprint, fingerprints
from plumbline.sources.load import read_parquet
from plumbline.sources.sinks import write_prepared as write_table, write_report
from plumbline.streaming import write_prepared

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            # A bare "column" is a reserved word in DuckDB.
            ORACLES[name] = re.sub(r'(?<!")\bcolumn\b(?!")', '"column"', sql)
        return query
    return add


def pct(part: str, total: str) -> str:
    """Two-decimal percentage in SQL: exact binary value, half to even."""
    return f"CAST(format('{{:.2f}}', CAST({part} AS DOUBLE) / {total} * 100) AS DOUBLE)"


def r2(value: str) -> str:
    return f"CAST(format('{{:.2f}}', {value}) AS DOUBLE)"


def dirty(rest: str) -> str:
    return f"WITH t AS ({V.DIRTY_ORDERS})\n{rest}"


def labeled(rest: str) -> str:
    return f"WITH t AS ({V.LABELED_DOCUMENTS})\n{rest}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "custkey_text"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def per_column(names, body: str) -> str:
    """One SELECT per column, joined; {i} and {c} are filled in."""
    return "\nUNION ALL ".join(
        body.replace("{i}", str(i)).replace("{c}", c) for i, c in enumerate(names))


# --- profiling --------------------------------------------------------------------

@register("missing_by_column", dirty(per_column(
    ORDERS, "SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS missing FROM t")))
def missing_by_column(spark, sf):
    return inspection.missing_by_column(V.dirty_orders(spark, sf)).withColumn(
        "ordinal", F.col("ordinal").cast("bigint"))


@register("most_missing", labeled(
    "SELECT column, missing FROM (" + per_column(
        DOCUMENTS, "SELECT {i} AS ordinal, '{c}' AS column, count(*) - count({c}) AS missing FROM t")
    + ") ORDER BY missing DESC, ordinal LIMIT 12"))
def most_missing(spark, sf):
    return inspection.most_missing(V.labeled_documents(spark, sf)).select("column", "missing")


@register("missing_ranking", labeled(
    f"SELECT column, missing, {pct('missing', 'rows')} AS missing_percentage, count(*) OVER () AS affected_columns FROM ("
    + per_column(DOCUMENTS, "SELECT {i} AS ordinal, '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS missing FROM t")
    + ") WHERE missing > 0 ORDER BY 3 DESC, ordinal LIMIT 10"))
def missing_ranking(spark, sf):
    return profile.missing_ranking(facts.column_facts(V.labeled_documents(spark, sf))).drop("ordinal")


@register("dataset_profile", dirty(f"""
SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns,
       {pct('count(*) - count(o_totalprice)', '(count(*) * 7)')} AS missing_percentage,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM t)) AS duplicate_rows
FROM t"""))
def dataset_profile(spark, sf):
    return profile.dataset_profile(V.dirty_orders(spark, sf)).withColumn("columns", F.col("columns").cast("bigint"))


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
NUMERIC_SHARE = {
    c: f"(count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) * 1.0 / count({c}) >= 0.9)"
    for c in ("o_orderstatus", "o_orderpriority", "custkey_text")}


@register("column_profile", dirty("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS missing, "
    f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage, "
    f"count(DISTINCT {c}) AS unique_count, {NUMERIC_SHARE.get(c, 'false')} AS numbers_stored_as_text FROM t"
    for c in ORDERS)))
def column_profile(spark, sf):
    return profile.column_profile(V.dirty_orders(spark, sf)).drop("ordinal", "type", "kind")


@register("distinct_counts", per_column(
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
     "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_count FROM lineitem"))
def distinct_counts(spark, sf):
    return frequencies.distinct_counts(V.table(spark, sf, "lineitem"))


@register("constant_columns", dirty("SELECT * FROM (" + per_column(
    ORDERS, "SELECT '{c}' AS column, count(DISTINCT {c}) <= 1 AS constant FROM t") + ")"))
def constant_columns(spark, sf):
    return facts.column_facts(V.dirty_orders(spark, sf)).select("column", "constant")


@register("duplicate_rows", f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM ({V.NARROW_LINEITEM}) GROUP BY ALL_COLUMNS)""".replace(
    "ALL_COLUMNS", "l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_linenumber"))
def duplicate_rows(spark, sf):
    return duplicates.duplicate_count(V.narrow_lineitem(spark, sf))


@register("duplicate_documents", """
SELECT count(*) AS rows, count(DISTINCT (text, lang)) AS distinct_rows,
       count(*) - count(DISTINCT (text, lang)) AS duplicate_rows FROM documents""")
def duplicate_documents(spark, sf):
    return duplicates.duplicate_count(V.table(spark, sf, "documents").select("text", "lang"))


DESCRIBED = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"],
             "events": ["value"], "orders": ["o_totalprice"]}


@register("numeric_describe", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {t}"
    for t, names in DESCRIBED.items() for c in names))
def numeric_describe(spark, sf):
    parts = [profile.numeric_describe(V.table(spark, sf, t), names) for t, names in DESCRIBED.items()]
    return rounded(D.union(parts), "mean", "std", "q25", "q50", "q75")


@register("numeric_describe_narrowed", ORACLES["numeric_describe"])
def numeric_describe_narrowed(spark, sf):
    """The same quartiles from a small sketch whose brackets are wide: many values are ranked inside them."""
    parts = [profile.numeric_describe(V.table(spark, sf, t), names, sketch_size=64, margin=0.05)
             for t, names in DESCRIBED.items()]
    return rounded(D.union(parts), "mean", "std", "q25", "q50", "q75")


def frequency_sql(source: str, names, key=lambda c: f"CAST({c} AS VARCHAR)") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column, {key(c)} AS key, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1, 2"
        for c in names)


FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("value_frequencies", frequency_sql("lineitem", FLAGS))
def value_frequencies(spark, sf):
    return frequencies.frequencies(V.narrow_lineitem(spark, sf))


@register("document_frequencies", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS key, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1, 2"
    for c in ("doc_id", "text", "lang", "source", "n_chars")))
def document_frequencies(spark, sf):
    """All columns with their values whole, texts of any length included."""
    return frequencies.frequencies(V.table(spark, sf, "documents"), whole_texts=True)


@register("top_values", dirty(f"""
SELECT column, rank, key AS value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY column ORDER BY n DESC, key) AS rank FROM (
    {frequency_sql('t', ['o_orderstatus', 'o_orderpriority', 'custkey_text'])}
    UNION ALL {frequency_sql('t', ['o_orderdate'], lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')")}))
WHERE rank <= 5"""))
def top_values(spark, sf):
    return frequencies.top_values(V.dirty_orders(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@register("top_values_first_seen", dirty("""
SELECT column, rank, key AS value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY column ORDER BY n DESC, first_row) AS rank FROM (
    SELECT 'custkey_text' AS column, custkey_text AS key, count(*) AS n, min(_row) AS first_row FROM t GROUP BY 2))
WHERE rank <= 5"""))
def top_values_first_seen(spark, sf):
    return frequencies.top_values(V.dirty_orders(spark, sf), ["custkey_text"], row_id="_row").withColumn(
        "rank", F.col("rank").cast("bigint"))


@register("top_documents", """
SELECT column, rank, text AS value, n FROM (
  SELECT 'text' AS column, text, n, row_number() OVER (
    ORDER BY n DESC, CASE WHEN strlen(text) > 64 THEN '#' || sha256(text) ELSE text END) AS rank
  FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)) WHERE rank <= 5""")
def top_documents(spark, sf):
    return frequencies.top_values(V.table(spark, sf, "documents"), ["text"]).withColumn(
        "rank", F.col("rank").cast("bigint"))


@register("numbers_as_text", dirty("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) AS numeric_texts, "
    f"{share} AS numbers_stored_as_text FROM t" for c, share in NUMERIC_SHARE.items())))
def numbers_as_text(spark, sf):
    return facts.column_facts(V.dirty_orders(spark, sf)).where("kind = 'text'").select(
        "column", "numeric_texts", profile.numbers_as_text().alias("numbers_stored_as_text"))


@register("text_variants", dirty("SELECT column, count(*) AS variant_groups FROM (" + per_column(
    ["o_orderstatus", "o_orderpriority", "custkey_text"],
    "SELECT '{c}' AS column, lower(trim({c})) AS folded, count(DISTINCT {c}) AS spellings FROM t GROUP BY 2")
    + ") WHERE spellings > 1 GROUP BY 1"))
def text_variants(spark, sf):
    return facts.text_variant_columns(V.dirty_orders(spark, sf))


@register("mixed_type_values", """
SELECT 'mixed' AS column, count(DISTINCT event_id % 2) AS kinds FROM events HAVING count(DISTINCT event_id % 2) > 1""")
def mixed_type_values(spark, sf):
    """Event properties and values as one variant column of mixed kinds."""
    mixed = V.table(spark, sf, "events").selectExpr(
        "parse_json(props) as props",
        "case when event_id % 2 = 0 then parse_json(cast(value as string)) else parse_json(concat('\"', event_type, '\"')) end as mixed")
    return facts.mixed_type_columns(mixed)


HISTOGRAM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def histogram_sql(source: str, c: str) -> str:
    return f"""
SELECT '{c}' AS column, CAST(b AS BIGINT) AS bin, count(x) AS count FROM range(24) r(b) LEFT JOIN (
  SELECT x, CASE WHEN x < lo + g * step THEN g - 1 WHEN g < 23 AND x >= lo + (g + 1) * step THEN g + 1 ELSE g END AS bin
  FROM (SELECT x, lo, (hi - lo) / 24 AS step, least(floor((x - lo) * (24 / (hi - lo))), 23) AS g
        FROM (SELECT {c} / scale AS x, lo / scale AS lo, hi / scale AS hi FROM {source},
              (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
                      CAST(greatest(max(abs({c})), 1) AS DOUBLE) AS scale FROM {source})))) ON b = bin
GROUP BY 1, 2"""


@register("histogram_24", "\nUNION ALL ".join(histogram_sql("lineitem", c) for c in HISTOGRAM))
def histogram_24(spark, sf):
    return profile.histograms(V.table(spark, sf, "lineitem").select(*HISTOGRAM)).select(
        "column", F.col("bin").cast("bigint").alias("bin"), "count")


@register("histogram_values", histogram_sql("events", "value"))
def histogram_values(spark, sf):
    return profile.histograms(V.table(spark, sf, "events").select("value")).select(
        "column", F.col("bin").cast("bigint").alias("bin"), "count")


NUMERICS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS pairs FROM lineitem"
    for i, a in enumerate(NUMERICS) for b in NUMERICS[i + 1:])


@register("correlation_pairs", PAIRS)
def correlation_pairs(spark, sf):
    return rounded(profile.correlations(V.table(spark, sf, "lineitem")), "r")


@register("strongest_pair", f"SELECT * FROM ({PAIRS}) ORDER BY abs(r) DESC, a, b LIMIT 1")
def strongest_pair(spark, sf):
    return rounded(profile.strongest_pair(profile.correlations(V.table(spark, sf, "lineitem"))), "r")


@register("correlation_with_missing", dirty("""
SELECT 'o_orderkey' AS a, 'o_totalprice' AS b, round(corr(o_orderkey, o_totalprice), 6) AS r, count(o_totalprice) AS pairs FROM t
UNION ALL SELECT 'o_custkey', 'o_totalprice', round(corr(o_custkey, o_totalprice), 6), count(o_totalprice) FROM t
UNION ALL SELECT 'o_orderkey', 'o_custkey', round(corr(o_orderkey, o_custkey), 6), count(*) FROM t"""))
def correlation_with_missing(spark, sf):
    return rounded(profile.correlations(V.dirty_orders(spark, sf)), "r")


WIDE = 192


@register("correlation_wide", f"""
WITH w AS (SELECT vec_id, list_transform(range({WIDE}), lambda k: CASE WHEN (vec_id + k) % (3 + k // 64) <> 0 THEN CAST(embedding[k % 64 + 1] AS DOUBLE) * (1 + k // 64) + (vec_id * k) % 7 END) AS v
  FROM embeddings)
SELECT 'c' || i AS a, 'c' || j AS b, round(corr(v[i + 1], v[j + 1]), 6) AS r, count(v[i + 1] + v[j + 1]) AS pairs
FROM w, range({WIDE}) p(i), range({WIDE}) q(j) WHERE i < j GROUP BY i, j""")
def correlation_wide(spark, sf):
    """Embedding components and mixtures of them, each with missing cells of its own."""
    columns = [f"case when (vec_id + {k}) % {3 + k // 64} <> 0 then cast(embedding[{k % 64}] as double) * {1 + k // 64} + (vec_id * {k}) % 7 end as c{k}" for k in range(WIDE)]
    return rounded(profile.correlations(V.table(spark, sf, "embeddings").selectExpr(*columns)), "r")


@register("displayed_pair", labeled("SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS pairs FROM t"
    for a, b in (("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic")))
    + ") WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, a, b LIMIT 1"))
def displayed_pair(spark, sf):
    """The strongest pair among the columns a report would plot: identifiers are left out."""
    df = V.labeled_documents(spark, sf)
    shown = profile.correlation_plot_columns(profile.column_profile(df))
    return rounded(profile.strongest_pair(profile.correlations(df), shown), "r").select("a", "b", "r", "pairs")


@register("numeric_plot_columns", dirty("""
SELECT 'o_totalprice' AS column, count(DISTINCT o_totalprice) AS unique_count FROM t
UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey) FROM t
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM t"""))
def numeric_plot_columns(spark, sf):
    columns = profile.column_profile(V.dirty_orders(spark, sf))
    return profile.numeric_plot_columns(columns, None, ["o_totalprice"]).select("column", "unique_count")


@register("category_plot_columns", dirty("SELECT column, unique_count FROM (" + per_column(
    ["o_orderstatus", "o_orderdate", "o_orderpriority", "custkey_text"],
    "SELECT '{c}' AS column, count(DISTINCT {c}) AS unique_count, count(*) AS n FROM t")
    + ") WHERE unique_count > 1 AND unique_count <= greatest(n * 0.8, 2)"))
def category_plot_columns(spark, sf):
    columns = profile.column_profile(V.dirty_orders(spark, sf))
    return profile.category_plot_columns(columns, "o_orderstatus").select("column", "unique_count")


@register("row_sample", """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 10000""")
def row_sample(spark, sf):
    return sampling.sample_rows(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@register("value_sample", dirty("""
SELECT _row AS row, o_totalprice AS value FROM t WHERE o_totalprice IS NOT NULL
ORDER BY md5(CAST(_row AS VARCHAR) || ':42'), _row LIMIT 10000"""))
def value_sample(spark, sf):
    return sampling.sample_values(V.dirty_orders(spark, sf), "o_totalprice")


@register("nested_duplicates", f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT embedding, label, count(*) AS n FROM ({V.TWICE_EMBEDDINGS}) GROUP BY 1, 2)""")
def nested_duplicates(spark, sf):
    return duplicates.duplicate_count(V.twice_embeddings(spark, sf).drop("vec_id"), "_row")


@register("json_values", """
SELECT event_id, 'T' AS kind, CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS shown, CAST(value AS VARCHAR) AS number FROM events""")
def json_values(spark, sf):
    from plumbline.functions.columns import json_value
    events = V.table(spark, sf, "events")
    return events.select("event_id", F.lit("T").alias("kind"),
                         json_value("ts", field_of(events, "ts").dataType).alias("shown"),
                         json_value("value", field_of(events, "value").dataType).alias("number"))


# --- dimensions -------------------------------------------------------------------

INDICATORS = ["dimension", "indicator", "numerator", "denominator", "value"]


@register("completeness_indicators", labeled(f"""
, f AS (SELECT count(*) AS n, count(*) * 7 AS cells, count(quality) AS q, count(toxic) AS x FROM t)
SELECT 'Completeness' AS dimension, indicator, numerator, denominator, {pct('numerator', 'denominator')} AS value FROM (
  SELECT '% filled cells' AS indicator, n * 5 + q + x AS numerator, cells AS denominator FROM f
  UNION ALL SELECT '% columns with less than 20% missing', CAST(5 + CAST((n - q) * 1.0 / n < 0.2 AS INT)
    + CAST((n - x) * 1.0 / n < 0.2 AS INT) AS BIGINT), 7 FROM f
  UNION ALL SELECT '% complete rows', (SELECT count(*) FROM t WHERE quality IS NOT NULL AND toxic IS NOT NULL), n FROM f
  UNION ALL SELECT '% filled in important columns', n + q, n * 2 FROM f)""".replace("\n, f AS", ", f AS", 1)))
def completeness_indicators(spark, sf):
    df = V.labeled_documents(spark, sf)
    return D.completeness(facts.column_facts(df), facts.table_facts(df), ["quality", "lang"]).select(*INDICATORS)


@register("completeness_findings", dirty(f"""
SELECT 'o_totalprice' AS column, 'missing' AS code,
  '''o_totalprice'': ' || (count(*) - count(o_totalprice)) || ' of ' || count(*) || ' cells empty (' || CAST({pct('count(*) - count(o_totalprice)', 'count(*)')} AS VARCHAR) || '%)' AS problem
FROM t HAVING count(*) > count(o_totalprice)"""))
def completeness_findings(spark, sf):
    return D.completeness_findings(facts.column_facts(V.dirty_orders(spark, sf))).select("column", "code", "problem")


CONSISTENCY = f"""
SELECT 'Consistency' AS dimension, indicator, numerator, denominator, {pct('numerator', 'denominator')} AS value FROM (
  SELECT 0 AS position, '% non-duplicate rows' AS indicator, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM t)) AS numerator,
    count(*) AS denominator FROM t
  UNION ALL SELECT 1, '% columns with consistent types', 7 - {' - '.join(f'CAST({s} AS BIGINT)' for s in NUMERIC_SHARE.values())}, 7 FROM t
  UNION ALL SELECT 2, '% categorical columns without text variants', 4 - (
    SELECT count(DISTINCT column) FROM (""" + per_column(
    list(NUMERIC_SHARE), "SELECT '{c}' AS column, lower(trim({c})) AS f FROM t GROUP BY 2 HAVING count(DISTINCT {c}) > 1") + ")), 4)"


@register("consistency_indicators", dirty(CONSISTENCY))
def consistency_indicators(spark, sf):
    df = V.dirty_orders(spark, sf)
    repeated = duplicates.duplicate_count(df).withColumn("dataset_id", F.lit("dataset"))
    return D.consistency(facts.column_facts(df), repeated, facts.text_variant_columns(df)).select(*INDICATORS)


@register("consistency_findings", dirty(f"""
SELECT column, code FROM (SELECT NULL AS column, 'duplicates' AS code, count(*) > (
    SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM t)) AS found FROM t
  UNION ALL SELECT 'custkey_text', 'inconsistent_type', {NUMERIC_SHARE['custkey_text']} FROM t
  UNION ALL SELECT 'o_orderpriority', 'text_variants', count(DISTINCT o_orderpriority) > count(DISTINCT lower(trim(o_orderpriority))) FROM t)
WHERE found"""))
def consistency_findings(spark, sf):
    df = V.dirty_orders(spark, sf)
    repeated = duplicates.duplicate_count(df).withColumn("dataset_id", F.lit("dataset"))
    return D.consistency_findings(facts.column_facts(df), repeated, facts.text_variant_columns(df)).select("column", "code")


@register("class_balance", labeled(f"""
, c AS (SELECT quality, count(*) AS n FROM t WHERE quality IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS labelled, count(*) AS classes, min(n) AS smallest, max(n) AS largest,
  count(*) FILTER (WHERE {pct('n', '(SELECT count(*) FROM t)')} < 5) AS rare_classes,
  {pct('min(n)', 'max(n)')} AS ratio FROM c""".replace("\n, c AS", ", c AS", 1)))
def class_balance(spark, sf):
    found = D.class_facts(V.labeled_documents(spark, sf), "quality")
    return found.join(D.class_balance(found).select("dataset_id", F.col("value").alias("ratio")), "dataset_id").select(
        "labelled", "classes", "smallest", "largest", "rare_classes", "ratio")


def distribution_sql(source: str, c: str) -> str:
    return f"""
, c AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank FROM (
    SELECT CAST({c} AS VARCHAR) AS label, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)),
s AS (SELECT (SELECT count({c}) FROM {source}) AS labelled, (SELECT count(*) FROM {source}) AS rows,
      (SELECT coalesce(sum(n), 0) FROM c WHERE rank <= 8) AS shown)
SELECT 'class' AS slot, rank, label, n AS count, {pct('n', 'labelled')} AS percentage FROM c, s WHERE rank <= 8
UNION ALL SELECT 'other', 9, NULL, CAST(labelled - shown AS BIGINT), {pct('(labelled - shown)', 'labelled')} FROM s
UNION ALL SELECT 'missing', 10, NULL, rows - labelled, NULL FROM s""".replace("\n, c AS", ", c AS", 1)


@register("class_distribution", labeled(distribution_sql("t", "quality")))
def class_distribution(spark, sf):
    return D.class_distribution(V.labeled_documents(spark, sf), "quality").withColumn("rank", F.col("rank").cast("bigint"))


@register("class_distribution_long", labeled(distribution_sql("t", "text")))
def class_distribution_long(spark, sf):
    """A target whose labels are whole documents."""
    return D.class_distribution(V.labeled_documents(spark, sf), "text").withColumn("rank", F.col("rank").cast("bigint"))


@register("class_distribution_many", "WITH z AS (SELECT 1)" + distribution_sql("customer", "c_nationkey"))
def class_distribution_many(spark, sf):
    return D.class_distribution(V.table(spark, sf, "customer"), "c_nationkey").withColumn("rank", F.col("rank").cast("bigint"))


@register("rare_classes", f"""
SELECT label, n AS count, {pct('n', 'rows')} AS percentage FROM (
  SELECT CAST(c_nationkey AS VARCHAR) AS label, count(*) AS n, (SELECT count(*) FROM customer) AS rows FROM customer GROUP BY 1)
WHERE {pct('n', 'rows')} < 5""")
def rare_classes(spark, sf):
    return D.rare_classes(V.table(spark, sf, "customer"), "c_nationkey")


@register("rare_classes_long", f"""
SELECT label, n AS count, {pct('n', 'rows')} AS percentage FROM (
  SELECT text AS label, count(*) AS n, (SELECT count(*) FROM documents) AS rows FROM documents GROUP BY 1)
WHERE {pct('n', 'rows')} < 5""")
def rare_classes_long(spark, sf):
    return D.rare_classes(V.table(spark, sf, "documents"), "text")


# --- outliers ---------------------------------------------------------------------

FENCED = {"events": "value", "documents": "n_chars", "orders": "o_totalprice", "lineitem": "l_extendedprice"}


def fence_cte(source: str, c: str, name: str = "q") -> str:
    return (f"{name} AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ("
            f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}))")


@register("iqr_bounds", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (WITH {fence_cte(t, c)} SELECT * FROM q)"
    for t, c in FENCED.items()))
def iqr_bounds(spark, sf):
    parts = []
    for t, c in FENCED.items():
        fence = outliers.fit_fences(V.table(spark, sf, t), [c])[c]
        parts.append(V.table(spark, sf, t).agg(
            F.lit(c).alias("column"), F.round(F.lit(fence["lower"]), 6).alias("lower"),
            F.round(F.lit(fence["upper"]), 6).alias("upper")))
    return D.union(parts)


@register("outlier_counts", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, outliers, present FROM (WITH {fence_cte(t, c)} SELECT "
    f"count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outliers, count({c}) AS present FROM {t}, q)"
    for t, c in FENCED.items()))
def outlier_counts(spark, sf):
    return D.union([
        outliers.outlier_counts(V.table(spark, sf, t), outliers.fit_fences(V.table(spark, sf, t), [c]))
        for t, c in FENCED.items()])


MEASURES = ["o_orderkey", "o_custkey", "o_totalprice"]
QUALITY = (
    "SELECT 'Data Quality' AS dimension, indicator, numerator, denominator, "
    f"{pct('numerator', 'denominator')} AS value FROM (SELECT 0 AS position, '% numeric values without outliers' AS indicator, "
    "CAST(sum(inside) AS BIGINT) AS numerator, CAST(sum(present) AS BIGINT) AS denominator FROM ("
    + "\nUNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE {c} BETWEEN lower AND upper) AS inside, count({c}) AS present FROM t, "
        f"(WITH {fence_cte('t', c)} SELECT * FROM q)" for c in MEASURES)
    + ") UNION ALL SELECT 1, '% non-constant columns', (SELECT count(*) FROM ("
    + per_column(ORDERS, "SELECT count(DISTINCT {c}) AS d FROM t") + ") WHERE d > 1), 7)")


@register("data_quality_indicators", dirty(QUALITY))
def data_quality_indicators(spark, sf):
    df = V.dirty_orders(spark, sf)
    counts = outliers.outlier_counts(df, outliers.fit_fences(df))
    return D.data_quality(facts.column_facts(df), counts).select(*INDICATORS)


@register("data_quality_findings", dirty(
    "SELECT column, code, problem FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column, 'outliers' AS code, n, '''{c}'': ' || n || ' of ' || present || ' values lie outside the quartile fences' AS problem FROM ("
        f"SELECT count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS n, count({c}) AS present FROM t, (WITH {fence_cte('t', c)} SELECT * FROM q))"
        for c in MEASURES) + ") WHERE n > 0"))
def data_quality_findings(spark, sf):
    df = V.dirty_orders(spark, sf)
    counts = outliers.outlier_counts(df, outliers.fit_fences(df))
    return D.data_quality_findings(facts.column_facts(df), counts).select("column", "code", "problem")


@register("box_stats", f"""
WITH {fence_cte('events', 'value')}
SELECT 'value' AS column, round(any_value(q1), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
  round(any_value(q3), 6) AS q3, min(value) FILTER (WHERE value BETWEEN lower AND upper) AS whisker_low,
  max(value) FILTER (WHERE value BETWEEN lower AND upper) AS whisker_high, count(value) AS finite_count,
  count(*) FILTER (WHERE value < lower OR value > upper) AS outliers FROM events, q""")
def box_stats(spark, sf):
    box = inspection.box_statistics(V.table(spark, sf, "events"), ["value"])
    return rounded(box, "q1", "median", "q3").drop("lower", "upper")


@register("box_fliers", f"""
WITH {fence_cte('events', 'value')}, s AS (SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 10000)
SELECT event_id AS row, value FROM s, q WHERE value < lower OR value > upper ORDER BY event_id LIMIT 200""")
def box_fliers(spark, sf):
    events = V.table(spark, sf, "events")
    return inspection.fliers(events, "value", outliers.fit_fences(events, ["value"])["value"], "event_id")


@register("outlier_records", f"""
WITH {fence_cte('events', 'value')}
SELECT event_id + 2 AS source_row, CAST(value AS VARCHAR) AS value FROM events, q
WHERE value < lower OR value > upper ORDER BY event_id LIMIT 8""")
def outlier_records(spark, sf):
    events = V.table(spark, sf, "events")
    return inspection.outlier_records(events, "value", outliers.fit_fences(events, ["value"])["value"], "event_id")


@register("missing_records", dirty(
    "SELECT _row + 2 AS source_row, 'Missing' AS value FROM t WHERE o_totalprice IS NULL ORDER BY _row LIMIT 8"))
def missing_records(spark, sf):
    return inspection.missing_records(V.dirty_orders(spark, sf), "o_totalprice")


@register("category_counts", dirty("""
SELECT rank, CASE WHEN label <> trim(label) THEN '''' || label || '''' ELSE label END AS label, count FROM (
  SELECT o_orderpriority AS label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank
  FROM t GROUP BY 1) WHERE rank <= 8"""))
def category_counts(spark, sf):
    return inspection.category_counts(V.dirty_orders(spark, sf), "o_orderpriority").withColumn(
        "rank", F.col("rank").cast("bigint"))


@register("category_share", labeled(
    "SELECT coalesce(CAST(quality AS VARCHAR), 'Missing values') AS label, count(*) AS count FROM t GROUP BY 1"))
def category_share(spark, sf):
    return inspection.category_share(V.labeled_documents(spark, sf), "quality")


@register("before_after_counts", dirty("""
SELECT version, CASE WHEN label <> trim(label) THEN '''' || label || '''' ELSE label END AS label, count FROM (
  SELECT *, row_number() OVER (PARTITION BY version ORDER BY count DESC, label) AS rank FROM (
    SELECT 'before' AS version, o_orderpriority AS label, count(*) AS count FROM t GROUP BY 2
    UNION ALL SELECT 'after', lower(trim(o_orderpriority)), count(*) FROM t GROUP BY 2)) WHERE rank <= 8"""))
def before_after_counts(spark, sf):
    df = V.dirty_orders(spark, sf)
    after = preparation.apply(df, Operation("casefold", "o_orderpriority"))
    return inspection.before_and_after(
        lambda d: inspection.category_counts(d, "o_orderpriority").drop("rank"), df, after)


# --- preparation ------------------------------------------------------------------

KEEP_FIRST = f"""SELECT {', '.join(ORDERS)}, _row FROM (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(ORDERS)} ORDER BY _row) AS rn FROM t) WHERE rn = 1"""


@register("dedupe_keep_first", dirty(KEEP_FIRST))
def dedupe_keep_first(spark, sf):
    return duplicates.drop_duplicates(V.dirty_orders(spark, sf))


@register("duplicate_pairs", dirty(f"""
SELECT _row AS removed_row, kept_row FROM (
  SELECT _row, min(_row) OVER (PARTITION BY {', '.join(ORDERS)}) AS kept_row FROM t) WHERE _row <> kept_row"""))
def duplicate_pairs(spark, sf):
    return duplicates.duplicate_pairs(V.dirty_orders(spark, sf))


@register("duplicate_values", dirty(f"""
, p AS (SELECT * FROM (SELECT *, min(_row) OVER (PARTITION BY {', '.join(ORDERS)}) AS kept_row FROM t) WHERE _row <> kept_row)
""".replace("\n, p", ", p", 1) + "\nUNION ALL ".join(
    f"SELECT p._row AS removed_row, p.kept_row, '{c}' AS column, "
    + ", ".join(f"coalesce(CASE WHEN {v} <> trim({v}) THEN '''' || {v} || '''' ELSE {v} END, '(missing)') AS {side}"
                for side, v in ((side, f"strftime({row}.{c}, '%Y-%m-%dT%H:%M:%S')" if c == "o_orderdate" else
                                 f"CAST({f'CAST({row}.{c} AS DECIMAL(20, 2))' if c == 'o_totalprice' else f'{row}.{c}'} AS VARCHAR)")
                                for side, row in (("kept", "k"), ("removed", "p"))))
    + " FROM p JOIN t k ON k._row = p.kept_row" for c in ORDERS)))
def duplicate_values(spark, sf):
    df = V.dirty_orders(spark, sf)
    values = duplicates.pair_values(df, duplicates.duplicate_pairs(df))
    # The engines write large floating-point numbers differently.
    return values.withColumns({side: F.expr(f"if(column = 'o_totalprice' and {side} <> '(missing)', cast(cast(try_cast({side} as double) as decimal(20, 2)) as string), {side})")
                               for side in ("kept", "removed")})


@register("duplicate_pairs_hot", """
SELECT event_id AS removed_row, kept_row FROM (
  SELECT event_id, min(event_id) OVER (PARTITION BY CASE WHEN event_id % 2 = 0 THEN 'same' ELSE event_type END) AS kept_row FROM events)
WHERE event_id <> kept_row""")
def duplicate_pairs_hot(spark, sf):
    """Half of the rows are equal; the other half falls into a few groups."""
    same = V.table(spark, sf, "events").selectExpr("case when event_id % 2 = 0 then 'same' else event_type end as what", "event_id as _row")
    return duplicates.duplicate_pairs(same)


@register("nested_zero", """
SELECT count(*) AS rows, count(DISTINCT (label % 3, vec_id % 5)) AS distinct_rows, count(*) - count(DISTINCT (label % 3, vec_id % 5)) AS duplicate_rows,
  count(DISTINCT (label % 3, vec_id % 5)) AS distinct_values FROM embeddings""")
def nested_zero(spark, sf):
    """-0.0 and 0.0 inside arrays and structs are one value, for rows and for columns."""
    df = V.table(spark, sf, "embeddings").selectExpr(
        "struct(array(if(vec_id % 2 = 0, double('-0.0'), 0D), label % 3) as a, cast(vec_id % 5 as float) as b) as nested")
    return duplicates.duplicate_count(df).withColumn("distinct_values", frequencies.distinct_counts(df).select("distinct_count").scalar())


@register("nested_maps", """
SELECT count(*) AS rows, count(DISTINCT (event_type, event_id % 5, event_id % 2)) AS distinct_rows,
  count(*) - count(DISTINCT (event_type, event_id % 5, event_id % 2)) AS duplicate_rows FROM events""")
def nested_maps(spark, sf):
    """The order of a map's entries counts."""
    entries = "struct(event_type as k, double(event_id % 5) as v)", "struct('' as k, 1D as v)"
    df = V.table(spark, sf, "events").selectExpr(
        f"if(event_id % 2 = 0, map_from_entries(array({entries[0]}, {entries[1]})), map_from_entries(array({entries[1]}, {entries[0]}))) as m")
    return duplicates.duplicate_count(df)


@register("variant_duplicates", """
SELECT min(event_id) AS _row, kind, shown FROM (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'STRING' ELSE 'OBJECT' END AS kind,
    CASE WHEN event_id % 3 < 2 THEN strftime(ts, '"%Y-%m-%d"') ELSE '{"a":"x 1.0","n":' || (event_id % 40) || '}' END AS shown FROM events)
GROUP BY kind, shown""")
def variant_duplicates(spark, sf):
    """Dates, the texts that spell them, and objects whose keys and numbers are written in different ways; the kept
    rows are as they were."""
    number = "concat(event_id % 40, if(event_id % 2 = 0, '.0', ''))"
    df = V.table(spark, sf, "events").selectExpr(
        f"""case event_id % 3 when 0 then cast(to_date(ts) as variant) when 1 then parse_json(date_format(ts, '"yyyy-MM-dd"'))
        else parse_json(if(event_id % 7 = 0, concat('{{"a":"x 1.0","n":', {number}, '}}'), concat('{{"n":', {number}, ',"a":"x 1.0"}}'))) end as v""",
        "event_id as _row")
    return duplicates.drop_duplicates(df).selectExpr("_row", "regexp_extract(schema_of_variant(v), '^[A-Z]+', 0) as kind", "to_json(v) as shown")


def prepared(name: str, operation: Operation, expression: str | None, condition: str = "true",
             cte: str = "", keep: tuple[str, ...] = ("o_orderkey",), view=V.dirty_orders, sql=dirty):
    """One preparation operation, fitted and applied to a whole table."""
    column = operation.column
    shown = f", {expression} AS {column}" if expression else f", {column}"
    body = f"{cte}\nSELECT {', '.join(keep)}{shown}, _row FROM t{', q' if cte else ''} WHERE {condition}"

    @register(name, sql(body))
    def query(spark, sf):
        df = view(spark, sf)
        result = preparation.apply(df, preparation.fit(df, operation)).select(*keep, column, "_row")
        if operation.action in preparation.NUMERIC_ACTIONS:
            result = rounded(result, column)
        return result
    return query


PRICE = "o_totalprice"
Q = ", " + fence_cte("t", PRICE)
prepared("drop_missing", Operation("drop_missing", PRICE), None, f"{PRICE} IS NOT NULL")
prepared("fill_median", Operation("fill_median", PRICE), f"round(coalesce({PRICE}, med), 6)",
         cte=f", q AS (SELECT quantile_cont({PRICE}, 0.5) AS med FROM t)")
prepared("fill_mode", Operation("fill_mode", "toxic"), "coalesce(toxic, m)", keep=("doc_id",), view=V.labeled_documents,
         sql=labeled, cte=", q AS (SELECT toxic AS m FROM t WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
prepared("trim_text", Operation("trim", "o_orderpriority"), "trim(o_orderpriority)")
prepared("casefold_text", Operation("casefold", "o_orderpriority"), "lower(trim(o_orderpriority))")
prepared("clip_outliers", Operation("clip_outliers", PRICE),
         f"round(CASE WHEN {PRICE} < lower THEN lower WHEN {PRICE} > upper THEN upper ELSE {PRICE} END, 6)", cte=Q)
prepared("drop_outliers", Operation("drop_outliers", PRICE), f"round({PRICE}, 6)",
         f"{PRICE} IS NULL OR {PRICE} BETWEEN lower AND upper", Q)
SCALE = ", q AS (SELECT m, {offset} AS off, {divisor} AS div FROM t, (SELECT max(abs(o_totalprice)) AS m FROM t) GROUP BY m)"
prepared("minmax_scale", Operation("minmax", PRICE), f"round(({PRICE} / m - off) / div, 6)", cte=SCALE.format(
    offset="min(o_totalprice) / m", divisor="max(o_totalprice) / m - min(o_totalprice) / m"))
prepared("standardize", Operation("standardize", PRICE), f"round(({PRICE} / m - off) / div, 6)", cte=SCALE.format(
    offset="avg(o_totalprice / m)", divisor="stddev_pop(o_totalprice / m)"))


@register("fit_train_apply_test", f"""
WITH {fence_cte("(SELECT * FROM orders WHERE o_orderkey % 5 <> 0)", PRICE)},
s AS (SELECT max(abs(o_totalprice)) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (
  SELECT CASE WHEN o_totalprice < lower THEN lower WHEN o_totalprice > upper THEN upper ELSE o_totalprice END AS o_totalprice
  FROM orders, q WHERE o_orderkey % 5 <> 0))
SELECT o_orderkey, round((x / m - lo / m) / (hi / m - lo / m), 6) AS o_totalprice FROM (
  SELECT o_orderkey, CASE WHEN o_totalprice < lower THEN lower WHEN o_totalprice > upper THEN upper ELSE o_totalprice END AS x
  FROM orders, q WHERE o_orderkey % 5 = 0), s""")
def fit_train_apply_test(spark, sf):
    """Parameters from the training split (four fifths), reused on the test split."""
    orders = V.table(spark, sf, "orders")
    train, test = orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 5 = 0")
    clip = preparation.fit(train, Operation("clip_outliers", PRICE))
    scale = preparation.fit(preparation.apply(train, clip), Operation("minmax", PRICE))
    result = preparation.apply(preparation.apply(test, clip), scale)
    return rounded(result.select("o_orderkey", PRICE), PRICE)


OPERATIONS = [
    Operation("duplicates"), Operation("drop_missing", PRICE), Operation("fill_median", PRICE),
    Operation("trim", "o_orderpriority"), Operation("casefold", "o_orderpriority"),
    Operation("clip_outliers", PRICE), Operation("drop_outliers", PRICE)]


@register("change_audit", dirty(f""", {fence_cte('t', PRICE)},
c AS (SELECT count(*) AS n, count(*) - count({PRICE}) AS gone, count(*) FILTER (WHERE {PRICE} < lower OR {PRICE} > upper) AS out,
  count(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM trim(o_orderpriority)) AS trimmed,
  count(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM lower(trim(o_orderpriority))) AS folded,
  count(*) - (SELECT count(*) FROM ({KEEP_FIRST})) AS dup FROM t, q)
SELECT 'duplicates' AS action, n AS rows, dup AS affected_rows, CAST(0 AS BIGINT) AS changed_cells, dup AS removed_rows FROM c
UNION ALL SELECT 'drop_missing', n, gone, 0, gone FROM c
UNION ALL SELECT 'fill_median', n, gone, gone, 0 FROM c
UNION ALL SELECT 'trim', n, trimmed, trimmed, 0 FROM c
UNION ALL SELECT 'casefold', n, folded, folded, 0 FROM c
UNION ALL SELECT 'clip_outliers', n, out, out, 0 FROM c
UNION ALL SELECT 'drop_outliers', n, out, 0, out FROM c""".replace("WITH t AS", "WITH t AS", 1)))
def change_audit(spark, sf):
    df = V.dirty_orders(spark, sf)
    return D.union([
        preparation.audit(df, preparation.fit(df, o)).withColumn("action", F.lit(o.action)) for o in OPERATIONS])


@register("change_examples", dirty("""
SELECT row, _row + 2 AS source_row, '''' || o_orderpriority || '''' AS before, lower(trim(o_orderpriority)) AS after
FROM (SELECT *, row_number() OVER (ORDER BY _row) AS row FROM t) WHERE o_orderpriority <> trim(o_orderpriority) ORDER BY _row LIMIT 8"""))
def change_examples(spark, sf):
    df = V.dirty_orders(spark, sf)
    return preparation.examples(df, Operation("trim", "o_orderpriority")).drop("matched_row", "matched_source_row")


@register("duplicate_examples", dirty(f"""
SELECT row, _row + 2 AS source_row, matched_row, kept_row + 2 AS matched_source_row, 'Row removed' AS after,
  'o_orderkey=' || o_orderkey || '; o_custkey=' || o_custkey || '; o_orderstatus=' || o_orderstatus || '; o_totalprice=' || coalesce(CAST(o_totalprice AS VARCHAR), '(missing)') AS before
FROM (SELECT *, min(_row) OVER (PARTITION BY {', '.join(ORDERS)}) AS kept_row, min(row) OVER (PARTITION BY {', '.join(ORDERS)}) AS matched_row
  FROM (SELECT *, row_number() OVER (ORDER BY _row) AS row FROM t)) WHERE _row <> kept_row ORDER BY _row LIMIT 8"""))
def duplicate_examples(spark, sf):
    return preparation.examples(V.dirty_orders(spark, sf), Operation("duplicates"))


RECIPE = [Operation("duplicates"), Operation("casefold", "o_orderpriority"), Operation("fill_median", PRICE),
          Operation("clip_outliers", PRICE)]
RECIPE_SQL = f""", d AS ({KEEP_FIRST}),
f AS (SELECT * REPLACE (lower(trim(o_orderpriority)) AS o_orderpriority,
  coalesce({PRICE}, (SELECT quantile_cont({PRICE}, 0.5) FROM d)) AS {PRICE}) FROM d), {fence_cte('f', PRICE)}"""


@register("recipe_replay", dirty(RECIPE_SQL + f"""
SELECT o_orderkey, o_orderpriority, round(CASE WHEN {PRICE} < lower THEN lower WHEN {PRICE} > upper THEN upper ELSE {PRICE} END, 6)
  AS {PRICE}, _row + 2 AS source_row FROM f, q"""))
def recipe_replay(spark, sf):
    df = V.dirty_orders(spark, sf)
    result = Recipe.fit(df, RECIPE).apply(df)
    return rounded(result, PRICE).select("o_orderkey", "o_orderpriority", PRICE, (F.col("_row") + 2).alias("source_row"))


@register("recipe_json_replay", """
SELECT event_id AS _row, coalesce(CASE WHEN event_id % 9 <> 0 THEN date_trunc('day', ts) END, (SELECT d FROM (
  SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY 1) ORDER BY n DESC, d LIMIT 1)) AS day,
  coalesce(CASE WHEN event_id % 11 <> 0 THEN event_type END, (SELECT k FROM (
  SELECT event_type AS k, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1) ORDER BY n DESC, k LIMIT 1)) AS code FROM events""")
def recipe_json_replay(spark, sf):
    """Fitted instants and bytes come back from JSON as they were, whatever the time zone of the session."""
    df = V.table(spark, sf, "events").selectExpr(
        "case when event_id % 9 <> 0 then date_trunc('day', ts) end as day", "case when event_id % 11 <> 0 then encode(event_type, 'UTF-8') end as code",
        "event_id as _row")
    recipe = Recipe.fit(df, [Operation("fill_mode", "day"), Operation("fill_mode", "code")])
    return Recipe.from_json(recipe.to_json()).apply(df).withColumn("code", F.decode("code", "UTF-8"))


STEPS = [Operation("trim", "custkey_text"), Operation("drop_missing", PRICE), Operation("trim", "o_orderpriority"), Operation("casefold", "o_orderpriority")]


@register("recipe_noop", dirty("""
SELECT 'drop_missing' AS action, count(*) - count(o_totalprice) AS affected_rows, CAST(0 AS BIGINT) AS changed_cells, count(*) - count(o_totalprice) AS removed_rows FROM t
UNION ALL SELECT 'trim', n, n, 0 FROM (SELECT count(*) AS n FROM t WHERE o_totalprice IS NOT NULL AND o_orderpriority <> trim(o_orderpriority))
UNION ALL SELECT 'casefold', n, n, 0 FROM (SELECT count(*) AS n FROM t WHERE o_totalprice IS NOT NULL AND trim(o_orderpriority) <> lower(trim(o_orderpriority)))"""))
def recipe_noop(spark, sf):
    """A step that changes nothing is not recorded."""
    recipe = Recipe.fit(V.dirty_orders(spark, sf), STEPS, skip_unchanged=True)
    return spark.createDataFrame(
        [(r["action"], r["affected_rows"], r["changed_cells"], r["removed_rows"]) for r in recipe.records()],
        "action string, affected_rows bigint, changed_cells bigint, removed_rows bigint")


@register("recipe_target_change", dirty("""
SELECT 'o_orderstatus' AS target, CAST(3 AS BIGINT) AS steps, count(o_totalprice) AS rows FROM t
UNION ALL SELECT 'o_orderpriority', 0, count(*) FROM t"""))
def recipe_target_change(spark, sf):
    """Another target clears the steps: the rows are those of the source again."""
    df = V.dirty_orders(spark, sf)
    recipe = Recipe.fit(df, STEPS, target="o_orderstatus", skip_unchanged=True)
    return D.union([r.apply(df).agg(F.lit(r.target).alias("target"), F.lit(len(r.steps)).cast("bigint").alias("steps"), F.count(F.lit(1)).alias("rows"))
                    for r in (recipe, recipe.with_target("o_orderpriority"))])


@register("preparation_guards", """
SELECT guard, refused FROM (SELECT 'infinity' AS guard, count(*) FILTER (WHERE o_orderkey % 100 = 1) > 0 AS refused FROM orders
UNION ALL SELECT 'no values', count(*) > 0 FROM orders UNION ALL SELECT 'constant', count(DISTINCT o_totalprice * 0) < 2 FROM orders
UNION ALL SELECT 'every row', count(*) > 0 FROM orders UNION ALL SELECT 'varying', count(DISTINCT o_totalprice) < 2 FROM orders
UNION ALL SELECT 'target', true UNION ALL SELECT 'text', true UNION ALL SELECT 'unknown name', true UNION ALL SELECT 'unknown action', true)""")
def preparation_guards(spark, sf):
    """What each guard says of the whole table; the data decide the first five."""
    df = V.table(spark, sf, "orders").selectExpr(
        "if(o_orderkey % 100 = 1, double('inf'), o_totalprice) as wild", "cast(null as double) as none", "o_totalprice * 0 as flat", "o_totalprice",
        "o_orderpriority", "o_orderkey as _row")
    rows = []
    for guard, action, column in (
            ("infinity", "clip_outliers", "wild"), ("no values", "fill_median", "none"), ("constant", "minmax", "flat"), ("every row", "drop_missing", "none"),
            ("varying", "minmax", "o_totalprice"), ("target", "fill_mode", "flat"), ("text", "standardize", "o_orderpriority"),
            ("unknown name", "trim", "o_nothing"), ("unknown action", "round", "flat")):
        try:
            Recipe.fit(df, [Operation(action, column)], target="flat" if guard == "target" else None)
            rows.append((guard, False))
        except ValueError:
            rows.append((guard, True))
    return spark.createDataFrame(rows, "guard string, refused boolean")


@register("prepared_sink", dirty(RECIPE_SQL + f"""
SELECT o_orderkey, o_orderpriority, round(CASE WHEN {PRICE} < lower THEN lower WHEN {PRICE} > upper THEN upper ELSE {PRICE} END, 6) AS {PRICE},
  (SELECT count(*) FROM t) AS original_rows, (SELECT count(*) FROM d) AS prepared_rows, CAST(4 AS BIGINT) AS steps FROM f, q"""))
def prepared_sink(spark, sf):
    """The prepared table and its manifest, written and read back."""
    df = V.dirty_orders(spark, sf)
    recipe = Recipe.fit(df, RECIPE)
    path, record = write_table(df, recipe, f"{shared_folder(spark)}/{uuid4().hex}.parquet", context())
    shown = spark.read.text(record).selectExpr(
        "cast(get_json_object(value, '$.original_rows') as bigint) as original_rows", "cast(get_json_object(value, '$.prepared_rows') as bigint) as prepared_rows",
        "cast(json_array_length(get_json_object(value, '$.steps')) as bigint) as steps")
    return rounded(spark.read.parquet(path), PRICE).select("o_orderkey", "o_orderpriority", PRICE).join(F.broadcast(shown))  # one row


@register("recipe_undo", dirty(RECIPE_SQL + f"\nSELECT o_orderkey, o_orderpriority, round({PRICE}, 6) AS {PRICE} FROM f, q"))
def recipe_undo(spark, sf):
    df = V.dirty_orders(spark, sf)
    result = Recipe.fit(df, RECIPE).undo().apply(df)
    return rounded(result, PRICE).select("o_orderkey", "o_orderpriority", PRICE)


# --- scores -----------------------------------------------------------------------

def context() -> UsageContext:
    made = UsageContext("Predict the order status", "classification", "o_orderstatus", ["o_totalprice"])
    made.documentation["data_collection"] = made.provenance["origin"] = True
    return made


def scores_sql(missing: str) -> str:
    """Scores of the six dimensions of t; ``missing``: which cells of t are missing."""
    return f""", k AS (SELECT count(*) AS n, count(*) FILTER (WHERE {missing}) AS gone FROM t),
consistency AS ({CONSISTENCY}), quality AS ({QUALITY}),
scores AS (
  SELECT 'Completeness' AS dimension, {r2(f"({pct('n * 7 - gone', '(n * 7)')} + {pct('CAST(6 + CAST(gone * 1.0 / n < 0.2 AS INT) AS BIGINT)', '7')} + {pct('n - gone', 'n')} + {pct('n - gone', 'n')}) / 4")} AS score, 7.8 AS w FROM k
  UNION ALL SELECT 'Consistency', {r2('sum(value) / 3')}, 2.1 FROM consistency
  UNION ALL SELECT 'Class Balance', {pct('min(c)', 'max(c)')}, 2.3 FROM (SELECT count(*) AS c FROM t GROUP BY o_orderstatus)
  UNION ALL SELECT 'Documentation', {r2('100.0 / 6')}, 2.5
  UNION ALL SELECT 'Provenance', {r2('100.0 / 5')}, 2.5
  UNION ALL SELECT 'Data Quality', {r2('sum(value) / 2')}, 15.1 FROM quality)"""


SCORES = scores_sql("o_totalprice IS NULL")
BAND = "CASE WHEN score >= 90 THEN 'Ready' WHEN score >= 75 THEN 'Almost ready' WHEN score >= 50 THEN 'Requires preparation' ELSE 'Not ready' END"


@register("dimension_scores", dirty(SCORES + f"""
SELECT dimension, true AS applicable, score, CAST(w AS DOUBLE) AS weight, {pct('w', '32.3')} AS weight_percentage FROM scores"""))
def dimension_scores(spark, sf):
    return evaluate(V.dirty_orders(spark, sf), context()).dimensions.select(
        "dimension", "applicable", "score", "weight", "weight_percentage")


def task_query(task: str, target: str | None) -> None:
    """Weights of the other tasks; class balance does not apply to them."""
    weights = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in K.DIMENSION_WEIGHTS[task].items()) + " END"
    total = sum(K.DIMENSION_WEIGHTS[task].values())
    score = "score" if target else f"CASE dimension WHEN 'Documentation' THEN {r2('100.0 / 5')} ELSE score END"  # no target to define

    @register(f"dimension_scores_{task}", dirty(SCORES + f"""
SELECT dimension, dimension <> 'Class Balance' AS applicable, CASE WHEN dimension <> 'Class Balance' THEN {score} END AS score,
  CASE WHEN dimension <> 'Class Balance' THEN {pct(f'({weights})', f'{total!r}')} END AS weight_percentage FROM scores"""))
    def query(spark, sf):
        usage = UsageContext("Predict the price", task, target, ["o_totalprice"])
        usage.documentation["data_collection"] = usage.provenance["origin"] = True
        return evaluate(V.dirty_orders(spark, sf), usage).dimensions.select("dimension", "applicable", "score", "weight_percentage")


task_query("regression", "o_totalprice")
task_query("other", None)


@register("report_tables", dirty(SCORES + f"""
SELECT 'dimension' AS kind, dimension AS name, score AS value FROM scores
UNION ALL SELECT 'info', 'rows', CAST(count(*) AS DOUBLE) FROM t
UNION ALL SELECT 'histogram', 'o_totalprice', CAST(count(o_totalprice) AS DOUBLE) FROM t
UNION ALL SELECT 'context', 'classification', 1.0"""))
def report_tables(spark, sf):
    """A report written and read back: scores, the information record, histograms and the context."""
    df, folder = V.dirty_orders(spark, sf), f"{shared_folder(spark)}/{uuid4().hex}"
    info = df.agg(F.count(F.lit(1)).alias("rows"))
    write_report(evaluate(df, context()), folder, profile.column_profile(df), info=info, context=context(), histograms=profile.histograms(df))
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return D.union([
        read("dimensions").selectExpr("'dimension' as kind", "dimension as name", "score as value"),
        read("info").selectExpr("'info' as kind", "'rows' as name", "cast(rows as double) as value"),
        read("histograms").where("column = 'o_totalprice'").groupBy("column").agg(F.sum("count").alias("n")).selectExpr("'histogram' as kind", "column as name", "cast(n as double) as value"),
        read("context").selectExpr("'context' as kind", "get_json_object(body, '$.task_type') as name", "1D as value")])


def overall_sql(weight: str, source: str) -> str:
    return SCORES + f"""
SELECT score, {BAND} AS classification, '{source}' AS weight_source FROM (
  SELECT {r2(f'sum(score * {weight}) / sum({weight})')} AS score FROM scores)"""


@register("overall_score", dirty(overall_sql("w", "study_defaults")))
def overall_score(spark, sf):
    return evaluate(V.dirty_orders(spark, sf), context()).scorecard.drop("dataset_id")


OVERRIDE = "CASE dimension WHEN 'Documentation' THEN 0 WHEN 'Completeness' THEN 30 ELSE w END"


@register("weight_override", dirty(overall_sql(f"({OVERRIDE})", "custom")))
def weight_override(spark, sf):
    result = evaluate(V.dirty_orders(spark, sf), context())
    return result.reweight({"Documentation": 0, "Completeness": 30}).scorecard.drop("dataset_id")


@register("all_findings")
def all_findings(spark, sf):
    return evaluate(V.dirty_orders(spark, sf), context()).findings.drop("dataset_id")


PREPARED = dirty(RECIPE_SQL + f"""
SELECT f.* REPLACE (CASE WHEN {PRICE} < lower THEN lower WHEN {PRICE} > upper THEN upper ELSE {PRICE} END AS {PRICE}) FROM f, q""")
OVERALL = "SELECT dimension, score FROM {v} UNION ALL SELECT 'Overall', " + r2("sum(score * w) / sum(w)") + " FROM {v}"


@register("compare_before_after", f"""
WITH a AS ({dirty(SCORES)} SELECT * FROM scores), b AS (WITH t AS ({PREPARED}){SCORES} SELECT * FROM scores),
x AS ({OVERALL.replace('{v}', 'a')}), y AS ({OVERALL.replace('{v}', 'b')})
SELECT x.dimension, x.score AS original, y.score AS prepared, round(y.score - x.score, 2) AS delta
FROM x JOIN y ON x.dimension = y.dimension""")
def compare_before_after(spark, sf):
    df = V.dirty_orders(spark, sf)
    return compare(df, Recipe.fit(df, RECIPE).apply(df), context())


# Table: measurements; texts; other columns.
SCORED = {
    "region": ("r_regionkey", "r_name", ""), "nation": ("n_nationkey n_regionkey", "n_name", ""),
    "customer": ("c_custkey c_nationkey c_acctbal", "c_name c_mktsegment", ""),
    "supplier": ("s_suppkey s_nationkey s_acctbal", "s_name", ""),
    "part": ("p_partkey p_size p_retailprice", "p_name p_brand p_type", ""),
    "orders": ("o_orderkey o_custkey o_totalprice", "o_orderstatus o_orderpriority", "o_orderdate"),
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "l_returnflag l_linestatus", "l_shipdate"),
    "events": ("event_id user_id value", "event_type props", "ts"), "documents": ("doc_id n_chars", "text lang source", ""),
    "embeddings": ("vec_id label", "", "embedding"), "pages": ("page_id", "url html", ""), "benchmark": ("item_id", "text", ""),
    "labels": ("doc_id quality toxic", "", ""), "conversations": ("conv_id turn", "role text", ""),
    "dirty": ("o_orderkey o_custkey o_totalprice", "o_orderstatus o_orderpriority custkey_text", "o_orderdate"),
}
DIRTY_TABLE = f"(SELECT * EXCLUDE (_row) FROM ({V.DIRTY_ORDERS}))"


def scored_sql(name: str) -> str:
    """The overall score of one table without context or metadata."""
    source = DIRTY_TABLE if name == "dirty" else f"(SELECT * FROM {name})"
    measures, texts, others = [part.split() for part in SCORED[name]]
    columns = [*measures, *texts, *others]
    add = lambda parts: f"CAST({' + '.join(parts) or '0'} AS BIGINT)"
    numeric = lambda c: f"CAST(count({c}) > 0 AND count(TRY_CAST(trim({c}) AS DOUBLE)) >= 0.9 * count({c}) AS INT)"
    w = K.DIMENSION_WEIGHTS["other"]
    fences = ", ".join(fence_cte("t", c, f"q{i}") for i, c in enumerate(measures))
    beyond = add(f"(SELECT count(*) FROM t, q{i} WHERE {c} < lower OR {c} > upper)" for i, c in enumerate(measures))
    varying = add(f"CAST(EXISTS(SELECT 1 FROM t GROUP BY lower(trim({c})) HAVING count(DISTINCT {c}) > 1) AS INT)" for c in texts)
    completeness = [pct("filled", f"(n * {len(columns)})"), pct("acceptable", f"{len(columns)}"), pct("complete", "n"), "100"]
    categorical = len(texts) + len(others)
    consistency = [pct("different", "n"), pct(f"({len(columns)} - spelt)", f"{len(columns)}"),
                   pct(f"({categorical} - varying)", f"{categorical}") if categorical else "100"]
    quality = [pct("(present - beyond)", "present"), pct("varied", f"{len(columns)}")]
    mean = lambda parts: r2(f"({' + '.join(parts)}) / {len(parts)}.0")
    return f"""
SELECT '{name}' AS dataset_id, score, {BAND} AS classification, 'study_defaults' AS weight_source, CAST(NULL AS VARCHAR) AS error FROM (
WITH t AS {source}, {fences}, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}) AS complete,
  {add(f'count({c})' for c in columns)} AS filled, {add(f'CAST(count(*) - count({c}) < 0.2 * count(*) AS INT)' for c in columns)} AS acceptable,
  {add(map(numeric, texts))} AS spelt, {add(f'count({c})' for c in measures)} AS present, {add(f'CAST(min({c}) < max({c}) AS INT)' for c in columns)} AS varied,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS different, {varying} AS varying, {beyond} AS beyond FROM t)
SELECT {r2(f"({w['Completeness']} * {mean(completeness)} + {w['Consistency']} * {mean(consistency)} + {w['Data Quality']} * {mean(quality)}) / {sum(w.values())!r}")} AS score FROM k)"""


@register("score_tables", "\nUNION ALL ".join(map(scored_sql, SCORED)))
def score_tables(spark, sf):
    """All supplied tables and one with faults, measured together."""
    return score_many({n: V.dirty_orders(spark, sf) if n == "dirty" else V.table(spark, sf, n) for n in SCORED}).select(
        "dataset_id", "score", "classification", "weight_source", "error")


# --- metadata ---------------------------------------------------------------------
# Every order is a dataset and its line numbers are its columns; metadata bodies are
# assembled from the order and its lines.

LINES = """
SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS described,
  max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS united, max(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS listed
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def metadata_tables(spark, sf):
    lineitem, orders = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.expr("max(case when l_returnflag <> 'N' then 1 else 0 end) as described"),
        F.expr("max(case when l_linestatus = 'F' then 1 else 0 end) as united"),
        F.expr("max(case when l_tax > 0.04 then 1 else 0 end) as listed"))
    columns = lines.selectExpr("cast(l_orderkey as string) as dataset_id", "concat('line', l_linenumber) as column")
    # An order has at most seven line numbers, which bounds the collected map.
    entries = lines.groupBy("l_orderkey").agg(F.expr("""
        map_from_entries(collect_list(struct(concat('line', l_linenumber) as key, named_struct(
            'description', case when described = 1 then 'line' else ' ' end,
            'unit', case when united = 1 then 'piece' end,
            'categories', case when listed = 1 then map('a', 'first') else map('a', '') end) as value))) as columns"""))
    bodies = orders.join(entries, orders.o_orderkey == entries.l_orderkey, "left").selectExpr(
        "cast(o_orderkey as string) as dataset_id",
        """parse_json(to_json(named_struct('schema_version', '1', 'columns', columns,
            'documentation', named_struct(
                'target_definition', named_struct('column', 'line1', 'description', o_orderpriority),
                'data_collection', case when o_orderstatus = 'F' then '  ' else o_orderstatus end,
                'collection_period', named_struct('start', date_format(o_orderdate, 'yyyy-MM-dd'),
                    'end', case when o_orderkey % 3 = 0 then '1990-02-30' else '2020-01-01' end),
                'known_limitations', case when o_orderkey % 4 = 0 then array() else array(o_orderpriority) end),
            'provenance', named_struct('origin', o_orderpriority, 'collector', case when o_custkey % 2 = 0 then 'team' end,
                'generation_period', named_struct('start', '2020-01-01', 'end', date_format(o_orderdate, 'yyyy-MM-dd')),
                'transformations', array(o_orderstatus, case when o_orderkey % 7 = 0 then ' ' else 'raw' end),
                'version', o_orderkey)))) as body""",
        "'orders' as source", "cast(null as string) as sha256", "cast(array() as array<string>) as warnings")
    contexts = orders.selectExpr(
        "cast(o_orderkey as string) as dataset_id",
        "case when o_orderkey % 6 = 0 then null else 'line1' end as target_column",
        "map('collector', o_orderstatus = 'P', 'target_definition', o_custkey % 10 = 0) as claims")
    return bodies, columns, contexts


COVERAGE = f"""WITH lines AS ({LINES}), cov AS (SELECT l_orderkey, count(*) AS columns,
  CAST(sum(described) AS BIGINT) AS described, CAST(sum(greatest(united, listed)) AS BIGINT) AS with_units,
  max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS has_first FROM lines GROUP BY 1)"""


@register("metadata_coverage", COVERAGE + """
SELECT CAST(l_orderkey AS VARCHAR) AS dataset_id, columns, described, with_units FROM cov""")
def metadata_coverage(spark, sf):
    bodies, columns, _ = metadata_tables(spark, sf)
    return metadata_audit.column_coverage(bodies, columns)


ITEMS = COVERAGE + """, o AS (
  SELECT orders.*, coalesce(columns, 0) AS cols, coalesce(described, 0) AS described, coalesce(with_units, 0) AS with_units,
    coalesce(has_first, 0) AS has_first FROM orders LEFT JOIN cov ON o_orderkey = l_orderkey),
items AS (
  SELECT o_orderkey, 'variable_descriptions' AS item, true AS applicable, false AS claimed, described AS part, cols AS whole FROM o
  UNION ALL SELECT o_orderkey, 'target_definition', o_orderkey % 6 <> 0, o_custkey % 10 = 0,
    CAST(o_orderkey % 6 <> 0 AND has_first = 1 AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'data_collection', true, false, CAST(o_orderstatus <> 'F' AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'collection_period', true, false, CAST(o_orderkey % 3 <> 0 AND o_orderdate <= DATE '2020-01-01' AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'units_and_categories', true, false, with_units, cols FROM o
  UNION ALL SELECT o_orderkey, 'known_limitations', true, false, CAST(o_orderkey % 4 <> 0 AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'origin', true, false, 1, 1 FROM o
  UNION ALL SELECT o_orderkey, 'collector', true, o_orderstatus = 'P', CAST(o_custkey % 2 = 0 AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'generation_period', true, false, CAST(o_orderdate >= DATE '2020-01-01' AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'transformations', true, false, CAST(o_orderkey % 7 <> 0 AS INT), 1 FROM o
  UNION ALL SELECT o_orderkey, 'version', true, false, 0, 1 FROM o),
judged AS (SELECT *, CASE WHEN claimed AND applicable THEN 100.0::DOUBLE WHEN whole = 0 THEN 0.0 ELSE """ + pct("part", "whole") + """ END AS score FROM items)
"""


def said(text: str) -> str:
    """A text as SQL; ``register`` would quote the bare word inside it."""
    return "'" + text.replace("column", "col' || 'umn") + "'"


@register("metadata_items", ITEMS + """
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, dimension, position, item, label, CASE WHEN covers THEN part ELSE 0 END AS covered, cols AS columns, score,
  CASE WHEN NOT applicable THEN 'not_applicable' WHEN claimed THEN 'self_reported'
    WHEN whole > 0 AND part = whole THEN 'documented' WHEN score > 0 THEN 'partial' ELSE 'missing' END AS status,
  claimed AS self_reported, applicable, CASE WHEN claimed AND applicable THEN 'User checkbox' ELSE 'orders' END AS source,
  CASE WHEN covers THEN 'columns' ELSE lower(dimension) || '.' || item END AS field,
  CASE WHEN NOT applicable THEN """ + f"{said(metadata_audit.EXCLUDED_DETAIL)} WHEN claimed THEN {said(metadata_audit.CLAIMED_DETAIL)}" + """
    WHEN covers THEN part || '/' || cols || ' dataset columns covered.' ELSE asks END AS detail
FROM judged JOIN (SELECT o_orderkey, cols FROM o) USING (o_orderkey) JOIN (VALUES """ + ", ".join(
    f"('{d}', {i}, '{item}', '{label}', {said(metadata_audit.DETAILS.get(item, metadata_audit.TEXT_DETAIL))}, {item in metadata_audit.COVERAGE_ITEMS})"
    for d, labels in metadata_audit.LABELS.items() for i, (item, label) in enumerate(labels.items()))
    + """) v(dimension, position, item, label, asks, covers) USING (item)""")
def metadata_items(spark, sf):
    """All columns but the evidence, which ``metadata_evidence`` compares."""
    return metadata_audit.audit(*metadata_tables(spark, sf)).drop("evidence")


@register("metadata_evidence", COVERAGE + """
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, item, evidence FROM (
  SELECT o_orderkey, 'variable_descriptions' AS item, '[' || coalesce(string_agg('"line' || l_linenumber || '"', ',' ORDER BY l_linenumber) FILTER (described = 1), '') || ']' AS evidence
    FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1
  UNION ALL SELECT o_orderkey, 'origin', '"' || o_orderpriority || '"' FROM orders
  UNION ALL SELECT o_orderkey, 'collector', CASE WHEN o_orderstatus = 'P' THEN 'true' WHEN o_custkey % 2 = 0 THEN '"team"' END FROM orders
  UNION ALL SELECT o_orderkey, 'version', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT o_orderkey, 'known_limitations', CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE '["' || o_orderpriority || '"]' END FROM orders)""")
def metadata_evidence(spark, sf):
    items = metadata_audit.audit(*metadata_tables(spark, sf))
    return items.where("item in ('variable_descriptions', 'origin', 'collector', 'version', 'known_limitations')").select("dataset_id", "item", "evidence")


@register("metadata_scores", ITEMS + f"""
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CASE WHEN item IN ('origin', 'collector', 'generation_period', 'transformations', 'version')
  THEN 'Provenance' ELSE 'Documentation' END AS dimension, {r2('sum(score) / count(*)')} AS score
FROM judged WHERE applicable GROUP BY 1, 2""")
def metadata_scores(spark, sf):
    items = metadata_audit.audit(*metadata_tables(spark, sf))
    return scoring.dimension_scores(metadata_audit.audit_indicators(items)).drop("applicable")


@register("metadata_findings", ITEMS + """
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, item AS code FROM judged WHERE applicable AND score < 100""")
def metadata_findings(spark, sf):
    return metadata_audit.audit_findings(metadata_audit.audit(*metadata_tables(spark, sf))).select("dataset_id", "code")


@register("metadata_envelope", """
SELECT CAST(event_id AS VARCHAR) AS dataset_id, CASE WHEN event_type = 'error' THEN 'metadata is not valid JSON'
  WHEN event_type = 'click' THEN 'metadata must be a JSON object' WHEN event_type = 'view' THEN 'schema_version must be "1"'
  WHEN event_id % 2 = 0 THEN 'dataset_sha256 does not match this dataset; evidence ignored' END AS warning FROM events""")
def metadata_envelope(spark, sf):
    from plumbline.sources.metadata import checked_metadata
    texts = V.table(spark, sf, "events").selectExpr(
        "cast(event_id as string) as dataset_id", "'e' as source", "cast(event_id as string) as sha256",
        """case event_type when 'error' then concat('{', props) when 'click' then concat('[', props, ']') when 'view' then props
           else to_json(named_struct('schema_version', '1', 'dataset_sha256',
                case when event_id % 2 = 0 then 'other' else cast(event_id as string) end)) end as text""")
    return checked_metadata(texts).selectExpr("dataset_id", "substring(try_element_at(warnings, 1), 4) as warning")


# --- sources ----------------------------------------------------------------------

@register("parquet_positions", "SELECT o_orderkey, o_orderkey AS _row FROM orders")
def parquet_positions(spark, sf):
    return read_parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "_row")


@register("csv_scan", dirty("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
  CASE WHEN custkey_text <> 'n/a' THEN CAST(custkey_text AS BIGINT) END AS custkey_text FROM t"""))
def csv_scan(spark, sf):
    """The dirty orders written as CSV and read back with detected types."""
    folder = f"{shared_folder(spark)}/{uuid4().hex}.csv"
    V.dirty_orders(spark, sf).select(*ORDERS).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.csv(
        folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_csv(spark, folder, row_id=None).data


@register("stream_recipe", f"""
WITH {fence_cte('orders', PRICE)}
SELECT o_orderkey, lower(trim(o_orderpriority)) AS o_orderpriority,
  round(CASE WHEN {PRICE} < lower THEN lower WHEN {PRICE} > upper THEN upper ELSE {PRICE} END, 6) AS {PRICE} FROM orders, q""")
def stream_recipe(spark, sf):
    """A recipe fitted on the table, applied to the same files as a stream."""
    orders = V.table(spark, sf, "orders").withColumn("_row", F.col("o_orderkey"))
    recipe = Recipe.fit(orders, [Operation("casefold", "o_orderpriority"), Operation("clip_outliers", PRICE)],
                        skip_unchanged=True)
    if len(recipe.steps) == 1:  # no outlier to clip in this table: use the fitted bounds all the same
        clip = preparation.fit(orders, Operation("clip_outliers", PRICE))
        recipe = Recipe(recipe.steps + (Step(clip),))
    stream = spark.readStream.schema(orders.drop("_row").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    folder = f"{shared_folder(spark)}/{uuid4().hex}"
    query = write_prepared(stream, recipe, f"{folder}/data", f"{folder}/progress", available_now=True)
    query.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/data").select("o_orderkey", "o_orderpriority", PRICE), PRICE)


@register("file_fingerprints")
def file_fingerprints(spark, sf):
    return fingerprints(spark, f"{sf}/*.parquet").selectExpr(
        "element_at(split(path, '/'), -1) as file", "length", "sha256")


@register("dataset_fingerprints")
def dataset_fingerprints(spark, sf):
    return dataset_fingerprint(fingerprints(spark, f"{sf}/*.parquet"))
