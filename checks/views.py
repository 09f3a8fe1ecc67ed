"""Deterministic dirt on the supplied tables, as expressions both engines accept.

The supplied tables have no missing values, duplicates or spelling variants, so these
views add some. All rows of the source take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

APPENDED = 1_000_000_000_000

ORDER_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000 "
    "ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
    "CASE WHEN o_orderkey % 5 = 0 THEN '  ' || lower(o_orderpriority) || ' ' "
    "ELSE o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE '' || o_custkey END AS custkey_text",
]

DIRTY_ORDERS = f"""
SELECT {', '.join(ORDER_COLUMNS)}, o_orderkey AS _row FROM orders
UNION ALL
SELECT {', '.join(ORDER_COLUMNS)}, o_orderkey + {APPENDED} AS _row FROM orders WHERE o_orderkey % 50 = 0"""

LABELED_DOCUMENTS = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, d.doc_id AS _row
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

NARROW_LINEITEM = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_linenumber FROM lineitem"

TWICE_EMBEDDINGS = """
SELECT vec_id, embedding, label, vec_id AS _row FROM embeddings
UNION ALL
SELECT vec_id, embedding, label, vec_id + 1000000000000 AS _row FROM embeddings WHERE label % 2 = 0"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    first = orders.selectExpr(*ORDER_COLUMNS, "o_orderkey AS _row")
    again = orders.where("o_orderkey % 50 = 0").selectExpr(*ORDER_COLUMNS, f"o_orderkey + {APPENDED} AS _row")
    return first.unionByName(again)


def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = documents.join(labels, "doc_id", "left")
    return joined.selectExpr("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "doc_id AS _row")


def narrow_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber")


def twice_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vectors.selectExpr("*", "vec_id AS _row").unionByName(
        vectors.where("label % 2 = 0").selectExpr("*", f"vec_id + {APPENDED} AS _row"))
