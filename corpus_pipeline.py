"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again. All but the last return the columns of ``documents``.

1. quality rules: failing lines go, documents that lose too much or fail the base rule go;
2. line dedup: a line of three or more documents stays in the largest ``doc_id`` only;
3. MinHash near-dedup: the smallest ``doc_id`` of each class stays;
4. benchmark decontamination: documents that contain a benchmark item go;
5. best-fit packing: the rest becomes pieces with places in sequences of 1024 tokens.

A missing or empty text fails the quality rules. A missing id is an id of its own kind, before all others: its rows are judged one
by one by their texts, but count as one document where stage 2 counts the documents of a line. Rows that repeat as a whole
become one in stage 3. An empty table goes through all stages and gives no pieces; further columns stay until stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.lineage import written
from plumbline.llm.contamination import drop_contaminated
from plumbline.llm.lines import drop_repeated_lines
from plumbline.llm.near import keep_one
from plumbline.llm.packing import pack
from plumbline.llm.quality import clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Connected components of near-duplicates and token ids are beyond SQL; a test holds the rows of ``run`` against a
#: brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
