"""CSV with detected delimiter, character set and column types."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import ROW_ID, literal, quote
from plumbline.functions.lineage import written
from plumbline.functions.text import INTEGER_PATTERN, is_number_sql, number_sql, strip_sql
from plumbline.sources.files import LoadError, placed_rows

# Delimiters in order of preference, and how much text decides.
DELIMITERS = (",", ";", "\t")
SAMPLE_CHARACTERS = 10_000

# Texts that mean a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Texts of a boolean column.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")

CHARSETS = {"utf-8-sig": "UTF-8", "latin1": "ISO-8859-1"}
EXTRA = "__extra_field__"


@dataclass
class CsvTable:
    data: DataFrame
    encoding: str
    delimiter: str


def read_csv(spark: SparkSession, path: str, row_id: str | None = ROW_ID) -> CsvTable:
    """Three passes: one looks at the bytes, the first lines and the quotes of every file, one decides types, and the
    reader itself.

    A file is split across tasks unless some line of it has an odd number of quotes, which is the only way a record
    can span lines.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    files = written(lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"),
        (quotes % 2 == 1).alias("odd"), place.alias("place")).groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("odd"),
        F.min_by("line", F.when(F.length(F.trim("line")) > 0, F.col("place"))).alias("head")), "csv-files")
    facts = files.agg(F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("odd"), F.bool_and("odd").alias("all_odd")).first()
    if facts["utf8"] is None:
        raise LoadError("The file has no columns to read.")
    encoding = "utf-8-sig" if facts["utf8"] else "latin1"
    sample = _sample(lines, encoding)
    delimiter = detect_delimiter(sample)
    names = header_names(sample, delimiter)
    _check_headers(files, names, delimiter, encoding)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA]])

    def rows(paths: str | list[str], across_lines: bool) -> DataFrame:
        return spark.read.csv(
            paths, schema=schema, header=True, sep=delimiter, encoding=CHARSETS[encoding],
            quote='"', escape='"', multiLine=across_lines, enforceSchema=True)

    if facts["odd"] == facts["all_odd"]:
        frames = [rows(path, bool(facts["odd"]))]
    else:  # only files whose quotes call for it are read as a whole; names of files are what a reader is given
        named = {odd: [r.file for r in files.where(F.col("odd") == odd).select("file").collect()] for odd in (False, True)}
        frames = [rows(paths, odd) for odd, paths in named.items()]
    positioned = placed_rows(frames, row_id) if row_id else reduce(DataFrame.unionByName, frames)
    return CsvTable(_typed(positioned, names, "," if delimiter == ";" else ".", row_id),
                    encoding, delimiter)


def _check_headers(files: DataFrame, names: list[str], delimiter: str, encoding: str) -> None:
    """Every file of a folder must have the header of the first one, in the same order. Each spelling of a header
    is looked at once."""
    for row in files.where("head is not null").groupBy("head").agg(F.min("file").alias("file")).toLocalIterator():
        head = bytes(row["head"]).decode(encoding, "replace").lstrip("\ufeff")
        if (found := header_names(head + "\n", delimiter)) != names:
            raise LoadError(f"{row['file']} has the header {found}, other files have {names}")


def _sample(lines: DataFrame, encoding: str) -> str:
    """The first characters of the first file, decoded; a line is at least one character."""
    first = sorted(lines.inputFiles())[0]
    head = lines.sparkSession.read.text(first).select(F.col("value").cast("binary").alias("b"))
    text = ""
    for row in head.limit(SAMPLE_CHARACTERS).toLocalIterator():
        text += bytes(row["b"]).decode(encoding, "replace") + "\n"
        if len(text) >= SAMPLE_CHARACTERS:
            break
    return text.lstrip("\ufeff")[:max(SAMPLE_CHARACTERS, text.find("\n"))]


def detect_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        header = sample.split("\n", 1)[0]
        return max(DELIMITERS, key=header.count)


def header_names(sample: str, delimiter: str) -> list[str]:
    """Column names of the header; repeated names are an error, blank ones get a number."""
    names = next(csv.reader(sample.split("\n", 1)[:1], delimiter=delimiter))
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise LoadError(f"Duplicate column names: {', '.join(repeated)}")
    return [n or f"Unnamed: {i}" for i, n in enumerate(names)]


def _typed(texts: DataFrame, names: list[str], decimal: str, row_id: str | None) -> DataFrame:
    """Missing texts to NULL, then the narrowest type that fits every present value."""
    absent = ", ".join(map(literal, MISSING_TEXTS))
    booleans = ", ".join(map(literal, TRUE_TEXTS + FALSE_TEXTS))
    values = {n: f"(case when {quote(n)} not in ({absent}) then {quote(n)} end)" for n in names}
    clean = texts.selectExpr(*[f"{v} as {quote(n)}" for n, v in values.items()], EXTRA,
                             *([quote(row_id)] if row_id else []))
    counts = clean.agg(
        F.count(EXTRA).alias("extra"),
        *[F.expr(a) for i, q in enumerate(map(quote, names)) for a in (
            f"count({q}) as present{i}",
            f"count_if({q} rlike r'{INTEGER_PATTERN}' and try_cast({strip_sql(q)} as bigint) is not null) as whole{i}",
            f"count_if({is_number_sql(q, decimal)}) as number{i}",
            f"count_if({q} in ({booleans})) as boolean{i}")]).first()
    if counts["extra"]:
        raise LoadError(f"{counts['extra']} row(s) have more fields than the header.")
    columns = []
    for i, q in enumerate(map(quote, names)):
        present = counts[f"present{i}"]
        if present and counts[f"whole{i}"] == present:
            typed = f"cast({strip_sql(q)} as bigint)"
        elif counts[f"number{i}"] == present:
            typed = number_sql(q, decimal)
        elif counts[f"boolean{i}"] == present:
            typed = f"{q} in ({', '.join(map(literal, TRUE_TEXTS))})"
        else:
            typed = q
        columns.append(f"{typed} as {q}")
    return clean.selectExpr(*columns, *([quote(row_id)] if row_id else []))
