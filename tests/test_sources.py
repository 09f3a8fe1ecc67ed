import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans.context import UsageContext
from plumbline.plans.evaluate import compare, evaluate, metadata_items
from plumbline.plans.preparation import Operation
from plumbline.plans.recipe import Recipe
from plumbline.sources.csv import read_csv
from plumbline.sources.files import LoadError, dataset_fingerprint, fingerprints
from plumbline.sources.load import load, read_parquet, score_folder
from plumbline.sources.metadata import MAX_METADATA_BYTES, read_metadata
from plumbline.sources.sinks import write_prepared, write_report

# An own data set: order amounts and whether the order came back. Only the keys are the schema's.
PERIOD = {"start": "2024-03-01", "end": "2024-09-30"}
DOCUMENT = {
    "schema_version": "1",
    "columns": {
        "amount": {"description": "Order total before tax", "unit": "EUR"},
        "returned": {"description": "Order came back", "categories": {"0": "kept", "1": "sent back"}},
    },
    "documentation": {
        "target_definition": {"column": "returned", "description": "Whether the buyer sent the order back"},
        "data_collection": "Nightly export of the shop",
        "collection_period": PERIOD,
        "known_limitations": ["Gift cards are left out"],
    },
    "provenance": {
        "origin": "Web shop", "collector": "Sales desk", "generation_period": PERIOD,
        "transformations": ["Totals rounded to cents"], "version": "7",
    },
}
TICKED = dict(documentation=dict.fromkeys(UsageContext().documentation, True),
              provenance=dict.fromkeys(UsageContext().provenance, True))


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r)[:-1] for r in df.orderBy("_row").collect()]


@pytest.mark.parametrize("text,encoding,names,expected,delimiter", [
    ("a,b\n1,x\n2,y\n", "utf-8", ["a", "b"], [(1, "x"), (2, "y")], ","),
    ("a;b\n1,5;x\n2;y,z\n", "utf-8", ["a", "b"], [(1.5, "x"), (2.0, "y,z")], ";"),
    ("a\tb\n1\tTrue\n2\tFalse\n", "utf-8", ["a", "b"], [(1, True), (2, False)], "\t"),
    ("não,b\nSão,1\n", "latin1", ["não", "b"], [("São", 1)], ","),
    ("não,b\nSão,1\n", "utf-8-sig", ["não", "b"], [("São", 1)], ","),
    ("a,A,\nNA,n/a,1e3\n5,,inf\n", "utf-8", ["a", "A", "Unnamed: 2"],
     [(None, None, 1000.0), (5, None, float("inf"))], ","),
    ('a,b\n"x\ny","say ""hi"""\nz,2\n', "utf-8", ["a", "b"], [("x\ny", 'say "hi"'), ("z", "2")], ","),
    ("a,b\r\n007,1d\r\n8,2\r\n", "utf-8", ["a", "b"], [(7, "1d"), (8, "2")], ","),
])
def test_csv(spark, tmp_path, text, encoding, names, expected, delimiter):
    dataset = load(spark, write(tmp_path / "t.CSV", text, encoding))
    assert dataset.data.columns == [*names, "_row"]
    assert rows(dataset.data) == expected
    info = dataset.info.first()
    assert info.delimiter == delimiter and info.rows == len(expected) and info.columns == len(names)
    assert info.encoding == ("latin1" if encoding == "latin1" else "utf-8-sig")
    assert info.sha256 == hashlib.sha256(text.encode(encoding)).hexdigest()
    assert info.metadata_file is None and info.metadata_warnings == []


@pytest.mark.parametrize("name,text,message", [
    ("t.csv", "a,a,b\n1,2,3\n", "Duplicate"), ("t.csv", "", "empty"), ("t.csv", "a,b\n", "no data"),
    ("t.csv", "a\n1\n", "one column"), ("t.txt", "a,b\n1,2\n", "Unsupported"),
    ("t.csv", "a,b\n1,2\n1,2,3\n", "more fields"),
])
def test_bad_files(spark, tmp_path, name, text, message):
    with pytest.raises(LoadError, match=message):
        load(spark, write(tmp_path / name, text))
    with pytest.raises(LoadError, match="not found"):
        load(spark, str(tmp_path / "absent.csv"))


def test_csv_positions_across_splits(spark, tmp_path):
    body = "k,v\n" + "".join(f"{i},{'w' * (i % 50)}x\n" for i in range(4000))
    path = write(tmp_path / "t.csv", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        dataset = load(spark, path)
        assert dataset.data.rdd.getNumPartitions() > 4
        assert dataset.data.where("k <> _row").count() == 0 and dataset.data.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_positions(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).withColumn("v", F.lit("x")).repartition(5).write.parquet(path)
    df = read_parquet(spark, path)
    assert sorted(r._row for r in df.select("_row").collect()) == list(range(5000))
    assert load(spark, path).info.first().rows == 5000
    digests = fingerprints(spark, path)
    combined = dataset_fingerprint(digests).first()
    parts = sorted(r.sha256 for r in digests.collect())
    assert combined.files == 5 and combined.sha256 == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_fingerprint_holds_no_file(spark, tmp_path):
    """Spark's reader may not give any bytes as a row here: digests come from streams, longer than a buffer or not."""
    contents = {"a b.parquet": bytes(range(256)) * 1000, "p%20q.parquet": b"x", "ü#é.parquet": b"y" * (1 << 16), "z.parquet": b"x"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "0")
    try:
        files = fingerprints(spark, f"{tmp_path}/*.parquet")
        found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.collect()}
        combined = dataset_fingerprint(files).first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    digests = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    assert found == {name: (len(content), digests[name]) for name, content in contents.items()}
    assert tuple(combined) == (4, sum(map(len, contents.values())), hashlib.sha256("".join(sorted(digests.values())).encode()).hexdigest())


def test_fingerprint_of_a_file_above_2_gb(spark, tmp_path):
    """A sparse file, which takes no room on the disk."""
    with (tmp_path / "long.parquet").open("wb") as file:
        file.truncate((1 << 31) + 5)
        file.seek(-1, 2)
        file.write(b"!")
    (tmp_path / "short.parquet").write_bytes(b"short")
    whole = hashlib.sha256()
    for _ in range(1 << 11):
        whole.update(bytes(1 << 20))
    whole.update(b"\0\0\0\0!")
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in fingerprints(spark, f"{tmp_path}/*.parquet").collect()}
    assert found == {"long.parquet": ((1 << 31) + 5, whole.hexdigest()),
                     "short.parquet": (5, hashlib.sha256(b"short").hexdigest())}


@pytest.fixture
def shop(spark, tmp_path):
    path = write(tmp_path / "sample.csv", "amount,returned\n20,0\n21,1\n22,0\n23,1\n")

    def run(document, context=None, raw=None):
        metadata = tmp_path / "meta.json"
        metadata.write_bytes(raw if raw is not None else json.dumps(document).encode())
        dataset = load(spark, path, str(metadata), dataset_id="dataset")
        context = context or UsageContext("Predict returns", "classification", "returned")
        items = metadata_items(dataset.data, context, dataset.metadata, "dataset", "_row")
        result = evaluate(dataset.data, context, dataset.metadata, row_id="_row")
        scores = {r.dimension: r.score for r in result.dimensions.collect()}
        return dataset, {r["item"]: r for r in items.collect()}, scores
    return run


def changed(**sections):
    return {**json.loads(json.dumps(DOCUMENT)), **sections}


def test_complete_document(shop):
    dataset, items, scores = shop(DOCUMENT)
    assert scores["Documentation"] == scores["Provenance"] == 100
    assert {i.status for i in items.values()} == {"documented"}
    assert dataset.info.first().metadata_file == "meta.json"
    assert {i.source for i in items.values()} == {"meta.json"}


def test_everything_ticked_without_document(shop):
    _, items, scores = shop(None, UsageContext("x", "classification", "returned", **TICKED), b"{")
    assert scores["Documentation"] == scores["Provenance"] == 100
    assert {i.status for i in items.values()} == {"self_reported"}
    assert items["origin"].field == "provenance.origin" and items["origin"].source == "User checkbox"


def test_partial_coverage(shop):
    document = changed(columns={
        "amount": {"description": "Total", "unit": "EUR"}, "returned": {"description": "  "},
        "absent": {"description": "x", "unit": "y"}})
    _, items, scores = shop(document)
    assert (items["variable_descriptions"].score, items["units_and_categories"].score) == (50, 50)
    assert items["variable_descriptions"].status == "partial"
    assert scores["Documentation"] == 83.33


@pytest.mark.parametrize("target,status,score", [
    ("amount", "missing", 83.33), ("unknown", "missing", 83.33), (None, "not_applicable", 100)])
def test_target_definition(shop, target, status, score):
    _, items, scores = shop(DOCUMENT, UsageContext("x", "other", target))
    assert items["target_definition"].status == status and scores["Documentation"] == score


def test_wrong_value_types(shop):
    document = changed(
        documentation={
            "target_definition": {"column": "returned", "description": "x"}, "data_collection": True,
            "collection_period": {"start": "2026-02-30", "end": "2026-03-01"}, "known_limitations": ["ok", " "]},
        provenance={
            "origin": "  ", "collector": 5, "generation_period": {"start": "2026-02-01", "end": "2026-01-01"},
            "transformations": [], "version": 1})
    _, _, scores = shop(document)
    assert scores["Documentation"] == 50 and scores["Provenance"] == 0


@pytest.mark.parametrize("raw,warning", [
    (b"{", "JSON"), (b"[]", "object"), (b'{"schema_version": "2"}', "schema_version"), (b"{}", "schema_version"),
    (b'{"schema_version": 1}', "schema_version"), (b"\xef\xbb\xbf{}", "JSON"), (b"\xff{}", "UTF-8"),
    (b'{"schema_version": "1", "dataset_sha256": "0"}', "does not match"),
    (b" " * (MAX_METADATA_BYTES + 1), "2 MiB"),
])
def test_unusable_metadata_warns(shop, raw, warning):
    dataset, _, scores = shop(None, raw=raw)
    assert scores["Documentation"] == scores["Provenance"] == 0
    assert warning in dataset.info.first().metadata_warnings[0]


@pytest.mark.parametrize("document", [
    changed(columns=[], documentation=[], provenance="x"),
    changed(columns={"amount": "x", "returned": [1]}, documentation=3, provenance=None)])
def test_sections_of_the_wrong_type(shop, document):
    _, _, scores = shop(document)
    assert scores["Documentation"] == scores["Provenance"] == 0


def test_checkboxes_beside_broken_json(shop):
    context = UsageContext("x", "classification", "returned")
    context.documentation["data_collection"] = context.provenance["origin"] = True
    _, _, scores = shop(None, context, b"{")
    assert (scores["Documentation"], scores["Provenance"]) == (16.67, 20)


def test_checksum_binds_metadata_to_data(shop):
    digest = hashlib.sha256(b"amount,returned\n20,0\n21,1\n22,0\n23,1\n").hexdigest()
    _, _, scores = shop(changed(dataset_sha256=digest))
    assert scores["Provenance"] == 100


def test_missing_metadata_file(spark, tmp_path):
    digests = spark.createDataFrame([("a", "1"), ("b", "2")], "dataset_id string, sha256 string")
    result = {r.dataset_id: r for r in read_metadata(spark, {"a": str(tmp_path / "no.json")}, digests).collect()}
    assert result["a"].warnings == ["no.json: file not found"] and result["b"].warnings == []


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_export(spark, tmp_path, suffix):
    source = write(tmp_path / "in.csv", "x,c\n1, A \n,b\n3,b\n")
    dataset = load(spark, source)
    recipe = Recipe.fit(dataset.data, [Operation("fill_median", "x")])
    context = UsageContext("x")
    comparison = compare(dataset.data, recipe.apply(dataset.data), context, row_id="_row")
    path, manifest = write_prepared(dataset.data, recipe, str(tmp_path / f"out{suffix}"), context,
                                    "in.csv", comparison, dataset.metadata)
    body = json.loads(spark.read.text(manifest).first()[0])
    assert (body["original_rows"], body["prepared_rows"]) == (3, 3)
    assert [s["action"] for s in body["steps"]] == ["fill_median"]
    assert body["comparison"] and body["source_metadata"][0]["sha256"]
    back = load(spark, path).data
    assert sorted(rows(back)) == [(1.0, " A "), (2.0, "b"), (3.0, "b")]
    with pytest.raises(Exception, match="(?i)exist"):
        write_prepared(dataset.data, recipe, path, context)
    with pytest.raises(ValueError, match="source"):
        write_prepared(dataset.data, recipe, source, context)
    with pytest.raises(ValueError, match="output"):
        write_prepared(dataset.data, recipe, str(tmp_path / "out.xlsx"), context)


def test_folder_and_report(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    write(folder / "good.csv", "x,c\n1,a\n2,b\n")
    write(folder / "bad.csv", "a,a\n1,2\n")
    write(folder / "notes.md", "ignored")
    result = {r.dataset_id: r for r in score_folder(spark, str(folder)).collect()}
    assert set(result) == {"good.csv", "bad.csv"}
    assert result["good.csv"].score is not None and "Duplicate" in result["bad.csv"].error
    evaluation = evaluate(load(spark, str(folder / "good.csv")).data, UsageContext("x"), row_id="_row")
    write_report(evaluation, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "indicators")).count() == evaluation.indicators.count()


def test_folder_with_columns_in_another_order(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,2\n")
    write(tmp_path / "b.csv", "b,a\n3,4\n")
    with pytest.raises(LoadError, match="header"):
        read_csv(spark, str(tmp_path))


def test_one_file_with_open_quotes_among_others(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    expected = []
    for i in range(7):
        rows = [(f"k{i}-{j}", "two\nlines" if i == 3 and j == 1 else f"v{j}") for j in range(3)]
        expected += rows
        # The last file spells its header in another way; the one with the open quote has a quoted header.
        head = '"a",b' if i in (3, 6) else "a,b"
        (folder / f"part-{i}.csv").write_text(head + "\n" + "".join(f'{a},"{b}"\n' for a, b in rows))
    got = [(r.a, r.b) for r in read_csv(spark, str(folder)).data.orderBy("_row").collect()]
    assert got == expected
    (folder / "part-9.csv").write_text("b,a\n1,2\n")
    with pytest.raises(LoadError, match="other files"):
        read_csv(spark, str(folder))


def test_positions_over_many_files(spark, tmp_path):
    spark.range(1000).repartition(40, "id").write.parquet(str(tmp_path / "t.parquet"))
    rows = read_parquet(spark, str(tmp_path / "t.parquet"))
    assert sorted(r._row for r in rows.collect()) == list(range(1000))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
