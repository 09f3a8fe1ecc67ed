"""Token-id files with a minimal perfect hash index.

Layout of a folder, all Parquet, so that any store that Spark writes to can hold it:

* ``kind=shard``: raw ids of consecutive documents (16 bits each if the vocabulary allows,
  else 32), about a million per row, with the bounds of the documents in it;
* ``kind=key``: document key and place, in storage order; the index is built from it;
* ``index``: per bucket of keys a minimal perfect hash (displacements) and, by slot, a
  32-bit fingerprint of the key and the place: shard, offset and length;
* ``meta``: one row with the number of buckets and the settings.

A key is a document id and a copy number (0 for the first row with that id). Finding a key
takes one bucket, one displacement, one slot, whatever the size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.lineage import scratch_path
from plumbline.functions.local import local_frame
from plumbline.llm.bytetext import mixed, slices, text_bytes
from plumbline.llm.columns import documents, keyed, shown_id
from plumbline.llm.packing import tokenizer_path
from plumbline.llm.tokens import Encoder

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SHARD_IDS = 1 << 20
BUCKET_KEYS = 2048
_GROUP = 4  # keys per displacement
_ROWS = "kind string, id bigint, copy bigint, part int, chunk int, offset bigint, n_ids bigint, bounds binary, payload binary"
_INDEX = "bucket bigint, n int, displacements binary, fingerprints binary, parts binary, chunks binary, offsets binary, lengths binary"


def _encoded(tokenizer: str, end_id: int, shard_ids: int, width: str):
    """Shard rows and key rows of a task whose documents come in ascending order."""
    names = ["kind", "id", "copy", "part", "chunk", "offset", "n_ids", "bounds", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        chunk, filled, held, sizes, last, copy = 0, 0, [], [], None, 0

        def shard() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
            row = ["shard", None, None, part, chunk, 0, filled, bounds.tobytes(), np.concatenate(held).astype(width).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                piece = batch.slice(low, high - low)
                ids, bounds = encoder.encode(piece.column("text"), end_id)
                keys = []
                for doc, a, b in zip(piece.column("id").to_pylist(), bounds[:-1], bounds[1:]):
                    if filled and filled + b - a > shard_ids:
                        yield shard()
                        chunk, filled, held, sizes = chunk + 1, 0, [], []
                    copy = copy + 1 if doc == last else 0
                    last = doc
                    keys.append((doc, copy, chunk, filled, int(b - a)))
                    held.append(ids[a:b])
                    sizes.append(int(b - a))
                    filled += int(b - a)
                n = len(keys)
                if n:
                    docs, copies, chunks, places, lengths = zip(*keys)
                    columns = [["key"] * n, docs, copies, [part] * n, chunks, places, lengths, [None] * n, [None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if sizes:
            yield shard()

    return run


def key_hashes(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + copies.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slots(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    return (mixed(hashes + displacements.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(n)).astype(np.int64)


def _groups(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(-(-n // _GROUP))).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group, and the slot of each key: distinct hashes fill 0 to n - 1 exactly.

    Largest groups first; each takes the least displacement that puts all its keys on free,
    different slots.
    """
    n = len(hashes)
    group = _groups(hashes, n)
    counts = np.bincount(group, minlength=-(-n // _GROUP))
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(counts)[:-1])
    free, displacements, slots = np.ones(n, bool), np.zeros(len(counts), np.uint32), np.zeros(n, np.int64)
    for g in np.argsort(-counts, kind="stable"):
        own = members[g]
        if not len(own):
            break
        tried, step = 0, 64
        while True:
            options = np.arange(tried, tried + step, dtype=np.uint64)
            places = _slots(hashes[own][None, :], options[:, None], n)
            fits = free[places].all(axis=1)
            if len(own) > 1:
                ordered = np.sort(places, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                best = int(np.argmax(fits))
                displacements[g], slots[own] = tried + best, places[best]
                free[places[best]] = False
                break
            tried, step = tried + step, min(4 * step, 1 << 14)
    return displacements, slots


def _bucket_index(keys: pd.DataFrame) -> pd.DataFrame:
    hashes = key_hashes(keys["id"].to_numpy(), keys["copy"].to_numpy())
    displacements, slots = perfect_hash(hashes)

    def by_slot(values, kind: str) -> bytes:
        out = np.empty(len(slots), kind)
        out[slots] = values
        return out.tobytes()

    return pd.DataFrame([{
        "bucket": keys["bucket"].iloc[0], "n": len(keys), "displacements": displacements.astype("<u4").tobytes(),
        "fingerprints": by_slot(hashes & np.uint64(0xFFFFFFFF), "<u4"), "parts": by_slot(keys["part"], "<i4"),
        "chunks": by_slot(keys["chunk"], "<i4"), "offsets": by_slot(keys["offset"], "<u4"), "lengths": by_slot(keys["n_ids"], "<u4")}])


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("id", "copy"), F.lit(n_buckets)).alias("bucket")


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes all rows of ``docs`` in ascending id order (missing ids first; rows with one id by
    a hash of their text, then by text) and the index over them. A missing or empty text is
    the end id alone. An empty table gives an empty folder that reads as no documents."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    width = "<u2" if Encoder.of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = keyed(docs).select("id", "tag", "text").repartitionByRange("id").sortWithinPartitions("id", "tag", "text")
    rows.select("id", "text").mapInArrow(_encoded(tokenizer, end_id, shard_ids, width), _ROWS).write.partitionBy("kind").parquet(f"{path}/data")
    keys = _data(spark, path, "key").select("id", "copy", "part", "chunk", "offset", "n_ids")
    n_buckets = max(1, -(-keys.count() // BUCKET_KEYS))
    keys.select(_bucket(n_buckets), "*").groupBy("bucket").applyInPandas(_bucket_index, _INDEX).write.parquet(f"{path}/index")
    local_frame(spark, [(n_buckets, width, end_id)], "n_buckets bigint, width string, end_id int").write.parquet(f"{path}/meta")


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_ROWS).option("basePath", f"{path}/data").parquet(f"{path}/data").where(F.col("kind") == kind)


def find(keys: DataFrame, path: str) -> DataFrame:
    """``id, copy, part, chunk, offset, n_ids`` of the keys (``id``, ``copy``) that the files hold.

    A key outside the files passes the fingerprint with probability 2 to the -32.
    """
    spark = keys.sparkSession
    n_buckets = spark.read.parquet(f"{path}/meta").first().n_buckets
    wanted = keys.select("id", "copy").distinct().select(_bucket(n_buckets), "id", "copy").groupBy("bucket").agg(
        F.collect_list("id").alias("ids"), F.collect_list("copy").alias("copies"))
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies = np.array(row["ids"], np.int64), np.array(row["copies"], np.int64)
                hashes = key_hashes(ids, copies)
                at = _slots(hashes, np.frombuffer(row["displacements"], "<u4")[_groups(hashes, row["n"])], row["n"])
                at, hit = at, np.frombuffer(row["fingerprints"], "<u4")[at] == hashes & np.uint64(0xFFFFFFFF)
                columns = [np.frombuffer(row[c], t)[at[hit]] for c, t in (
                    ("parts", "<i4"), ("chunks", "<i4"), ("offsets", "<u4"), ("lengths", "<u4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(copies[hit]), pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)),
                     pa.array(columns[2].astype(np.int64)), pa.array(columns[3].astype(np.int64))],
                    names=["id", "copy", "part", "chunk", "offset", "n_ids"])

    return wanted.join(index, "bucket").mapInArrow(run, "id bigint, copy bigint, part int, chunk int, offset bigint, n_ids bigint")


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """``part, chunk, offset, n_ids, ids_crc32`` of every stored document, in place from the
    raw payload, and ``ids`` if asked for."""
    width = spark.read.parquet(f"{path}/meta").first().width
    kinds = {"ids": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, raw, payload = (batch.column(c)[i] for c in ("part", "chunk", "bounds", "payload"))
                bounds = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                ids = np.frombuffer(payload.as_buffer(), width).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(crc)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64))) if with_ids else pa.nulls(n, kinds["ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, chunk.as_py(), np.int32)), pa.array(bounds[:-1]),
                     pa.array(np.diff(bounds)), pa.array(np.array(crc, np.int64)), lists],
                    names=["part", "chunk", "offset", "n_ids", "ids_crc32", "ids"])

    rows = _data(spark, path, "shard").select("part", "chunk", "bounds", "payload").mapInArrow(
        run, "part int, chunk int, offset bigint, n_ids bigint, ids_crc32 bigint, ids array<bigint>")
    return rows if with_ids else rows.drop("ids")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, chunk, base``: the ids in all shards before. A running sum within each part plus
    one over the parts, which are as many as the tasks that wrote them."""
    shards = _data(spark, path, "shard").select("part", "chunk", "n_ids")
    totals, base = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()), []
    before = 0
    for part, n in totals:
        base.append((part, before))
        before += n
    parts = local_frame(spark, base, "part int, before bigint")
    within = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(F.broadcast(parts), "part").select(  # one row per task that wrote
        "part", "chunk", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))


def op8_perfect_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), scratch_path(spark, "shards")
    write(docs, path)
    copies = keyed(docs).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    keys = copies.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    stored = read(spark, path).join(shard_starts(spark, path), ["part", "chunk"])
    found = find(keys, path).drop("n_ids").join(stored, ["part", "chunk", "offset"])
    return found.select(shown_id(), (F.col("base") + F.col("offset")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
