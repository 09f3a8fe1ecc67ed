"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items hide in long texts, so their Jaccard similarity says little. Documents are
partitioned by their number of shingles, and the number of MinHash bins grows with the
partition: with two to four bins for each shingle, most shingles of a document are the
minimum of their bin, and an item that is contained shares most of its own bins with it.
Items are sketched once for each partition. The few shingles of a short item may all lose
their bins, so they meet all shingles of a document. Candidates are verified on exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.lineage import written
from plumbline.llm.bytetext import SPACES, all_word_hashes, mixed, shingle_hashes, slices, text_bytes
from plumbline.llm.columns import documents, keyed, renewed, shown_id

PARTITIONS = 30  # documents of up to 2 ** 29 shingles; a text cannot hold more


@dataclass(frozen=True)
class Containment:
    """``threshold``: share of an item's shingles that a document must hold. ``matched``: share of
    the item's bins that must agree for a candidate (one at least); a contained item has
    about 0.8 * 0.8 of them. Items of up to ``short`` shingles meet all shingles of a document,
    not its minima only, so none is missed. ``broadcast_rows``: a side of up to so many rows (counted) is
    sent to all tasks, a larger one is shuffled, in ``salts`` parts for each key."""

    shingle: int = 5
    threshold: float = 0.8
    matched: float = 0.15
    short: int = 12
    broadcast_rows: int = 1_000_000
    salts: int = 16


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and the n + 1 bounds."""
    data, offsets = text_bytes(column)
    words, owners = all_word_hashes(data, offsets, inside=~SPACES)
    hashes, of = shingle_hashes(words, owners, len(column), size)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(column) + 1))


def partition_of(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def bin_minima(values: np.ndarray, owners: np.ndarray, partition: np.ndarray) -> np.ndarray:
    """Which of the values (sorted within their owner) are the least of their bin. Partition p
    has 2 ** (p + 1) bins, told apart by the leading bits."""
    bins = values >> (np.uint64(63) - partition.astype(np.uint64))
    first = np.ones(len(values), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owners[1:] != owners[:-1])
    return first


_SKETCH = "id bigint, tag bigint, p int, v bigint, n int, least boolean"


def _sketch(how: Containment, items: bool):
    """Rows ``id, tag, p, v``, the set size ``n`` and whether ``v`` is the ``least`` of its bin: a document in
    its own partition, with all shingles; an item in all, with its minima, a short one with all shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets, 1 << 20):
                part = batch.slice(low, high - low)
                values, bounds = _shingles(part.column("text"), how.shingle)
                sizes = np.diff(bounds)
                owners = np.repeat(np.arange(len(sizes)), sizes)
                own = partition_of(sizes)
                for p in range(PARTITIONS) if items else [None]:
                    partition = own[owners] if p is None else np.full(len(owners), p)
                    least = bin_minima(values, owners, partition)
                    keep = least | (sizes[owners] <= how.short) if items else np.ones(len(values), bool)
                    of = pa.array(owners[keep])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(of), part.column("tag").take(of), pa.array(partition[keep].astype(np.int32)),
                         pa.array(values[keep].view(np.int64)), pa.array(sizes[owners][keep].astype(np.int32)),
                         pa.array(least[keep])], names=["id", "tag", "p", "v", "n", "least"])

    return run


def _verify(how: Containment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = text_bytes(batch.column("text"))
            for low, high in slices(lengths, 1 << 20):
                part = batch.slice(low, high - low)
                (docs, d), (items, i) = (_shingles(part.column(c), how.shingle) for c in ("text", "item_text"))
                share = [len(np.intersect1d(docs[d[k]:d[k + 1]], items[i[k]:i[k + 1]], assume_unique=True)) / max(1, i[k + 1] - i[k])
                         for k in range(part.num_rows)]
                hit = pa.array([s >= how.threshold - 1e-12 for s in share], pa.bool_())
                out = part.select(["id", "tag", "item"]).append_column("containment", pa.array(share, pa.float64()))
                yield out.filter(hit)

    return run


def contained(docs: DataFrame, items: DataFrame, how: Containment = Containment()) -> DataFrame:
    """``id, tag, item, containment`` of keyed documents that hold an item (keyed too).

    Sets of ``how.shingle`` words; a text of fewer words has one shingle of all of them, so a
    short item is found in documents of just its words. Items and documents without words
    match nothing. Rows with one id are judged one by one, and the best counts. An empty
    side gives no rows.
    """
    sketched = written(items.select("id", "tag", "text").mapInArrow(_sketch(how, True), _SKETCH)
                       .select(F.col("id").alias("item"), F.col("tag").alias("item_tag"), "p", "v", "n"), "items")
    minima = docs.select("id", "tag", "text").mapInArrow(_sketch(how, False), _SKETCH).drop("n")
    if sketched.count() <= how.broadcast_rows * 4:
        hits = minima.join(F.broadcast(sketched), ["p", "v"])  # its rows are counted
    else:
        salted = sketched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
        hits = minima.withColumn("salt", F.pmod(F.xxhash64("id", "tag"), F.lit(how.salts)).cast("int")).join(salted, ["p", "v", "salt"])
    hits = hits.where(F.col("least") | (F.col("n") <= how.short))
    matched = hits.groupBy("id", "tag", "item", "item_tag").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    found = written(matched.where(F.col("m") >= F.greatest(F.lit(1), F.floor(F.col("n") * how.matched))).select("id", "tag", "item", "item_tag"), "candidates")
    named = found.join(items.select(F.col("id").alias("item"), F.col("tag").alias("item_tag"), F.col("text").alias("item_text")).distinct(), ["item", "item_tag"])
    few = found.count() <= how.broadcast_rows
    wide = docs.select("id", "tag", "text").join(F.broadcast(named) if few and items.count() <= how.broadcast_rows else named, ["id", "tag"])
    checked = wide.select("id", "tag", "item", "text", "item_text").mapInArrow(_verify(how), "id bigint, tag bigint, item bigint, containment double")
    return checked.groupBy("id", "tag", "item").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, how: Containment = Containment(), *, id_col: str = "doc_id",
                      text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, that hold no item."""
    rows = keyed(docs, id_col, text_col)
    leaks = contained(rows, keyed(items, item_id_col, item_text_col), how).select("id", "tag").distinct()
    return renewed(rows.join(leaks, ["id", "tag"], "left_anti"), docs, {})


def op9_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contained(keyed(documents(spark, sf_dir)), keyed(items, "item_id"))
    best = found.groupBy("id", "item").agg(F.max("containment").alias("containment"))
    return best.select(shown_id(), shown_id("item").alias("item_id"), F.round("containment", 6).alias("containment"))
