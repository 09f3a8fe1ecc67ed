"""Ranked lexical search over posting lists that are blocked by the likeness of their documents.

Texts are read once; what is kept of a document is a row of its own. Documents lie in shards of a
bounded size, as the scan deals them, so a term that stands in every document has a list of
bounded length in every shard and no list is gathered. A shard's lists are built and searched
within a task: no row is larger than what one document holds. Within a shard each posting list is
clustered by document similarity: the documents of the list choose the nearest of a few
representatives, by the inner product of random projections. A block stores the largest value of
each coordinate among its documents. No document of a block scores more than the query's product
with that summary; a block is skipped only where this product is below the tenth score found so
far, so the ranking is exact.

Scores are integers (see ``Scoring``). The vocabulary of an index is that of the queries it is
built for; counts of documents and terms are always over the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions.lineage import written
from plumbline.llm.bytetext import LETTERS, LOWER, mixed, slices, text_bytes, word_places
from plumbline.llm.columns import NO_ID, documents


@dataclass(frozen=True)
class Scoring:
    """A term's weight is floor(``scale`` * ln((2N + 2) / (2df + 1))); in a document of n terms it counts
    (10**9 * tf) div (1000 * tf + 8 * m) with m = 25 + (75 * n * N) div L. ``shard_docs`` and ``shard_bytes`` bound a
    shard (a term of a document and its count have 8 bytes), ``block`` is the mean number of documents in a block,
    ``query_bytes`` the size of the group of queries that is worked on at a time."""

    k: int = 10
    scale: int = 1000
    shard_docs: int = 8192
    shard_bytes: int = 16 << 20
    block: int = 512
    projections: int = 16
    query_bytes: int = 16 << 20


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes (64 bits) and rows of the terms, stretch by stretch: runs of letters, digits and
    non-ASCII characters with A-Z lower-cased."""
    data, offsets = text_bytes(column)
    for starts, ends, rows, hashed in word_places(data, offsets, inside=LETTERS, fold=LOWER):
        yield hashed(starts, ends), rows


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start up to its end, one range after the other."""
    sizes = ends - starts
    return np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between neighbouring bounds; exact, in 64 bits."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


_FORWARD = "id bigint, size bigint, terms binary, tfs binary"


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Pieces of an array of 32-bit numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(data.astype(np.uint32))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column and the n + 1 bounds of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, "<u4", int(bounds[-1])) if data is not None and data.size else np.zeros(0, np.uint32)
    return raw[bounds[0]:], bounds - bounds[0]


def _forward(vocabulary):
    """Of each document with terms: its id, its number of terms, and the vocabulary terms it holds with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                part = batch.slice(low, high - low)
                n = high - low
                size, pairs = np.zeros(n, np.int64), []
                for hashes, rows in terms(part.column("text")):
                    size += np.bincount(rows, minlength=n)
                    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                    hit = words[at] == hashes
                    pairs.append(np.stack(np.unique(rows[hit] * len(words) + at[hit], return_counts=True)))
                key, tf = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
                key, inverse = np.unique(key, return_inverse=True)  # a long text comes in several stretches
                tf = np.bincount(inverse, weights=tf, minlength=len(key)).astype(np.int64)
                held, full = np.bincount(key // len(words), minlength=n), size > 0
                bounds = np.concatenate([[0], np.cumsum(held[full])])
                yield pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy()[full]), pa.array(size[full]),
                                                  _binaries(key % len(words), bounds), _binaries(tf, bounds)], names=["id", "size", "terms", "tfs"])

    return run


def _document_frequencies(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: the number of documents of each term it has seen."""
        total = np.zeros(n_words, np.int64)
        for batch in batches:
            found, n = np.unique(_numbers(batch.column("terms"))[0], return_counts=True)
            total[found] += n
        seen = np.flatnonzero(total)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["term", "df"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], how: Scoring) -> Iterator[pa.RecordBatch]:
    """The documents of a task in shards, cut wherever one is full; a longer document goes with the one it meets."""
    parts, n_docs, weight = [], 0, 0
    for batch in batches:
        entries = 8 * _numbers(batch.column("terms"))[1]
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(entries, entries[at] + how.shard_bytes - weight, "right")) - 1
            end = min(batch.num_rows, at + how.shard_docs - n_docs, max(at + 1, room))
            parts.append(batch.slice(at, end - at))
            n_docs, weight = n_docs + end - at, weight + int(entries[end] - entries[at])
            if n_docs >= how.shard_docs or weight >= how.shard_bytes or end < batch.num_rows:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts, n_docs, weight = [], 0, 0
            at = end
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def clustered(points: np.ndarray, block: int, seed: int) -> np.ndarray:
    """The block of each point: the representative with the largest inner product among about one in ``block`` points,
    which are drawn by the seed."""
    n = len(points)
    chosen = np.random.default_rng(seed).choice(n, -(-n // block), replace=False)
    return np.unique((points @ points[chosen].T).argmax(axis=1), return_inverse=True)[1]


def blocked(ids: np.ndarray, bounds: np.ndarray, words: np.ndarray, values: np.ndarray, n_words: int, block: int, projections: int) -> dict[str, np.ndarray]:
    """The index of a shard from its documents' coordinates (``words`` and ``values`` between ``bounds``).

    ``lists``: bounds of each term's ``members`` (numbers of documents), block after block; ``blocks``: bounds of each
    term's entries in ``starts`` (where a block's members begin) and ``sum_bounds`` (its summary). A list that fits one
    block has none: its documents cost no more than its summary would.
    """
    n = len(ids)
    owners = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(words, kind="stable")
    lists = np.searchsorted(words[order], np.arange(n_words + 1))
    members = owners[order]
    points = np.zeros((n, projections))
    for j in range(projections):
        spread = mixed(np.arange(n_words, dtype=np.uint64) * np.uint64(projections) + np.uint64(j))
        signs = np.where(spread >> np.uint64(63), np.float32(1), np.float32(-1))
        points[:, j] = np.bincount(owners, weights=values * signs[words], minlength=n)
    points = (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    blocks, starts, sum_sizes, sum_terms, sum_values = np.zeros(n_words + 1, np.int64), [], [], [], []
    lengths = np.diff(lists)
    for t in np.flatnonzero(lengths > block):
        own = members[lists[t]:lists[t + 1]]
        of = clustered(points[own], block, int(t))
        inside = np.argsort(of, kind="stable")
        own, of = own[inside], of[inside]
        members[lists[t]:lists[t + 1]] = own
        n_blocks = int(of[-1]) + 1
        blocks[t + 1] = n_blocks
        starts.append(lists[t] + np.searchsorted(of, np.arange(n_blocks)))
        largest = np.zeros(n_blocks * n_words, np.uint32)
        for low in range(0, len(own), 2048):
            part = own[low:low + 2048]
            places = _ranges(bounds[part], bounds[part + 1])
            np.maximum.at(largest, np.repeat(of[low:low + 2048], bounds[part + 1] - bounds[part]) * n_words + words[places], values[places])
        filled = np.flatnonzero(largest)
        sum_sizes.append(np.bincount(filled // n_words, minlength=n_blocks))
        sum_terms.append((filled % n_words).astype(np.uint32))
        sum_values.append(largest[filled])

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return {"ids": ids, "bounds": bounds, "terms": words, "values": values, "lists": lists, "members": members, "blocks": np.cumsum(blocks),
            "starts": joined(starts), "sum_bounds": np.concatenate([[0], np.cumsum(joined(sum_sizes))]), "sum_terms": joined(sum_terms),
            "sum_values": joined(sum_values)}


def shard_index(shard: pa.RecordBatch, n_words: int, n_docs: int, n_terms: int, how: Scoring) -> dict[str, np.ndarray]:
    """The index of a shard of documents with their terms and counts."""
    (words, bounds), tfs = _numbers(shard.column("terms")), _numbers(shard.column("tfs"))[0]
    length = np.array([25 + 75 * n * n_docs // n_terms for n in shard.column("size").to_pylist()], np.int64)  # Python's integers do not overflow
    tf = tfs.astype(np.int64)
    values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(length, np.diff(bounds)))
    return blocked(shard.column("id").to_numpy(), bounds, words, values.astype(np.uint32), n_words, how.block, how.projections)


class _Top:
    """The first k documents of one query: highest score first, then the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        first = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[first], scores[first]


def search_shard(index: dict[str, np.ndarray], weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], tops: list[_Top]) -> int:
    """Brings the queries' top lists up to date with a shard; the number of blocks that were skipped.

    ``queries``: distinct terms and how often each occurs. Rare terms come first, so the bar is high when
    the long lists come. Once a list is done, its documents are scored or known to stay below the bar;
    what is new in a later list does not hold the term, so bounds leave it out.
    """
    bounds, words, values, members = index["bounds"], index["terms"], index["values"].astype(np.int64), index["members"]
    lists, blocks, starts = index["lists"], index["blocks"], index["starts"]
    sum_bounds, sum_terms, sum_values = index["sum_bounds"], index["sum_terms"], index["sum_values"].astype(np.int64)
    skipped = 0
    query, open_terms = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    for (own, times), top in zip(queries, tops):
        query[own] = open_terms[own] = weights[own] * times
        seen = np.zeros(len(index["ids"]), bool)
        for t in own[np.argsort(-weights[own], kind="stable")]:
            low, high = lists[t], lists[t + 1]
            if low == high or not query[t]:
                continue
            docs = members[low:high]
            first, last = blocks[t], blocks[t + 1]
            if first < last:
                a, b = sum_bounds[first], sum_bounds[last]
                most = _sums(open_terms[sum_terms[a:b]] * sum_values[a:b], sum_bounds[first:last + 1] - a)
                keep = most >= top.least
                skipped += int((~keep).sum())
                edges = np.append(starts[first:last], high)
                docs = members[_ranges(edges[:-1][keep], edges[1:][keep])]
            open_terms[t] = 0
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            places = _ranges(bounds[docs], bounds[docs + 1])
            top.add(index["ids"][docs], _sums(query[words[places]] * values[places], np.concatenate([[0], np.cumsum(bounds[docs + 1] - bounds[docs])])))
        query[own] = open_terms[own] = 0
    return skipped


def _search(shared, how: Scoring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries, n_docs, n_terms = shared.value
        tops = [_Top(how.k) for _ in queries]
        for shard in _shards(batches, how):
            search_shard(shard_index(shard, len(weights), n_docs, n_terms, how), weights, queries, tops)
        n = [len(t.ids) for t in tops]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(tops)), n)), pa.array(np.concatenate([t.ids for t in tops])), pa.array(np.concatenate([t.scores for t in tops]))],
            names=["query", "id", "score"])

    return run


def _group(rows: DataFrame, items: pa.Table, how: Scoring) -> DataFrame:
    """``item, rank, id, score`` for one group of items."""
    spark = rows.sparkSession
    found = [np.zeros(0, np.uint64)] * items.num_rows
    for low, high in slices(text_bytes(items.column("text").combine_chunks())[1]):
        for hashes, owners in terms(items.column("text").combine_chunks().slice(low, high - low)):
            edges = np.searchsorted(owners, np.arange(high - low + 1))  # rows come in order
            for k in np.unique(owners):
                found[low + k] = np.concatenate([found[low + k], hashes[edges[k]:edges[k + 1]]])
    vocabulary = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    if not len(vocabulary):
        return spark.createDataFrame([], schema)
    forward = written(rows.mapInArrow(_forward(spark.sparkContext.broadcast(vocabulary)), _FORWARD), "document-terms")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], schema)
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in forward.select("terms").mapInArrow(_document_frequencies(len(vocabulary)), "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # the group's terms
        df[term] = n
    weights = np.array([math.floor(how.scale * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    queries = [np.unique(np.searchsorted(vocabulary, x), return_counts=True) for x in found]
    shared = spark.sparkContext.broadcast((weights, queries, n_docs, n_terms))
    best = forward.where(F.length("terms") > 0).mapInArrow(_search(shared, how), "query bigint, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(items.num_rows)), "item": items.column("item").combine_chunks()}))
    return ranked.join(F.broadcast(names), "query").select("item", "rank", "id", "score")  # a group's items


def rank(docs: DataFrame, items: DataFrame, how: Scoring = Scoring(), *, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``how.k`` best documents of each item with a score above 0, equal scores by
    ascending id (a missing one first).

    Missing and empty texts have no terms: as documents they are never found, as items they find nothing. Every
    row is a document or item of its own, also if its id repeats or is missing. An empty side gives no
    rows. Items are worked on in groups of a bounded size, so what tasks are sent does not grow with them.
    """
    def column(name: str, other: str) -> Column:
        return F.col(f"`{name}`").cast("long").alias(other)

    rows = docs.select(F.coalesce(column(id_col, "id"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    queries = items.select(column(item_id_col, "item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // how.query_bytes))
    ranked = [_group(rows, queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).toArrow(), how) for g in range(groups)]
    return reduce(DataFrame.unionByName, ranked).select(
        F.col("item").alias("item_id"), "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
