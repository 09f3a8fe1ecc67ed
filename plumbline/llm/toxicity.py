"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class; the other side is unlabelled text, which
holds toxic texts too, at the rate of the class prior. The risk of calling unlabelled text
toxic is corrected by the prior and kept from going below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.bytetext import LETTERS, LOWER, text_bytes, word_places
from plumbline.llm.columns import documents, texts

BITS = 20
FOLDS = 5
#: Besides whole words, their first so many bytes are features: insults are inflected.
PREFIXES = (4, 5, 6, 7, 8, 9)


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample (documents with the smallest hash of their id) and the
    settings of the fit. ``least_z``: the hash of a word or prefix is a feature if its rate
    among positives exceeds that in unlabelled text by so many standard errors; the
    ``most_features`` strongest stay."""

    positives: int = 8_000
    unlabelled: int = 16_000
    least_z: float = 5.0
    most_features: int = 400
    steps: int = 600
    rate: float = 0.1
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # of a word hash: its feature or -1
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)) == 0


def _hits(data: np.ndarray, offsets: np.ndarray, features: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct ``row << BITS | bucket`` of the words and prefixes of each text, or
    ``row << BITS | feature`` of those that are features."""
    found = []
    for starts, ends, rows, hashed in word_places(data, offsets, inside=LETTERS, fold=LOWER):
        for size in (None, *PREFIXES):
            long = slice(None) if size is None else np.flatnonzero(ends - starts > size)
            places = starts[long]
            bucket = (hashed(places, ends[long] if size is None else places + size) >> np.uint64(64 - BITS)).astype(np.int64)
            row = rows[long].astype(np.int64)
            if features is not None:
                bucket = features[bucket].astype(np.int64)
                row, bucket = row[bucket >= 0], bucket[bucket >= 0]
            found.append(np.unique(row << BITS | bucket))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled texts of the task each bucket occurs."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        hits = _hits(*text_bytes(batch.column("text")))
        side = batch.column("positive").to_numpy(zero_copy_only=False)[hits >> BITS]
        for which in (0, 1):
            counts[which] += np.bincount(hits[side == bool(which)] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    buckets = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(buckets.astype(np.int32)), pa.array(counts[1][buckets]), pa.array(counts[0][buckets])], names=["bucket", "p", "u"])


def _vectors(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _hits(*text_bytes(batch.column("text")), features)
            begins = np.searchsorted(hits, np.arange(batch.num_rows + 1, dtype=np.int64) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((hits & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), lists], names=["positive", "found"])

    return run


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, how: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear score under the non-negative risk with the logistic loss,
    by Adam on the whole sample. Where the corrected part is negative, its gradient is turned."""
    rows, shares = [], []
    for part in (x[positive], x[~positive]):
        patterns, times = np.unique(part, axis=0, return_counts=True)  # few: most texts have no feature
        rows.append(np.column_stack([patterns, np.ones(len(patterns), np.float32)]))
        shares.append(times / len(part))
    theta, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    theta[-1] = np.log(prior / (1 - prior))

    def mean_gradient(side: int, sign: int) -> tuple[float, np.ndarray]:
        part, share = rows[side], shares[side]
        z = sign * (part @ theta)
        return float(share @ np.logaddexp(0, -z)), -sign * (part.T @ (share / (1 + np.exp(np.clip(z, -50, 50)))))

    for step in range(1, how.steps + 1):
        _, g_plus = mean_gradient(0, 1)
        r_minus, g_minus = mean_gradient(0, -1)
        r_unlabelled, g_unlabelled = mean_gradient(1, -1)
        corrected = r_unlabelled - prior * r_minus
        gradient = prior * g_plus + (g_unlabelled - prior * g_minus) if corrected >= 0 else prior * g_minus - g_unlabelled
        gradient = gradient + how.decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta = theta - how.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Fits on documents and labels outside the held-out fold. The prior is the toxic share of
    the labelled documents there. Without positives every score is 0."""
    none = Model(np.full(1 << BITS, -1, np.int16), np.zeros(0), -50.0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return none
    rows = texts(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(how.positives)
    others = rows.select("doc_id").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(how.unlabelled)
    chosen = toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(others.select("doc_id", F.lit(False).alias("positive")))
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id").select("positive", "text")
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return none
    n_p, n_u = sizes[True], sizes[False]
    counts = sample.mapInArrow(_document_counts, "bucket int, p int, u int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    best = [r.bucket for r in counts.select("bucket", z.alias("z")).where(F.col("z") >= how.least_z)
            .orderBy(F.desc("z"), "bucket").limit(how.most_features).collect()]
    features = np.full(1 << BITS, -1, np.int16)
    features[best] = np.arange(len(best))
    vectors = sample.mapInArrow(_vectors(features), "positive boolean, found array<int>").toArrow()
    positive, found = vectors["positive"].to_numpy(), vectors["found"].combine_chunks()
    x = np.zeros((len(positive), len(best)), np.float32)
    x[np.repeat(np.arange(len(positive)), found.value_lengths().to_numpy()), found.flatten().to_numpy()] = 1
    weights, bias = fit_nnpu(x, positive, float(np.clip(share, 1e-6, 1 - 1e-6)), how)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every row, from its whole text alone. An empty or
    missing text scores the bias."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.features, model.weights, model.bias))  # 2 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        for batch in batches:
            hits = _hits(*text_bytes(batch.column("text")), features)
            sums = bias + np.bincount(hits >> BITS, weights=weights[hits & ((1 << BITS) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -50, 50))))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
