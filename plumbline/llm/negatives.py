"""Hard negatives by exact integer scores from float32 matrix products.

Vectors of integers are reduced modulo several small primes. The product of two residue matrices
is exact in float32, because no sum reaches 2 ** 24. The residues of a score are put
together by Chinese remaindering in mixed radix with balanced digits, which gives the
signed score itself. Anchors go to all tasks in batches of a bounded size; each task keeps the few
best rows per anchor while it reads its rows block by block, and windows choose among the tasks'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.lineage import written

#: Residues lie within +-254 and a product sums 256 of them: 254 * 254 * 256 < 2 ** 24.
DEPTH = 256
_TOP = 509
#: Scores beyond it are refused: the window multiplies them by percentages in 64 bits.
LARGEST_SCORE = 2**55


def primes_for(bound: int) -> list[int]:
    """The largest primes up to 509 whose product exceeds all differences of scores within +-bound."""
    chosen, product, candidate = [], 1, _TOP
    while product <= 2 * bound + 1:
        if all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
            chosen.append(candidate)
            product *= candidate
        candidate -= 1
    return chosen


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """The residues nearest to zero; twice, as the first quotient may be off by one."""
    for _ in range(2):
        values = values - np.float32(p) * np.rint(values * np.float32(1 / p))
    return values


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    out = []
    for p in primes:
        r = vectors % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (int64) of the rows behind two lists of residue matrices."""
    digits: list[np.ndarray] = []
    for x, y, p in zip(a, b, primes):
        r = np.zeros((len(x), len(y)), np.float32)
        for k in range(0, x.shape[1], DEPTH):
            r = r + _centred(x[:, k:k + DEPTH] @ y[:, k:k + DEPTH].T, p)
        r = _centred(r, p)
        for digit, q in zip(digits, primes):  # the digit in this place is what is left, divided by the places before
            inverse = pow(q, -1, p)
            r = _centred((r - digit) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(r)
    total = np.zeros(digits[0].shape, np.int64)
    for digit, p in zip(reversed(digits), reversed(primes)):
        total = total * p + digit.astype(np.int64)
    return total


@dataclass(frozen=True)
class Mining:
    """``positives`` per anchor and ``negatives`` per anchor and positive; a negative scores from ``low`` to
    ``high`` percent of the positive. ``batch_bytes``: anchors that tasks hold at a time."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    batch_bytes: int = 32 << 20
    block_rows: int = 4096
    block_anchors: int = 512
    task_rows: int = 1 << 14


class _Best:
    """The first ``k`` rows for each of ``n`` places, by score, then id, then number of the row."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.found = np.zeros((5, 0), np.int64)  # place, score, id rank key, row number, position

    def add(self, at: int, table: np.ndarray, mask: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Scores of places from ``at`` on (rows) against a block of rows (columns), where the mask holds."""
        k = min(self.k, table.shape[1])
        low = np.iinfo(np.int64).min
        held = np.where(mask, table, low)
        least = np.partition(held, -k, axis=1)[:, -k]
        places, columns = np.nonzero(mask & (held >= np.maximum(least, self.least[at:at + len(table)])[:, None]))
        if not len(places):
            return
        own = (self.found[0] >= at) & (self.found[0] < at + len(table))
        new = np.stack([places + at, table[places, columns], ids[columns], numbers[columns], columns])
        both = np.concatenate([self.found[:, own], new], axis=1)
        both = both[:, np.lexsort((both[3], both[2], -both[1], both[0]))]
        first = np.searchsorted(both[0], both[0])
        rank = np.arange(both.shape[1]) - first
        both = both[:, rank < self.k]
        full = both[0][(np.arange(both.shape[1]) - np.searchsorted(both[0], both[0])) == self.k - 1]
        last = both[1][(np.arange(both.shape[1]) - np.searchsorted(both[0], both[0])) == self.k - 1]
        self.least[full] = last
        self.found = np.concatenate([self.found[:, ~own], both], axis=1)


_NO_ID = np.iinfo(np.int64).max  # a missing id comes last among equal scores


def _vectors(column: pa.Array, depth: int) -> np.ndarray:
    """A list column as a matrix; missing places at the end count as zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), depth), np.int64)
    out[np.arange(depth)[None, :] < lengths[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(batch.slice(at, size))
            n += held[-1].num_rows
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_FOUND = "anchor bigint, positive int, score bigint, id bigint, n bigint"


def _search(shared, primes: list[int], depth: int, how: Mining):
    """Each task's best rows for every anchor of a batch; ``windows`` (anchor x positive: least and largest score)
    if negatives are wanted, else None for positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        windows, many = anchors["windows"], len(anchors["n"])
        left = residues(anchors["vectors"], primes)
        turns = 1 if windows is None else windows.shape[1]
        best = [_Best(many, how.positives if windows is None else how.negatives) for _ in range(turns)]
        for batch in _blocks(batches, how.block_rows):
            numbers, labels = batch.column("n").to_numpy(), batch.column("label").to_numpy()
            ids = batch.column("id").fill_null(_NO_ID).to_numpy()
            right = residues(_vectors(batch.column("vector"), depth), primes)
            for at in range(0, many, how.block_anchors):
                end = min(many, at + how.block_anchors)
                table = scores([x[at:end] for x in left], right, primes)
                same = anchors["labels"][at:end, None] == labels[None, :]
                if windows is None:
                    best[0].add(at, table, same & (anchors["n"][at:end, None] != numbers[None, :]), ids, numbers)
                    continue
                for j in range(turns):
                    low, high = windows[at:end, j, 0, None], windows[at:end, j, 1, None]
                    best[j].add(at, table, ~same & (table >= low) & (table <= high), ids, numbers)
        for j, b in enumerate(best):
            place, score, ids, numbers, _ = b.found
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors["n"][place]), pa.array(np.full(len(place), j, np.int32)), pa.array(score),
                 pa.array(ids, mask=ids == _NO_ID), pa.array(numbers)], names=["anchor", "positive", "score", "id", "n"])

    return run


def _first(found: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("n"))
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(rows: DataFrame, how: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows ``id, label, vector``
    (integers) and ``anchor`` (whether the row is one).

    Every row counts by itself, also if its id repeats or is missing (a missing id comes last
    among equal scores); rows without label or vector are the caller's to drop. Shorter vectors count as if
    filled up with zeros. Anchors without positives, and positives without a row in their window, give
    no rows, and so does an empty table. Scores beyond 2 ** 55 raise an error.
    """
    spark = rows.sparkSession
    stored = written(rows.select("id", F.col("label").cast("long").alias("label"), "vector", "anchor", F.monotonically_increasing_id().alias("n")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("depth"), F.max(square).alias("norm"),
                      F.count_if("anchor").alias("anchors")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not size.anchors:
        return spark.createDataFrame([], schema)
    bound = int(size.norm * (1 + 1e-9)) + 1  # of all inner products, by the lengths of the vectors
    if bound > LARGEST_SCORE:
        raise ValueError("inner products of these vectors may exceed 2 ** 55")
    depth, primes = max(1, size.depth), primes_for(bound)
    dealt = stored.drop("anchor").repartition(max(1, -(-size.rows // how.task_rows)), "n")
    batches = max(1, -(-size.anchors * 8 * (depth + 16) // how.batch_bytes))
    mined = []
    for b in range(batches):
        own = stored.where("anchor").where(F.pmod(F.xxhash64("n"), F.lit(batches)) == b)
        table = own.select("n", "id", "label", "vector").orderBy("n").toArrow().combine_chunks()  # a counted batch
        if not table.num_rows:
            continue
        numbers = table.column("n").to_numpy()
        anchors = {"n": numbers, "labels": table.column("label").to_numpy(), "windows": None,
                   "vectors": _vectors(table.column("vector").combine_chunks(), depth)}
        found = dealt.mapInArrow(_search(spark.sparkContext.broadcast(anchors), primes, depth, how), _FOUND)
        near = written(_first(found, how.positives, "place").select(
            "anchor", (F.col("place") - 1).alias("positive"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
        known = near.select("anchor", "positive", "positive_score").toArrow()  # at most `positives` rows for each anchor of the batch
        windows = np.tile(np.array([1, 0], np.int64), (len(numbers), how.positives, 1))  # nothing fits
        at, score = np.searchsorted(numbers, known.column("anchor").to_numpy()), known.column("positive_score").to_numpy()
        windows[at, known.column("positive").to_numpy()] = np.stack([-(-how.low * score // 100), how.high * score // 100], axis=1)
        found = dealt.mapInArrow(_search(spark.sparkContext.broadcast(anchors | {"windows": windows}), primes, depth, how), _FOUND)
        hard = _first(found, how.negatives, "rank")
        names = own.select(F.col("n").alias("anchor"), F.col("id").alias("anchor_id"))
        mined.append(hard.select("anchor", "positive", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
                     .join(near, ["anchor", "positive"]).join(names, "anchor")
                     .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return reduce(DataFrame.unionByName, mined)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``id, label, vector`` with components rounded down to integers, of the rows that have a label and a vector of
    finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def op12_residue_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    noisy = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(noisy.withColumn("anchor", F.coalesce(F.col("id") % 50 == 0, F.lit(False))))
