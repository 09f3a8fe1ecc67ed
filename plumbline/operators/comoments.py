"""Pearson correlations of any number of columns over pairwise complete rows.

Every task multiplies its rows' value and presence matrices, block of rows by block, and keeps only
column by column sums; Spark deals these by strips of columns and adds them up. The plan has the same
size for 5 columns and for 5,000: columns travel as one array per row. Beyond ``STRIP``
columns the matrix is worked on strip by strip, so a task never holds more than a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.local import local_frame

_NAN = "double('NaN')"

STRIP = 768
"""Columns on one side of the sums that a task holds: ten matrices of 4.5 MB."""

GROUP = 64
"""Columns of a strip whose sums are dealt as one row."""

BLOCK_ROWS = 4096
"""Rows multiplied at a time. With 19 bits a code, sums of squared codes of equal and of different values stay apart in doubles."""


def pair_correlations(df: DataFrame, values: dict[str, str], least_pairs: int, strip: int = STRIP, group: int = GROUP) -> DataFrame:
    """(a, b, r, pairs) for every pair of the named values (as SQL) in their order, missing as NULL.

    The values should be scaled and centred. r is NULL below ``least_pairs`` common rows or when
    one side is constant on them.
    """
    names = list(values)
    spark = df.sparkSession
    strips = [names[i:i + strip] for i in range(0, len(names), strip)]
    parts = []
    for i, left in enumerate(strips):
        for j, right in enumerate(strips[i:], i):
            sides = [f"array({', '.join(f'coalesce({values[n]}, {_NAN})' for n in side)}) as {k}" for k, side in (("x", left), ("y", right))]
            sums = df.selectExpr(*sides[:1 if i == j else 2]).mapInArrow(_sums(len(left), len(right), i == j, group), "part int, sums binary")
            pairs = sums.repartition("part").mapInArrow(
                _pairs(len(left), len(right), i == j, group, least_pairs), "i int, j int, r double, pairs bigint")
            parts.append(pairs.select((F.col("i") + i * strip).alias("i"), (F.col("j") + j * strip).alias("j"), "r", "pairs"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    numbered = local_frame(spark, list(enumerate(names)), "k int, name string")  # one row for each column
    for side, k in (("a", "i"), ("b", "j")):
        found = found.join(F.broadcast(numbered.select(F.col("k").alias(k), F.col("name").alias(side))), k)
    return found.select("a", "b", "r", "pairs")


def column_ranges(values: DataFrame, names: list[str]) -> list[tuple[float, float, float] | None]:
    """Smallest and largest value and mean of each named column of doubles, None without values. The plan does not
    grow with the columns; the mean is of parts so small that it cannot overflow."""
    top = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, top):
                column = batch.column("x").slice(at, top)
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                there = ~np.isnan(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(np.where(there, x, np.inf).min(axis=0)), pa.array(np.where(there, x, -np.inf).max(axis=0)),
                     pa.array((np.where(there, x, 0) / 2**20).sum(axis=0)), pa.array(there.sum(axis=0))], names=["k", "low", "high", "part", "n"])

    rows = values.selectExpr(f"array({', '.join(f'coalesce({n}, {_NAN})' for n in names)}) as x").mapInArrow(
        run, "k int, low double, high double, part double, n bigint")
    found = rows.groupBy("k").agg(F.min("low"), F.max("high"), F.sum("part"), F.sum("n")).collect()  # a row for each column
    ranges: list[tuple[float, float, float] | None] = [None] * len(names)
    for k, low, high, part, n in found:
        if n:
            ranges[k] = (low, high, part / n * 2**20 if abs(part / n) < 1e280 else 0.0)
    return ranges


def _sums(n_left: int, n_right: int, same: bool, group: int):
    """Ten matrices (left x right columns) of a task's rows: common rows and sums of products; then for each
    side over the rows where the other is present: sum, sum of squares, and the code of
    its values if it is one (0: none yet, -1: several) in two parts of the same shape."""
    top = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, n_left, n_right))
        codes = np.zeros((2, n_left, n_right), np.int64)

        def coded(x: np.ndarray) -> np.ndarray:
            """A number from 1 to 2 ** 19 for each value, mostly different for different values; 0 where missing."""
            bits = (x + 0.0).view(np.uint64)
            bits = (bits ^ (bits >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            return np.where(np.isnan(x), 0, (bits >> np.uint64(45)).astype(np.int64) + 1).astype(np.float64)

        def one_side(k: int, x: np.ndarray, code: np.ndarray, other: np.ndarray, common: np.ndarray, turn) -> None:
            total[2 + k] += turn(x.T @ other)
            total[4 + k] += turn((x * x).T @ other)
            first, second = turn(code.T @ other), turn((code * code).T @ other)
            one = np.where(common > 0, first / np.maximum(common, 1), 0)
            one = np.where(first * one == second, one, -1).astype(np.int64)  # equality holds for equal codes only
            codes[k] = np.where(codes[k] == 0, one, np.where((one == 0) | (one == codes[k]), codes[k], -1))

        for batch in batches:
            for at in range(0, batch.num_rows, top):
                part = batch.slice(at, top)
                sides = []
                for column in part.columns:
                    x = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    code, there = coded(x), ~np.isnan(x)
                    sides.append((np.where(there, x, 0.0), code, there.astype(np.float64)))
                left, right = sides[0], sides[-1]
                common = left[2].T @ right[2]
                total[0] += common
                total[1] += left[0].T @ right[0]
                one_side(0, left[0], left[1], right[2], common, lambda m: m)
                one_side(1, right[0], right[1], left[2], common, np.transpose)
        for low in range(0, n_left, group):
            block = np.concatenate([total[:, low:low + group], codes[:, low:low + group].astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array([low // group], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["part", "sums"])

    return run


def _pairs(n_left: int, n_right: int, same: bool, group: int, least_pairs: int):
    """Adds up the sums of all tasks for a group of columns and turns them into pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums")):
                new = np.frombuffer(raw.as_buffer(), np.float64).reshape(8, -1, n_right)
                if part not in held:
                    held[part] = new.copy()
                    continue
                old = held[part]
                old[:6] += new[:6]
                a, b = old[6:], new[6:]
                old[6:] = np.where(a == 0, b, np.where((b == 0) | (a == b), a, -1))
        for part, (n, xy, sx, sy, qx, qy, cx, cy) in held.items():
            with np.errstate(all="ignore"):
                spread = np.sqrt(qx - sx * sx / n) * np.sqrt(qy - sy * sy / n)
                r = np.clip((xy - sx * sy / n) / spread, -1.0, 1.0)
            known = (n >= least_pairs) & (cx < 0) & (cy < 0) & np.isfinite(r)
            i, j = np.indices(n.shape)
            i += part * group
            keep = (i < j) if same else np.ones(n.shape, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(r[keep], mask=~known[keep]),
                 pa.array(n[keep].astype(np.int64))], names=["i", "j", "r", "pairs"])

    return run
