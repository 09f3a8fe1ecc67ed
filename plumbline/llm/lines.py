"""Line deduplication over range-partitioned line hashes.

Lines travel as hash, document and position, never as text. The range partitions are cut by
hash, document and position together, so that a line of a third of all documents spreads
over many tasks. Each task streams its sorted rows: a group that lies within one task is
decided there; the first and the last group of a task may go on in its neighbours and are
decided by a summary of at most a few rows per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.lineage import written
from plumbline.llm.columns import documents, keyed, renewed, shown_id

LEAST_CHARS = 20
LEAST_DOCS = 3
DROP, OPEN, SEEN = 0, 1, 2
_STREAMED = "h1 bigint, h2 bigint, id bigint, tag bigint, pos int, kind int"
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The stripped line with A-Z in lower case. ``lower`` does that for ASCII lines; others
    keep their other capitals."""
    stripped = F.btrim(line, F.lit(_BLANK))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(stripped) == F.length(stripped), F.lower(stripped)).otherwise(
        F.translate(stripped, capitals, capitals.lower()))


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2`` (128 bits of the key), ``id, tag, pos`` of every line whose key is long enough."""
    lines = docs.select("id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "tag", "pos")


def _stream(least_docs: int):
    """Decides sorted rows (hash, id descending) batch by batch.

    Row kinds out: DROP, a line to drop; OPEN, a line that depends on other tasks; SEEN, one
    of the first ids of a group that may go on elsewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "id", "tag", "pos"]
        group, rank, last_id, first_group = None, 0, None, True  # of the row before the batch
        held: list[list[np.ndarray]] = []  # rows of the 2nd to (least - 1)th document of that group
        seen: list[int] = []  # the first ids of that group

        def out(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
            kinds = np.full(len(columns[0]), kind, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, kinds]], names=[*names, "kind"])

        def evidence() -> pa.RecordBatch:
            n = len(seen)
            zeros = np.zeros(n, np.int64)
            return out([np.full(n, group[0]), np.full(n, group[1]), np.array(seen, np.int64), zeros, zeros.astype(np.int32)], SEEN)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            h1, h2, ids = rows[:3]
            n = len(h1)
            starts = np.empty(n, bool)
            starts[0] = group is None or (h1[0], h2[0]) != group
            starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh = starts.copy()
            fresh[0] |= ids[0] != last_id
            fresh[1:] |= ids[1:] != ids[:-1]
            begins = np.flatnonzero(starts)
            base = np.zeros(len(begins) + 1, np.int64)
            counted = np.cumsum(fresh)
            base[0], base[1:] = -rank, counted[begins] - 1
            number = np.cumsum(starts)  # 0: the group of the batch before
            ranks = counted - base[number]
            ends = np.append(begins, n) - 1  # last row of each group number
            top = np.where(ends >= 0, ranks[np.maximum(ends, 0)], rank)
            if starts[0] and group is not None:  # the held group has ended
                if first_group:
                    yield evidence()
                first_group, held, seen = False, [], []
            is_open = (number == 0) & (group is not None and first_group) | (number == 1) & (group is None)
            if is_open.any():
                yield out([r[is_open] for r in rows], OPEN)
            settled = ~is_open & ((ranks >= least_docs) | (ranks >= 2) & (top[number] >= least_docs))
            if held and number[0] == 0 and top[0] >= least_docs:
                for part in held:
                    yield out(part, DROP)
                held = []
            if settled.any():
                yield out([r[settled] for r in rows], DROP)
            opening = bool(is_open[-1])
            if not starts[0] and len(begins) and first_group and group is not None:  # it ended inside this batch
                more = ids[(number == 0) & fresh]
                seen = (seen + more.tolist())[:least_docs]
                yield evidence()
                seen = []
            elif is_open.any() and not opening:
                group = (h1[0], h2[0])
                seen = ids[is_open & fresh].tolist()[:least_docs]
                yield evidence()
                seen = []
            of_last = number == number[-1]
            if len(begins):
                held, seen = [], []
            seen = (seen + ids[of_last & fresh].tolist())[:least_docs]
            waiting = of_last & ~is_open & (ranks >= 2) & (top[number] < least_docs)
            if waiting.any():
                held.append([r[waiting] for r in rows])
            group, rank, last_id, first_group = (h1[-1], h2[-1]), int(ranks[-1]), ids[-1], opening
        if group is not None:
            yield evidence()
            for part in held:
                yield out(part, OPEN)

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    """Keep bits up to the last dropped line; later lines stay."""
    def packed(positions) -> bytes:
        bits = np.ones(max(positions) // 8 * 8 + 8, np.uint8)
        bits[positions] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return dropped.map(packed)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    def apply(t, bitmap):
        if t is None:
            return None
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:len(lines)]
        return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])

    return pd.Series([apply(t, k) for t, k in zip(text, keep)], dtype=object)


def keep_bitmaps(rows: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``id, tag, n_dropped, keep`` of the documents (see ``keyed``) that lose lines.

    A key of at least ``least_chars`` code points that occurs in ``least_docs`` documents or
    more stays only in the document with the largest id; rows with a missing id count as one
    document with the smallest id, rows with the same id as one document. ``keep``: zlib of
    a bit per line, 1 to keep, up to the last dropped line. An empty table gives no rows.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be at least 2")
    order = ["h1", "h2", F.desc("id"), "tag", "pos"]
    ranged = line_hashes(rows, least_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = written(ranged.mapInArrow(_stream(least_docs), _STREAMED), "lines")
    ends = streamed.where(f"kind = {SEEN}").select("h1", "h2", "id").distinct()
    ends = ends.groupBy("h1", "h2").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where(f"n >= {least_docs}")
    late = streamed.where(f"kind = {OPEN}").join(F.broadcast(ends), ["h1", "h2"]).where("id < largest")  # two groups a task
    dropped = streamed.where(f"kind = {DROP}").select("id", "tag", "pos").unionByName(late.select("id", "tag", "pos"))
    per_doc = dropped.distinct().groupBy("id", "tag").agg(F.collect_list("pos").alias("positions"))
    return per_doc.select("id", "tag", F.size("positions").cast("long").alias("n_dropped"), _bitmap("positions").alias("keep"))


def with_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The keyed rows with ``n_dropped`` and ``kept_text``."""
    joined = rows.join(bitmaps, ["id", "tag"], "left")
    changed = _kept(F.when(F.col("keep").isNotNull(), F.col("text")), "keep")
    return joined.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0))).withColumn("kept_text", F.coalesce(changed, "text"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                        least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of ``docs`` with its columns; texts have lost their repeated lines and
    ``length_col``, if there is one, follows. A text that loses nothing stays as it is, a
    missing one too."""
    rows = keyed(docs, id_col, text_col)
    done = with_bitmaps(rows, keep_bitmaps(rows, least_chars=least_chars, least_docs=least_docs))
    lost = F.col("n_dropped") > 0
    values = {text_col: F.when(lost, F.col("kept_text")).otherwise(F.col("input")[text_col])}
    if length_col in docs.columns:
        values[length_col] = F.when(lost, F.length("kept_text")).otherwise(F.col("input")[length_col])
    return renewed(done, docs, values)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(documents(spark, sf_dir))
    done = with_bitmaps(rows, keep_bitmaps(rows))
    return done.select(
        shown_id(), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
