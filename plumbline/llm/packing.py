"""Best-fit packing planned on the histogram of piece lengths.

The plan is made over counts: it sees at most one number per length, however many documents
there are. Each piece then takes a planned slot by its rank among the pieces of its length.
Ranks come from counters within each task plus a running sum over the tasks' counts, so no
length, however frequent, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.lineage import written
from plumbline.llm.bytetext import slices, text_bytes
from plumbline.llm.columns import documents, texts
from plumbline.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
_RANK_BITS = 48


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Plan:
    """Slots: pieces of ``lengths[i]`` with ranks from ``ranks[i]`` on (up to the next entry of
    the same length) go to the sequences from ``sequences[i]`` on, one each, at ``offsets[i]``."""

    lengths: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    n_sequences: int


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over counts: longest pieces first, each into the fullest sequences
    that still have room, a run of equal sequences at a time."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: first sequence, how many
    slots: list[tuple[int, int, int, int]] = []
    n_sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = next((r for r in range(length, capacity + 1) if room[r]), None)
            if free is None:
                free, each = capacity, capacity // length
                first, many = n_sequences, -(-left // each)
                n_sequences += many
            else:
                first, many = room[free].pop()
                each = free // length
            full = min(many, left // each)
            runs = [(first, full, each)] if full else []
            if full < many and left - full * each:
                runs.append((first + full, 1, left - full * each))
            used = sum(n for _, n, _ in runs)
            if used < many:
                room[free].append((first + used, many - used))
            for start, n, times in runs:
                for k in range(times):
                    slots.append((length, rank, start, capacity - free + k * length))
                    rank += n
                    left -= n
                rest = free - times * length
                if rest:
                    room[rest].append((start, n))
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return Plan(*table.T, n_sequences)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, task int, place bigint"


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut, and their first piece
    is the short one. ``task`` and ``place``: the task and the rank within task and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(tokenizer), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                part = batch.slice(low, high - low)
                ids, bounds = encoder.encode(part.column("text"), end_id)
                totals = np.diff(bounds)
                n = -(-totals // capacity)
                owner = np.repeat(np.arange(len(totals)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                head = totals - (n - 1) * capacity
                length = np.where(piece == 0, head[owner], capacity)
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                place = np.empty(len(length), np.int64)
                place[order] = used[ordered] + np.arange(len(ordered)) - first
                used += np.bincount(length, minlength=capacity + 1)
                raw = [ids[a:a + s].astype("<u4").tobytes() for a, s in zip(bounds[owner] + start, length)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(np.array([zlib.crc32(x) for x in raw], np.int64)),
                    pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
                    pa.array(np.full(len(raw), task, np.int32)), pa.array(place)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"])

    return texts(docs).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and the
    ids (little-endian unsigned 32-bit) if asked for.

    A missing or empty text is one piece of the end id alone. Repeated rows and missing ids
    are documents like others; an empty table gives no pieces. Texts go through the
    tokenizer once; the pieces are written before they are ranked, so that ranks hold when
    tasks run again.
    """
    stored = written(pieces(docs, tokenizer=tokenizer or tokenizer_path(TOKENIZER), end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces")
    per_task = written(stored.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = best_fit(counts, capacity)
    keys = plan.lengths << _RANK_BITS | plan.ranks
    shared = docs.sparkSession.sparkContext.broadcast((keys, plan.ranks, plan.sequences, plan.offsets))  # a few thousand slots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, batch.column("length").to_numpy() << _RANK_BITS | rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences[slot] + rank - ranks[slot]), pa.array(offsets[slot]), batch.column("ids")],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    ranked = stored.join(bases, ["task", "length"]).withColumn("rank", F.col("place") + F.col("base"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank").mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary")
    return out if with_ids else out.drop("ids")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
