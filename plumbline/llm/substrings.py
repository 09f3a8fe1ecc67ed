"""Exact substring deduplication: every byte of a 200-byte string that occurs elsewhere goes.

Texts are cut into stretches of consecutive windows that share an anchor, the 48-byte gram
of least hash in the window. Equal windows have equal anchors at equal distance, so all
copies of a window meet under one key, aligned on the anchor. Keys seen once are dropped
before any text moves; stretches that are equal as a whole need no text either. For the
rest, the stretches of a key are documents of a column-wise construction: each round
inserts one symbol of every document, from the last column to the first, and updates the
order of the suffixes (their symbols in this order are the column of the collection's
Burrows-Wheeler transform) and the common prefixes of neighbours. Columns are read from a
sequential external file. Neighbours with 200 common bytes are the repeated windows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.lineage import written
from plumbline.llm.bytetext import _INVERSE, mixed, powers, prefix_sums, slices, text_bytes
from plumbline.llm.columns import documents, keyed, shown_id

LENGTH = 200
GRAM = 48
SPREAD = LENGTH - GRAM + 1  # places of a gram in a window
PART = 1 << 18  # bytes whose index arrays exist at the same time, over 100 for each byte; results do not depend on it
#: A key with more different stretches than this is split by longer grams before it is sorted.
MOST = 2_000
#: Stretches that are sorted together.
BATCH = 20_000
#: Stretches that leave a task together with their bytes, 352 each at most.
SENT = 8_192
STRING, SPAN = 0, 1
_FOUND = "kind int, key bigint, digest bigint, id bigint, tag bigint, start bigint, n int, d int, times int"
_SPANS = "id bigint, tag bigint, start bigint, stop bigint"


def _sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    n = len(values)
    padded = np.concatenate([values, np.full(-n % size, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, size)
    before = np.minimum.accumulate(padded, axis=1).reshape(-1)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n - size + 1], before[size - 1:n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``key, digest, row, first, n, d``: from byte ``first`` on, ``n`` windows of the row share an
    anchor that lies ``d`` bytes after the first; the digest covers all their bytes."""
    n_windows = len(data) - LENGTH + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64),) * 6
    sums, back = prefix_sums(data), powers(len(data) + 1, _INVERSE)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * back[:len(data) - GRAM + 1])
    low = np.uint64((1 << 22) - 1)
    anchors = (_sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPREAD) & low).astype(np.int64)
    rows = np.searchsorted(offsets, np.arange(n_windows), "right") - 1
    valid = np.arange(n_windows) + LENGTH <= offsets[rows + 1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], n_windows)
    ends = np.flatnonzero(np.append(valid[:-1] & ~valid[1:], valid[-1])) + 1  # the last window of a text
    if len(starts):
        nearest = ends[np.minimum(np.searchsorted(ends, starts, "right"), len(ends) - 1)]
        stops = np.minimum(stops, nearest)
    n, anchor = stops - starts, anchors[starts]
    size = n + LENGTH - 1
    digest = mixed((sums[starts + size] - sums[starts]) * back[starts] + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (anchor - starts).astype(np.uint64))
    return grams[anchor].view(np.int64), digest.view(np.int64), rows[starts], starts, n, anchor - starts


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of all texts. One that repeats within its text yields its bytes as spans and
    stays once, with ``times`` 2."""
    def out(kind, key, digest, ids, tags, start, n, d, times) -> pa.RecordBatch:
        size = len(key)
        arrays = [np.full(size, kind, np.int32), key, digest, ids, tags, start.astype(np.int64), n.astype(np.int32), d.astype(np.int32), times.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[x.split()[0] for x in _FOUND.split(", ")])

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        all_ids = batch.column("id").to_numpy()
        all_tags = batch.column("tag").to_numpy()
        for low, high in slices(offsets, PART):
            begin, end = offsets[low], offsets[high]
            for at in range(begin, max(begin + 1, end - LENGTH + 1), PART):  # more than one only for a long text
                part = data[at:min(end, at + PART + LENGTH - 1)]
                bounds = np.clip(offsets[low:high + 1] - at, 0, len(part))
                key, digest, row, start, n, d = stretches(part, bounds)
                if not len(key):
                    continue
                doc = low + row
                start = start + at - offsets[doc]
                order = np.lexsort((start, digest, key, row))
                key, digest, doc, start, n, d = (x[order] for x in (key, digest, doc, start, n, d))
                again = np.zeros(len(key), bool)
                again[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & (doc[1:] == doc[:-1])
                first = np.flatnonzero(~again)
                times = np.minimum(np.diff(np.append(first, len(key))), 2)
                yield out(STRING, key[first], digest[first], all_ids[doc[first]], all_tags[doc[first]], start[first], n[first], d[first], times)
                repeated = np.repeat(times == 2, np.diff(np.append(first, len(key))))
                if repeated.any():
                    picked = np.flatnonzero(repeated)
                    picked = picked[np.lexsort((start[picked], doc[picked]))]
                    s, e, o = start[picked], start[picked] + n[picked] + LENGTH - 1, doc[picked]
                    joined = np.zeros(len(s), bool)  # next to or over the one before
                    joined[1:] = (o[1:] == o[:-1]) & (s[1:] <= e[:-1])
                    heads = np.flatnonzero(~joined)
                    stop = np.maximum.reduceat(e, heads)
                    zero = np.zeros(len(heads), np.int64)
                    yield out(SPAN, zero, stop, all_ids[o[heads]], all_tags[o[heads]], s[heads], zero, zero, zero)


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key stands alone within the task go; the first and the
    last row of a task stay. Rows that stand for two stay, spans too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        key = table["key"].to_numpy()
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[:-1] | same[1:] | (table["times"].to_numpy() != 1)
        if held is None:
            keep[0] = True
        else:
            keep[0] |= held_keep
        rows = table.filter(pa.array(keep[:-1].tolist() + [False]))
        held, held_keep = table.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
        yield from rows.to_batches()
    if held is not None:
        yield held


def repeated_columns(texts: list[bytes], group: np.ndarray, d: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The repeated windows of stretches, ascending, as ``stretch << 16 | byte where the window starts``.

    ``group`` ascends; stretches of a group are aligned ``d`` bytes after their start. Each
    round takes one column of all stretches, from right to left. ``order`` holds the
    stretches by group and by what follows the column, ``common`` the common prefix with the
    one before (-1 between groups). Sorting the order by the new symbols, stably, gives the
    order of the suffixes that begin here; a common prefix is one more than the least common
    prefix in between.
    """
    sizes = np.array([len(t) for t in texts])
    left, right = -d, sizes - d
    m, low, high = len(texts), int(left.min()), int(right.max())
    found = []
    with tempfile.TemporaryFile() as file:  # the columns, last first
        for c in range(0, m, 4096):  # transposed in blocks of stretches
            block = np.zeros((min(4096, m - c), high - low), np.uint8)
            for i, t in enumerate(texts[c:c + 4096]):
                block[i, left[c + i] - low:right[c + i] - low] = np.frombuffer(t, np.uint8)
            for column, symbols in enumerate(np.ascontiguousarray(block[:, ::-1].T)):
                file.seek(column * m + c)
                file.write(symbols.tobytes())
        file.seek(0)
        entering = np.argsort(-right, kind="stable")
        turns = np.searchsorted(-right[entering], np.arange(-high, -low + 1), "left")
        order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
        for turn, column in enumerate(range(high - 1, low - 1, -1)):
            symbols = np.frombuffer(file.read(m), np.uint8)
            stays = left[order] <= column
            if not stays.all():
                kept = np.flatnonzero(stays)
                common = np.minimum.reduceat(common[:kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else common[:0]
                order = order[kept]
            new = np.sort(entering[turns[turn]:turns[turn + 1]])
            if len(new):
                order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int16), common])
                by_group = np.argsort(group[order], kind="stable")
                order, common = order[by_group], np.maximum(common[by_group], 0)
            if not len(order):
                continue
            own = group[order]
            common[0] = -1
            common[1:][own[1:] != own[:-1]] = -1
            moved = np.argsort(own * 256 + symbols[order], kind="stable")
            key = (own * 256 + symbols[order])[moved]
            p, q = moved[:-1], moved[1:]
            fresh = np.where(own[moved][1:] == own[moved][:-1], 0, -1).astype(np.int16)
            equal = np.flatnonzero(key[1:] == key[:-1])
            near = equal[q[equal] == p[equal] + 1]
            fresh[near] = common[q[near]] + 1
            wide = equal[q[equal] != p[equal] + 1]
            if len(wide):
                places = np.column_stack([p[wide] + 1, q[wide] + 1]).reshape(-1)
                fresh[wide] = np.minimum.reduceat(np.append(common, np.int16(-1)), places)[::2] + 1
            order, common = order[moved], np.append(np.int16(-1), fresh)
            long = common >= length
            if long.any():
                long[:-1] |= long[1:]
                hit = order[long]
                found.append(hit << 16 | (column - left[hit]))
    hits = np.concatenate(found) if found else np.zeros(0, np.int64)
    hits.sort()
    return hits


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows among stretches (rows sorted by key, keys whole within a task)."""
    held: pa.Table | None = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = table["key"].to_numpy()
        group = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        hits = repeated_columns(table["bytes"].to_pylist(), group, table["d"].to_numpy().astype(np.int64))
        head = np.ones(len(hits), bool)
        head[1:] = hits[1:] != hits[:-1] + 1
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(hits)) - 1 if len(heads) else heads
        of, first, last = hits[heads] >> 16, hits[heads] & 0xFFFF, hits[tails] & 0xFFFF
        start = table["start"].to_numpy()[of]
        return pa.RecordBatch.from_arrays(
            [pa.array(table["id"].to_numpy()[of]), pa.array(table["tag"].to_numpy()[of]), pa.array(start + first),
             pa.array(start + last + LENGTH)], names=["id", "tag", "start", "stop"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        if held.num_rows >= BATCH:
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted stretches of every text with their bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        wanted = batch.column("wanted")
        of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        fields = wanted.flatten()
        fields = dict(zip(fields.type.names, fields.flatten()))
        begin = offsets[of] + fields["start"].to_numpy()
        end = begin + fields["n"].to_numpy() + LENGTH - 1
        for at in range(0, len(of), SENT):
            part = slice(at, at + SENT)
            size = len(of[part])
            texts = [data[x:y].tobytes() for x, y in zip(begin[part].tolist(), end[part].tolist())]
            key, digest, start, n, d, different = (fields[c][part] for c in ("key", "digest", "start", "n", "d", "different"))
            yield pa.RecordBatch.from_arrays(
                [key, digest, batch.column("id").take(pa.array(of[part])), batch.column("tag").take(pa.array(of[part])), start, n, d,
                 pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, SPREAD - 1, np.int32)), different, pa.array(texts, pa.binary())],
                names=[x.split()[0] for x in _CONTENT.split(", ")])


#: ``different`` counts the different stretches of the row's key.
_CONTENT = "key bigint, digest bigint, id bigint, tag bigint, start bigint, n int, d int, low int, high int, different bigint, bytes binary"


def _halved(rows: DataFrame) -> DataFrame:
    """Stretches of crowded keys in two: windows whose anchor is near, and far. Windows of a half
    share more bytes than the anchor (columns ``-low`` to ``LENGTH - high``), which make the new key."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    # Window i of a stretch has its anchor d - i bytes after it: the first ones are far.
    far = F.least(F.col("n"), F.greatest(F.lit(0), F.col("d") - middle))
    parts = rows.withColumn("part", F.explode(F.array(
        F.struct(F.lit(0).alias("skip"), far.alias("n"), (middle + 1).alias("low"), F.col("high").alias("high")),
        F.struct(far.alias("skip"), (F.col("n") - far).alias("n"), F.col("low").alias("low"), middle.alias("high"))))).where("part.n > 0")
    d, low, high = F.col("d") - F.col("part.skip"), F.col("part.low"), F.col("part.high")
    data = F.substring("bytes", F.col("part.skip") + 1, F.col("part.n") + LENGTH - 1)
    shared = F.substring(data, d - low + 1, LENGTH - high + low)
    return parts.select(
        F.xxhash64("key", low, high, shared).alias("key"), F.xxhash64(data, d).alias("digest"), "id", "tag",
        (F.col("start") + F.col("part.skip")).alias("start"), F.col("part.n").alias("n"), d.alias("d"), low.alias("low"), high.alias("high"), data.alias("bytes"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``id, tag, start, stop`` (bytes; overlapping spans may occur) of keyed rows: every window of
    ``LENGTH`` bytes that also starts elsewhere, in the same row or another. ``tag`` tells rows
    apart that share an id."""
    found = rows.select("id", "tag", "text").mapInArrow(_find, _FOUND)
    order = ["key", "digest", "id", "start"]
    found = written(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_drop_single, _FOUND), "stretches")
    spans = [found.where(f"kind = {SPAN}").select("id", "tag", "start", F.col("digest").alias("stop"))]
    strings = found.where(f"kind = {STRING}")
    equal = strings.groupBy("key", "digest").agg(
        F.sum("times").alias("times"), F.min_by(F.struct("id", "tag", "start", "n", "d"), F.struct("id", "tag", "start")).alias("one"))
    per_key = equal.groupBy("key").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("different")).where("`all` > 1")
    known = written(equal.join(per_key, "key"), "equal")
    copied = strings.join(known.where("times > 1").select("key", "digest"), ["key", "digest"])
    spans.append(copied.select("id", "tag", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("stop")))

    wanted = known.where("different > 1").groupBy("one.id", "one.tag").agg(F.collect_list(F.struct(
        "key", "digest", F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.d").alias("d"), "different")).alias("wanted"))
    texts = wanted.join(rows, ["id", "tag"]).select("id", "tag", "text", "wanted").dropDuplicates(["id", "tag"])  # of rows that repeat, one
    todo = written(texts.mapInArrow(_contents, _CONTENT), "contents")
    while True:
        pairs = todo.where(f"different between 2 and {MOST}")
        spans.append(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups, _SPANS))  # read once, so not written
        crowded = todo.where(f"different > {MOST} and low < high")
        if crowded.isEmpty():
            break
        halves = written(_halved(crowded), "halves")
        same = halves.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "tag", "start")).alias("one"))
        copied = halves.join(same.where("copies > 1").select("key", "digest"), ["key", "digest"])
        spans.append(copied.select("id", "tag", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("stop")))
        per_key = same.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
        firsts = same.join(per_key, "key").select("key", "digest", "one.id", "one.tag", "one.start", "different")
        todo = written(halves.join(firsts, ["key", "digest", "id", "tag", "start"]).select(*todo.columns), "contents")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out



def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            removed, n_spans, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i]:offsets[i + 1]]
                spans = batch.column("spans")[i].as_py()
                if spans:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, [min(s["start"], len(raw)) for s in spans], 1)
                    np.add.at(edge, [min(s["stop"], len(raw)) for s in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(raw) else 0)
                    removed.append(int(gone.sum()))
                    raw = raw[~gone]
                else:
                    removed.append(0)
                    n_spans.append(0)
                digests.append(hashlib.sha256(raw.tobytes()).hexdigest())
                kept_texts.append(raw.tobytes() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests),
                 pa.array(kept_texts, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def cut_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """A row per row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for,
    ``kept`` (the remaining bytes; a cut may leave part of a character).

    A missing or empty text has no bytes. Every copy goes, the first one too; rows that
    repeat as a whole are repeats of each other. Texts under ``LENGTH`` bytes lose nothing.
    """
    rows = keyed(docs).select("id", "tag", "text")
    spans = repeated_spans(rows).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = rows.join(spans, ["id", "tag"], "left").select("id", "text", "spans").mapInArrow(
        _cut(with_text), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def op6_columnwise_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select(shown_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
