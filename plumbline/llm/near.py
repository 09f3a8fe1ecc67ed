"""Near-duplicate classes by DartMinHash signatures and banded joining.

Copies collapse on a digest of their words before anything is joined. Signatures of the
distinct texts are cut into bands; texts that share a band meet in a bucket. No bucket is
gathered and none emits all its pairs: small buckets test all their pairs; members of large
ones are tested against the smallest centre of their buckets, then, where they are still
apart, against the member with the most links of each bucket. What is apart even then is
compared by signature and verified, block by block.
Every link is verified on the exact shingle sets, then classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.lineage import written
from plumbline.llm.bytetext import SPACES, all_word_hashes, mixed, powers, shingle_hashes, slices, text_bytes
from plumbline.llm.columns import documents, keyed, renewed, shown_id

_GOLD = 0x9E3779B97F4A7C15


def _salt(turn: int) -> np.uint64:
    return np.uint64(_GOLD * turn % 2**64)


@dataclass(frozen=True)
class Near:
    """``bands`` of ``rows`` coordinates: two texts of similarity s share no band with
    probability (1 - s ** rows) ** bands, 3e-6 at 0.8. Buckets of up to ``small`` members test
    all pairs. ``slack``: blocks compare signatures with this margin below the threshold
    (four standard errors)."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    small: int = 8
    slack: float = 0.13
    block: int = 64
    weighting: str = "set"  # or "count": weights are how often a shingle occurs

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def dart_minhash(hashes: np.ndarray, owners: np.ndarray, n: int, coordinates: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n x coordinates, 64 bits) of weighted sets given as element hash, owner, weight.

    Each element has a region, its weight wide and unbounded in rank. A Poisson process
    seeded by the element throws darts into it, the same for every set that holds the
    element; a set sees the darts within its weight. Each dart lands on one coordinate,
    which keeps the dart of least rank. Ranks are looked at up to a limit that fills all
    coordinates almost surely, about t ln t + 2t darts a set; sets with an empty coordinate
    look twice as far. The width is thrown in dyadic strips, so heavy elements cost no more.
    Sets without elements get zeros.
    """
    signature = np.zeros((n, coordinates), np.uint64)
    weight = np.ones(len(hashes)) if weights is None else weights.astype(np.float64)
    total = np.bincount(owners, weights=weight, minlength=n)
    limit = (coordinates * np.log(coordinates) + 2 * coordinates) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        best = np.full(n * coordinates, np.inf)
        thrown = []
        chosen = np.flatnonzero(todo[owners])
        strip = 0
        while len(chosen):
            seed = mixed(hashes[chosen] + _salt(3 * strip + 7))
            rank, at, turn = np.zeros(len(chosen)), chosen, 0
            while len(at):
                u = mixed(seed + _salt(2 * turn + 1))
                rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / 2**strip
                near = rank <= limit[owners[at]]
                at, seed, rank, u = at[near], seed[near], rank[near], u[near]
                dart = mixed(seed + _salt(2 * turn + 2))
                place = (2**strip - 1) + (mixed(u) >> np.uint64(11)).astype(np.float64) / 2**53 * 2**strip
                key = owners[at] * coordinates + (dart % np.uint64(coordinates)).astype(np.int64)
                seen = place < weight[at] if weights is not None else slice(None)
                np.minimum.at(best, key[seen], rank[seen])
                thrown.append((key[seen], rank[seen], dart[seen]))
                turn += 1
            strip += 1
            chosen = chosen[weight[chosen] > 2**strip - 1]
        for key, rank, dart in thrown:
            wins = rank == best[key]
            signature.reshape(-1)[key[wins]] = dart[wins]
        empty = np.isinf(best).reshape(n, coordinates).any(axis=1)
        todo &= empty
        limit = np.where(todo, limit * 2, limit)
    return signature


def _sketch(how: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                n, part = high - low, batch.slice(low, high - low)
                words, owners = all_word_hashes(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], inside=~SPACES)
                counts = np.bincount(owners, minlength=n)
                begins = np.concatenate([[0], np.cumsum(counts)])
                place = np.arange(len(words)) - begins[owners]
                digests = []
                for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                    terms = mixed(words + np.uint64(base)) * powers(int(counts.max()) + 1 if n else 1, np.uint64(base))[place]
                    sums = np.concatenate([[0], np.cumsum(terms, dtype=np.uint64)]).astype(np.uint64)
                    digests.append(mixed(sums[begins[1:]] - sums[begins[:-1]]).view(np.int64))
                hashes, of = shingle_hashes(words, owners, n, how.shingle)
                weights = None
                if how.weighting == "count":
                    pairs, weights = np.unique(np.rec.fromarrays([of, hashes]), return_counts=True)
                    of, hashes = np.asarray(pairs.f0), np.asarray(pairs.f1)
                signature = dart_minhash(hashes, of, n, how.coordinates, weights)
                banded = signature.reshape(n, how.bands, how.rows)
                bands = np.zeros((n, how.bands), np.uint64)
                for j in range(how.rows):
                    bands = mixed(bands + banded[:, :, j])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * how.bands, how.bands, dtype=np.int32)), pa.array(bands.view(np.int64).reshape(-1)))
                short = (signature >> np.uint64(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tag"), pa.array(digests[0]), pa.array(digests[1]), pa.array(counts.astype(np.int64)),
                     pa.array(np.diff(offsets[low:high + 1])), lists,
                     pa.array([row.tobytes() for row in short], pa.binary())],
                    names=["id", "tag", "d1", "d2", "n_words", "n_bytes", "bands", "signature"])

    return run


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    words, owners = all_word_hashes(data, offsets, inside=~SPACES)
    hashes, of = shingle_hashes(words, owners, len(column), size)
    order = np.argsort(of, kind="stable")
    return (np.unique(x) for x in np.split(hashes[order], np.cumsum(np.bincount(of, minlength=len(column)))[:-1]))


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _verify(how: Near):
    """Keeps the pairs of texts whose shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = text_bytes(batch.column("text_a"))
            for low, high in slices(lengths, 1 << 20):
                part = batch.slice(low, high - low)
                links = [_similar(a, b, how.similarity) for a, b in zip(*(_sets(part.column(c), how.shingle) for c in ("text_a", "text_b")))]
                yield part.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: each vertex of the edges (``a, b``) with the smallest vertex connected to it.

    Every round takes the least label around and then the label of the label, so that
    distances halve; rounds are written, nothing is gathered.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        done = written(nearer.join(jump, "next", "left").select("v", "label", F.least("next", "far").alias("next")), "labels")
        labels = done.select("v", F.col("next").alias("label"))
        if done.where("label != next").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: components of the labels that the links touch."""
    first, second = (labels.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    named = links.join(first, "a", "left").join(second, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b").distinct()
    roots = components(named).withColumnRenamed("label", "root")
    moved = labels.join(roots.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels.select("v"), "v", "left_anti").select("v", F.col("root").alias("label"))
    return written(moved.unionByName(new), "labels")


def _text_classes(rows: DataFrame, how: Near) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches (a row per row), the texts (``d1, d2, label``) and the classes (``label, first``: the
    smallest ``id, tag`` of their rows) of keyed rows. Vertices are texts, numbered; ids link nothing."""
    sketched = written(rows.select("id", "tag", "text").mapInArrow(
        _sketch(how), "id bigint, tag bigint, d1 bigint, d2 bigint, n_words bigint, n_bytes bigint, bands array<bigint>, signature binary"), "sketches")
    copies = written(sketched.groupBy("d1", "d2").agg(
        F.min(F.struct("id", "tag")).alias("first"), F.max("n_words").alias("n_words"), F.max("n_bytes").alias("n_bytes"), F.min_by("bands", "id").alias("bands"),
        F.min_by("signature", "id").alias("signature")).sortWithinPartitions("d1", "d2").withColumn("v", F.monotonically_increasing_id()), "distinct")
    members = copies.where("n_words > 0").select("v", F.posexplode("bands").alias("band", "hash"))
    sized = members.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("centre")).where("n > 1")
    buckets = written(members.join(sized, ["band", "hash"]), "buckets")
    needed = copies.join(buckets.select("v").distinct(), "v", "left_semi").select("first.id", "first.tag", "v")
    texts = written(rows.select("id", "tag", "text").dropDuplicates(["id", "tag"]).join(needed, ["id", "tag"]).select("v", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
        wide = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
        wide = wide.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
        return wide.select("a", "b", "text_a", "text_b").mapInArrow(_verify(how), "a bigint, b bigint")

    # First all pairs of small buckets, and members of large ones against their least centre;
    # whom that leaves apart meets the best-linked member of each of its buckets.
    small = buckets.where(f"n <= {how.small}").groupBy("band", "hash").agg(F.collect_set("v").alias("vs"))  # at most `small` values
    inner = small.select(F.explode("vs").alias("a"), "vs").select("a", F.explode("vs").alias("b")).where("a < b")
    stars = buckets.where(f"n > {how.small}").groupBy("v").agg(F.min("centre").alias("b")).select(F.col("v").alias("a"), "b")
    links = written(verified(inner.unionByName(stars)), "links")
    labels = components(links)

    large = written(buckets.where(f"n > {how.small}").select("band", "hash", "v"), "large")
    if not large.isEmpty():
        degree = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
        apart = written(_apart(_labelled(large, labels.join(degree, "v", "left"))).fillna(0, ["links"]), "apart")
        if not apart.isEmpty():
            centres = apart.groupBy("band", "hash").agg(F.max_by(F.struct("v", "label"), F.struct("links", -F.col("v"))).alias("c"))
            again = apart.join(centres, ["band", "hash"]).where("label != c.label").select(F.col("v").alias("a"), F.col("c.v").alias("b"))
            labels = _merged(labels, written(verified(again), "links"))
            labels = _exhausted(large, labels, copies, texts, how)

    roots = written(copies.join(labels, "v", "left").select("d1", "d2", "first", F.coalesce("label", "v").alias("label")), "roots")
    return sketched, roots.drop("first"), roots.groupBy("label").agg(F.min("first").alias("first"))


def row_classes(rows: DataFrame, how: Near = Near()) -> DataFrame:
    """``id, tag, class_id``, a row per keyed row (see ``keyed``): the smallest id of the rows whose texts
    are connected to its text by links of similarity ``how.similarity`` or more between sets of
    ``how.shingle`` words.

    Texts with the same words are copies, texts without words are copies of each other, a
    text of fewer words has one shingle of all of them. Rows that share an id, or have none, are
    judged by their texts alone; classes whose smallest id is the same (``NO_ID``, or an id of
    several texts) show the same ``class_id``. An empty table gives no rows.
    """
    sketched, roots, classes = _text_classes(rows, how)
    named = roots.join(classes, "label").select("d1", "d2", F.col("first.id").alias("class_id"))
    return sketched.select("id", "tag", "d1", "d2").join(named, ["d1", "d2"]).select("id", "tag", "class_id")


def near_classes(rows: DataFrame, how: Near = Near()) -> DataFrame:
    """The distinct ``id, tag, class_id`` of ``row_classes``."""
    return row_classes(rows, how).distinct()


def _labelled(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of large buckets with their labels, written: they are grouped and joined again."""
    return written(large.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "labelled")


def _apart(named: DataFrame) -> DataFrame:
    """The labelled members of buckets that hold more than one label."""
    several = named.groupBy("band", "hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return named.join(several.select("band", "hash"), ["band", "hash"])


def _exhausted(large: DataFrame, labels: DataFrame, copies: DataFrame, texts: DataFrame, how: Near) -> DataFrame:
    """Whatever is still apart: the members of a bucket, and again those outside its commonest
    label, are laid in numbered blocks, and every block of the first kind meets every one of the
    second. The pairs of blocks are dealt by bucket and both numbers, so that one bucket
    spreads over all tasks. Signatures meet first; two texts are compared in the first bucket
    they share. Only pairs of blocks with similar signatures and different labels get their
    texts, and those are verified on the spot; only links come out."""
    bucket = ["band", "hash"]
    apart = _apart(_labelled(large, labels))
    by_label = apart.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.groupBy(*bucket).agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    signed = apart.join(most, bucket).join(copies.select("v", "signature", "bands", "n_bytes"), "v")
    signed = written(signed.withColumn("outside", F.col("label") != F.col("most")).drop("most"), "apart")
    if signed.isEmpty():
        return labels

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*bucket).agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / how.block), F.ceil(F.sum("n_bytes") / 4e6), F.lit(1)).alias(name))

    outside = signed.where("outside")
    counts = written(sizes(signed, "ms").join(sizes(outside, "os"), bucket), "blocks")

    def blocks(rows: DataFrame, number: str, name: str, *columns: str) -> DataFrame:
        dealt = rows.join(counts, bucket).withColumn(number, F.pmod(F.xxhash64("v"), F.col(f"{number}s")))
        other = "o" if number == "m" else "m"
        return dealt.repartition(*bucket, number).groupBy(*bucket, number).agg(
            F.first(f"{other}s").alias(f"{other}s"), F.collect_list(F.struct(*columns)).alias(name))

    least = how.similarity - how.slack

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            left, right, pairs = row["members"], row["others"], []
            mine, table = (np.frombuffer(b"".join(r["signature"] for r in side), "<u2").reshape(len(side), -1) for side in (left, right))
            v, label, bands = (np.array([r[c] for r in right], np.int64) for c in ("v", "label", "bands"))
            for one, signature in zip(left, mine):
                near = ((table == signature).mean(axis=1) >= least) & (label != one["label"])
                if one["outside"]:
                    near &= v > one["v"]  # both are on both sides
                near = np.flatnonzero(near)
                near = near[(bands[near] == np.array(one["bands"], np.int64)).argmax(axis=1) == row["band"]]
                pairs += [{"a": one["v"], "b": int(x)} for x in v[near]]
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["band"]], pa.int32()), *(pa.array([row[c]], pa.int64()) for c in ("hash", "m", "o")),
                     pa.array([pairs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["band", "hash", "m", "o", "pairs"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            sets = {}
            for side, end in (("members", "a"), ("others", "b")):
                wanted = {p[end] for p in row["pairs"]} - sets.keys()
                part = [r for r in row[side] if r["v"] in wanted]
                sets |= zip((r["v"] for r in part), _sets(pa.array([r["text"] for r in part], pa.string()), how.shingle))
            links = [(p["a"], p["b"]) for p in row["pairs"] if _similar(sets[p["a"]], sets[p["b"]], how.similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    signs = ("v", "label", "outside", "signature", "bands")
    members = blocks(signed, "m", "members", *signs).withColumn("o", numbers("os")).drop("os")
    others = blocks(outside, "o", "others", *signs).withColumn("m", numbers("ms")).drop("ms")
    alike = written(members.join(others, [*bucket, "m", "o"]).select(*bucket, "m", "o", "members", "others").mapInArrow(
        compare, "band int, hash bigint, m bigint, o bigint, pairs array<struct<a: bigint, b: bigint>>"), "alike")
    if alike.isEmpty():
        return labels
    members = blocks(signed.join(texts, "v"), "m", "members", "v", "text").drop("os")
    others = blocks(outside.join(texts, "v"), "o", "others", "v", "text").drop("ms")
    wide = alike.join(others, [*bucket, "o"]).join(members, [*bucket, "m"]).select("pairs", "members", "others")
    return _merged(labels, written(wide.mapInArrow(verify, "a bigint, b bigint").distinct(), "links"))


def keep_one(docs: DataFrame, how: Near = Near(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of texts with the columns of ``docs``: that of the smallest id (of rows that
    share it, the one with the smallest text hash; of rows that share both, one)."""
    rows = keyed(docs, id_col, text_col)
    _, _, classes = _text_classes(rows, how)
    chosen = rows.select("id", "tag", "input").dropDuplicates(["id", "tag"]).join(classes.select("first.id", "first.tag"), ["id", "tag"])
    return renewed(chosen, docs, {})


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_classes(keyed(documents(spark, sf_dir))).select(shown_id(), shown_id("class_id").alias("class_id"))
