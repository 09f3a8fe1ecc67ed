"""Ranked search, hard negatives and token counts against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.functions import lineage
from plumbline.llm import counts, negatives, ranking
from plumbline.llm.packing import tokenizer_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def text(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in np.minimum(draw.zipf(1.3, n), 400))


def brute_ranking(docs, items, k=10):
    held = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(h.values()) for h in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for h in held for w in h)
    out = []
    for item, t in items:
        query = Counter(TERM.findall((t or "").translate(LOWER)))
        scored = []
        for (i, _), h, n in zip(docs, held, sizes):
            score = 0
            for w, times in query.items():
                if w in h:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += times * weight * (1_000_000_000 * h[w] // (1000 * h[w] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


DOCS = ([(i, text(i, 5 + i % 90)) for i in range(400)] + [(500 + i, text(7, 60)) for i in range(30)] + [(600, None), (601, ""), (602, " .,;! "), (None, text(8, 20)),
        (None, text(9, 20)), (603, "Straße ÄÖ ß é W1 w1 W2"), (604, text(3, 30_000)), (7, text(7, 12)), (7, text(7, 12))])
ITEMS = [(i, text(i * 3, 12)) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere unknown"), (None, "w3 w9 w9"), (53, "STRASSE straße ß"), (1, text(3, 12)), (54, "w1 " * 200 + text(11, 300))]


@pytest.mark.parametrize("how", [ranking.Scoring(), ranking.Scoring(block=3, shard_docs=64), ranking.Scoring(block=20, query_bytes=300, shard_bytes=2000)])
def test_ranking(spark, how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id bigint, text string, item string, score int").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, id int")
    got = [tuple(r) for r in ranking.rank(docs, items, how).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_ranking(DOCS, ITEMS)))
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ranking.rank(none, items, how).count() == 0
    assert ranking.rank(docs, items.where("item_id < 0"), how).count() == 0
    assert ranking.rank(docs.where("doc_id = 601"), items, how).count() == 0


def test_no_row_between_steps_is_larger_than_a_document(spark, monkeypatch, tmp_path):
    for module in (ranking, lineage):
        monkeypatch.setattr(module, "scratch_path", lambda _, name: str(tmp_path / name), raising=False)
    docs = spark.createDataFrame([(i, text(i, 20)) for i in range(2000)], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranking.rank(docs, items).count() > 100
    parts = list(tmp_path.rglob("*.parquet"))
    assert parts
    for part in parts:
        table = pq.read_table(part)
        assert max((sum(len(v) for v in row.values() if isinstance(v, bytes)) for row in table.to_pylist()), default=0) <= 8 * 20


def test_shards_are_cut_where_they_are_full():
    held = [1, 0, 4, 2, 9, 1, 1, 1, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(held)])
    numbers = ranking._binaries(np.arange(bounds[-1]), bounds)
    whole = pa.RecordBatch.from_arrays([pa.array(range(10)), numbers], names=["id", "terms"])
    for cuts in ([0, 10], [0, 3, 3, 4, 10]):
        batches = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        for how in (ranking.Scoring(), ranking.Scoring(shard_docs=3), ranking.Scoring(shard_bytes=40), ranking.Scoring(shard_docs=2, shard_bytes=8)):
            shards = list(ranking._shards(iter(batches), how))
            assert [i for s in shards for i in s.column("id").to_pylist()] == list(range(10))
            assert np.concatenate([ranking._numbers(s.column("terms"))[0] for s in shards]).tolist() == list(range(22))
            for s in shards:
                sizes = np.diff(ranking._numbers(s.column("terms"))[1])
                assert len(sizes) <= how.shard_docs and 8 * (sizes.sum() - sizes[-1]) <= how.shard_bytes


def test_blocks_are_skipped_and_bound_their_documents():
    draw = np.random.default_rng(1)
    docs = [np.unique(draw.integers(40 * (i % 5), 40 * (i % 5) + 60, 30)) for i in range(300)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    words, values = np.concatenate(docs).astype(np.uint32), draw.integers(1, 1000, bounds[-1]).astype(np.uint32)
    index = ranking.blocked(np.arange(300), bounds, words, values, 260, 8, 16)
    for t in range(260):
        first, last = index["blocks"][t], index["blocks"][t + 1]
        edges = np.append(index["starts"][first:last], index["lists"][t + 1])
        members = index["members"][index["lists"][t]:index["lists"][t + 1]]
        assert set(members) == {d for d, own in enumerate(docs) if t in own}
        for b in range(last - first):
            own = index["members"][edges[b]:edges[b + 1]]
            expected = {}
            for d in own:
                for w, v in zip(docs[d], values[bounds[d]:bounds[d + 1]]):
                    expected[w] = max(expected.get(w, 0), v)
            at = slice(index["sum_bounds"][first + b], index["sum_bounds"][first + b + 1])
            assert dict(zip(index["sum_terms"][at], index["sum_values"][at])) == expected
    top = ranking._Top(3)
    weights = draw.integers(1, 100, 260)
    query = np.array([3, 50, 90])
    skipped = ranking.search_shard(index, weights, [(query, np.ones(3, np.int64))], [top])
    scores = [(-sum(int(weights[w]) * int(v) for w, v in zip(d, values[bounds[i]:bounds[i + 1]]) if w in query), i) for i, d in enumerate(docs)]
    assert skipped and [(-s, i) for s, i in zip(top.scores, top.ids)] == sorted(scores)[:3]


def brute_negatives(rows, positives=5, count=3):
    out = []
    for a, (i, label, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, b, j, m) for b, (j, m, w, _) in enumerate(rows) if b != a]
        for s, _, _, _, p, _ in sorted(x for x in scored if x[5] == label)[:positives]:
            good = sorted(x for x in scored if x[5] != label and -50 * s <= -100 * x[0] <= -95 * s)[:count]
            out += [(i, p, r + 1, x[4], -s, -x[0]) for r, x in enumerate(good)]
    return out


@pytest.mark.parametrize("scale", [1, 300, 100_000])
def test_hard_negatives(spark, scale):
    draw = np.random.default_rng(scale)
    vectors = (draw.normal(size=(260, 6)) * 40 * scale).astype(int)
    rows = [(i, i % 4, vectors[i].tolist(), i % 20 == 0) for i in range(260)]
    rows += [(300 + i, i % 4, vectors[3].tolist(), False) for i in range(40)]  # ties
    rows += [(40, 0, vectors[40].tolist(), True), (None, 1, vectors[5].tolist(), False), (None, 2, vectors[20].tolist(), True),
             (400, 1, vectors[0][:3].tolist(), True), (401, 3, [], True), (402, 9, vectors[2].tolist(), True)]
    data = spark.createDataFrame(rows, "id bigint, label int, vector array<bigint>, anchor boolean").coalesce(1)
    small = negatives.Mining(block_rows=37, block_anchors=5, task_rows=90, batch_bytes=500)
    for how in (negatives.Mining(), small):
        got = Counter(tuple(r) for r in negatives.mine(data, how).collect())
        assert got == Counter(brute_negatives(rows)) and len(got) > 30
    assert negatives.mine(data.where("id < 0")).count() == 0 and negatives.mine(data.where("not anchor")).count() == 0
    with pytest.raises(ValueError, match="2 \\*\\* 55"):
        negatives.mine(data.withColumn("vector", F.transform("vector", lambda x: x + 2**40)))


@pytest.mark.parametrize("depth, largest", [(1, 3), (64, 300), (700, 2**20), (257, 2**23)])
def test_residue_products_are_exact(depth, largest):
    draw = np.random.default_rng(depth)
    a, b = draw.integers(-largest, largest + 1, (20, depth)), draw.integers(-largest, largest + 1, (30, depth))
    a[0], b[0], a[1] = largest, largest, -largest  # the extremes of the range
    primes = negatives.primes_for(depth * largest**2)
    assert (negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes) == a @ b.T).all()
    assert max(primes) <= 509 and (max(primes) // 2) ** 2 * negatives.DEPTH < 2**24


def test_quantised_rows(spark):
    rows = [(1, [0.5, -0.001], 3), (2, None, 1), (3, [0.1, None], 1), (4, [float("nan")], 1), (5, [float("inf")], 1), (6, [1.0], None), (None, [], 2)]
    got = negatives.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in got] == [(1, 3, [128, -1]), (None, 2, [])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    draw = np.random.default_rng(2)
    parts = ["a", "Word ", " ", "\n", "<|endoftext|>", "<s>", "é", "\t", "don't ", "12", "  \n", "\U0001F600 ", "é ", "x y z"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 60))) for _ in range(300)] + [None, "", " ", text(1, 60_000), "x" * 3000, " " * 3000]
    rows = [(i if i % 11 else None, t, 1) for i, t in enumerate(texts)]
    data = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, n_tokens int").repartition(3)
    path = tokenizer_path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        whole = SentencePieceProcessor(model_file=path)
        count = lambda t: len(whole.encode(t))
    else:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    expected = Counter((i, len((t or "").encode()), n := count(t or ""), n > 512) for i, t, _ in rows + rows[:3])
    got = counts.count_tokens(data, tokenizer=path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and Counter(map(tuple, got.collect())) == expected
    assert counts.count_tokens(data.where("doc_id < 0"), tokenizer=path).count() == 0
    counter = counts.TokenCounter(path)
    assert counter.cut is not None and len(counter.pieces(text(1, 5000), 100)) > 50
    for most in (3, 40):  # cuts at every safe place, calls of every size
        assert counter.count([t or "" for t in texts], piece_chars=most, batch_bytes=200).tolist() == [count(t or "") for t in texts]


def test_balanced_batches():
    sizes = np.array([5, 5, 5, 100, 1, 1, 1, 30, 0, 0])
    ranges = list(counts.balanced(sizes, 40))
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[0][0] == 0 and ranges[-1][1] == len(sizes)
    assert max(sizes[a:b].sum() for a, b in ranges) <= 140 and list(counts.balanced(sizes[:0], 40)) == []
