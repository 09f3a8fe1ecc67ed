"""Secret scanning: fixed shapes, and tokens that a Markov model of random strings explains
better than one of ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.bytetext import runs, text_bytes
from plumbline.llm.columns import documents, texts

#: The base kinds in their order and their shapes.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MARKOV = "markov"
_ORDER = {k: i for i, k in enumerate((*KINDS, MARKOV))}

#: The characters of tokens; everything else is one boundary symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_A = len(ALPHABET) + 1
_CODE = np.full(256, _A - 1, np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_A - 1)
_TOKEN = _CODE < _A - 1
_HEX = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdef"])

RANDOM, ORDINARY = 1, 0
_BACKOFF = 20


@dataclass(frozen=True)
class Thresholds:
    """A token of ``least_chars`` or more characters is a secret if the log-likelihood ratio
    is at least ``total`` in all and ``per_char`` for each of its pairs."""

    least_chars: int = 16
    total: float = 25.0
    per_char: float = 2.5


def generated(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled random strings: ``n`` each over common key alphabets, 16 to 64 characters."""
    draw = np.random.default_rng(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    out = []
    for letters in ("0123456789abcdef", upper + "234567", lower + digits, lower + upper + digits, ALPHABET[:64], lower + upper + digits + "-_"):
        table = np.array(list(letters))
        out += ["".join(table[draw.integers(0, len(table), size)]) for size in draw.integers(16, 65, n)]
    return out


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind order, end)`` of the fixed shapes in code points."""
    spans = [(s, 2, e) for s, e in hex_runs]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    return sorted(spans)


def _rows(batch: pa.RecordBatch, least: int) -> Iterator[tuple[int, str | None, np.ndarray, list, list]]:
    """Per row: its number, its text (None where nothing can be found), its bytes, and the
    hex runs and token runs in code points."""
    column = batch.column("text")
    data, offsets = text_bytes(column)
    found: dict[int, tuple[list, list]] = {}
    for which, (mask, size) in enumerate(((_HEX, LEAST["hex"]), (_TOKEN, least))):
        starts, ends = runs(mask[data], offsets)
        long = ends - starts >= size
        for row, s, e in zip(np.searchsorted(offsets, starts[long], "right") - 1, starts[long], ends[long]):
            found.setdefault(int(row), ([], []))[which].append((int(s - offsets[row]), int(e - offsets[row])))
    for row in range(len(column)):
        raw = data[offsets[row]:offsets[row + 1]]
        hexes, tokens = found.get(row, ([], []))
        if hexes or tokens:
            places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
            hexes, tokens = ([(int(places[s]), int(places[e])) for s, e in x] for x in (hexes, tokens))
        yield row, column[row].as_py() or "", raw, hexes, tokens


def identifiers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text strung together as in programs: snake_case and CamelCase."""
    snake, camel = raw.copy(), raw.copy()
    snake[snake == 32] = ord("_")
    begins = np.flatnonzero((raw[1:] >= 97) & (raw[1:] <= 122) & (raw[:-1] == 32)) + 1
    camel[begins] -= 32
    return snake, camel[camel != 32]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _A * _A), np.int64)

    def add(label: int, raw: np.ndarray) -> None:
        codes = _CODE[raw].astype(np.int32)
        if len(codes) > 1:
            counts[label] += np.bincount(codes[:-1] * _A + codes[1:], minlength=_A * _A)

    for batch in batches:
        for _, text, raw, hexes, _ in _rows(batch, 16):
            spans = base_spans(text, hexes)
            if spans:
                chars = list(text)
                for start, kind, end in spans:
                    value = ASSIGN.match(text, start)[1] if kind == 0 else text[start:end]
                    add(RANDOM, np.frombuffer(value.encode(), np.uint8))
                    chars[start:end] = " " * (end - start)
                raw = np.frombuffer("".join(chars).encode(), np.uint8)
            for form in (raw, *identifiers(raw)):
                add(ORDINARY, form)
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], names=["label", "pair", "n"])


def train(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of each pair of characters, random over ordinary.

    Labelled samples: values of the fixed shapes in all texts and generated strings are
    random; everything else in all texts, as it stands and strung together to identifiers, is
    ordinary. Counts are summed by Spark; what
    reaches the driver is bounded by the square of the alphabet. Both models fall back on how
    frequent single characters are, by the weight of ``_BACKOFF`` pairs, and are defined on
    an empty table too.
    """
    counted = texts(docs).select("text").mapInArrow(_count, "label int, pair int, n bigint").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, _A * _A))
    for row in counted.collect():
        counts[row.label, row.pair] += row.n
    for value in generated():
        codes = _CODE[np.frombuffer(value.encode(), np.uint8)].astype(np.int32)
        counts[RANDOM] += np.bincount(codes[:-1] * _A + codes[1:], minlength=_A * _A)
    tables = counts.reshape(2, _A, _A)[:, :, :_A - 1]  # inside a token: the next symbol is no boundary
    single = tables.sum(axis=1, keepdims=True) + 1
    tables = tables + _BACKOFF * single / single.sum(axis=2, keepdims=True)
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    return logs[RANDOM] - logs[ORDINARY]


_SPANS = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, ratios: np.ndarray | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points; end exclusive) for every row,
    ordered by start, then kind. A missing or empty text has none; repeated rows and missing
    ids are rows like others. Markov spans never overlap base spans.

    The model is trained on ``docs`` if no ``ratios`` are given.
    """
    ratios = train(docs) if ratios is None else ratios
    names = (*KINDS, MARKOV)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text, _, hexes, tokens in _rows(batch, limits.least_chars):
                spans = base_spans(text, hexes)
                for start, end in tokens:
                    if any(s < end and start < e for s, _, e in spans):
                        continue
                    codes = _CODE[np.frombuffer(text[start:end].encode(), np.uint8)]
                    score = ratios[codes[:-1], codes[1:]].sum()
                    if score >= limits.total and score >= limits.per_char * (end - start - 1):
                        spans.append((start, _ORDER[MARKOV], end))
                out.append([{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPAN_TYPE)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, _SPANS)


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    base = F.filter("spans", lambda x: x.kind != MARKOV)
    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
