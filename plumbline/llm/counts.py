"""Token counts of whole texts, without keeping ids.

Texts are encoded in batches of about equal bytes inside an Arrow function that gives back
lengths alone. A long text is split where the tokenizer can build no token across the cut, so
that no call encodes more than a bounded stretch, however long a text is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from plumbline.llm.bytetext import slices, text_bytes
from plumbline.llm.columns import documents, texts
from plumbline.llm.packing import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes that one call of the library encodes, about.
BATCH_BYTES = 1 << 19
#: Characters up to which a text is encoded in one piece.
PIECE_CHARS = 1 << 17

#: A blank or line feed after a visible ASCII character. Byte-level rules and rules that drop white
#: space end a token there, and the blank belongs to what follows.
_BEFORE_BLANK = re.compile(r"(?<=[!-~])(?=[ \n])")
#: A single blank between visible ASCII characters. Where each stretch starts with a word mark of
#: its own, the blank is that mark.
_BLANK = re.compile(r"(?<=[!-~]) (?=[!-~])")


class TokenCounter:
    """Counts as the library of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file does by default: special
    strings inside texts as the library reads them, no added tokens, no truncation, no padding."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            vocabulary = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            apart = model.encode("a", out_type=str)[:1] in (["▁a"], ["▁"]) and all("▁" not in p.lstrip("▁") for p in vocabulary)
            self.cut = _BLANK if apart else None
            self._lengths: Callable[[list[str]], list[int]] = lambda batch: [
                len(x) for x in model.encode(batch, num_threads=1, add_bos=False, add_eos=False)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.cut = _BEFORE_BLANK if _splits_before_blanks(json.loads(model.to_str())) else None
            self._lengths = lambda batch: [len(e) for e in model.encode_batch_fast(batch, add_special_tokens=False)]

    def pieces(self, text: str, most: int) -> list[str]:
        """The text in stretches of ``most`` characters or a little more, cut at safe places only; whole if there are none."""
        if self.cut is None or len(text) <= most:
            return [text]
        out, at = [], 0
        while len(text) - at > most:
            found = self.cut.search(text, at + most)
            if found is None:
                break
            out.append(text[at:found.start()])
            at = found.end()
        return [*out, text[at:]]

    def count(self, batch: list[str], *, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> np.ndarray:
        """The number of tokens of each text."""
        parts = [(i, p) for i, text in enumerate(batch) for p in self.pieces(text, piece_chars)]
        owners = np.array([i for i, _ in parts], np.int64)
        lengths = np.zeros(len(parts), np.int64)
        for low, high in balanced(np.array([len(p.encode()) for _, p in parts], np.int64), batch_bytes):
            lengths[low:high] = self._lengths([p for _, p in parts[low:high]])
        counts = np.zeros(len(batch), np.int64)
        np.add.at(counts, owners, lengths)
        return counts


def _splits_before_blanks(settings: dict) -> bool:
    """Whether every token ends before a blank that follows a visible character: pre-tokens of the usual
    byte-level rule, or of a pattern whose white space is dropped; no added token that takes blanks in."""
    if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in settings["added_tokens"]):
        return False
    rule = settings["pre_tokenizer"] or {}
    steps = rule.get("pretokenizers", [rule])
    if steps[-1].get("type") != "ByteLevel" or any(s.get("add_prefix_space") for s in steps):
        return False
    if steps[-1]["use_regex"]:
        return len(steps) == 1 and settings["normalizer"] is None
    split = steps[0]
    pattern = split.get("pattern", {}).get("Regex", "")
    return len(steps) == 2 and split.get("behavior") == "Removed" and split.get("invert") and " " not in pattern and r"\s+" not in pattern


def balanced(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about equal sums, each about ``limit`` at most unless one size alone is more."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // limit))
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, n) / n, "left") + 1
    bounds = np.unique(np.concatenate([[0], np.minimum(cuts, len(sizes)), [len(sizes)]]))
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist())


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A missing or empty text has no bytes and no tokens. Repeated rows and missing ids are rows
    like others, other columns are not looked at, an empty table gives no rows. One pass, no
    shuffle; a task holds a stretch of a few megabytes of text at a time, or one long text.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                part = batch.slice(low, high - low)
                counts = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets[low:high + 1])), pa.array(counts), pa.array(counts > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
