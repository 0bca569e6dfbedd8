"""Token counts: batch encoding in Arrow functions that return lengths only.

``token_counts(docs, path)`` gives one row per input row: the id column,
``n_bytes`` (UTF-8) and ``n_tokens`` (no begin, end or added special tokens; a
special string inside a text is one token, which is the library's default).

Texts are cut at boundaries no token can cross, so long texts become many
pieces. A piece that the worker has counted before is not encoded again; the
others go to the tokenizer in batches of about ``batch_bytes`` bytes each, and
only lengths come back. The memo is bounded by ``memo`` pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty
table gives an empty result; repeated rows each get their row; null ids stay
null; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches

#: Before a lone space between two non-blank characters, byte-level pre-tokenizers
#: always end a match: only the start of a match may be a space.
SAFE = re.compile(r"(?<=\S)(?= \S)")
BATCH_BYTES = 1 << 18
#: Pieces that a worker remembers, and their characters.
MEMO, MEMO_CHARS = 300_000, 32 << 20


@functools.cache
def _encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of a batch of texts, whether texts may be cut at SAFE)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (a["lstrip"] or a["rstrip"] or " " in a["content"]) for a in spec.get("added_tokens") or [])
    cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cuts


def _by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about equal bytes; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


class _Counter:
    """Lengths of pieces, by a memo of bounded size."""

    def __init__(self, path: str, batch_bytes: int, memo: int):
        self.lengths_of, self.cuts = _encoder(path)
        self.batch_bytes, self.most, self.memo, self.held = batch_bytes, memo, {}, 0

    def _learn(self, pieces: list[str]) -> None:
        self.held += sum(map(len, pieces))
        for run in _by_bytes(pieces, self.batch_bytes):
            self.memo.update(zip(run, self.lengths_of(run), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        if not self.cuts:
            out: list[int] = []
            for run in _by_bytes(texts, self.batch_bytes):
                out += self.lengths_of(run)
            return np.array(out, dtype=np.int64)
        out = []
        for run in _by_bytes(texts, 16 * self.batch_bytes):
            cut = [SAFE.split(x) for x in run]
            new = list({p for pieces in cut for p in pieces}.difference(self.memo))
            if len(self.memo) + len(new) > self.most or self.held > MEMO_CHARS:
                self.memo.clear()
                self.held = 0
                new = list({p for pieces in cut for p in pieces})
            self._learn(new)
            get = self.memo.__getitem__
            out += [sum(map(get, pieces)) for pieces in cut]
        return np.array(out, dtype=np.int64)


def token_counts(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES, memo: int = MEMO) -> DataFrame:
    """Per row of ``docs``: the id, n_bytes, n_tokens by the tokenizer file at ``path``."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or _Counter(path, batch_bytes, memo)
            counts = counter.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(docs[id_column], F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return in_small_batches(rows).mapInArrow(run, schema)
