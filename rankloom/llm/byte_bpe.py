"""Byte-level BPE by DuckDB recursive queries, one connection per worker.

``encode(docs, ranks_path, pattern)`` gives per row the id column, ``n_tokens``,
``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the bytes that
the ids stand for); ``digests=True`` gives the SHA-256 of both instead, so that
the lists need not leave the worker. ``decode_ids`` turns ids into bytes.

Each match of the pattern is a word. The distinct words that a worker has not
met yet become token-position rows, one byte each; a recursive query joins
neighbours to the merge table, contracts each word's leftmost pair of minimum
rank, and ends when no word has a pair left. Decoding is an ordered aggregation
of the tokens' bytes. Memo and chunk sizes bound the memory of a worker.

A query takes as many rounds as its longest word has contractions, so a word of more
than ``WINDOW`` bytes goes in as windows that overlap by half, equal windows once. Tokens
stand beside each other in an encoding exactly if the encoding of the two together is these
two; so two windows are joined at a token that both have at the same place, and the
result is that of the whole word. Windows of text that repeats may be out of step and
share no token: then the next one starts where a token of the last one does, about its
middle; where that one shares none either (tokens as long as the window) the last one is made
twice as wide, and joined anew. The work for a word thus grows with its length, whatever it repeats.

Defined results: a null text is the empty text (0 tokens, digests of nothing);
repeated rows each get their row; null ids stay null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import tempfile
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, in_small_batches

#: Words that a worker remembers, and their bytes.
MEMO, MEMO_BYTES = 300_000, 32 << 20
CHUNK_CHARS = 1 << 21
WINDOW = 64
#: The squares of the lengths of the words of one query add up to so many at most (or it has one word): they bound its rows.
QUERY_ROWS = 1 << 20

#: start: (word, pos, nxt, tok), nxt the position of the word's next token or -1; each
#: round keeps the rows of words that had a pair. key is a * 2^32 + b, best is
#: rank * 2^32 + pos: its minimum is the leftmost pair of minimum rank.
ENCODE = """
with recursive steps(word, round, pos, nxt, tok) as (
    select word, 0, pos, nxt, tok from start
  union all
    select p.word, p.round + 1, p.pos,
           case when p.pos = c.pos then c.after else p.nxt end,
           case when p.pos = c.pos then c.best // 4294967296 else p.tok end
    from steps p join (
        select word, min(best) as best, arg_min(pos, best) as pos, arg_min(gone, best) as gone, arg_min(after, best) as after
        from (select n.word, n.pos, n.nxt as gone, x.nxt as after, m.rank * 4294967296 + n.pos as best
              from steps n join steps x on x.pos = n.nxt join merges m on m.key = n.tok * 4294967296 + x.tok)
        group by word
    ) c on c.word = p.word
    where p.pos <> c.gone
)
select s.word, s.pos, s.tok
from steps s join (select word, max(round) as round from steps group by word) l using (word, round)
"""

DECODE = """
select t.word, string_agg(v.hex, '' order by t.pos) as hex
from tokens t join vocabulary v on v.id = t.tok group by t.word order by t.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one ``base64(token) rank`` per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose join is a token: (key, rank); the rank is also the id of the join."""
    rows = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "rank": pa.array([r for _, r in rows], pa.int64())})


@functools.cache
def _engine(ranks_path: str):
    """One connection per worker process, with the merge table and the vocabulary."""
    import duckdb

    ranks = read_ranks(ranks_path)
    spill = os.path.join(tempfile.gettempdir(), f"rankloom-duckdb-{os.getpid()}")
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": spill})
    merges = merge_table(ranks)
    vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "hex": pa.array([t.hex() for t in ranks])})
    con.register("merges_in", merges)
    con.register("vocabulary_in", vocabulary)
    con.execute("create table merges as select * from merges_in")
    con.execute("create table vocabulary as select * from vocabulary_in")
    con.unregister("merges_in")
    con.unregister("vocabulary_in")
    single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(t) for t in ranks]
    return con, ranks, single, size


def _contracted(words: list[bytes], ranks_path: str) -> list[np.ndarray]:
    """The ids of each word, by the recursive query."""
    con, _, single, _ = _engine(ranks_path)
    out: list[np.ndarray] = []
    rows = np.cumsum([len(w) ** 2 for w in words])
    while len(out) < len(words):
        done = len(out)
        upto = max(done + 1, int(np.searchsorted(rows, (rows[done - 1] if done else 0) + QUERY_ROWS, "right")))
        part = words[done:upto]
        size = np.array([len(w) for w in part], dtype=np.int64)
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        following = np.arange(1, len(data) + 1, dtype=np.int64)
        following[np.cumsum(size) - 1] = -1
        con.register("start", pa.table({"word": np.repeat(np.arange(len(part)), size), "pos": np.arange(len(data), dtype=np.int64), "nxt": following, "tok": single[data]}))
        found = con.execute(ENCODE).fetchnumpy()
        con.unregister("start")
        order = np.argsort(found["pos"])
        word, ids = np.asarray(found["word"], dtype=np.int64)[order], np.asarray(found["tok"], dtype=np.int64)[order]
        out += np.split(ids, np.searchsorted(word, np.arange(1, len(part))))
    return out


@dataclass
class _Window:
    """Part of a word with its ids and their places, of which those from ``low`` up to ``high`` are the word's."""

    start: int
    width: int
    ids: np.ndarray
    at: np.ndarray
    low: int = 0
    high: int | None = None

    def joined(self, other: _Window) -> bool:
        """Whether the two have a token in common at one place; from the first such one on the word's ids are the other's."""
        _, a, b = np.intersect1d(self.at[self.low :], other.at, assume_unique=True, return_indices=True)
        same = np.flatnonzero(self.ids[self.low :][a] == other.ids[b])
        if len(same):
            self.high, other.low = int(a[same[0]]) + self.low, int(b[same[0]])
        return len(same) > 0


def _starts(word: bytes) -> range:
    return range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2)


def _walk(word: bytes, known: dict[bytes, np.ndarray], size: np.ndarray) -> Generator[bytes, None, np.ndarray]:
    """The ids of a word from those of its windows; yields windows whose ids it has yet to know."""

    def window(start: int, width: int) -> Generator[bytes, None, _Window]:
        piece = word[start : start + width]
        if piece not in known:
            yield piece
        ids = known[piece]
        return _Window(start, width, ids, np.cumsum(size[ids]) - size[ids] + start)

    chain, step = [(yield from window(0, WINDOW))], WINDOW // 2
    while (end := chain[-1].start + chain[-1].width) < len(word):
        last = chain[-1]
        own = int(last.at[last.low :][np.searchsorted(last.at[last.low :], (last.start + end) // 2) - 1])  # a token of the last window, about its middle
        ahead = [(s, WINDOW) for s in range((end - 1) // step * step, last.start, -step) if s + WINDOW > end and word[s : s + WINDOW] in known]
        here = [(own, max(WINDOW, last.width))] if own > last.start else []
        for start, width in [*here, *ahead] if last.width > WINDOW else [*ahead, *here]:
            following = yield from window(start, width)
            if last.joined(following):
                chain.append(following)
                break
        else:  # a wider last window, and where that does not fit what is before it, one in place of both
            wider = 2 * last.width
            while True:
                last = chain.pop()
                last = yield from window(last.start, max(wider, end + WINDOW - last.start))
                if not chain or chain[-1].joined(last):
                    chain.append(last)
                    break
    return np.concatenate([x.ids[x.low : x.high] for x in chain])


def encode_words(words: list[bytes], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, how many each word has)."""
    _, ranks, _, size = _engine(ranks_path)
    out = [np.array([ranks[w]]) if w in ranks else np.zeros(0, np.int64) for w in words]
    rest = [i for i, w in enumerate(words) if w and w not in ranks]
    wanted = dict.fromkeys(words[i][k : k + WINDOW] if len(words[i]) > WINDOW else words[i] for i in rest for k in _starts(words[i]))
    known: dict[bytes, np.ndarray] = {}
    walks = {i: _walk(words[i], known, size) for i in rest if len(words[i]) > WINDOW}
    while wanted:
        known.update(zip(wanted, _contracted(list(wanted), ranks_path), strict=True))
        wanted = {}
        for i in list(walks):  # each as far as it comes
            try:
                wanted[next(walks[i])] = None
            except StopIteration as done:
                out[i] = done.value
                del walks[i]
    for i in rest:
        if len(words[i]) <= WINDOW:
            out[i] = known[words[i]]
    return np.concatenate([np.zeros(0, np.int64), *out]).astype(np.uint32), np.array([len(x) for x in out], np.int64)


def decode_words(ids: np.ndarray, counts: np.ndarray, ranks_path: str) -> list[bytes]:
    """The bytes of each run of ids, by an ordered aggregation."""
    con, *_ = _engine(ranks_path)
    out = [b""] * len(counts)
    word = np.repeat(np.arange(len(counts)), counts)
    con.register("tokens", pa.table({"word": word, "pos": np.arange(len(ids), dtype=np.int64), "tok": ids.astype(np.int64)}))
    for w, text in con.execute(DECODE).fetchall():
        out[w] = bytes.fromhex(text)
    con.unregister("tokens")
    return out


class _Codes(dict):
    """A number for each word, in the order they come up."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class _Memo:
    """Ids and bytes of the words met so far; emptied when it holds too many."""

    def __init__(self, ranks_path: str, pattern: str, most: int):
        import regex

        self.path, self.find, self.most = ranks_path, regex.compile(pattern).findall, most
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids, self.size, self.bytes, self.held = _Codes(), np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, the ids as bytes, what they decode to) of each text."""
        if len(self.codes) > self.most or self.held > MEMO_BYTES:
            self.clear()
        get, had = self.codes.__getitem__, len(self.codes)
        found = [np.fromiter(map(get, self.find(x)), np.int64) for x in texts]
        new = [w.encode("utf-8") for w in list(self.codes)[had:]]
        if new:
            self.held += sum(map(len, new))
            ids, size = encode_words(new, self.path)
            self.bytes += decode_words(ids, size, self.path)
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        first = np.cumsum(self.size) - self.size
        out = []
        for codes in found:
            size = self.size[codes]
            total = int(size.sum())
            at = np.arange(total) + np.repeat(first[codes] - (np.cumsum(size) - size), size)
            out.append((total, self.ids[at].astype("<u4").tobytes(), b"".join(map(self.bytes.__getitem__, codes.tolist()))))
        return out


def _chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", digests: bool = False, memo: int = MEMO) -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, and ids and decoded bytes or their digests."""
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kind = T.StringType() if digests else T.BinaryType()
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, kind) for n in names)])
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or _Memo(ranks_path, pattern, memo)
            count, a, b, at = [], [], [], 0
            for texts in _chunks(batch.column(1).to_pylist(), CHUNK_CHARS):
                for n, ids, data in held.encode(texts):
                    count.append(n)
                    a.append(hexed(ids) if digests else ids)
                    b.append(hexed(data) if digests else data)
                if not digests:
                    yield _rows(batch.column(0).slice(at, len(count)), count, a, b, digests, id_column, names)
                    at, count, a, b = at + len(count), [], [], []
            if digests and count:
                yield _rows(batch.column(0), count, a, b, digests, id_column, names)

    return in_small_batches(docs.select(docs[id_column], F.coalesce(docs[text_column], F.lit("")).alias("text"))).mapInArrow(freeing(run), schema)


def _rows(ids, count, a, b, digests, id_column, names) -> pa.RecordBatch:
    kind = pa.string() if digests else pa.binary()
    return pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(a, kind), pa.array(b, kind)], names=[id_column, "n_tokens", *names])


def decode_ids(ids: list[list[int]], ranks_path: str) -> list[bytes]:
    """The bytes that each list of ids stands for."""
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
    return decode_words(flat, counts, ranks_path)
