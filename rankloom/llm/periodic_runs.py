"""Periodic runs of words: seed-and-extend along the diagonals of a document with itself.

``periodic_runs(docs)`` adds to every row

* ``n_words``, and ``runs``: array of (start, length, period), by start, then period. A run is a
  stretch of consecutive words whose smallest period is ``period`` (words that far apart
  are identical), of at least ``max(MIN_LENGTH, 2 * period)`` words, that no neighbouring
  word extends;
* ``collapsed``: the words, joined by one space, without those that a run repeats: all
  that any run contains after its first ``period`` words.

How. A run of period q shows as a stretch of matches at lag q (word i equals word i + q),
at least ``max(MIN_LENGTH - q, q)`` long. Lags fall into bands, each with the shortest
stretch that it guarantees; a band's seeds are k-grams of about half that, taken at
every place of a stride that no such stretch can pass between. The k-grams of a document
are indexed by prefix doubling, which keeps only those that occur again, so prose is
done after two rounds. A seed and every later occurrence of its k-gram within the
band's lags is a pair; it is extended both ways along its lag, unless the table of the
furthest place covered at that lag says that an earlier one has reached it, or both
lie in one run of a period that divides the lag (a stretch with a smaller period is
known by that). A band has at most two pairs or so for each word, however periodic the
text is, so the work for a document of n words is about n log n, and memory is a few numbers for
each word. Documents are rows: nothing is shuffled.

Defined results: a null, empty or blank text has no words, no runs and an empty
``collapsed``; repeated rows each get theirs; ids are not read; other columns are
handed on, but for those named like a new one, which are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, in_small_batches

MIN_LENGTH = 12
#: Seeds whose pairs are laid out at once.
SEEDS = 1 << 16

RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
NEW = [T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)]


def bands(n: int, shortest: int = MIN_LENGTH) -> list[tuple[int, int, int, int]]:
    """(k, stride, least lag, greatest lag) of each band for a text of n words: any stretch of matches that a run
    of one of these lags must have holds a k-gram that starts at a multiple of the stride."""
    out, low, k = [], 1, 2
    while low <= n // 2:
        while True:  # the band's lags reach up to 4k - 1; the shortest stretch that its runs have must hold a seed
            high = 4 * k - 1
            least = min(max(shortest - q, q) for q in {low, high, *range(low, min(high, shortest) + 1)})
            if 2 * k > least or 4 * k - 1 >= shortest:
                break
            k *= 2
        out.append((k, least - k + 1, low, min(high, n // 2)))
        low, k = high + 1, 2 * k
    return out


class _Grams:
    """Occurrences of the k-grams that occur more than once, for k = 1, 2, 4, ... in turn."""

    def __init__(self, ids: np.ndarray):
        self.n, self.k = len(ids), 1
        self.kind = np.full(self.n, -1, np.int64)  # the k-gram at a place, -1 where it occurs once
        self._keep(np.arange(self.n), ids)

    def _keep(self, places: np.ndarray, names: np.ndarray) -> None:
        order = np.argsort(names, kind="stable")
        places, names = places[order], names[order]
        first = np.concatenate([[True], names[1:] != names[:-1]]) if len(names) else np.zeros(0, bool)
        numbers = np.cumsum(first) - 1
        again = np.bincount(numbers, minlength=1)[numbers] > 1
        self.places, self.names = places[again], numbers[again]  # by k-gram, then place
        self.kind[:] = -1
        self.kind[self.places] = self.names

    def doubled(self) -> bool:
        """From k to 2k; False where no k-gram is left."""
        there = np.sort(self.places[self.places + self.k < self.n])
        there = there[self.kind[there + self.k] >= 0]
        names = self.kind[there] * (self.n + 1) + self.kind[there + self.k]
        self.k *= 2
        self._keep(there, names)
        return len(self.places) > 0

    def pairs(self, stride: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lags, places) of seeds at multiples of the stride and later occurrences, by lag, then place, a part of the seeds at a time."""
        keys = self.names * (self.n + 1) + self.places
        at = np.flatnonzero(self.kind[::stride] >= 0) * stride
        for k in range(0, len(at), SEEDS):
            seeds = at[k : k + SEEDS]
            base = self.kind[seeds] * (self.n + 1)
            first = np.searchsorted(keys, base + np.minimum(seeds + low, self.n))
            after = np.searchsorted(keys, base + np.minimum(seeds + high, self.n), "right")
            many = after - first
            seeds = np.repeat(seeds, many)
            other = self.places[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]
            order = np.lexsort((seeds, other - seeds))
            yield (other - seeds)[order], seeds[order]


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements agree from the start, looked at in growing pieces."""
    done, step, n = 0, 32, min(len(a), len(b))
    while done < n:
        differ = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + len(differ), 2 * step
    return n


def runs_of(ids: np.ndarray, shortest: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers."""
    n = len(ids)
    if n < shortest:
        return []
    grams, found = _Grams(ids), {}
    furthest: dict[int, int] = {}  # per lag: where the last stretch of matches ended
    reach, by = np.zeros(n, np.int64), np.ones(n, np.int64)  # per place: the end of the run that reaches furthest, its period
    for k, stride, low, high in bands(n, shortest):
        while grams.k < k:
            if not grams.doubled():
                return _listed(found)
        for lags, places in grams.pairs(stride, low, high):
            # both in a run whose period divides the lag: known
            open_ = (reach[places] < places + lags + k) | (lags % by[places] != 0)
            for q, i in zip(lags[open_].tolist(), places[open_].tolist(), strict=True):
                if i < furthest.get(q, 0) or (q % by[i] == 0 and reach[i] >= i + q + k):
                    continue
                end = i + k + _first_difference(ids[i + k :], ids[i + q + k :])
                start = i - _first_difference(ids[:i][::-1], ids[q : i + q][::-1])
                furthest[q] = end
                if end - start >= max(shortest - q, q):
                    found[start, end + q] = min(q, found.get((start, end + q), q))
                    further = reach[start : end + q] < end + q
                    reach[start : end + q][further] = end + q
                    by[start : end + q][further] = q
    return _listed(found)


def _listed(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run repeats."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _row(text: str | None, shortest: int) -> tuple[int, list[tuple[int, int, int]], str]:
    words = (text or "").encode("utf-8").split()  # of bytes: at space, tab, line feed, vertical tab, form feed, carriage return
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = runs_of(ids, shortest) if len(numbers) < len(words) else []
    if runs:
        words = [words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()]
    return len(ids), runs, b" ".join(words).decode("utf-8")


def periodic_runs(docs: DataFrame, *, text_column: str = "text", shortest: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with n_words, runs and collapsed (see above)."""
    if shortest < 3:
        raise ValueError("runs of two words hold no seed")
    new = [f.name.lower() for f in NEW]
    rest = [c for c in docs.columns if c.lower() not in new]
    plain = [f"c{k}" for k in range(len(rest))]  # by place: names of the input are its own
    given = docs.select(*(docs[f"`{c}`"].alias(p) for c, p in zip(rest, plain, strict=True)), docs[f"`{text_column}`"].alias("read"))
    schema = T.StructType([*(T.StructField(p, docs.schema[c].dataType) for c, p in zip(rest, plain, strict=True)), *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in RUN.names]))
        for batch in batches:
            rows = [_row(x.as_py(), shortest) for x in batch.column(len(rest))]
            new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[dict(zip(RUN.names, x, strict=True)) for x in r[1]] for r in rows], kind), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], names=[*plain, *(f.name for f in NEW)])

    found = in_small_batches(given).mapInArrow(freeing(run), schema)
    return found.select(*(F.col(p).alias(c) for c, p in zip(rest, plain, strict=True)), *(f.name for f in NEW))


def top_run(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then period; null without runs."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
