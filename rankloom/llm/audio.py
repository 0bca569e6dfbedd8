"""Media columns: chroma audio fingerprints, and alignment of recordings by them.

``fingerprints`` turns a column of recordings (bare PCM, 16 bit, mono, at ``rate``; or WAV, PCM of 8
to 32 bits or floats, of any rate and number of channels, which are brought to it)
into arrays of 32-bit integers. A recording is read in pieces: beside its bytes a worker holds
some 300 bytes for each frame of it. Short-time spectra are folded into twelve pitch
classes per frame; an integral image over frames and classes gives the sum of any
rectangle in four look-ups; sixteen rectangle filters, each quantised to two bits
in Gray code, make the integer of a frame.

``align`` searches every query recording among all: queries and recordings are cut
into blocks of at most ``QUERIES`` and ``RECORDINGS``, and each pair of blocks meets in
one task. There the integers of the recordings are sorted once, those of a query are
looked up among them, a histogram of offsets is taken for each recording with at least
``LEAST_HITS`` equal integers, and the bit errors at its peak say whether the two align.
No candidates are chosen beforehand, so no pair is lost. One row per query and block of
recordings leaves: the number of recordings that align and the best of them. No list of
pairs is made. The look-ups grow with queries times blocks, the rest with the number of
equal integers.

``search`` does the same for clips that are not among the recordings; ``clips`` makes
such, cut, quieter and noisy, from recordings. ``melodies`` renders a column of numeric
vectors as recordings, a note for each component, for tables that hold no audio.

Defined results: a recording that is null, empty, shorter than one filter, or a WAV file of
another format (compressed, damaged) has an empty fingerprint and aligns with nothing; in ``align`` a recording does not match
itself (rows of the same id count as itself), in ``search`` ids of clips and recordings
have nothing to do with each other; of equal errors the longer overlap, then
the smaller id is best; null ids are no queries; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

RATE = 4096
#: Samples of a frame, and between frames: a clip that starts between two is at most half a hop away from one.
FRAME, HOP = 512, 128
CLASSES = 12
FILTERS = 16
#: Frames that the widest filter spans.
SPAN = 32
#: Between the quantiser's steps, in natural log of a ratio.
STEP = 0.25
LEAST_HITS = 2
MOST_ERROR = 0.2
LEAST_OVERLAP = 32
#: Recordings and queries of a task.
RECORDINGS = 4096
QUERIES = 4096
#: Equal integers and cells of histograms that are held at a time.
HITS = 1 << 22
CLIPS = 64
#: Samples of a piece of a recording, and frames whose spectra are held at a time.
PIECE, FRAMES = 1 << 20, 4096
#: WAV formats by kind and bits: how samples are stored, and their full scale over that of 16 bits.
FORMATS = {(1, 8): (np.uint8, 1.0), (1, 16): ("<i2", 1.0), (1, 24): (None, 1 / 256), (1, 32): ("<i4", 1 / 65536), (3, 32): ("<f4", 32768.0), (3, 64): ("<f8", 32768.0)}


# -- fingerprints -------------------------------------------------------------


def _opened(data: bytes | None) -> tuple[np.ndarray, int | None, float]:
    """(frames by channels as they stand, samples a second, the value of full scale over that of 16 bits); no rate where the data is bare 16-bit mono PCM."""
    data = data or b""
    if data[:4] != b"RIFF":
        return np.frombuffer(data, "<i2", len(data) // 2)[:, None], None, 1.0
    at, form = 12, b""
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        if data[at : at + 4] == b"data" and len(form) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if kind == 0xFFFE and len(form) >= 26:  # the kind proper is in the extension
                kind = struct.unpack("<H", form[24:26])[0]
            found = FORMATS.get((kind, bits))
            if not found or not channels or not rate:
                break
            width, body = bits // 8 * channels, memoryview(data)[at + 8 : min(len(data), at + 8 + size)]
            n = len(body) // width
            if bits == 24:
                bytes_ = np.frombuffer(body, np.uint8, n * width).reshape(n, channels, 3)
                return bytes_, rate, 1 / 256
            return np.frombuffer(body, found[0], n * channels).reshape(n, channels), rate, found[1]
        at += 8 + size + size % 2
    return np.zeros((0, 1), np.int16), None, 1.0


def _pieces(data: bytes | None, rate: int) -> Iterator[np.ndarray]:
    """The samples of a recording, channels averaged, at ``rate``, a bounded number at a time.

    A file of another rate is brought to it by means over a sample's width (between samples where it is slower).
    """
    raw, own, scale = _opened(data)

    def mono(first: int, last: int) -> np.ndarray:
        part = raw[first:last]
        if part.ndim == 3:  # 24 bits
            wide = np.zeros((*part.shape[:2], 4), np.uint8)
            wide[..., 1:] = part
            part = wide.view("<i4")[..., 0] / 256
        value = part.astype(np.float32).mean(axis=1)
        return ((value - 128) * 256 if part.dtype == np.uint8 else value * np.float32(scale)).astype(np.float32)

    if own is None or own == rate:
        for at in range(0, len(raw), PIECE):
            yield mono(at, at + PIECE)
        return
    ratio = own / rate
    for at in range(0, int(len(raw) / ratio), PIECE):
        middle = (np.arange(at, min(at + PIECE, int(len(raw) / ratio))) + 0.5) * ratio  # in samples of the file
        half = max(1.0, ratio) / 2
        low, high = np.clip(middle - half, 0, len(raw)), np.clip(middle + half, 0, len(raw))
        first = int(low[0])
        sums = np.concatenate([[0.0], np.cumsum(mono(first, int(np.ceil(high[-1])) + 1), dtype=np.float64)])
        places = np.arange(len(sums), dtype=np.float64)
        yield ((np.interp(high - first, places, sums) - np.interp(low - first, places, sums)) / np.maximum(high - low, 1e-9)).astype(np.float32)


def _pcm(data: bytes | None, rate: int = RATE) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.float32), *_pieces(data, rate)])


def _class_weights(rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes (bins from 100 Hz up)."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), CLASSES), np.float32)
    used = np.flatnonzero(hz >= 100)
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray | Iterator[np.ndarray], rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes, each frame of length one (or zero); of samples, whole or in pieces."""
    weights, window, out, rest = _class_weights(rate), np.hanning(FRAME).astype(np.float32), [np.zeros((0, CLASSES), np.float32)], np.zeros(0, np.float32)
    for piece in [samples] if isinstance(samples, np.ndarray) else samples:
        rest = np.concatenate([rest, piece])
        n = (len(rest) - FRAME) // HOP + 1 if len(rest) >= FRAME else 0
        for k in range(0, n, FRAMES):
            many = min(FRAMES, n - k)
            frames = np.lib.stride_tricks.sliding_window_view(rest[k * HOP : (k + many - 1) * HOP + FRAME], FRAME)[::HOP]
            power = np.abs(np.fft.rfft(frames * window, axis=1)).astype(np.float32) ** 2
            found = np.sqrt(power @ weights)
            out.append(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-6))
        rest = rest[n * HOP :]
    return np.concatenate(out)


def _rectangles() -> list[tuple[int, int, int, int]]:
    """(kind, width in frames, first class, number of classes) of each filter, by rule."""
    return [(k % 4, SPAN // 4 * (1 + k // 4), 5 * k % 7, 4 + k % 2 * 2) for k in range(FILTERS)]


def integers(found: np.ndarray) -> np.ndarray:
    """The packed integers of a chromagram: one per frame from which SPAN frames follow."""
    n = len(found) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(found) + 1, CLASSES + 1))
    image[1:, 1:] = found.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(a: int, b: int, low: int, high: int) -> np.ndarray:
        return image[t + b, high] - image[t + a, high] - image[t + b, low] + image[t + a, low]

    out = np.zeros(n, np.uint32)
    for k, (kind, w, y, h) in enumerate(_rectangles()):
        m, c = w // 2, y + h // 2
        if kind == 0:  # upper against lower classes
            a, b = area(0, w, c, y + h), area(0, w, y, c)
        elif kind == 1:  # later against earlier
            a, b = area(m, w, y, y + h), area(0, m, y, y + h)
        elif kind == 2:  # the two diagonals
            a, b = area(0, m, y, c) + area(m, w, c, y + h), area(0, m, c, y + h) + area(m, w, y, c)
        else:  # middle against both sides
            q = w // 4
            a, b = area(q, w - q, y, y + h), area(0, q, y, y + h) + area(w - q, w, y, y + h)
        level = np.searchsorted((-STEP, 0.0, STEP), np.log((1 + a) / (1 + b)))
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, *, id_column: str, audio_column: str, rate: int = RATE) -> DataFrame:
    """Per row: the id and ``print``, an array of integers."""
    schema = T.StructType([recordings.schema[id_column], T.StructField("print", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLIPS):
                part = batch.slice(at, CLIPS)
                made = [integers(chroma(_pieces(x.as_py(), rate), rate)).view(np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int32()))], names=[id_column, "print"])

    return recordings.select(F.col(id_column), F.col(audio_column)).mapInArrow(run, schema)


def melodies(vectors: DataFrame, *, id_column: str, vector_column: str, step: float = 0.1, rate: int = RATE) -> DataFrame:
    """Per row: the id and ``audio``, a note of FRAME samples for each component: ``step`` is a whole tone."""
    schema = T.StructType([vectors.schema[id_column], T.StructField("audio", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = np.arange(25)
        hz = 220 * 2 ** (notes / 12)
        waves = (12000 * np.sin(2 * np.pi * hz[:, None] * np.arange(FRAME) / rate)).astype("<i2")
        for batch in batches:
            for at in range(0, batch.num_rows, CLIPS):
                part = batch.slice(at, CLIPS)
                made = []
                for x in part.column(1).to_pylist():
                    v = np.nan_to_num(np.array([0.0 if y is None else y for y in x or []], float))
                    made.append(waves[np.clip(12 + 2 * np.round(v / step), 0, 24).astype(int)].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=[id_column, "audio"])

    return vectors.select(F.col(id_column), F.col(vector_column)).mapInArrow(run, schema)


def clips(recordings: DataFrame, *, id_column: str, audio_column: str, kept: float = 0.6, gain: float = 0.5, noise: float = 0.02) -> DataFrame:
    """Per row: the id and ``audio``, a stretch of the recording of the part ``kept``, at ``gain`` and with noise; place and noise follow from the id."""
    schema = T.StructType([recordings.schema[id_column], T.StructField("audio", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                samples = _pcm(x.as_py())
                rng = np.random.default_rng(zlib.crc32(str(i).encode()))
                n = int(kept * len(samples))
                at = int(rng.integers(0, len(samples) - n + 1))
                loud = gain * samples[at : at + n] + rng.normal(0, noise * 32768 * gain, n)
                made.append(np.clip(loud, -32768, 32767).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_column, "audio"])

    return recordings.select(F.col(id_column), F.col(audio_column)).mapInArrow(run, schema)


# -- alignment ----------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class _Index:
    """Recordings that stand in ``flat`` one after another, their integers sorted."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray) -> None:
        self.flat, self.starts, self.sizes = flat, starts[:-1], np.diff(starts)
        order = np.argsort(flat, kind="stable")
        self.ranked = flat[order]
        self.record = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.frame = _ranges(np.zeros(len(self.sizes), np.int64), self.sizes)[order]

    def best_offsets(self, query: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(hits, offset) at the peak of each recording's offset histogram, the least of equal peaks; zeros where fewer than ``least`` integers agree."""
        hits, offset = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        order = np.argsort(query, kind="stable")
        values, first, often = np.unique(query[order], return_index=True, return_counts=True)
        low, high = np.searchsorted(self.ranked, values, "left"), np.searchsorted(self.ranked, values, "right")
        at, slot = _ranges(low, high - low), np.repeat(np.arange(len(values)), high - low)
        record = self.record[at]
        agree = np.bincount(record, weights=often[slot], minlength=len(self.sizes)).astype(np.int64)
        chosen = np.flatnonzero(agree >= least)
        if not len(chosen):
            return hits, offset
        width = len(query) + int(self.sizes[chosen].max())
        # so many recordings at a time that hits and cells stay bounded
        share = np.full(len(self.sizes), -1)
        share[chosen] = np.cumsum(agree[chosen] + width) // HITS
        place = np.zeros(len(self.sizes), np.int64)
        for s in np.unique(share[chosen]):
            part = np.flatnonzero(share == s)
            place[part] = np.arange(len(part))
            mine = np.flatnonzero(share[record] == s)
            times = often[slot[mine]]
            which = order[_ranges(first[slot[mine]], times)]
            cell = np.repeat(place[record[mine]] * width + self.frame[at[mine]] + len(query) - 1, times) - which
            histogram = np.bincount(cell, minlength=len(part) * width).reshape(len(part), width)
            peak = histogram.argmax(axis=1)
            hits[part], offset[part] = histogram[np.arange(len(part)), peak], peak - (len(query) - 1)
        return hits, offset

    def errors(self, query: np.ndarray, chosen: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of differing bits, overlap) of the chosen recordings at their offsets; (1, 0) without overlap enough."""
        first, last = np.maximum(0, -offset), np.minimum(len(query), self.sizes[chosen] - offset)
        overlap = np.where(last - first >= LEAST_OVERLAP, last - first, 0)
        differing = np.bitwise_count(query[_ranges(first, overlap)] ^ self.flat[_ranges(self.starts[chosen] + first + offset, overlap)])
        wrong = np.bincount(np.repeat(np.arange(len(chosen)), overlap), weights=differing, minlength=len(chosen))
        return np.where(overlap > 0, wrong / (32 * np.maximum(overlap, 1)), 1.0), overlap


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id among the sorted distinct ones; nulls come last."""
    coded = ids.dictionary_encode()
    place = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
    return np.append(place, len(place))[coded.indices.fill_null(len(place)).to_numpy(zero_copy_only=False)]


def align(prints: DataFrame, is_query: Column, *, id_column: str) -> DataFrame:
    """Per query of ``prints`` (id, print): id, n_frames, n_matches, best_id, best_offset, best_error."""
    rows = checkpointed(prints.select(F.col(id_column).alias("id"), "print", F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")))
    return _searched(rows, rows.filter("query"), id_column, apart=True)


def search(prints: DataFrame, asked: DataFrame, *, id_column: str) -> DataFrame:
    """Per row of ``asked`` (id, print), held against all of ``prints``: the columns of ``align``."""
    numbered = lambda df: checkpointed(df.select(F.col(id_column).alias("id"), "print", F.monotonically_increasing_id().alias("row")))
    return _searched(numbered(prints), numbered(asked), id_column, apart=False)


def _searched(recordings: DataFrame, queries: DataFrame, id_column: str, *, apart: bool) -> DataFrame:
    """apart: rows of one id, or one row, don't match each other."""
    kind = recordings.schema["id"].dataType.simpleString()
    is_long = F.size("print") >= LEAST_OVERLAP  # shorter ones align with nothing
    long, asked = recordings.filter(is_long), queries.filter(is_long)
    n, n_queries = long.count(), asked.count()
    blocks, parts = max(1, math.ceil(n / RECORDINGS)), max(1, math.ceil(n_queries / QUERIES))
    dealt = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    here = long.select(dealt(blocks).alias("block"), each(parts).alias("part"), "row", "id", "print", F.lit(False).alias("asks"))
    asking = asked.select(each(blocks).alias("block"), dealt(parts).alias("part"), "row", "id", "print", F.lit(True).alias("asks"))

    def cell(table: pa.Table) -> pa.Table:
        row, asks = (table.column(c).to_numpy() for c in ("row", "asks"))
        ids = table.column("id").combine_chunks()
        place = _places(ids)
        lists = table.column("print").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint32)
        at = np.flatnonzero(~asks)
        sizes = np.diff(offsets)[at].astype(np.int64)
        index = _Index(values[_ranges(offsets[at].astype(np.int64), sizes)], np.append(0, np.cumsum(sizes)))
        found = []
        for q in np.flatnonzero(asks):
            mine = values[offsets[q] : offsets[q + 1]]
            hits, shift = index.best_offsets(mine, LEAST_HITS)
            other = (row[at] != row[q]) & (place[at] != place[q]) if apart else True
            chosen = np.flatnonzero((hits >= LEAST_HITS) & other)
            error, overlap = index.errors(mine, chosen, shift[chosen])
            good = error <= MOST_ERROR
            chosen, error, overlap = chosen[good], error[good], overlap[good]
            if len(chosen):
                k = np.lexsort((shift[chosen], place[at[chosen]], -overlap, error))[0]
                found.append((int(row[q]), len(chosen), float(error[k]), int(overlap[k]), ids[int(at[chosen[k]])].as_py(), int(shift[chosen[k]])))
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), table.schema.field("id").type, pa.int32())
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("row", "n", "error", "overlap", "match", "offset"), columns, kinds, strict=True)})

    cells = here.unionAll(asking).groupBy("block", "part").applyInArrow(cell, f"row long, n long, error double, overlap int, match {kind}, offset int")
    best = F.min(F.struct("error", (-F.col("overlap")).alias("o"), F.col("match").isNull().alias("none"), "match", "offset")).alias("best")
    totals = cells.groupBy(F.col("row").alias("of")).agg(F.sum("n").alias("n"), best)
    out = queries.select("id", "row", F.size("print").alias("n_frames")).join(totals, F.col("row") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_column), "n_frames", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.col("best.match").alias("best_id"), F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_error"))
