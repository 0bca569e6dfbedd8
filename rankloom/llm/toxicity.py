"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features are the distinct words, pairs of neighbouring words and pairs with one
word between, hashed into ``2**bits`` places. Each coordinate has its own rate,
and the L1 term keeps most weights at zero: the model is a short list of places
and weights, which goes to every task.

Training takes a bounded sample of the labelled rows (``most`` rows, those of
smallest hash of id), hashed to features where it is read. It is cut into shards of ``shard_rows`` rows; each shard is
trained by one Spark task, and the model is the mean of the shards' weights.
Scoring is one pass of Arrow batches over all texts.

Defined results: a null or empty text has the score of the bias alone; rows
without a label are not learned from; where a document has several labels, the
highest counts, where several documents share an id, one of them does (so training has at most
``most`` documents); without any labelled row every score is 0.0; repeated rows each
get their score; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, in_small_batches

BITS = 20
MOST_ROWS = 20_000
SHARD_ROWS = 10_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 10.0, 1.0
WORDS = re.compile(r"\w+")
#: Words that a worker remembers; longer ones than LONG_WORD characters are hashed anew.
MEMO, LONG_WORD = 500_000, 64
CHUNK_WORDS = 1 << 20


class _Hashes(dict):
    """A 64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every feature of texts that stand one after another."""
    zero = np.zeros_like(words)
    docs, places = [doc], [_mixed(words, zero, 1)]
    for gap in (1, 2):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        places.append(_mixed(words[:-gap][same], words[gap:][same], 1 + gap))
    return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - bits)).astype(np.int64)


def _batches(texts: list[str], hashes: _Hashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, word hashes, place of each word's text) for runs of texts."""
    count, words, sizes = 0, [], []
    for text in texts:
        found = WORDS.findall(text.lower())
        words += map(hashes.__getitem__, found)
        sizes.append(len(found))
        count += 1
        if len(words) >= CHUNK_WORDS:
            yield count, np.array(words, np.uint64), np.repeat(np.arange(count), sizes)
            count, words, sizes = 0, [], []
            if len(hashes) > MEMO:
                hashes.clear()
    if count:
        yield count, np.array(words, np.uint64), np.repeat(np.arange(count), sizes)


@dataclass
class Model:
    """Weights that are not zero, by place; the bias; the number of bits of a place."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    rows: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.places] = self.weights
        return out


def _places(texts: list[str], bits: int, hashes: _Hashes) -> list[np.ndarray]:
    """The distinct places of each text's features, in order."""
    rows = []
    for count, words, doc in _batches(texts, hashes):
        docs, places = features(words, doc, bits)
        key = np.unique(docs << bits | places)
        ends = np.searchsorted(key >> bits, np.arange(count + 1))
        rows += [(key[ends[k] : ends[k + 1]] & ((1 << bits) - 1)).astype(np.int32) for k in range(count)]
    return rows


def _fitted(rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) after FTRL-proximal passes over rows of places in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(rate / (1 - rate))), 0.0
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            root = np.sqrt(ns + g * g)
            z[at] += g - (root - np.sqrt(ns)) / ALPHA * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    places = np.flatnonzero(w)
    return places, w[places], bias


def _hashed(rows: DataFrame, bits: int) -> DataFrame:
    """(order, y, text) to (order, y, places): what is shuffled and gathered is numbers of features, not texts."""
    schema = T.StructType([rows.schema["order"], rows.schema["y"], T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = _places(batch.column(2).to_pylist(), bits, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return in_small_batches(rows).mapInArrow(freeing(run), schema)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", bits: int = BITS, most: int = MOST_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> Model:
    """A model of ``labels`` (id, label): learned from at most ``most`` labelled rows."""
    marked = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column)).cast("int").alias("y"))
    sample = marked.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(most)  # ids and labels alone: a bounded table
    texts = docs.select(F.col(id_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(sample), F.col("key") == F.col("id"))
    one = _hashed(met.select("order", "y", "text"), bits).groupBy("order", "y").agg(F.min("places").alias("places"))  # one of the rows that repeat an id
    joined = one.select("order", "places", "y", F.pmod("order", F.lit(max(1, -(-sample.count() // shard_rows)))).cast("int").alias("shard"))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        places, weights, bias = _fitted([np.asarray(x, np.int32) for x in rows["places"]], rows["y"].to_numpy(float), bits, epochs)
        out = pd.DataFrame({"place": np.append(places, -1), "weight": np.append(weights, bias)})
        return out.assign(rows=len(rows))

    found = joined.groupBy("shard").applyInPandas(shard, "place long, weight double, rows long")
    shards = F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")
    got = found.groupBy("place").agg(*shards).toPandas()  # at most 2**bits + 1 rows, few of them not zero
    if got.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -np.inf, bits, 0)
    bias = got[got["place"] == -1].iloc[0]
    rest = got[got["place"] >= 0].sort_values("place")
    return Model(rest["place"].to_numpy(np.int64), (rest["total"] / bias["n"]).to_numpy(np.float32), bias["total"] / bias["n"], bits, int(bias["rows"]))


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and the ``score``, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast((model.places, model.weights))
    bias, bits = model.bias, model.bits
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = held.value
        dense = Model(places, weights, bias, bits, 0).dense()
        hashes = _Hashes()
        for batch in batches:
            out = []
            for count, words, doc in _batches(batch.column(1).to_pylist(), hashes):
                docs, at = features(words, doc, bits)
                hit = dense[at] != 0
                key = np.unique(docs[hit] << bits | at[hit])
                sums = np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=count)
                with np.errstate(over="ignore"):
                    out.append(1 / (1 + np.exp(-(bias + sums))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_column, "score"])

    return in_small_batches(docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))).mapInArrow(run, schema)
