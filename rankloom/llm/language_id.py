"""Language ID: interpolated Kneser-Ney character models, one per language.

A text's words (runs of letters, lower-cased) are scored letter by letter, with
marks at both ends of a word. A model of order ``ORDER`` is held as sorted arrays
of n-gram hashes with log probabilities and of context hashes with back-off
weights. The language of lowest length-normalised cross-entropy wins. A score is
the softmax of negative cross-entropies at a temperature fitted on rows kept
apart from the counts; on the same rows each language's rejection threshold is
calibrated: a text whose cross-entropy is above it is marked ``rejected``.

Counting and fitting run in Spark, on a bounded sample: about ``per_language`` documents of
each language, chosen by a hash of id and text; rows alike in both count once, so null or
equal ids, and copies however many, are rows like others. Where the sample has more than
``MOST_GRAMS`` different grams it is halved until it has not, which bounds the models by a
count whatever the number of languages and the length of texts. Scoring is one pass of Arrow batches;
each worker remembers the scores of up to ``MEMO`` words, of ``MEMO_CHARS`` characters.

Defined results: a null text, or one without a letter, is ``und`` with score 0.0
and is rejected; so is every text where nothing could be learned; equal
cross-entropies go to the first language by code point; repeated rows each get
their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, in_small_batches, stored

ORDER = 4
PER_LANGUAGE = 2000
#: Grams of ``ORDER`` letters of all languages together: what is held by the driver and by each worker is at most some 150 MB.
MOST_GRAMS = 4_000_000
#: Words whose scores a worker remembers, and their characters.
MEMO, MEMO_CHARS = 300_000, 32 << 20
CHUNK_CHARS = 1 << 21
#: A table of at most so many languages and their row counts is broadcast.
BROADCAST_LANGUAGES = 10_000
#: Of calibration texts (of one language, in nats per letter): the quantile, and what is added to it.
QUANTILE, MARGIN = 0.999, 0.5
START, END = "\x02", "\x03"
UNKNOWN = "und"


def _gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` code points that end at each place (wrapping at the start)."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(order - 1, -1, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.roll(codes, k) + np.uint64(1)
        h ^= h >> np.uint64(31)
    return h


@dataclass
class CharModel:
    """One language: per order sorted hashes with log probabilities, and with log back-off weights of contexts."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    def score(self, hashes: list[np.ndarray], context_hashes: list[np.ndarray]) -> np.ndarray:
        """log p of each place, given the hashes of the grams (orders 1 up) that end there and of their contexts."""
        n = len(hashes[0])
        out, open_, carried = np.full(n, self.floor), np.ones(n, bool), np.zeros(n)
        for k in range(len(self.grams) - 1, -1, -1):
            at = np.searchsorted(self.grams[k], hashes[k])
            at[at == len(self.grams[k])] = 0
            hit = open_ & (self.grams[k][at] == hashes[k])
            out[hit] = carried[hit] + self.logp[k][at[hit]]
            open_ &= ~hit
            c = np.searchsorted(self.contexts[k], context_hashes[k])
            c[c == len(self.contexts[k])] = 0
            known = open_ & (self.contexts[k][c] == context_hashes[k])
            carried[known] += self.backoff[k][c[known]]
        out[open_] = carried[open_] + self.floor
        return out


def _hashes_of(texts: list[str], size: int) -> np.ndarray:
    """The hash of each text of ``size`` code points, as ``_gram_hashes`` has it; of the empty one 0."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(texts), size)
    h = np.zeros(len(texts), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k] + np.uint64(1)
        h ^= h >> np.uint64(31)
    return h


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, texts = batch.column("size").to_numpy(), np.array([*batch.column("gram").to_pylist(), None], object)[:-1]
        out = np.zeros(len(texts), np.uint64)
        for k in np.unique(sizes):
            at = np.flatnonzero(sizes == k)
            out[at] = _hashes_of(texts[at].tolist(), int(k))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("lang", "size", "context")), pa.array(out.view(np.int64)), batch.column("value")], names=["lang", "size", "context", "hash", "value"])


def kneser_ney(grams: DataFrame) -> dict[str, CharModel]:
    """The interpolated model of each language, of ``grams`` (lang, gram, n): all its grams of ``ORDER`` letters and how often they stand.

    Counts, discounts and probabilities are aggregates and joins by language and gram. What
    comes to the driver is a hash and a number for each gram and context: about three times
    as many as ``grams`` has rows, which the caller bounds.
    """
    levels = [grams.select("lang", "gram", F.col("n").cast("long").alias("n"))]
    for _ in range(ORDER - 1):  # below the top, the number of different letters before the gram
        levels.insert(0, levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    letters = levels[0].groupBy(F.col("lang").alias("of")).agg((1 / (F.count(F.lit(1)) + 1)).alias("lower"))
    tables, lower = [], None
    for k, level in enumerate(levels, 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = level.groupBy(F.col("lang").alias("in")).agg(F.least(F.lit(0.95), F.greatest(F.lit(0.05), ones / F.greatest(F.lit(1), ones + 2 * twos))).alias("d"))
        before, total, kinds = F.expr(f"substring(gram, 1, {k - 1})"), F.sum("n"), F.count(F.lit(1))
        sums = level.groupBy(F.col("lang").alias("by"), before.alias("before")).agg(total.alias("total"), kinds.alias("kinds"))
        rows = level.join(discounts, F.col("lang") == F.col("in")).join(sums, (F.col("lang") == F.col("by")) & (before == F.col("before")))
        if lower is None:
            rows = rows.join(letters, F.col("lang") == F.col("of"))
        else:  # every gram without its first letter is one of the level below
            shorter = lower.select(F.col("lang").alias("of"), F.col("gram").alias("end"), F.col("p").alias("lower"))
            rows = rows.join(shorter, (F.col("lang") == F.col("of")) & (F.expr("substring(gram, 2)") == F.col("end")))
        rest = F.col("d") * F.col("kinds") / F.col("total")
        lower = stored(rows.select("lang", "gram", "before", rest.alias("rest"), ((F.col("n") - F.col("d")) / F.col("total") + rest * F.col("lower")).alias("p")))
        tables.append(lower.select("lang", F.lit(k).alias("size"), F.lit(False).alias("context"), "gram", F.col("p").alias("value")))
        tables.append(lower.select("lang", F.lit(k - 1).alias("size"), F.lit(True).alias("context"), F.col("before").alias("gram"), F.col("rest").alias("value")).distinct())
    found = reduce(DataFrame.unionAll, tables).mapInArrow(_hashed, "lang string, size int, context boolean, hash long, value double").toArrow()
    coded = found.column("lang").combine_chunks().dictionary_encode()
    lang, (size, context, value) = coded.indices.to_numpy(), (found.column(x).to_numpy() for x in ("size", "context", "value"))
    hashes = found.column("hash").to_numpy().view(np.uint64)

    def sorted_table(of: int, k: int, is_context: bool) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((lang == of) & (size == k) & (context == is_context))
        at = at[np.lexsort((value[at], hashes[at]))]
        return hashes[at], np.log(value[at]).astype(np.float32)

    models = {}
    for of, name in enumerate(coded.dictionary.to_pylist()):
        own = [sorted_table(of, k, False) for k in range(1, ORDER + 1)]
        contexts = [sorted_table(of, k, True) for k in range(ORDER)]
        models[name] = CharModel([h for h, _ in own], [v for _, v in own], [h for h, _ in contexts], [v for _, v in contexts], float(-np.log(len(own[0][0]) + 1)))
    return models


@dataclass
class Model:
    languages: list[str]
    models: list[CharModel]
    temperature: float
    most: np.ndarray


class _Scorer:
    """Negative log probabilities of words in every language, remembered."""

    def __init__(self, models: list[CharModel]):
        import regex

        self.models, self.find = models, regex.compile(r"\p{L}+").findall
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.held = 0
        self.costs, self.sizes = np.zeros((0, len(self.models)), np.float32), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        pad = START * (ORDER - 1)
        text = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes = [_gram_hashes(text, k) for k in range(1, ORDER + 1)]
        context = [np.zeros(len(text), np.uint64), *(np.roll(h, 1) for h in hashes[:-1])]
        own = text != ord(START)
        hashes, context = [h[own] for h in hashes], [h[own] for h in context]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        cost = np.stack([-np.add.reduceat(m.score(hashes, context), starts) for m in self.models], axis=1).astype(np.float32)
        self.costs, self.sizes = np.concatenate([self.costs, cost]), np.concatenate([self.sizes, sizes])

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per letter of each text in each language; NaN without a letter."""
        if len(self.codes) > MEMO or self.held > MEMO_CHARS:
            self.clear()
        codes, had = self.codes, len(self.codes)
        found = []
        for x in texts:
            words = self.find(x.lower())
            for w in words:
                if w not in codes:
                    codes[w] = len(codes)
                    self.held += len(w)
            found.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
        if len(codes) > had:
            self._learn(list(codes)[had:])
        out = np.full((len(texts), len(self.models)), np.nan)
        for k, at in enumerate(found):
            if len(at):
                out[k] = self.costs[at].sum(axis=0, dtype=np.float64) / self.sizes[at].sum()
        return out


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        held.append(x or "")
        size += len(x or "")
        if size > CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _entropies(rows: DataFrame, models: list[CharModel], keep: str) -> DataFrame:
    """(keep, entropies) of ``rows`` (keep, text)."""
    held = rows.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    schema = T.StructType([rows.schema[keep], T.StructField("entropies", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value)
        for batch in batches:
            found = np.concatenate([scorer.entropies(x) for x in _runs(batch.column(1).to_pylist())]) if batch.num_rows else np.zeros((0, len(held.value)))
            offsets = np.arange(len(found) + 1, dtype=np.int32) * len(held.value)
            flat = pa.array(found.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[keep, "entropies"])

    return in_small_batches(rows.select(keep, "text")).mapInArrow(freeing(run), schema)


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): the grams of ``ORDER`` letters of the words of ``sample`` (lang, text)."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    framed = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda k: framed.substr(k, F.lit(ORDER)))).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages that occur, from about ``per_language`` documents of each (fewer where they have more than ``MOST_GRAMS`` grams together)."""
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.xxhash64(id_column, text_column).alias("row"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    sizes = rows.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("row", 0.02).alias("n"))
    chance = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES  # else texts are shuffled
    sized, share = rows.join(F.broadcast(sizes) if few else sizes, F.col("lang") == F.col("of")), 1.0
    apart = F.pmod(F.xxhash64("row", F.lit(23)), F.lit(5)) == 0
    while True:
        sample = sized.filter(chance < F.lit(share * per_language) / F.col("n"))
        sample = sample.dropDuplicates(["lang", "row"])  # rows that repeat are drawn together, and learned from once
        grams = stored(_counted(sample.filter(~apart)))
        n = grams.count()
        if n <= MOST_GRAMS:
            break
        share /= 2  # a smaller sample is part of the larger one
    found = kneser_ney(grams) if n else {}
    languages = sorted(found)
    models = [found[x] for x in languages]
    if not models:
        return Model([], [], 1.0, np.zeros(0))
    kept = _entropies(sample.filter(apart).select("lang", "text"), models, "lang").toPandas()  # numbers of a bounded sample
    kept = kept[kept["lang"].isin(languages)]
    rows_of = [(languages.index(a), np.array(b, float)) for a, b in zip(kept["lang"], kept["entropies"], strict=True) if b is not None and all(v is not None and v == v for v in b)]
    truth, found = np.array([a for a, _ in rows_of], int), np.array([b for _, b in rows_of]).reshape(-1, len(languages))
    most = np.full(len(languages), np.inf)
    for k in range(len(languages)):
        if (truth == k).any():
            most[k] = np.quantile(found[truth == k, k], QUANTILE) + MARGIN
    best = 1.0
    if len(truth):
        losses = {t: -np.log(np.maximum(_softmax(-found * t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
        best = min(losses, key=losses.get)
    return Model(languages, models, best, most)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _judged(texts: list[str | None], scorer: _Scorer | None, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the language, score, cross-entropy, rejected) of each text."""
    n = len(texts)
    best, score, entropy = np.full(n, len(model.languages)), np.zeros(n), np.full(n, np.nan)
    if scorer and n:
        found = np.concatenate([scorer.entropies(x) for x in _runs(texts)])
        ok = ~np.isnan(found[:, 0])
        if ok.any():
            best[ok] = found[ok].argmin(axis=1)
            entropy[ok] = found[ok].min(axis=1)
            score[ok] = _softmax(-found[ok] * model.temperature).max(axis=1)
    return best, score, entropy, ~(entropy <= np.append(model.most, -np.inf)[best])


def identify(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, lang_pred, score, cross_entropy, rejected."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        scorer = _Scorer(model.models) if model.models else None
        for batch in batches:
            best, score, entropy, rejected = _judged(batch.column(1).to_pylist(), scorer, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=schema.names)

    return in_small_batches(docs.select(F.col(id_column), F.col(text_column).alias("text"))).mapInArrow(freeing(run), schema)


def accepted(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = _Scorer(model.models) if model.models else None
        for batch in batches:
            yield batch.filter(pa.array(~_judged(batch.column(at).to_pylist(), scorer, model)[3]))

    return in_small_batches(docs).mapInArrow(freeing(run), docs.schema)
