"""Toxicity and language ID: held-out accuracy, the models' promises, edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string"
ODD = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 !!", None, "x"), (4, "w " * 40_000, "en", "x"), (4, "w " * 40_000, "en", "x"), (None, "the word", None, "x"), (5, "x" * 200_000, None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p and y for p, y in held) / sum(y for _, y in held) >= 0.6
    assert sum(p and not y for p, y in held) / sum(not y for _, y in held) <= 0.02


def test_toxicity_learns_a_word(spark, odd):
    rows = [(k, ("good words here " * 3) + ("awful" if k % 3 == 0 else "nice")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(0, 0), (9999, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels)
    assert model.rows == 300 and np.array_equal(model.weights, again.weights)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(scores[k] for k in range(0, 300, 3)) > 0.5 > max(scores[k] for k in range(300) if k % 3)
    some = toxicity.score(odd, model).collect()
    assert len(some) == len(ODD) and all(r["score"] == pytest.approx(1 / (1 + np.exp(-model.bias))) for r in some if r["doc_id"] in (1, 2))
    assert toxicity.score(odd.limit(0), model).count() == 0
    several = toxicity.train(docs, labels, shard_rows=100)
    assert several.rows == 300
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, several).collect()}
    assert min(scores[k] for k in range(0, 300, 3)) > max(scores[k] for k in range(300) if k % 3)


def plain_ftrl(texts, labels, bits, epochs):
    """(weights by place, bias): one coordinate after another."""
    full = (1 << 64) - 1

    def place(a, b, kind):
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + kind) & full
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & full
        return (x ^ x >> 32) >> (64 - bits)

    rows = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", t.lower())]
        rows.append({place(a, 0, 1) for a in h} | {place(a, b, 2) for a, b in zip(h, h[1:])} | {place(a, b, 3) for a, b in zip(h, h[2:])})
    z, n, t = defaultdict(float), defaultdict(float), toxicity

    def weight(k):
        return 0.0 if abs(z[k]) <= t.L1 else -(z[k] - np.sign(z[k]) * t.L1) / ((t.BETA + n[k] ** 0.5) / t.ALPHA + t.L2)

    rate = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    bias, squares = np.log(rate / (1 - rate)), 0.0
    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in row}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for k in row:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / t.ALPHA * w[k]
                n[k] += g * g
            squares += g * g
            bias -= 0.05 * g / (1 + squares**0.5)
    return {k: weight(k) for k in z if weight(k)}, bias


def test_ftrl_against_loops(monkeypatch):
    """All weights of some dozens of rows, with a smaller L1 so that many are not zero."""
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "bad", "awful", "nice", "day", "you", "are"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    labels = [int("awful" in t and "you" in t) for t in texts]
    places, weights, bias = toxicity._fitted(toxicity._places(texts, 16, toxicity._Hashes()), np.array(labels, float), 16, 3)
    expected, due = plain_ftrl(texts, labels, 16, 3)
    assert len(expected) > 20 and dict(zip(places.tolist(), weights, strict=True)) == pytest.approx(expected) and bias == pytest.approx(due)


def test_toxicity_without_labels(spark, odd):
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}


def test_languages_of_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.98
    assert sum(r["rejected"] for r in got) / len(got) <= 0.01


def plain_kneser_ney(words, order):
    """p(letter, the letters before it) of the interpolated model, by recursion over counts of all orders."""
    tops = Counter()
    for w in words:
        framed = "\x02" * (order - 1) + w + "\x03"
        tops.update(framed[k : k + order] for k in range(len(w) + 1))
    counts = {order: dict(tops)}
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discount = {}
    for k, c in counts.items():
        one, two = (sum(v == i for v in c.values()) for i in (1, 2))
        discount[k] = min(0.95, max(0.05, one / max(1, one + 2 * two)))

    def p(letter, before):
        k = len(before) + 1
        lower = p(letter, before[1:]) if before else 1 / (len(counts[1]) + 1)
        after = [v for g, v in counts[k].items() if g[:-1] == before]
        if not after:
            return lower
        return (max(0, counts[k].get(before + letter, 0) - discount[k]) + discount[k] * len(after) * lower) / sum(after)

    return p, dict(tops)


def model_p(model, letter, before):
    text = np.frombuffer((before + letter).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = [language_id._gram_hashes(text, k) for k in range(1, 5)]
    context = [np.zeros(4, np.uint64), *(np.roll(h, 1) for h in hashes[:-1])]
    return float(np.exp(model.score([h[3:] for h in hashes], [h[3:] for h in context]))[0])


def fitted(spark, tops, lang="x"):
    return language_id.kneser_ney(spark.createDataFrame([(lang, g, n) for g, n in tops.items()], "lang string, gram string, n long"))


def test_kneser_ney_against_recursion(spark):
    """Every seen and many unseen letters after seen and unseen contexts; with the share of one unseen letter they sum to one."""
    words = ["the", "then", "that", "hat", "the", "a", "nat", "tan", "ten", "ten", "een"]
    p, tops = plain_kneser_ney(words, 4)
    model = fitted(spark, tops)["x"]
    letters = sorted({g[-1] for g in tops})
    contexts = sorted({g[:-1] for g in tops}) + ["\x02\x02z", "zzz", "zth", "zze"]
    for before in contexts:
        found = [model_p(model, x, before) for x in [*letters, "q"]]
        assert found == pytest.approx([p(x, before) for x in [*letters, "q"]], rel=1e-5)
        assert sum(found) == pytest.approx(1.0, abs=1e-5)


def test_word_costs_against_recursion(spark):
    words = ["the", "then", "that", "hat", "the", "a", "nat"]
    p, tops = plain_kneser_ney(words, 4)
    texts = ["the hat", "THEN nothing", "a", "", "12"]
    found = language_id._Scorer([fitted(spark, tops)["x"]]).entropies(texts)[:, 0]
    for text, got in zip(texts, found, strict=True):
        letters = [(x, ("\x02\x02\x02" + w)[k : k + 3]) for w in re.findall("[a-z]+", text.lower()) for k, x in enumerate(w + "\x03")]
        if not letters:
            assert np.isnan(got)
            continue
        assert got == pytest.approx(-sum(np.log(p(x, before)) for x, before in letters) / len(letters), rel=1e-5)


def test_languages_are_fitted_apart(spark):
    """Two languages in one table, one with letters beyond 16 bits, have the models that each has alone."""
    tops = [plain_kneser_ney(words, 4)[1] for words in (["the", "then", "hat", "hat"], ["\U00010400\U00010401", "hat", "\u00e9t\u00e9"])]
    both = spark.createDataFrame([(lang, g, n) for lang, t in zip("xy", tops, strict=True) for g, n in t.items()], "lang string, gram string, n long")
    got = language_id.kneser_ney(both)
    assert sorted(got) == ["x", "y"]
    for lang, t in zip("xy", tops, strict=True):
        alone = fitted(spark, t)["x"]
        assert got[lang].floor == alone.floor
        for name in ("grams", "logp", "contexts", "backoff"):
            assert all(np.array_equal(a, b) for a, b in zip(getattr(got[lang], name), getattr(alone, name), strict=True))
    p, _ = plain_kneser_ney(["\U00010400\U00010401", "hat", "\u00e9t\u00e9"], 4)
    assert model_p(got["y"], "\U00010401", "\x02\x02\U00010400") == pytest.approx(p("\U00010401", "\x02\x02\U00010400"), rel=1e-5)


def test_models_are_bounded_by_their_grams(spark, monkeypatch):
    """A sample with more grams than may be held is halved; all languages are still learned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = language_id.train(docs)
    sizes = lambda model: sum(len(m.grams[-1]) for m in model.models)
    monkeypatch.setattr(language_id, "MOST_GRAMS", int(0.8 * sizes(whole)))
    some = language_id.train(docs)
    assert 0 < sizes(some) <= 0.8 * sizes(whole) and some.languages == whole.languages


def test_language_edges(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    for k in (1, 2, 3):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0.0 and got[k]["rejected"]
    assert got[5]["rejected"] and got[5]["lang_pred"] in model.languages
    assert language_id.identify(odd, model).count() == len(ODD)
    assert language_id.identify(odd.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    kept = language_id.accepted(docs.unionByName(odd.withColumn("source", F.lit(None)).withColumn("n_chars", F.lit(0)).select(docs.columns)), model)
    assert kept.columns == docs.columns and docs.count() * 0.98 <= kept.count() <= docs.count() + 3
