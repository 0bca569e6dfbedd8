import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.periodic_runs import bands, periodic_runs, runs_of, top_run


def plainly(words, shortest=12):
    """Every maximal stretch of matches at every lag, by the smallest lag that has it."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(shortest, 2 * q):
                found.setdefault((start, i + q), q)
            i = max(i, start + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def sequences():
    rng = random.Random(11)
    for k in range(600):
        n, letters = rng.randrange(150), rng.choice([1, 2, 3, 9])
        if k % 3 == 0:
            yield [rng.randrange(letters) for _ in range(n)]
            continue
        out = []
        while len(out) < n:  # repeats within repeats, some cut short
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 25))]
            out += (unit * rng.randrange(1, 6))[: rng.randrange(1, 120)]
        yield out if k % 3 == 1 else out * 2
    a, b = [0], [0, 1]
    while len(b) < 200:  # Fibonacci words have the most runs
        a, b = b, b + a
        yield b


def test_equal_to_all_lags():
    for words in sequences():
        assert runs_of(np.array(words, np.int64)) == plainly(words), words
    for words in list(sequences())[:100]:
        assert runs_of(np.array(words, np.int64), 5) == plainly(words, 5), words


def test_no_stretch_passes_between_seeds():
    for shortest in (3, 5, 12, 40):
        lags = []
        for k, stride, low, high in bands(5000, shortest):
            lags += range(low, high + 1)
            assert stride >= 1 and all(stride + k - 1 <= max(shortest - q, q) for q in range(low, high + 1))
        assert lags == list(range(1, 2501))


@pytest.mark.parametrize("words", [[0] * 200_000, [0, 1] * 100_000, list(range(1000)) * 200, list(range(100_000)) * 2, [0] * 100_000 + [1] + [0] * 100_000])
def test_very_long_texts(words):
    found = runs_of(np.array(words))
    assert 1 <= len(found) <= 3 and max(x[1] for x in found) >= len(words) // 2


def test_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, " \t\n ", 7), (3, "a " * 14, 8), (3, "a " * 14, 8), (4, "x y z " * 12 + "q", 9), (5, "one two", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int").withColumns({"read": F.lit(1), "__text": F.lit("t"), "runs": F.lit("old")})
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "c0", "read", "__text", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    assert got == sorted([(1, 0, [], "")] * 2 + [(None, 0, [], ""), (2, 0, [], "")] + [(3, 14, [(0, 14, 1)], "a")] * 2 + [(4, 13, [(0, 12, 1)], "x y z q"), (5, 2, [], "one two")], key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, shortest=2)


def test_top_run(spark):
    words = " ".join(["a"] * 12 + ["b"] + ["c"] * 12 + ["d"] + ["e", "f"] * 6)
    row = periodic_runs(spark.createDataFrame([(1, words)], "doc_id long, text string")).withColumn("top", top_run(F.col("runs"))).first()
    assert [tuple(x) for x in row.runs] == [(0, 12, 1), (13, 12, 1), (26, 12, 2)] and (row.top.start, row.top.period) == (0, 1)
    assert row.collapsed == "a b c d e f"
