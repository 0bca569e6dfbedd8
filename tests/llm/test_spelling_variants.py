import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from rankloom.llm import queries
from rankloom.llm.spelling_variants import grouped, near_words, neighbourhood, reduced, symbols_for


def apart(a, b):
    """Whether exactly one insertion, deletion or replacement makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made():
    rng = random.Random(13)
    words = {}
    while len(words) < 500:
        word = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
        words[word] = rng.choice([1, 5, 5, 25, 26, 125, 700])
    return words | {"日本語": 5, "日本": 30, "x": 5, "😀a": 2, "😀": 10}


def plainly(words):
    near = {a: [b for b in words if apart(a, b)] for a in words}
    form = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in form.items() if words[b] >= 5 * words[a]}

    def root(a):
        return root(form[a]) if a in form else a

    return sorted((a, form.get(a), root(a), n, len(near[a]), words.get(form.get(a))) for a, n in words.items())


def test_equal_to_all_pairs(spark):
    words = made()
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for symbols in (None, 2, 4):
        assert sorted(tuple(r) for r in grouped(table, symbols=symbols).collect()) == plainly(words)
    pairs = near_words(table)
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted((a, b) for a in words for b in words if apart(a, b))


def test_chains_of_forms(spark):
    chain = [("a" * 20 + "b" * k, 5**k) for k in range(12)]  # each is a form of the one before
    got = {r.word: r.root for r in grouped(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_neighbourhood_is_whole(spark):
    n, s = 5, 3
    row = spark.range(1).select(neighbourhood(F.lit("abcab"), s).alias("x"), reduced(F.lit("aéa😀"), 4).alias("r")).first()
    letters = "abc"
    wanted = {"abcab"[:i] + c + "abcab"[i + 1 :] for i in range(n) for c in [*letters, ""]}
    assert sorted(row.x) == sorted(wanted)
    assert len(row.r) == 4 and set(row.r) <= set("abcd") and row.r[0] == row.r[2]


def test_symbols():
    assert symbols_for(0, 1) == 4 and symbols_for(10**6, 6) == 10 and symbols_for(10**12, 6) == 26


def test_rows(spark):
    rows = [("word", 3), ("word", 2), (None, 9), ("", 9), ("wordy", 25), ("null", None), ("ward", 25)]
    table = spark.createDataFrame(rows, "word string, n int").withColumns({"form": F.lit(1), "root": F.lit("r"), "a": F.lit(0), "n_near": F.lit(2)})
    got = sorted(tuple(r) for r in grouped(table).collect())
    assert got == [("ward", None, "ward", 25, 1, None), ("word", "ward", "ward", 5, 2, 25), ("wordy", None, "wordy", 25, 1, None)]
    assert grouped(table.limit(0)).collect() == [] and near_words(table.limit(0)).collect() == []


def test_words_of_texts(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Ärgern", "ÄRGERN", "kürzen×x", "short", "letters", "Letter"]) + rng.choice([",", "1", "-"]) for _ in range(60))) for k in range(40)] + [(None, "letter letter"), (7, None), (8, "")]
    wanted = Counter()
    for k, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            wanted[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in queries._words_with_errors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: n for w, n in wanted.items() if len(w) >= 6 and n >= 5} and len(got) >= 4
