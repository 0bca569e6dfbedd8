"""The similarity join against brute force, its parts, edge cases."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from rankloom.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.8):
    """[(id, class, links)] of (id, text) by comparing all pairs that share a shingle."""
    reader = ngram_join._Reader()
    sets = [set(ngram_join.shingles(reader.words(t or "")[0]).tolist()) for _, t in rows]
    shared, by = defaultdict(int), defaultdict(list)
    for k, s in enumerate(sets):
        for h in s or {None}:
            by[h].append(k)
    for at in by.values():
        for i, a in enumerate(at):
            for b in at[:i]:
                shared[b, a] += 1
    root, links = list(range(len(rows))), defaultdict(int)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def joined(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    return sorted(map(tuple, ngram_join.near_copies(df).collect()), key=str)


@pytest.fixture(scope="module")
def crowd():
    """A dense group of near copies, exact copies of some, and a passage that many unlike texts share."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(text)))
    rows += [(200 + k, rows[k][1]) for k in range(10)]
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(300 + k, passage + " " + " ".join(f"q{rng.random()}" for _ in range(100))) for k in range(80)]
    return rows


def test_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize(("node", "block", "few"), [(32, 1024, 16), (4, 8, 2)])
def test_dense_group(spark, crowd, monkeypatch, node, block, few):
    monkeypatch.setattr(ngram_join, "SMALL_NODE", node)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FEW_FAR", few)
    assert joined(spark, crowd) == brute(crowd)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (5, "a  B c"), (None, "a b c"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "z " * 30_000), (8, "z " * 30_001), (None, "only null"), (None, "only null")]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, rows[:0]) == []


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other"), (3, "other"), (4, None), (5, ""), (None, "a b c d e f"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.deduplicated(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (3, "other"), (4, None), (None, "alone")], key=str)
    # near copies of one id, or of none: one of each group stays
    near = [" ".join(f"w{j}" for j in range(100)) + f" end{k}" for k in range(4)]
    for i in (7, None):
        assert ngram_join.deduplicated(spark.createDataFrame([(i, t) for t in near], "doc_id long, text string")).count() == 1
    assert ngram_join.deduplicated(df.limit(0)).count() == 0


def test_shuffled_when_groups_are_many(spark, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert joined(spark, crowd) == brute(crowd)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(100, 101 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys((5, 6, 7, 8, 9), 5), **dict.fromkeys(range(100, 151), 100)}


def test_paths_reach_the_recall(spark):
    """Pairs at the threshold, without the exact check that follows."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        base = [f"{k}-{j}" for j in range(300)]
        other = list(base)
        for j in rng.choice(296, 6, replace=False):
            other[j] = f"{k}-{j}-x"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    texts = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, mark long")
    signed = ngram_join._signed(texts).cache()
    reader = ngram_join._Reader()
    keys = [reader.words(t)[1] for _, t in rows]
    sets = [set(ngram_join.shingles(reader.words(t)[0]).tolist()) for _, t in rows]
    linked = {(max(keys[2 * k : 2 * k + 2]), min(keys[2 * k : 2 * k + 2])) for k in range(300) if len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= 0.8}
    root = {r["node"]: r["root"] for r in ngram_join.components(ngram_join.chosen_paths(signed.select("key", *ngram_join._SKETCH, "tokens"))).collect()}
    assert len(linked) > 200 and sum(root.get(a, a) == root.get(b, b) for a, b in linked) / len(linked) >= 0.99


def test_paths_reach_the_recall_in_deep_nodes(spark, monkeypatch):
    """Pairs at the threshold that share a passage with thousands of unlike texts."""
    monkeypatch.setattr(ngram_join, "SMALL_NODE", 100)
    monkeypatch.setattr(ngram_join, "FEW_FAR", 4)
    rng = np.random.default_rng(6)
    passage, rows = [f"p{j}" for j in range(110)], []
    for k in range(1000):
        base = passage + [f"{k}-{j}" for j in range(190)]
        rows.append((2 * k, " ".join(base)))
        other = list(base)
        for j in rng.choice(21, 6, replace=False):
            other[190 + 5 * j] = f"{k}-{j}-x"
        rows.append((2 * k + 1, " ".join(other)))
    signed = ngram_join._signed(spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, mark long")).cache()
    reader = ngram_join._Reader()
    words = [reader.words(t) for _, t in rows]
    sets = [set(ngram_join.shingles(w).tolist()) for w, _ in words]
    likeness = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(1000)]
    linked = {(max(words[2 * k][1], words[2 * k + 1][1]), min(words[2 * k][1], words[2 * k + 1][1])) for k in range(1000) if 0.8 <= likeness[k] < 0.85}
    root = {r["node"]: r["root"] for r in ngram_join.components(ngram_join.chosen_paths(signed.select("key", *ngram_join._SKETCH, "tokens"))).collect()}
    assert len(linked) > 900 and sum(root.get(a, a) != root.get(b, b) for a, b in linked) <= 1
    # the strangers stay apart
    assert len({root.get(k, k) for _, k in words}) >= 950


def test_rest_of_the_levels(spark, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_NODE", 4)
    monkeypatch.setattr(ngram_join, "FEW_FAR", 2)
    monkeypatch.setattr(ngram_join, "MOST_LEVELS", 1)
    assert joined(spark, crowd) == brute(crowd)


def test_near_roots():
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, (3, 4))
    rows = [(0, base[0]), (0, base[1]), (0, base[0]), (1, base[0]), (1, base[2]), (1, base[2]), (2, base[1])]
    path, sketch = np.array([p for p, _ in rows]), [np.array([s[k] for _, s in rows]) for k in range(4)]
    assert ngram_join.near_roots(path, sketch).tolist() == [0, 1, 0, 3, 4, 4, 6]
    # a chain of neighbours, each near the next only
    chain = [np.array([(1 << min(63, 20 * k)) - 1 for k in (0, 2, 1, 3)], np.uint64).view(np.int64)]
    assert ngram_join.near_roots(np.zeros(4, np.int64), chain).tolist() == [0, 0, 0, 0]


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, 400).astype(np.uint64)) for _ in range(30)]
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    others = ~np.eye(30, dtype=bool)
    assert (ngram_join.shared_counts(sets)[others] == expected[others]).all()
    assert (ngram_join.shared_counts(sets[:10], sets[10:]) == expected[:10, 10:]).all()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = con.execute(f"select doc_id, class_id, n_links from ({queries.ORACLE_SQL['op10_ngram_join']})").fetchall()
    assert sorted(map(tuple, queries.op10_ngram_join(spark, SF).collect())) == sorted(expected)
