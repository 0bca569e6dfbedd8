"""Mixing: targets against a plain loop, the rounding's promises, edge cases."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing

SF = "/root/testdata/sf0.01"


def plain_targets(sizes: dict, weights=(5.0, 2.0, 1.0), ceiling=3.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: ceiling * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and target[s] > ceiling * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def uneven(spark):
    rows = [(k, " ".join(["w"] * (k % 17 + 1)), None if k % 11 == 0 else f"s{k % 4 if k % 5 else 0}", 1) for k in range(600)]
    rows += [(1000 + k, "tiny text", f"rare{k}", 1) for k in range(3)] + [(2000, "", "s1", 1), (2001, None, "s2", 1), (5, "w w w w w w", "s0", 1), (5, "w w w w w w", "s0", 1), (None, "a b", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_targets_and_sizes(uneven):
    got = mixing.mix(uneven).collect()
    sizes = defaultdict(int)
    for r in uneven.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    expected = plain_targets(sizes)
    assert len(got) == uneven.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]


def test_taken_is_near_the_target(uneven):
    taken, most, target = defaultdict(int), defaultdict(int), {}
    for r in mixing.mix(uneven).collect():
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_reruns_agree(spark, uneven):
    a = sorted(map(str, mixing.mix(uneven).collect()))
    assert sorted(map(str, mixing.mix(uneven.repartition(7)).collect())) == a


def test_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    units = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("key"), F.col("id").alias("unit"), (F.col("id") % 9 + 1.0).alias("w"), F.lit(0.3).alias("p"))
    got = mixing.rounded(units, fan_in=4).collect()
    assert sorted(r["unit"] for r in got) == list(range(1000)) and {r["p"] for r in got} <= {0.0, 1.0}
    words = sum(r["p"] * (r["unit"] % 9 + 1) for r in got)
    assert abs(words - 0.3 * sum(k % 9 + 1 for k in range(1000))) <= 9


def test_every_document_has_its_chance(spark):
    units = spark.range(64).select(F.lit("s").alias("source"), F.col("id").alias("key"), F.col("id").alias("unit"), F.lit(2.0).alias("w"), F.lit(0.25).alias("p"))
    hits = defaultdict(int)
    for seed in range(6):
        for r in mixing.rounded(units, seed).collect():
            hits[r["unit"]] += r["p"]
    assert sum(hits.values()) == 6 * 16 and max(hits.values()) < 6


def test_empty_and_mixed_rows(spark, uneven):
    assert mixing.mix(uneven.limit(0)).count() == 0
    out = mixing.mixed(uneven)
    assert out.columns == uneven.columns
    assert out.count() == mixing.mix(uneven).agg(F.sum("copies")).first()[0]


def test_no_text_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [tuple(r)[2:] for r in mixing.mix(df).orderBy("doc_id").collect()] == [(0, 0, 0.0, 0, 0), (0, 0, 0.0, 0, 0)]


def test_rows_alike(spark):
    """Null ids, equal sizes and equal texts: each source within half a document of its target, no row above three times."""
    rows = [(None, "w x y z", "ab"[k % 2] if k < 2000 else "c", k) for k in range(2500)] + [(7, "one two three", "c", k) for k in range(9001)]
    rows += [(None, f"w x {k} z", "ab"[k % 2], k) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and max(r.taken / r.size for r in got) <= 3
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 for s in "abc")
    out = mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source: r.n for r in out} == dict(taken)


def test_names_of_the_input_are_its_own(spark):
    clash = ["of_id", "of_source", "of_mark", "whole", "more", "copy", "one", "size", "rows", "__id", "__source", "__copies", "OF_ID_"]
    docs = spark.createDataFrame([(k, "a b c", "s" if k % 3 else "t", *range(len(clash))) for k in range(30)] + [(3, "a b c", "t", *range(len(clash)))] * 7, ["doc_id", "text", "source", *clash])
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() > 0
