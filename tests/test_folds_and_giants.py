"""Out-of-fold statistics against plain loops over folds, and ranks of sessions that are cut into ranges."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.operators import splits
from rankloom.operators import windows as W


def test_statistics_of_the_other_folds(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot"] * 6 + ["x", "y", None]), rng.choice([0, 1, 1, 2, 4, None]), rng.choice([None, *(float(x) for x in range(9))])) for k in range(400)] + [(400, "lone", 3, 1.0)]
    df = spark.createDataFrame(rows, "Id long, k string, fold int, v double")
    names = ["sum", "count", "mean", "var", "min", "max", "median"]
    got = {r["Id"]: [r[f"v_{f}"] for f in names] for r in splits.fold_aware(df, ["k"], {"v": names}).collect()}
    assert len(got) == len(rows)
    for i, k, fold, _ in rows:
        others = [v for _, q, f, v in rows if q == k and f is not None and f != fold and v is not None]
        seen = any(q == k and f is not None and f != fold for _, q, f, _ in rows)
        if fold is None:
            assert got[i] == [None] * 7
        elif not others:
            assert got[i] == [None, 0, None, None, None, None, None], (seen, got[i])
        else:
            want = [sum(others), len(others), statistics.mean(others), statistics.variance(others) if len(others) > 1 else None, min(others), max(others), statistics.median(others)]
            assert got[i] == pytest.approx(want), (i, k, fold)
    assert splits.fold_aware(df.limit(0), ["k"], {"v": names}).collect() == []
    with pytest.raises(ValueError):
        splits.fold_aware(df, ["k"], {"v": ["mode"]})


def test_the_number_of_folds_is_no_number_of_scans(spark, tmp_path):
    spark.range(200).select((F.col("id") % 7).alias("k"), (F.col("id") % 20).alias("fold"), (F.col("id") % 13).alias("v")).write.parquet(str(tmp_path / "in"))
    df = splits.fold_aware(spark.read.parquet(str(tmp_path / "in")), ["k"], {"v": ["min", "max", "mean", "median"]})
    assert len(re.findall(r"Relation \[k#\d+L,fold#\d+L,v#", df._jdf.queryExecution().optimizedPlan().toString())) == 2  # the rows and the states


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_ranks_of_giant_sessions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(W, "BROADCAST_VALUES", broadcast)
    rng = random.Random(9)
    rows = [(rng.choice(["giant"] * 8 + [None] * 4 + ["a", "b", "c"]), k, rng.choice([None, 1.0, 1.0, 1.0, *(x / 4 for x in range(30))])) for k in range(900)] + [("lone", 900, 2.0), ("null", 901, None)]
    df = spark.createDataFrame(rows, "ranker_id string, Id long, v double")
    names = [f"v_{x}" for x in ("ordinal", "rank", "dense_rank", "percentile", "from_mean", "from_min", "from_max")]
    want = {r["Id"]: [r[c] for c in names] for r in W.session_ranks(df, "v").collect()}
    got = {r["Id"]: [r[c] for c in names] for r in W.session_ranks(df, "v", giant=40).collect()}
    assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i]) for i in want)
    order = {}
    for g, i, v in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        order[g] = order.get(g, 0) + 1
        assert got[i][0] == order[g]


def test_no_window_holds_a_giant_session(spark):
    df = spark.range(3000).select(F.lit("one").alias("ranker_id"), F.col("id").alias("Id"), (F.col("id") % 5).alias("v"))
    ranked = W.session_ranks(df, "v", giant=100)
    windows = [x for x in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in x]
    assert sum("__range" in x for x in windows) == 1  # the other one is that of small sessions
    ordinals = [r["v_ordinal"] for r in ranked.orderBy("v", "Id").collect()]
    assert ordinals == list(range(1, 3001))


def test_places_and_folds_over_many_ranges(spark, monkeypatch):
    """Places don't depend on the number of ranges; folds over many buckets stay near equal."""
    df = spark.range(6000).select((F.col("id") % 2000).alias("g"), (F.col("id") < 900).cast("int").alias("y"))
    whole = {r["g"]: r["__place"] for r in splits._place(df, "g", 7).collect()}
    assert sorted(whole.values()) == list(range(2000))
    monkeypatch.setattr(splits, "RANGE_GROUPS", 10)
    assert {r["g"]: r["__place"] for r in splits._place(df, "g", 7).collect()} == whole
    out = splits.stratified_folds(df, "g", "y")
    folds = out.groupBy("fold").agg(F.sum("y").alias("y"), F.count_distinct("g").alias("n")).collect()
    assert len(folds) == 5 and sum(r["y"] for r in folds) == 900 and all(120 <= r["y"] <= 240 and 330 <= r["n"] <= 470 for r in folds)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("k")).filter("k > 1").isEmpty()
    assert splits._place(df.limit(0), "g", 7).collect() == [] and splits.stratified_folds(df.limit(0), "g", "y").collect() == []
