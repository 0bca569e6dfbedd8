"""Places, running totals and quantiles by ranges, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import encode, ordered, quality, splits


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp"])
@pytest.mark.parametrize("per_range", [1, 50, 100_000])
def test_running_totals(spark, kind, per_range):
    value = {"long": F.col("id"), "string": F.concat(F.lit("http://host/"), F.col("id")), "double": F.col("id") / 7, "timestamp": F.timestamp_seconds("id")}[kind]
    counts = spark.range(300).repartition(5).select(F.when(F.col("id") > 0, value).alias("v"), (F.col("id") % 4 + 1).alias("n"))
    got = {r["v"]: (r["__upto"], r["__all"]) for r in ordered.running(counts, [], "v", "n", per_range=per_range).collect()}
    rows = sorted((r for r in counts.collect()), key=lambda r: (r["v"] is None, r["v"] if r["v"] is not None else 0))
    total = 0
    for r in rows:
        total += r["n"]
        assert got[r["v"]] == (total, sum(x["n"] for x in rows))


@pytest.mark.parametrize("per_range", [3, 100_000])
def test_quantiles_of_groups(spark, per_range):
    """Groups of very unequal size, a null one too, each with quantiles of its own."""
    df = spark.range(2000).select(F.when(F.col("id") % 3 != 0, F.least(F.col("id") % 50, F.lit(7))).alias("g"), (F.col("id") * F.col("id") % 97).cast("double").alias("v"))
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = [0.0, 0.1, 0.5, 0.93, 1.0]
    want = {r["g"]: r for r in df.groupBy("g").agg(F.percentile("v", parts).alias("a"), F.array(*(F.expr(f"percentile_disc({p}) within group (order by v)") for p in parts)).alias("b")).collect()}
    for discrete in (False, True):
        got = {r["g"]: r["quantiles"] for r in ordered.quantiles_of(counts, ["g"], "v", "n", parts, discrete=discrete, per_range=per_range).collect()}
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]["b" if discrete else "a"]) for g in got)


def test_quantiles(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") * F.col("id") % 97).alias("v"))
    parts = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    exact = df.agg(F.percentile("v", parts).alias("a"), F.array(*(F.expr(f"percentile_disc({p}) within group (order by v)") for p in parts)).alias("b")).first()
    assert ordered.quantiles(df, "v", parts).first()[0] == pytest.approx(exact["a"])
    assert ordered.quantiles(df, "v", parts, discrete=True).first()[0] == pytest.approx(exact["b"])
    assert ordered.quantiles(df.filter("false"), "v", [0.5]).first()[0] == [None]
    assert ordered.quantiles(df.filter("v is null"), "v", [0.5]).count() == 1


def test_profiles_read_their_input_twice_at_most(spark, tmp_path):
    """Whatever the number of columns: the input's files are in the plan once at most, beside the one pass that is counted."""
    columns = [f"c{k}" for k in range(12)]
    spark.range(500).select(*((F.col("id") * (k + 3) % 101).alias(c) for k, c in enumerate(columns))).withColumn("c3", F.lit(None).cast("int")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    for found in (quality.outlier_profile(df, columns), quality.described(df, columns)):
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert sum("Location" in x and str(tmp_path) in x for x in plan.splitlines()) <= 1
        rows = {r["column"]: r for r in found.collect()}
        assert set(rows) == set(columns) and rows["c3"]["min"] is None and rows["c0"]["max"] == 100


def test_temporal_split_of_ties_and_nulls(spark):
    rng = random.Random(6)
    for dates, ties in ((5, 1000), (1, 1000), (3, 2), (1, 1), (40, 7)):
        rows = [(rng.choice([None, *range(dates)]) if dates > 2 else 0, rng.choice([None, *range(ties)]), k % 3) for k in range(61)]
        df = spark.createDataFrame(rows, "d int, Id int, x int")
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0))
        for ratio in (0.0, 0.3, 0.5, 0.8, 1.0):
            a, b = (sorted(map(tuple, x.collect()), key=repr) for x in splits.temporal_split(df, "d", ratio))
            k = int(len(rows) * ratio)
            assert sorted(a + b, key=repr) == sorted(rows, key=repr) and len(a) == k
            keys = lambda rs: sorted((r[:2] for r in rs), key=repr)
            assert keys(a) == keys(order[:k])
    a, b = splits.temporal_split(df.limit(0), "d")
    assert a.collect() == b.collect() == []


def test_sides_of_a_temporal_split_are_filters(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("d"), F.col("id").alias("Id"))
    for side in splits.temporal_split(df, "d", 0.55):
        assert not any(x in plan_of(side) for x in ("Window", "Join", "Aggregate"))


def test_no_window_over_all_rows(spark, capsys):
    df = spark.range(100).select((F.col("id") % 7).cast("string").alias("v"))
    encode.ordinal(df, "v").explain()
    windows = [x for x in capsys.readouterr().out.splitlines() if " Window [" in x or "- Window" in x]
    assert len(windows) == 1 and "__range" in windows[0]
