"""Session operators: hand-made frames with ties, nulls, lone rows and empty tables, and the queries' SQL."""

import decimal
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.functions import scalars as S
from rankloom.operators import documents, encode, features, learn, metrics, quality, reports, splits, submission
from rankloom.operators import windows as W
from rankloom.plans.queries import ORACLE_SQL, QUERIES
from rankloom.sessions import order_sessions
from rankloom.sources import tables
from rankloom.storage import stored
from rankloom.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def options(spark):
    rows = [("a", 1, 10.0, 0), ("a", 2, 10.0, 1), ("a", 3, None, 0), ("a", 4, 30.0, 0), ("b", 5, 7.0, 1), (None, 6, 1.0, 0)]
    return spark.createDataFrame(rows, "ranker_id string, Id long, v double, selected int")


def by_id(df, *columns):
    return {r["Id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_ranks_with_ties_and_nulls(options):
    got = by_id(options.select("Id", W.ordinal_rank("v").alias("o"), W.average_rank("v").alias("a"), W.dense_rank("v").alias("d"), W.percentile_of("v").alias("p")), "o", "a", "d", "p")
    assert got[1] == (1, 1.5, 1, 0.25) and got[2] == (2, 1.5, 1, 0.25)
    assert got[3] == (None, None, None, None)
    assert got[4] == (3, 3.0, 2, 1.0)
    assert got[5] == (1, 1.0, 1, None)


def test_distinct_counts_null_once(options):
    assert by_id(options.select("Id", W.distinct_in_group("v").alias("n")), "n")[1] == (3,)


def test_windows_share_one_exchange(options):
    df = options.select("*", W.ordinal_rank("v"), W.average_rank("v"), W.from_mean("v"), W.group_size(), W.distinct_in_group("v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_features_on_an_empty_table(spark):
    from rankloom.sessions import order_sessions

    assert features.all_features(order_sessions(spark, SF).limit(0)).count() == 0


def test_every_feature_column_is_held_against_sql(spark):
    """The columns that the steps make are all among the results of queries that have SQL."""
    from rankloom.sessions import order_sessions

    options = order_sessions(spark, SF)
    made = set(features.all_features(options).columns) - set(options.columns) - {"avg_total_price", "avg_policy_compliant"}  # two that are joined
    compared = set()
    for name in ("all_features", "feature_copies_and_ranks", "layovers_and_trips", "other_features"):
        assert name in ORACLE_SQL
        compared |= set(QUERIES[name](spark, SF).columns)
    assert len(made) >= 77 and made - compared == set()


def test_durations_and_days(spark):
    df = spark.sql("select '01:30:00' d, timestamp_ntz '2020-01-01 23:00:00' a, timestamp_ntz '2020-01-03 22:00:00' b union all select 'x', null, null")
    got = df.select(S.duration_minutes(F.col("d")).alias("m"), S.whole_days(F.col("a"), F.col("b")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(90, 1), (None, None)]


def test_metrics_of_small_sessions(spark):
    """Sessions of unlike sizes: a tie that the id breaks, a positive at the end, none at all, one option."""
    rows = [("x", k, s, y) for k, s, y in ((10, 5.0, 0), (11, 5.0, 1), (12, -2.0, 0), (13, 0.5, 0))]
    rows += [("y", 20 + k, -float(k), int(k == 5)) for k in range(6)] + [("z", 30, 1.0, 0), ("z", 31, 2.0, 0), ("w", 40, 0.0, 1)]
    df = spark.createDataFrame(rows, "ranker_id string, Id long, predicted_score double, selected int")
    ranks = {"x": 2, "y": 6, "w": 1}  # none in z
    for k in (1, 2, 5, 6):
        assert metrics.hit_rate(df, k, 1).first()[0] == sum(r <= k for r in ranks.values()) / 4
    assert metrics.reciprocal_rank(df, 1).first()[0] == pytest.approx(sum(1 / r for r in ranks.values()) / 4)
    assert metrics.hit_rate(df, 6, 5).first()[0] == 1.0 and metrics.hit_rate(df, 3, 7).first()[0] == 0.0
    with pytest.raises(ValueError):
        metrics.hit_rate(df.drop("selected"), 3)


def test_hit_rate_grows_with_k(spark):
    row = QUERIES["ranking_summary"](spark, SF).first()
    hits = [row[f"hit_rate_{k}"] for k in metrics.KS]
    assert hits == sorted(hits) and hits[0] <= row["mrr"] <= 1


def test_submission_rules(spark):
    options = spark.createDataFrame([(100 + k, "s") for k in range(4)], "Id long, ranker_id string")
    good = spark.createDataFrame([(100, "s", 4), (101, "s", 2), (102, "s", 1), (103, "s", 3)], "Id long, ranker_id string, selected int")
    assert submission.validated(good, options).first()["valid"]
    assert not submission.validated(good.withColumn("selected", F.lit(1)), options).first()["valid"]
    assert not submission.validated(good.filter("Id > 100"), options).first()["same_rows"]
    assert not submission.validated(good.drop("selected"), options).first()["valid"]


def test_splits_cover_and_do_not_overlap(spark, options):
    train, rest = splits.split_by_groups(options.filter("ranker_id is not null"), ratio=0.5)
    assert train.count() + rest.count() == 5
    splits.assert_no_shared_groups(train, rest)
    with pytest.raises(ValueError):
        splits.assert_no_shared_groups(train, train)
    one = splits.group_folds(options.filter("ranker_id is not null"), folds=2)
    assert one.groupBy("ranker_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_fold_statistics_leave_the_own_fold_out(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 3.0), ("x", 1, 5.0), (None, 0, 2.0), (None, 1, 8.0), ("y", 0, 9.0)], "k string, fold int, v double")
    got = {(r["k"], r["fold"], r["v"]): (r["v_sum"], r["v_mean"], r["v_max"]) for r in splits.fold_aware(df, ["k"], {"v": ["sum", "mean", "max"]}).collect()}
    assert got[("x", 0, 1.0)] == (8.0, 4.0, 5.0) and got[("x", 1, 3.0)] == (1.0, 1.0, 1.0)
    assert got[(None, 0, 2.0)] == (8.0, 8.0, 8.0) and got[("y", 0, 9.0)] == (None, None, None)


def test_rare_levels(spark):
    rows = [(x,) for x in ["big"] * 60 + ["mid"] * 40 + list("abcdefghij") + [None]]
    got = {r["c"]: r["count"] for r in encode.collapse_rare(spark.createDataFrame(rows, "c string"), "c").groupBy("c").count().collect()}
    assert got == {"big": 60, "other": 50, None: 1}
    with pytest.raises(ValueError):
        encode.encode(spark.createDataFrame(rows, "c string"), "c", "other")


DOCS = [
    '{"ranker_id":"r1","data":{"$values":[{"id":"f1","pricings":[{"id":"p1","totalPrice":10,"miniRules":[{"category":31,"monetaryAmount":1},{"category":31,"monetaryAmount":2},{"category":33,"monetaryAmount":3}],"pricingInfo":[{"isAccessTP":true,"faresInfo":[{"fareFamilyKey":"k","cabinClass":1,"seatsAvailable":4,"baggageAllowance":{"quantity":2}},{"cabinClass":2}]},{"faresInfo":[]}]}]},5,"x"]}}',
    '{"ranker_id":"r2","data":[{"id":"f2","pricings":[{"id":"p2","totalPrice":7,"miniRules":[],"pricingInfo":[]}]},{"id":"f3","pricings":[{"id":"p3","totalPrice":8,"pricingInfo":[{"isAccessTP":false,"faresInfo":[{"cabinClass":1}]}]}]}]}',
    '{"data":[{"id":"f4","pricings":[{"id":"p4","totalPrice":1,"pricingInfo":[{"faresInfo":[{"cabinClass":1}]}]}]}]}',
    "not json",
    "[1, 2]",
]


def test_documents(spark):
    df = spark.createDataFrame([(f"d{k}.json", x) for k, x in enumerate(DOCS)], "file string, value string")
    got = sorted(((r["pricing_id"], r["cabin_class"], r["cancellation_fee"], r["exchange_fee"]) for r in documents.fares(df).collect()), key=str)
    assert got == [("p1", 1.0, 2.0, 3.0), ("p1", 2.0, 2.0, 3.0), ("p3", 1.0, None, None), ("p4", 1.0, None, None)]
    light = sorted((r["pricing_id"], r["cancellation_fee"]) for r in documents.pricings(df).select("pricing_id", F.coalesce("cancellation_fee", F.lit(-1.0)).alias("cancellation_fee")).collect())
    assert light == [("p1", 1.0), ("p3", -1.0)]
    assert [r["n_options"] for r in documents.headers(df).orderBy("ranker_id", "n_options").collect()][-2:] == [1, 2]
    assert documents.fares(df.limit(0)).count() == 0


def test_feature_map_and_census(spark):
    df = spark.createDataFrame([("a.json", '{"x":{"p":{"n":1},"q":{"n":2}},"l":[{"m":"u"},{"m":"v"}],"y":"7"}'), ("b.json", '{"y":"no"}')], "file string, value string")
    wanted = [{"path": "x.*.n", "name": "n", "dtype": "str"}, {"path": "l.*.m", "name": "m", "dtype": "str"}, {"path": "y", "name": "y", "dtype": "int"}]
    got = {r["ranker_id"]: (r["n"], r["m"], r["y"]) for r in documents.mapped(df, wanted, tables.file_stem()).collect()}
    assert got == {"a": ("1,2", "u,v", 7), "b": (None, None, None)}
    census = {r[0]: r[1] for r in documents.key_paths(df, "file").collect()}
    assert census == {"y": 100.0, "x": 50.0, "x.p": 50.0, "x.p.n": 50.0, "x.q": 50.0, "x.q.n": 50.0, "l": 50.0, "l.m": 50.0}


def test_key_paths_of_odd_documents(spark):
    """Types that agree, lists that mix kinds, a document over two rows, a null key, names with marks, no JSON."""
    rows = [("a", '{"a":null,"x":[1,{"b":1}]}'), ("b", '{"a":{}}'), ("c", '{"a":[1,"x",{"q":{"r":[]}}]}'), ("c", '{"z":1}'), ("d", '{"a":1.5}'), ("e", '{"a":22.25}'), ("f", "no"), (None, '{"a":7}'), ("g", '{"":{"y":1},"p q":2}')]
    df = spark.createDataFrame(rows, "file string, value string")
    held = {"a": "abcde?", "x": "a", "x.b": "a", "a.q": "c", "a.q.r": "c", "z": "c", "": "g", ".y": "g", "p q": "g"}
    assert {r[0]: r[1] for r in documents.key_paths(df, "file").collect()} == {p: round(100 * len(d) / 7, 2) for p, d in held.items()}
    assert documents.key_paths(df.limit(0), "file").collect() == []


def test_key_paths_of_documents_written_otherwise_at_each_read(spark):
    """Lists that a shuffle filled have another order, and so the text another hash, when they are read again."""
    text = F.udf(lambda k: '{"a": %s, "b": {"c": %d}}' % (random.SystemRandom().sample(range(100), 50), k), "string").asNondeterministic()
    df = spark.range(30, numPartitions=3).select(F.col("id").alias("file"), text("id").alias("value"))
    assert {r[0]: r[1] for r in documents.key_paths(df, "file").collect()} == {"a": 100.0, "b": 100.0, "b.c": 100.0}


@pytest.mark.parametrize("of", [documents.fares, documents.pricings, documents.headers, lambda d: documents.mapped(d, [{"path": "data.*.*.id", "name": "ids"}], F.col("file"))])
def test_documents_are_written_and_parsed_once(spark, of):
    """Neither the text nor its parse is copied into the filters of the explodes that read them."""
    df = spark.range(9).select(F.col("id").alias("file"), F.to_json(F.struct(F.col("id").cast("string").alias("ranker_id"), F.array().alias("data"))).alias("value"))
    plan = of(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("StructsToJsonEvaluator") == 1


def test_chosen_feature_columns_cost_no_bins(spark):
    """Breaks of the price bins take a count of all prices: not where no bin is wanted; the columns are the same."""
    df = order_sessions(spark, SF)
    made = []
    held, S.quantile_bins = S.quantile_bins, lambda *a: made.append(a) or held(*a)
    try:
        few = features.all_features(df, ["Id", "price_rank", "carrier_market_share"])
        assert not made and few.columns == ["Id", "price_rank", "carrier_market_share"]
        whole = features.all_features(df)
        assert len(made) == 1
    finally:
        S.quantile_bins = held
    assert few.exceptAll(whole.select(few.columns)).isEmpty() and few.count() == whole.count()


def test_folds_read_a_stored_table(spark, monkeypatch):
    """The fits of the folds read their rows several times each: they are computed once."""
    kept = []
    monkeypatch.setattr(learn, "stored", lambda df: kept.append(df) or stored(df))
    df = spark.range(40).selectExpr("id % 4 as ranker_id", "id as Id", "id % 2 as fold", "cast(id < 4 as int) as selected", "id * 1.0 as x")
    oof, _ = learn.cross_validated(df, ["x"], lambda d, f: learn.weighted({"x": 1.0}))
    assert len(kept) == 1 and oof.count() == 40


def test_permutation_importance_of_chosen_sessions(spark):
    """A bounded number of rows in whole sessions, and no session at all."""
    df = spark.range(4000).select((F.col("id") % 400).alias("ranker_id"), F.col("id").alias("Id"), (F.col("id") < 400).cast("int").alias("selected"), (-F.col("id")).alias("good"), F.rand(3).alias("idle"))
    model = learn.weighted({"good": 1.0, "idle": 0.0})
    for most in (None, 1000):
        drops = {r["feature"]: r["drop"] for r in learn.permutation_importance(df, model, ["good", "idle"], k=1, min_size=5, most=most).collect()}
        assert drops["good"] > 0.5 and drops["idle"] == 0.0
    assert [r["drop"] for r in learn.permutation_importance(df, model, ["good", "idle"], min_size=50).collect()] == [0.0, 0.0]


def test_blocks_must_have_unique_keys(spark, options):
    block = spark.createDataFrame([("a", 1), ("a", 2)], "ranker_id string, z int")
    with pytest.raises(ValueError):
        documents.join_blocks(options, [block])
    blocks = documents.feature_blocks(block, [{"path": "z", "name": "z", "dtype": "float"}], penalty="z")
    assert "flex_score" in blocks["z"].columns


def test_flex_score(spark):
    df = spark.range(100).select(F.col("id").alias("p"), S.flex_score(F.col("id")).alias("f"))
    assert df.filter(F.abs(F.col("f") - (1 - F.col("p") / 100)) > 1e-12).isEmpty()


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r["a"], r["b"]): r["r"] for r in quality.correlations(df, ["a", "b"]).collect()}[("a", "b")] is None


def test_pareto_and_loyalty(spark):
    df = spark.createDataFrame([("s", 1, 10.0, 5), ("s", 2, 10.0, 6), ("s", 3, 12.0, 5), ("s", 4, 12.0, 4), ("s", 5, 1.0, None)], "ranker_id string, Id long, totalPrice double, mins int")
    assert {k: v[0] for k, v in by_id(reports.pareto(df, duration="mins"), "is_dominated").items()} == {1: False, 2: True, 3: True, 4: False, 5: None}
    flyer = spark.createDataFrame([("SU/S7", "S7"), ("SU", "S7"), (None, "S7")], "frequentFlyer string, legs0_segments0_marketingCarrier_code string")
    assert [r["loyalty_match"] for r in reports.loyalty_match(flyer).collect()] == [True, False, None]


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(source)
    for k in range(3):
        (tmp_path / "in" / f"d{k}.json").write_text('{"a":\n1}')
    keep = lambda df: df.select("file", F.length("value").alias("n"))
    ingest.ingest(spark, source, out, state, keep)
    (tmp_path / "in" / "d3.json").write_text("{}")
    ingest.ingest(spark, source, out, state, keep)
    assert sorted(r["file"] for r in spark.read.parquet(out).collect()) == ["d0.json", "d1.json", "d2.json", "d3.json"]


def test_sources(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("ranker_id"))
    df.coalesce(1).write.parquet(str(tmp_path / "train.parquet"))
    root = str(tmp_path)
    assert tables.load_split(spark, root, "train", ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        tables.load_split(spark, root, "dev")
    assert tables.first_rows(spark, f"{root}/train.parquet", 7).count() == 7
    tables.write_hash_partitioned(df, f"{root}/full/train", n=4)
    back = tables.partitioned(spark, f"{root}/full", "train", view="options")
    assert back.count() == 50 and spark.table("options").count() == 50
    tables.write_by_extension(df, f"{root}/x.csv")
    assert tables.read_by_extension(spark, f"{root}/x.csv", "id long, ranker_id long").count() == 50
    with pytest.raises(ValueError):
        tables.read_by_extension(spark, f"{root}/x.txt")


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for k, folder in enumerate(("a", "a/b")):
        (tmp_path / folder / f"r{k}.json").write_text('{"x":\n1}')
    (tmp_path / "a" / "skip.txt").write_text("no")
    df = tables.json_documents(spark, str(tmp_path / "a")).select(tables.file_stem().alias("key"), "value")
    assert sorted(map(tuple, df.collect())) == [("r0", '{"x":\n1}'), ("r1", '{"x":\n1}')]
    assert tables.json_documents(spark, str(tmp_path / "a"), 1).count() == 1
    tables.write_small_csv(df, str(tmp_path / "csv"))
    tables.write_report(df, str(tmp_path / "json"))
    tables.append_parquet(df, str(tmp_path / "pq"))
    tables.append_parquet(df, str(tmp_path / "pq"))
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 1
    assert spark.read.schema("key string").json(str(tmp_path / "json")).count() == 2 and spark.read.parquet(str(tmp_path / "pq")).count() == 4


def test_feature_lists_and_types(spark):
    df = spark.sql("select true as f, timestamp_ntz '1970-01-01 00:00:01' as t, 'x' as s")
    assert features.chosen_features(df, ["s", "none"], ("f", "core")) == (["s"], ["core"])
    assert tuple(S.typed_for_learning(df).first()) == (1, 1_000_000, "x")


def test_test_table_has_no_label(spark, options):
    quality.no_label(options.drop("selected"))
    with pytest.raises(ValueError):
        quality.no_label(options)


def test_ranker_learns_and_is_saved(spark, tmp_path):
    rows = [(s, 10 * s + k, float((7 * s + 3 * k) % 10), int(k == 0)) for s in range(30) for k in range(5)]
    df = spark.createDataFrame(rows, "ranker_id long, Id long, noise double, selected int").withColumn("good", F.col("selected") * 2.0 + F.col("noise") / 100).withColumn("fold", F.col("ranker_id") % 2)
    model = learn.fit_pairwise(df, ["good", "noise"])
    learn.save(model, str(tmp_path / "m"))
    same = learn.scored(df, learn.load(str(tmp_path / "m")), ["good", "noise"])
    assert metrics.hit_rate(same, 1, 1).first()[0] == 1.0
    assert learn.importance(model, ["good", "noise"]).first()["feature"] == "good"
    both = learn.averaged(df, [model, model], ["good", "noise"])
    assert metrics.hit_rate(both, 1, 1).first()[0] == 1.0
    drops = {r["feature"]: r["drop"] for r in learn.permutation_importance(df, model, ["good", "noise"], k=1, min_size=5).collect()}
    assert drops["good"] > 0.4 and abs(drops["noise"]) < 0.2


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{v + 0.0:.5f}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(_norm(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLE_SQL) <= set(entry.queries())
