"""Files of many parts, band joins, sketches that merge, and learning against closed forms."""

import gzip
import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.operators import documents, learn, metrics, sketches
from rankloom.plans import queries
from rankloom.sources import files, tables
from rankloom.storage import shared_dir
from rankloom.streaming import ingest


def test_first_rows_of_a_folder(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    names = sorted(tmp_path.glob("many/part-*.parquet"))
    order = [x for n in names for x in pq.read_table(n)["id"].to_pylist()]
    for most in (1000, 0):
        monkeypatch.setattr(tables, "MOST_NAMED", most)
        for n in (0, 1, 142, 143, 144, 500, 1000, 5000):
            assert sorted(r["id"] for r in tables.first_rows(spark, path, n).collect()) == sorted(order[:n])
    assert tables.first_rows(spark, path, 10).columns == ["id"]


def test_row_groups_are_bounded(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        tables.append_parquet(spark.range(2500).coalesce(1), path, rows_per_group=1000)
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/part-*.parquet")]
    assert len(groups) == 2 and all(m.row_group(k).num_rows <= 1000 for m in groups for k in range(m.num_row_groups)) and sum(m.num_rows for m in groups) == 5000


def test_packed_documents(spark, tmp_path):
    (tmp_path / "in/a/b").mkdir(parents=True)
    texts = {f"d{k}": "{" + f'"x":\n"{"y" * 100}{k}"' + "}" for k in range(40)}
    for k, (name, text) in enumerate(texts.items()):
        (tmp_path / "in" / ("a/b" if k % 2 else "a") / f"{name}.json").write_text(text)
    (tmp_path / "in/skip.txt").write_text("no")
    packed = tables.pack_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=1000)
    assert {r["file"].removesuffix(".json"): r["value"] for r in packed.collect()} == texts
    assert 2 <= len(list(tmp_path.glob("out/part-*"))) <= 6
    (tmp_path / "none").mkdir()
    assert tables.pack_documents(spark, str(tmp_path / "none"), str(tmp_path / "out2")).count() == 0


def test_documents_under_their_names(spark, tmp_path):
    root = tmp_path / "in"
    rows = [("a/x.json", '{"é":\n1}'), ("a/b/y.json", ""), ("z.json", "z" * 100_000), (None, "no"), ("no.json", None)]
    for text in ("old", '{"é":\n1}'):
        files.write_documents(spark.createDataFrame([("a/x.json", text), *rows[1:]], "name string, value string"), f"file://{root}")
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == dict(rows[:3])
    files.write_documents(spark.createDataFrame([], "name string, value string"), f"file://{tmp_path}/none")


def test_packing_small_files_takes_few_tasks(spark, tmp_path):
    files.write_documents(spark.range(80).select(F.concat("id", F.lit(".json")).alias("name"), F.lit("{}").alias("value")), str(tmp_path / "in"))
    name, sc = "spark.sql.files.openCostInBytes", spark.sparkContext
    held = spark.conf.get(name)
    spark.conf.set(name, 128 << 20)  # a task for each file
    sc.setJobGroup("packing", "")
    try:
        assert tables.pack_documents(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 80
    finally:
        spark.conf.set(name, held)
        sc.setJobGroup("", "")
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("packing") for s in sc.statusTracker().getJobInfo(j).stageIds]
    tasks = [i.numTasks for i in map(sc.statusTracker().getStageInfo, stages) if i]
    assert tasks and max(tasks) <= 8 * sc.defaultParallelism


def test_documents_below_folders(spark, tmp_path):
    """A file for each customer, named by it, and all orders of it, also of one who has very many."""
    rng = random.Random(5)
    orders = [(k, k % 300 if k < 900 else 7, "FOP"[k % 3], rng.randrange(100_000) / 4, f"{k % 5 + 1}-X") for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("files-*"))
    got = {r["ranker_id"]: tuple(r)[1:] for r in queries.documents_below_folders(spark, str(tmp_path)).collect()}
    of = {c: [o for o in orders if o[1] == c] for c in range(300)}
    assert got == {str(c): (len(x), round(sum(o[3] for o in x), 4), max(o[4] for o in x)) for c, x in of.items()}
    (made,) = set(root.glob("files-*")) - before
    assert sorted((int(p.parent.name.removeprefix("folder=")), int(p.stem)) for p in (made / "in").rglob("*.json")) == sorted((c % 10, c) for c in range(300))


def test_incremental_ingest_keeps_little_on_disk(spark, tmp_path):
    """All lines of all orders, also of one with very many; what stays on disk is a small part of the documents' texts."""
    rng = random.Random(6)
    lines = [(k // 4 if k < 16_000 else 3, rng.randrange(20_000), k % 7 + 1, rng.choice([None, rng.randrange(10**7) / 100]), k % 9 / 100, None if k % 11 == 0 else k % 10 / 100, float(k % 50), "NAR"[k % 3]) for k in range(20_000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_tax double, l_discount double, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("files-*"))
    got = {r["ranker_id"]: (r["n_prices"], r["total"]) for r in queries.incremental_ingest(spark, str(tmp_path)).collect()}
    of = {}
    for x in lines:
        of.setdefault(str(x[0]), []).append(x[3])
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in of.items()}
    assert all(got[k][1] == (pytest.approx(sum(known), abs=1e-4) if known else None) for k, v in of.items() for known in [[p for p in v if p is not None]])
    (made,) = set(root.glob("files-*")) - before
    texts = queries.order_documents(spark, str(tmp_path)).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    taken = spark.read.text(f"{made}/in").agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert taken == texts > 5 * sum(p.stat().st_size for p in made.rglob("*") if p.is_file())


def test_ingest_of_packed_and_plain_files(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    write = {"gz": lambda p, x: p.write_bytes(gzip.compress(x.encode())), "txt": lambda p, x: p.write_text(x)}
    for k, kind in enumerate(("gz", "txt", "gz", "txt")):
        write[kind](tmp_path / "in" / f"part-{k}.txt".replace(".txt", ".txt.gz" if kind == "gz" else ".txt"), f'{{"n":{k}}}\n{{"é":{k}}}\n')
        ingest.ingest(spark, source, out, state, lambda df: df.select("value"), pattern="part-*", lines=True)
        assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == sorted(f'{{"{x}":{j}}}' for j in range(k + 1) for x in "né")


def test_options_that_are_no_objects(spark):
    """Of options, pricings and fares what is of another kind is null on its own: what stands beside it stays."""
    good = '{"id":1,"pricings":[{"id":"p","totalPrice":"3.5","pricingInfo":[{"faresInfo":[{"fareFamilyKey":"k","baggageAllowance":{"quantity":"q"}}]}]},7,null]}'
    data = [f'{{"$values":[1,null,"x",{good},[{good}]]}}', f'[{good},{{"pricings":{good}}},{{"pricings":null}},3.5]', '{"$values":5}', '{"$values":null}', "7", "null", f'{{"$values":{{"a":{good}}}}}', '{"$values":[]}']
    df = spark.createDataFrame([(f'{{"ranker_id":"{k}","data":{x}}}',) for k, x in enumerate(data)] + [("7",), (None,), (f'{{"data":[{good}]}}',)], "value string")
    assert sorted(map(tuple, documents.pricings(df).collect())) == [(k, "1", "p", 3.5, "k", None, None) for k in "01"]
    assert sorted(tuple(r)[:4] for r in documents.fares(df).collect() if r["ranker_id"]) == [(k, "1", "p", 3.5) for k in "01"]
    assert {r["ranker_id"]: r["n_options"] for r in documents.headers(df).filter("ranker_id is not null").collect()} == {"0": 1, "1": 3, **{str(k): 0 for k in range(2, 8)}}


@pytest.mark.parametrize("within", [0.01, 0.5, 3.0])
def test_band_join(spark, within):
    """Nearest price within the tolerance, on both sides of bins' borders, with ties, nulls and repeated rows."""
    rng = random.Random(4)
    price = lambda: rng.choice([None, -1.0, 0.0, rng.randrange(-20, 60) / 4, rng.randrange(100) / 100])
    options = [(rng.choice("ab"), rng.randrange(6), price(), k) for k in range(120)]
    options += options[:5]
    priced = [(rng.choice("ab"), str(rng.randrange(6)), price(), f"p{k}") for k in range(200)]
    got = documents.join_prices_within(spark.createDataFrame(options, "ranker_id string, Id long, totalPrice double, n int"), spark.createDataFrame(priced, "ranker_id string, flight_id string, total_price_json double, pricing_id string"), within)
    assert got.columns == ["ranker_id", "Id", "totalPrice", "n", "total_price_json", "pricing_id"]
    want = []
    for g, i, p, n in options:
        near = [(abs(p - q), q, x) for h, j, q, x in priced if p is not None and q is not None and (h, j) == (g, str(i)) and abs(p - q) <= within]
        want.append((g, i, p, n, *(min(near)[1:] if near else (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        documents.join_prices_within(got, got, 0)


def test_sketches_merge(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 9).alias("day"), (F.col("id") * 7919 % 5003).alias("n"), F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).alias("s"), F.lit(None).cast("double").alias("none"), (F.col("id") % 100).cast("decimal(8,2)").alias("d"))
    columns = ["n", "s", "none", "d"]
    sketches.sketched(df, columns, ["day"]).write.partitionBy("day").parquet(str(tmp_path / "s"))
    parts = spark.read.parquet(str(tmp_path / "s"))
    got = {r["column"]: r for r in sketches.read_off(sketches.merged(parts)).collect()}
    whole = {r["column"]: r for r in sketches.read_off(sketches.sketched(df, columns)).collect()}
    for c in columns:
        exact = df.agg(F.count(F.lit(1)), F.count_if(F.col(c).isNull()), F.count_distinct(c)).first()
        assert (got[c]["n_rows"], got[c]["n_null"]) == (exact[0], exact[1])
        assert got[c]["n_distinct"] == whole[c]["n_distinct"] and abs(got[c]["n_distinct"] - exact[2]) <= 0.03 * exact[2]
        assert (got[c]["least"], got[c]["greatest"]) == (whole[c]["least"], whole[c]["greatest"])
    for c in ("n", "d"):
        values = sorted(float(r[0]) for r in df.select(c).collect())
        for p in (0.01, 0.25, 0.5, 0.95):
            at = got[c][f"p{round(100 * p)}"]
            below, upto = sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)
            assert below - 0.01 <= p <= upto + 0.01
    assert got["none"]["p50"] is None and got["s"]["p50"] is None and got["none"]["n_distinct"] == 0
    days = sketches.merged(parts, ["day"])
    assert days.count() == 9 * 4 and sketches.read_off(sketches.merged(parts.limit(0))).collect() == []


ROWS = [("a", 1, 1, [1.0, 0.0]), ("a", 2, 0, [0.0, 2.0]), ("a", 3, 0, [-1.0, 1.0]), ("b", 4, 0, [800.0, 1.0]), ("b", 5, 1, [2.0, 2.0]), ("c", 6, 0, [1.0, 1.0]), (None, 7, 1, [3.0, 0.0])]


def test_listwise_gradient_equals_a_loop(spark):
    df = spark.createDataFrame(ROWS, "ranker_id string, Id long, selected int, x array<double>")
    weights = [0.7, -1.2]
    loss, slope, n = 0.0, [0.0, 0.0], 0
    for g in {r[0] for r in ROWS}:
        rows = [r for r in ROWS if r[0] == g]
        if not any(r[2] for r in rows):
            continue
        n += 1
        scores = [sum(w * v for w, v in zip(weights, r[3], strict=True)) for r in rows]
        top = max(scores)
        z = sum(math.exp(s - top) for s in scores)
        loss += -sum(s - top - math.log(z) for s, r in zip(scores, rows, strict=True) if r[2])
        for k in range(2):
            slope[k] += sum(math.exp(s - top) / z * r[3][k] for s, r in zip(scores, rows, strict=True)) - sum(r[3][k] for r in rows if r[2])
    row = learn.softmax_gradient(df, weights).first()
    assert row["n_groups"] == n == 3 and row["loss"] == pytest.approx(loss / n) and list(row["gradient"]) == pytest.approx([x / n for x in slope])
    assert learn.softmax_gradient(df.limit(0), weights).first()["n_groups"] == 0


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(s, 11 * s + k, float((7 * s + 3 * k) % 10), int(k == 0)) for s in range(30) for k in range(11)]
    return spark.createDataFrame(rows, "ranker_id long, Id long, noise double, selected int").withColumn("good", F.col("selected") * 2.0 + F.col("noise") / 100).withColumn("fold", F.col("ranker_id") % 2)


def test_listwise_ranker_learns_and_is_saved(spark, sessions, tmp_path):
    model = learn.fit_listwise(sessions.withColumn("flat", F.lit(1.0)), ["good", "noise", "flat"], steps=12)
    learn.save(model, str(tmp_path / "m"))
    same = learn.scored(sessions.withColumn("flat", F.lit(1.0)), learn.load(str(tmp_path / "m")), ["good", "noise", "flat"])
    assert metrics.hit_rate(same, 1, 1).first()[0] == 1.0


def test_halving_ends_with_the_best_of_the_full_search(spark, sessions):
    def fit(df, features, flip):
        return learn.weighted({"good": -1.0 if flip else 1.0})

    found = learn.halved(sessions, ["good"], {"flip": [True, False]}, fit=fit, keep=2, rounds=2)
    rows = sorted(map(tuple, found.collect()))
    assert [r[:3] for r in rows] == [(1, 0.5, "{'flip': False}"), (1, 0.5, "{'flip': True}"), (2, 1.0, "{'flip': False}")]
    assert rows[-1][3] == learn.search(sessions, ["good"], {"flip": [True, False]}, fit=fit).first()["ndcg"] == 1.0


def test_attributions(spark, sessions):
    """Of a linear ranker: weight times distance; of any: gains sum up to the score less the base's."""
    weights = {"good": 3.0, "noise": -0.5}
    base = {"good": 0.5, "noise": 4.0}
    sample = sessions.limit(20).withColumn("noise", F.when(F.col("Id") % 5 != 0, F.col("noise")))
    got = {(r["Id"], r["feature"]): r["gain"] for r in learn.attributions(sample, learn.weighted(weights), list(weights), base).collect()}
    for r in sample.collect():
        for c, w in weights.items():
            assert got[r["Id"], c] == pytest.approx(w * ((r[c] if r[c] is not None else base[c]) - base[c]))
    trees = learn.fit_pointwise(sessions, ["good", "noise"], trees=2, depth=2)
    sums = {r["Id"]: r["s"] for r in learn.attributions(sessions.limit(10), trees, ["good", "noise"], base, draws=2).groupBy("Id").agg(F.sum("gain").alias("s")).collect()}
    score = {r["Id"]: r["predicted_score"] for r in learn.scored(sessions.limit(10), trees, ["good", "noise"]).collect()}
    zero = learn.scored(spark.createDataFrame([(1, 0.5, 4.0)], "Id long, good double, noise double"), trees, ["good", "noise"]).first()["predicted_score"]
    assert all(sums[i] == pytest.approx(score[i] - zero) for i in score)


def test_price_joins_broadcast_no_pricings(spark, tmp_path):
    """Pricings are as many as options, and files tell little of their number: neither join may collect them."""
    spark.range(50).select((F.col("id") % 5).alias("ranker_id"), F.col("id").alias("Id"), (F.col("id") * 1.5).alias("totalPrice")).write.parquet(f"{tmp_path}/o")
    options = spark.read.parquet(f"{tmp_path}/o")
    priced = options.select(F.col("ranker_id").cast("string").alias("ranker_id"), F.col("Id").cast("string").alias("flight_id"), (F.col("totalPrice") + 0.25).alias("total_price_json"))
    for joined in (documents.join_prices_within(options, priced, 0.5), documents.join_prices(options, priced, 2)):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert documents.join_prices_within(options, priced, 0.5).filter("total_price_json - totalPrice = 0.25").count() == 50
