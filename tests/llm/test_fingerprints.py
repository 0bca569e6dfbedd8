"""Fingerprints: edited texts and likeness against plain Python, neighbours, edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import fingerprints, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edits(rows):
    """{id: (text, edited, next)} of (id, text) with distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        out[i] = (t, t[: len(t) - half] + following[:half], following)
    return out


@pytest.mark.parametrize("bucket", [20_000, fingerprints.BUCKET_BYTES])
def test_edited_texts_and_likeness(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = fingerprints.edit_report(docs, fraction=1.0 - 2**-40)
    expected = edits([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r for r in exact.collect()}
    assert len(got) == len(expected) == docs.count()
    for i, (text, edited, following) in expected.items():
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(shingles(text), shingles(edited)), abs=1e-9)
        assert r["near_next"] == pytest.approx(jaccard(shingles(text), shingles(following)), abs=1e-9)


def test_estimates_are_close(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = edits([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    long = [(r["near_edited"], jaccard(shingles(expected[r["doc_id"]][0]), shingles(expected[r["doc_id"]][1]))) for r in queries.op5_fingerprints(spark, SF).collect() if r["n_chars"] > 2000]
    assert sum(abs(a - b) for a, b in long) / len(long) < 0.05


def test_equal_texts_and_edges(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "one"), (None, "null id"), (None, None), (6, "x" * 100_000), (7, "w " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bucket string")
    got = fingerprints.edit_report(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != by[5]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[3]["n_chars"] == 0 and by[4]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.edit_report(df.limit(0)).count() == 0
    lone = fingerprints.edit_report(df.filter("doc_id = 1")).first()
    assert lone["near_next"] == 1.0


def chain(rows):
    """The edited texts of (id, text) rows in any order, ids of any type: rows that are alike follow each other."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True)
    order += sorted((r for r in rows if r[0] is None), key=str)
    texts = [t or "" for _, t in order]
    return sorted((str(i), t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1], strict=True))


@pytest.mark.parametrize("kind", ["string", "long", "timestamp", "decimal(20,3)"])
@pytest.mark.parametrize("few", [0, 200_000])
def test_ids_of_any_type(spark, monkeypatch, kind, few):
    """Many buckets, repeated rows, null ids of one text."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 40)
    monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", few)
    names = [f"{k}" for k in range(3, 90)] if kind != "timestamp" else [f"2024-01-{1 + k % 28:02d} 01:02:03.{100000 + k}" for k in range(87)]
    rows = [(n, f"text {k} " + "abc" * (k % 7)) for k, n in enumerate(names)]
    rows += [rows[5]] * 40 + [(None, "no id")] * 30
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = fingerprints.edit_report(df).select(F.col("doc_id").cast("string"), "edited_sha256").collect()
    typed = [(r["doc_id"], r["text"]) for r in df.collect()]
    text = {str(r["doc_id"]): r["s"] for r in df.select("doc_id", F.col("doc_id").cast("string").alias("s")).collect()}
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(text[i]), hashlib.sha256(t.encode()).hexdigest()) for i, t in chain(typed))


def test_hot_id(spark):
    """Equal ids with unlike texts: every row has a follower, every text follows one."""
    rows = [(1, f"text {k}") for k in range(60)] + [(0, "last one")]
    pairs = fingerprints.followed(spark.createDataFrame(rows, "doc_id long, text string"), {"t": F.col("text")}).select("row.t", F.col("next.t").alias("n")).collect()
    assert sorted(r["t"] for r in pairs) == sorted(r["n"] for r in pairs) == sorted(t for _, t in rows)


def test_containment_and_merging(spark):
    a, b = " ".join(f"a{k}" for k in range(400)), " ".join(f"a{k}" for k in range(4000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("l"), (fingerprints.merged(F.col("a"), F.col("b")) == F.col("b")).alias("m")).first()
    assert r["c"] == 1.0 and r["l"] == pytest.approx(0.1, abs=0.03) and r["m"]


def test_packing_keeps_hashes_apart(spark):
    df = spark.range(1).select(fingerprints.packed(F.array(F.lit(1).cast("long"), F.lit(-1).cast("long"))).alias("p"), fingerprints.packed(F.expr("cast(array() as array<bigint>)")).alias("e"))
    assert tuple(df.first()) == ("AAAAAAH//////w==", "")
