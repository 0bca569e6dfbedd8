"""The pipeline: stages in order, what each does to its input, the last rows against tiktoken."""

import hashlib
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import byte_bpe, language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "personal_data", "mixing", "byte_bpe"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_clean_documents_stay(stages):
    before, known, unique, masked = (d.count() for d in stages[:4])
    assert known >= 0.98 * before and 0.8 * known <= unique < known and masked == unique


def test_decisions_take_effect(stages):
    masked = stages[3].filter(F.col("text").rlike(r"\[(EMAIL|IP|CARD|PHONE)\]"))
    assert masked.count() > 0 and stages[3].filter("n_chars <> length(text)").isEmpty()
    assert stages[3].filter(F.col("text").rlike(r"[a-z0-9]+@mail")).isEmpty()
    copies = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert max(copies.values()) <= 3


def test_last_rows(stages):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in stages[4].collect():
        ids = library.encode_ordinary(r["text"])
        expected.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(map(tuple, stages[5].collect())) == sorted(expected)


def test_run_hands_each_stage_the_rows_of_the_one_before(spark, monkeypatch):
    plus = lambda spark, docs, sf_dir: docs.select((F.col("doc_id") + 1).alias("doc_id"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", plus), ("b", plus), ("c", plus)])
    before = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum("doc_id"), F.count("doc_id")).first()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("doc_id")).first()[0] == before[0] + 3 * before[1]


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(map(tuple, stages[5].collect()), key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns with names that the stages use, stage by stage."""
    cat = "the cat is on the mat and that is it"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, cat, None, None, 5), (3, cat + " x@y.zz", "en", "s", 21), (3, cat + " x@y.zz", "en", "s", 21), (4, "x" * 50_000, None, "t", 50_000)]
    docs = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, size string, key long")
    out = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    assert all(out[n].columns == docs.columns for n in list(out)[:-1])
    known = {(r["doc_id"], r["text"]) for r in out["language_id"].collect()}
    assert known <= {(r[0], r[1]) for r in rows if r[1]}
    assert sorted(r["doc_id"] or 0 for r in out["ngram_join"].collect()) == [1, 3, 4]  # the text without an id is a near copy of 3
    masked = sorted(((r["doc_id"], r["text"], r["n_chars"], r["key"]) for r in out["personal_data"].collect()), key=lambda r: r[3])
    assert masked == [(1, None, None, 0), (2, "", 0, 1), (None, cat, len(cat), 2), *((3, cat + " [EMAIL]", len(cat) + 8, k) for k in (3, 4)), (4, "x" * 50_000, 50_000, 5)]
    assert {r["doc_id"] for r in out["mixing"].collect()} <= {None, 3, 4} and out["mixing"].count() <= 3 * 4
    assert {(r["doc_id"], r["n_tokens"] > 0) for r in out["byte_bpe"].collect()} == {(1, False), (2, False), (None, True), (3, True), (4, True)} and out["byte_bpe"].count() == 6


def test_any_names_of_columns(spark):
    names = ["__id", "__mark", "__of", "__spans", "__source", "__copies", "of_id", "of_mark", "OF_MARK_", "spans", "copy", "row", "host", "mark"]
    rows = [(k, "the cat is on the mat and that is it " * 3 + str(k // 2) + " a@b.cd", "en", "s", 5, *names) for k in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name


def test_no_ids(spark):
    """All ids null: every language learned, and no document lost for it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.train(docs.withColumn("doc_id", F.lit(None).cast("long")), per_language=100)
    assert known.languages == sorted(r[0] for r in docs.select("lang").filter("lang is not null").distinct().collect())
    kept = corpus_pipeline.known_languages(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), SF).count()
    assert kept >= 0.98 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
