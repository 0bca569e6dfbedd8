"""Personal data: base matches against Python's re, bootstrapped spans, masking."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import personal_data, queries

SF = "/root/testdata/sf0.01"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        worth = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if holds(k, m.group()))


TEXTS = [None, "", "a@b.c-x@d.e a@b.c_x@d.e x@y 1.2.3.4.5 999.1.1.1 001.02.3.255", "+1 (743) 555-3824 4994226020900891, +12 4111-1111-1111-1111 a@b@c.de", "é@x.yz héé 🙂 a.b@c.de", "9" * 30_000 + " " + "a" * 30_000 + "@ " + "1 " * 20_000 + "+1" + "." * 5000, "1.1.1.1", "1.1.1.1"]


def test_base_spans(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "x@y.zz", "")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in personal_data.find(df).collect()}
    assert {k: r["base"] for k, r in got.items()} == {k: base(t) for k, t in enumerate(TEXTS)} | {None: "email:0:6"}
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got.values())
    assert personal_data.find(df.limit(0)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@+ -()2_%é", max_size=60), min_size=20, max_size=20))
def test_base_spans_of_anything(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", personal_data.joined_text(personal_data.base_spans(F.col("text"))).alias("b"))
    assert {r["id"]: r["b"] for r in df.collect()} == dict(enumerate(map(base, texts)))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op8_personal_data(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        found = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(found.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [found.count(f"{k}:") for k in BASE]


@pytest.fixture(scope="module")
def announced(spark):
    rows = [(k, f"Some text. call me at +1 (555) 010-{1000 + k} after work, word{k} more") for k in range(40)]
    rows += [(100, "Some text. call me at (555) 010-2222 after work"), (101, "a count of 555 010 2222 things"), (102, "nothing at all here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_more(announced):
    got = {r["doc_id"]: r for r in personal_data.find(announced).collect()}
    assert got[100]["base"] == "" and got[100]["spans"] == "phone:22:36"
    assert got[101]["spans"] == "" and got[102]["spans"] == "" and got[0]["spans"] == got[0]["base"] != ""


def test_found_values_announce_further_contexts(spark):
    """Values found in a seeded context support a context where no base match stands, and that one finds more."""
    rows = [(k, f"Some text. call me at +1 (555) 010-{1000 + k} after work") for k in range(60)]
    rows += [(100 + k, f"Some text. call me at (555) 010-{2000 + k} after work") for k in range(8)]
    rows += [(200 + k, f"Other words. desk line (555) 010-{2000 + k} weekdays only") for k in range(8)]
    rows += [(300, "Other words. desk line (555) 010-3000 weekdays only"), (301, "a count of 555 010 4000 things")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[200 + k] == "phone:23:37" for k in range(8)) and got[300] == "phone:23:37" and got[301] == ""


def test_forms_find_more(spark):
    """A number that stands beside another, an address with other letters, one written out; not what breaks a kind's rules."""
    rows = [(k, f"w{k} +1 (555) 010-{1000 + k} v{k} u{k}.x@mail{k % 9}.example.com") for k in range(40)]
    odd = ["a +1 (456) 555-2186 12345678901234567 b", "on josé@mail3.example.com today", "u7 [at] mail4.example (dot) com no", "x (988) 555-24 y", "x 1 (988) 555-2485999999999999 y"]
    rows += [(100 + k, t) for k, t in enumerate(odd)]
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ("", "phone:2:19")
    assert got[101] == ("", "email:3:25") and got[102] == ("", "email:0:31")
    assert got[103] == ("", "") and got[104] == ("", "")


def plain_bootstrap(near):
    """(pattern, kind) to score, by loops over the rows of ``near``."""
    edges = {(p, n["instance"], n["seed"]): n["may"] for n in near for p in n["patterns"]}
    total, known = {}, {}
    for p, i, _ in edges:
        total.setdefault(p, set()).add(i)
    loose = {(p, i, k) for (p, i, s), may in edges.items() if s < 0 for k in range(4) if may >> k & 1}
    while True:
        seeds = {}
        for p, i, k in {(p, i, s) for p, i, s in edges if s >= 0} | {x for x in loose if known.get(x[1]) == x[2]}:
            seeds.setdefault((p, k), set()).add(i)
        patterns = {x: len(s) for x, s in seeds.items() if len(s) >= personal_data.SUPPORT}
        graph = [(p, i, k) for p, i, k in loose if (p, k) in patterns and known.get(i) != k]
        score = {x: n / (len(total[x[0]]) + personal_data.PRIOR) for x, n in patterns.items()}
        for _ in range(personal_data.ROUNDS):
            belief, gain = {}, {}
            for p, i, k in graph:
                belief[i, k] = max(belief.get((i, k), 0), score[p, k])
            for p, i, k in graph:
                gain[p, k] = gain.get((p, k), 0) + belief[i, k]
            score = {x: (n + gain.get(x, 0)) / (len(total[x[0]]) + personal_data.PRIOR) for x, n in patterns.items()}
        good = {x: v for x, v in score.items() if v >= personal_data.CONFIDENCE}
        best = {}
        for p, i, k in graph:
            if (p, k) in good and i not in known:
                best[i] = max(best.get(i, (0, 0)), (good[p, k], k))
        if not best:
            return good
        known |= {i: k for i, (_, k) in best.items()}


def test_bootstrap_against_loops(spark, announced):
    for df in (announced, spark.read.parquet(f"{SF}/documents.parquet")):
        scanned = personal_data.scan(df).cache()
        expected = plain_bootstrap([n for r in scanned.select("near").collect() for n in r["near"]])
        got = {(r["pattern"], r["kind"]): r["score"] for r in personal_data.bootstrap(scanned).collect()}
        assert got == pytest.approx(expected) and got


def test_masking(spark, announced, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in personal_data.masked(announced).collect()}
    assert texts[100] == "Some text. call me at [PHONE] after work" and texts[102] == "nothing at all here"
    monkeypatch.setattr(personal_data, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["text"] for r in personal_data.masked(announced).collect()} == texts
    odd = spark.createDataFrame([(1, None, 5), (1, "x@y.zz", 6), (1, "x@y.zz", 7), (None, "1.1.1.1 +1.1.1.1555555", 8)], "doc_id long, text string, n_chars long")
    out = personal_data.masked(odd)
    assert out.columns == odd.columns
    assert sorted((r["n_chars"], r["text"]) for r in out.filter("n_chars < 8").collect()) == [(5, None), (6, "[EMAIL]"), (7, "[EMAIL]")]
    assert "1.1" not in out.filter("n_chars = 8").first()["text"]
