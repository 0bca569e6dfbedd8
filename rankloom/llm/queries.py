"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, byte_bpe, fingerprints, language_id, mixing, ngram_join, periodic_runs, personal_data, spelling_variants, token_counts, toxicity, warc, wrappers
from .common import table, text_of, words_of


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def _part(parts: int):
    """The fold of a document: the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _part(4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _part(5) == 0
    found = language_id.identify(docs, language_id.train(docs.filter(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip of every twentieth recording, cut, quieter and noisy, searched among all recordings."""
    names = {"id_column": "vec_id", "audio_column": "audio"}
    vectors = table(spark, sf_dir, "embeddings")
    recordings = audio.melodies(vectors, id_column="vec_id", vector_column="embedding")
    asked = audio.clips(audio.melodies(vectors.filter(F.col("vec_id") % 20 == 0), id_column="vec_id", vector_column="embedding"), **names)
    return audio.search(audio.fingerprints(recordings, **names), audio.fingerprints(asked, **names), id_column="vec_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def _tail_repeated(docs: DataFrame) -> DataFrame:
    """``docs``, every tenth one (by the CRC-32 of its id) with its words from one place on replaced by repeats of the first few of them; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = words_of(text_of())
    n, g = F.size("w"), F.floor(h / 10)
    start = F.pmod(g, n)
    period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")))
    return docs.select("doc_id", F.when(h % 10 == 0, words).alias("w"), "text").select("doc_id", F.when(F.size("w") > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_tail_repeated(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    top = F.col("top")
    return found.withColumn("top", periodic_runs.top_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), (-top["shorter"]).alias("length"), top["period"].alias("period"),
        F.floor(-1000 * top["shorter"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: A run of Latin letters.
LETTERS = r"[A-Za-z\u00C0-\u00FF]+"


def _words_with_errors(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, one letter taken out of those whose document and run hash to a multiple of 199; of at least 6 letters and 5 occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(LETTERS), 0)).alias("run"))
    h, size = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))), F.length("run")
    gone = F.pmod(h, size)
    word = F.when(h % 199 == 0, F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, size))).otherwise(F.col("run"))
    return runs.filter(size >= 6).select(word.alias("word")).filter(F.length("word") >= 6).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(_words_with_errors(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_personal_data": op8_personal_data,
    "op9_audio": op9_audio,
    "op10_ngram_join": op10_ngram_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_main_text": op12_main_text,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The CRC-32 of a text, byte by byte, its reversed polynomial applied eight times for each.
_CRC32 = "xor(list_reduce([4294967295] || [cast('0x' || substr(hex(encode({text})), 2 * k + 1, 2) as bigint) for k in range(octet_length(encode({text})))], lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE_SQL = {
    "op4_warc": """
with p as (
    select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest,
           cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes
    from pages
), g as (
    select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when g.first is not null and p.page_id is distinct from g.first then 'revisit' else 'response' end as record_type,
       case when g.first is not null and p.page_id is distinct from g.first then g.first end as refers_to
from p left join g using (payload_digest)
""",
    "op10_ngram_join": r"""
with recursive w as (
    select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] as w from documents
), s as (
    select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
                                        when len(w) > 0 then [array_to_string(w, ' ')] else [''] end) as gram
    from w
), n as (
    select doc_id, count(*) as n from s group by doc_id
), linked as (
    select p.a, p.b
    from (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id <> b.doc_id group by all) p
    join n x on x.doc_id = p.a join n y on y.doc_id = p.b
    where shared * 1.8 >= 0.8 * (x.n + y.n) - 1e-9
), reached as (
    select doc_id as a, doc_id as b from documents
  union
    select r.a, l.b from reached r join linked l on l.a = r.b
)
select c.doc_id, c.class_id, coalesce(d.n_links, 0) as n_links
from (select a as doc_id, min(b) as class_id from reached group by a) c
left join (select a, count(*) as n_links from linked group by a) d on d.a = c.doc_id
""",
    "op11_periodic_runs": rf"""
with e as (
    select doc_id, {_CRC32.format(text="cast(doc_id as varchar)")} as h, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents
), b as (
    select *, h // 10 % len(w) as a, h // 10 % 8 as more from e
), d as (
    select doc_id, case when h % 10 = 0 and len(w) > 0 then [w[1 + case when i < a then i else a + (i - a) % (1 + (len(w) - a) // (3 + more)) end] for i in range(len(w))] else w end as w from b
), s as (
    select doc_id, unnest(range(len(w) - 3)) as i, unnest([array_to_string(w[i + 1:i + 4], ' ') for i in range(len(w) - 3)]) as gram from d where len(w) >= 12
), m as (
    select x.doc_id, y.i - x.i as q, x.i from s x join s y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
), z as (
    select doc_id, q, min(i) as first, max(i) + 4 + q as after from (select *, i - row_number() over (partition by doc_id, q order by i) as island from m) group by doc_id, q, island
), r as (
    select doc_id, first, after, min(q) as q from z where after - first >= greatest(12, 2 * q) group by doc_id, first, after
), top as (
    select doc_id, count(*) as n_runs, arg_min(first, (first - after, first, q)) as "start", max(after - first) as "length", arg_min(q, (first - after, first, q)) as period,
           string_agg(first || ',' || (after - first) || ',' || q || chr(10), '' order by first, q) as runs
    from r group by doc_id
), repeated as (
    select distinct doc_id, unnest(range(first + q, after)) as i from r
), kept as (
    select x.doc_id, string_agg(x.word, ' ' order by x.i) as text from (select doc_id, unnest(range(len(w))) as i, unnest(w) as word from d) x anti join repeated using (doc_id, i) group by x.doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, "start", "length", period, 1000 * "length" // period as exponent_milli,
       sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join top using (doc_id) left join kept on kept.doc_id = d.doc_id
""",
    "op13_spelling_variants": rf"""
with recursive o as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents
), h as (
    select *, {_CRC32.format(text="doc_id || ':' || run")} as h from o where length(run) >= 6
), v as (
    select word, count(*) as n
    from (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from h)
    where length(word) >= 6 group by word having count(*) >= 5
), p as (
    select word, n, unnest([substr(word, 1, i - 1) || '*' || substr(word, i + 1) for i in range(1, length(word) + 1)]) as replaced,
           unnest([substr(word, 1, i - 1) || substr(word, i + 1) for i in range(1, length(word) + 1)]) as deleted from v
), near as (
    select x.word as a, y.word as b, x.n as n_a, y.n as n_b from p x join p y on x.replaced = y.replaced and x.word <> y.word
  union
    select p.word, v.word, p.n, v.n from p join v on p.deleted = v.word
  union
    select v.word, p.word, v.n, p.n from p join v on p.deleted = v.word
), f as (
    select a as word, count(*) as n_near, arg_min(b, (-n_b, b)) as form, arg_min(n_b, (-n_b, b)) as form_n, any_value(n_a) as n from near group by a
), g as (
    select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * v.n then form end as form, case when form_n >= 5 * v.n then form_n end as form_n
    from v left join f on f.word = v.word
), r as (
    select word, word as root, 0 as k from g
  union all
    select r.word, g.form, k + 1 from r join g on g.word = r.root where g.form is not null
)
select g.word, g.form, r.root, g.n, g.n_near, g.form_n from g join (select word, arg_max(root, k) as root from r group by word) r on r.word = g.word
""",
}
