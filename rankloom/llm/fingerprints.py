"""Document fingerprints: threshold-scaled sketches of word shingles.

``sketch(text)`` keeps every hash of a five-word shingle below a fixed fraction
of the hash range, so sketches of documents of any two sizes are comparable:
they merge by union, and shared hashes estimate both the Jaccard likeness and
how much of one document the other contains. A text with words but no hash
below the threshold keeps its smallest one.

``edit_report`` holds each document against the one that follows it in
descending order of id and against a text made of both. Neighbours are found
without a global sort in one task: ids are cut into buckets of about
``BUCKET_BYTES`` by range partitioning, and the first row of each bucket is also
sent, as a guest, to the bucket before it. The ends of the buckets are known to
every task: two ids and hashes for each ``BUCKET_BYTES``, some 40 MB for 100 TB.

All of it is DataFrame expressions. Defined results: ids are of any type that can
be sorted; words are lower-cased and separated by blanks; a text of one to
four words is one shingle; a text without
words (or null, which counts as empty) has an empty sketch, like another empty
one (1.0), unlike all others (0.0); a lone document follows itself; equal ids
are ordered by a hash of their texts; rows alike in id and text follow each other,
the last of them the next document; null ids come last; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_of, words_of

SHINGLE = 5
#: The part of all shingle hashes that a sketch keeps.
FRACTION = 0.25
BUCKET_BYTES = 128 << 20
#: Buckets for each core, where the texts are few.
LEAST_BUCKETS = 4
#: At most so many (id, hash) pairs of repeated rows are broadcast.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """A hash of each run of ``width`` words; of all words where they are fewer; none without words."""

    def runs(hashes: Column) -> Column:
        n = F.size(hashes)
        whole = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        few = F.array(F.xxhash64(F.concat_ws(" ", hashes.cast("array<string>"))))
        return F.when(n >= width, whole).when(n > 0, few).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, fraction: float = FRACTION, width: int = SHINGLE) -> Column:
    """The sorted distinct shingle hashes below ``fraction`` of the range of hashes."""
    limit = int(fraction * 2**64) - 2**63

    def kept(hashes: Column) -> Column:
        return let(F.filter(hashes, lambda h: h < limit), lambda low: F.when((F.size(low) > 0) | (F.size(hashes) == 0), F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes))))

    return let(shingle_hashes(text, width), kept)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1))))


def containment(a: Column, b: Column) -> Column:
    """The estimated part of a's shingles that b has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.sort_array(F.array_union(a, b))


def packed(hashes: Column) -> Column:
    """A sketch as text: the low 40 bits of each hash, in order, as base64."""
    return F.base64(F.unhex(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit((1 << 40) - 1))), 10, "0")), "")))


def _bucketed(keys: DataFrame, buckets: int) -> tuple[Column, Column, int]:
    """(the bucket of a row's (id, tie), whether the row is the last of its bucket, the number of buckets); buckets ascend."""
    key = F.struct("id", "tie")
    ranges = keys.repartitionByRange(buckets, "id", "tie").groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    ends = ranges.agg(F.count(F.lit(1)).alias("n"), *(F.to_json(F.sort_array(F.collect_list(c)), exact).alias(c) for c in ("low", "high"))).first()
    kind = f"array<struct<id: {keys.schema['id'].dataType.simpleString()}, tie: bigint>>"
    low, high = (F.from_json(F.lit(ends[c]), kind, exact) for c in ("low", "high"))
    # binary search for the last low end that is not above the key: steps of halving length
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(int(ends["n"]).bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < ends["n"]) & (F.get(low, at + step) <= key), at + step).otherwise(at))
    return place, key == F.get(high, F.col("bucket")), ends["n"]


def followed(docs: DataFrame, columns: dict[str, Column], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``columns`` of each row, and as ``next`` those of the row that follows by descending id; after the last comes the first.

    Every row gets a follower, a lone row itself.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    made = lambda df: df.select("id", "tie", F.struct(*(c.alias(n) for n, c in columns.items())).alias("row"))
    keys = checkpointed(rows.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("bytes")))
    n, size, repeated = keys.agg(F.count(F.lit(1)), F.sum("bytes"), F.count_if(F.col("copies") > 1)).first()
    if not n:
        return made(rows).select("id", "row", F.col("row").alias("next"))
    others = None
    if repeated:
        # one of the rows that are alike meets the others; the rest follow each other
        many = keys.filter("copies > 1").select(F.col("id").alias("of"), F.col("tie").alias("as"), "copies")
        many = F.broadcast(many) if repeated <= BROADCAST_ROWS else many
        same = rows["id"].eqNullSafe(F.col("of")) & (rows["tie"] == F.col("as"))
        one = checkpointed(rows.join(many, same).select("id", "tie", "text", "copies").dropDuplicates(["id", "tie"]))
        others = made(one.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("copies")))))
        rows = rows.join(many, same, "left_anti").unionAll(one.select("id", "text", "tie"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    bucket, is_last, buckets = _bucketed(keys, max(math.ceil(size / BUCKET_BYTES), min(n, LEAST_BUCKETS * cores)))
    stays = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    visits = F.struct(F.pmod(F.col("bucket") + 1, F.lit(buckets)).cast("int").alias("to"), F.lit(True).alias("guest"))
    # columns are computed before the rows are dealt out, once for the row and its guest
    dealt = made(rows).withColumn("bucket", bucket).withColumn("sent", F.explode(F.when(is_last, F.array(stays, visits)).otherwise(F.array(stays)))).select("id", "tie", "row", "sent.*")
    w = Window.partitionBy("to").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    out = dealt.withColumn("next", F.lead("row").over(w)).filter(~F.col("guest")).select("id", "row", "next")
    return out if others is None else out.unionAll(others.select("id", "row", F.col("row").alias("next")))


def edit_report(docs: DataFrame, *, fraction: float = FRACTION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, contained (of the document in its edited text)."""
    text = text_of(text_column)
    pairs = followed(docs.select(docs[id_column].alias(id_column), text.alias(text_column)), {"text": F.col("text"), "sketch": sketch(F.col("text"), fraction)}, id_column=id_column, text_column=text_column)
    n = F.length("row.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("row.text"), n - half), F.left(F.col("next.text"), half))
    made = pairs.select(F.col("id").alias(id_column), n.cast("long").alias("n_chars"), F.col("row.sketch").alias("own"), F.col("next.sketch").alias("following"), edited.alias("edited"))
    made = made.select(id_column, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "following", sketch(F.col("edited"), fraction).alias("changed"))
    own, changed = F.col("own"), F.col("changed")
    return made.select(id_column, "n_chars", "edited_sha256", packed(own).alias("fingerprint"), packed(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"), containment(own, changed).alias("contained"))
