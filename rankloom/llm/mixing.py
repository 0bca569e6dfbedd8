"""Mixing sources to target weights by pivotal dependent rounding.

``mix(docs, weights)`` says how often the mix takes each document. A source's
target is its share of all words, by weight, but never above ``ceiling`` times
its own size; what is cut off goes to the others by weight until none is above.
A document's fractional number of copies is target / source size. The whole part
is taken; the fractions are rounded to 0 or 1 dependently: within a chunk the
documents are paired one after another, and a random transfer of words between
the two makes one of them integral and leaves the sum of words as it was. What
remains of each chunk, one fractional document at most, is paired again in
chunks of the next level, up a reduction tree with one chunk per source at its
root, whose remainder goes to the nearer side. So the words taken from a source
differ from its target by at most half of one document.

Everything is DataFrame work. The text is read once, for its number of words;
what follows handles narrow rows, kept by ``checkpoint()``. Chunks are dealt by
a hash, so a source with a third of all rows is many chunks. Random numbers are
hashes of ids and texts, so reruns agree, however rows are partitioned. Rows alike in id,
source and text are one unit, whose number of copies in all is rounded as one: they
are dealt to its rows evenly, some rows one more than others.

Defined results: a null text has size 0; a document of size 0 is taken 0 words
and 0 copies; the null source is the last; null ids, equal ids and repeated rows are
rows like others; which of the rows of a unit ``mixed`` takes once more than the others is not said
(they differ in other columns only); an empty table gives an empty result; a source of size 0 has
target 0. ``mix`` does not read other columns of the input, ``mixed`` hands them on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, free_names, text_of

#: Documents that one fold handles at each node of the reduction tree.
FAN_IN = 64
WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0
#: A table of at most so many sources (of a few hundred bytes each) is broadcast.
BROADCAST_SOURCES = 20_000
#: Rows of a unit that are written out at once.
STRETCH = 4096
#: A fraction this near 0 or 1 is rounding noise of the division.
NOISE = 1e-12


def _numbered(sources: DataFrame) -> DataFrame:
    """With ``place``, the 0-based rank by code point, nulls last, without one task for all.

    Range partitions are numbered among themselves; the counts before each of
    them, one number per partition, come from a small aggregate.
    """
    held = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = held.groupBy("part").count().collect()  # one row per partition
    before, total = {}, 0
    for row in sorted(counts, key=lambda r: r["part"]):
        before[row["part"]], total = total, total + row["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    if not before:
        return held.select("*", F.lit(0).cast("long").alias("place"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    return held.select("*", (start + within).cast("long").alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """``sources`` (source, source_size, n) with the target of each.

    The level that the unlimited sources share rises until none is above its
    ceiling; each round is one aggregate over the table of sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    held = checkpointed(_numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(ceiling)))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = held.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        rest = max(0.0, total - (row["used"] or 0.0))
        raised = rest / row["open"] if row["open"] else level
        if raised <= level:
            break
        level = raised
    return held.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level)))


def _draw(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pairs the items of a chunk (struct key, unit, w, p) one after another.

    The state holds the fractional item at hand and those decided so far.
    """
    empty = F.expr("cast(null as struct<key: bigint, unit: bigint, w: double, p: double>)")
    start = F.struct(empty.alias("open"), F.expr("cast(array() as array<struct<unit: bigint, p: double>>)").alias("done"))

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        up = F.least(a["w"] * (1 - a["p"]), x["w"] * x["p"])  # words that may go from x to a
        down = F.least(a["w"] * a["p"], x["w"] * (1 - x["p"]))
        to_a = _draw(a["key"], x["key"], F.lit(level), F.lit(seed)) * (up + down) < down
        moved = F.when(to_a, up).otherwise(-down)
        p_a, p_x = a["p"] + moved / a["w"], x["p"] - moved / x["w"]
        # what the transfer makes integral is known from the bound that it met
        a_ends = F.when(to_a, a["w"] * (1 - a["p"]) <= x["w"] * x["p"]).otherwise(a["w"] * a["p"] <= x["w"] * (1 - x["p"]))
        p_a, p_x = F.when(a_ends, F.round(p_a)).otherwise(p_a), F.when(a_ends, p_x).otherwise(F.round(p_x))
        item = lambda r, p: F.struct(r["key"].alias("key"), r["unit"].alias("unit"), r["w"].alias("w"), p.alias("p"))
        ended = lambda r, p: F.struct(r["unit"].alias("unit"), p.alias("p"))
        # both may be integral at once: then the one at hand is 0 or 1, and the next item pairs with it without effect
        paired = F.struct(
            F.when(a_ends, item(x, p_x)).otherwise(item(a, p_a)).alias("open"),
            F.concat(state["done"], F.array(F.when(a_ends, ended(a, p_a)).otherwise(ended(x, p_x)))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(item(x, x["p"]).alias("open"), state["done"].alias("done"))).otherwise(paired)

    return F.aggregate(items, start, step)


def rounded(units: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """``units`` (source, key, unit, w, p), 0 < p < 1, to (unit, p) with p 0 or 1.

    ``unit`` names the row, ``key`` is what the random numbers hang on. The tree's depth follows the largest source's number of units.
    """
    decided = []
    level, rows = 0, units
    while True:
        sizes = rows.groupBy(F.col("source").alias("of")).count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        if level == 0 and not most:
            return units.select("unit", "p")
        chunks = F.ceil(F.col("count") / F.lit(float(fan_in)))
        few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
        dealt = rows.join(F.broadcast(sizes) if few else sizes, F.col("source").eqNullSafe(F.col("of"))).select(
            "source", "key", "unit", "w", "p", F.pmod(F.xxhash64("key", F.lit(level), F.lit(seed)), chunks).alias("chunk")
        )
        order = F.xxhash64(F.col("key"), F.lit(seed)).alias("order")
        grouped = dealt.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct(order, "key", "unit", "w", "p"))).alias("items"))
        folded = checkpointed(grouped.select("source", _fold(F.col("items"), level, seed).alias("state")))
        decided.append(folded.select(F.inline("state.done")))
        rows = folded.select("source", "state.open.*")
        level += 1
        if most <= fan_in:
            break
    decided.append(rows.select("unit", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p")))
    return reduce(DataFrame.unionAll, decided)


def _units(docs: DataFrame, weights: tuple[float, ...], ceiling: float, seed: int, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """(id, source, size, mark, rows, source_size, target, whole, more) of the documents alike in id, source and text: ``whole`` copies of each of the rows, and one more of ``more`` of them."""
    sized = docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), _size(text_column).alias("size"), F.xxhash64(docs[text_column]).alias("mark"))
    units = checkpointed(sized.groupBy("id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("rows")).withColumn("key", F.xxhash64("id", "source", "mark")).withColumn("unit", F.monotonically_increasing_id()))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    wanted = checkpointed(targets(sources, weights, ceiling).select(F.col("source").alias("of"), "source_size", "target"))
    few = wanted.count() <= BROADCAST_SOURCES
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = units.join(F.broadcast(wanted) if few else wanted, F.col("source").eqNullSafe(F.col("of"))).withColumn("all", rate * F.col("rows"))
    sure = F.floor(F.col("all") + F.lit(NOISE)).cast("double")
    aimed = checkpointed(aimed.withColumn("sure", sure).withColumn("p", F.greatest(F.lit(0.0), F.col("all") - sure)).drop("of", "all"))
    done = rounded(aimed.filter(F.col("p") > NOISE).select("source", "key", "unit", F.col("size").cast("double").alias("w"), "p"), seed)
    extra = done.select(F.col("unit").alias("of"), F.col("p").alias("extra"))
    copies = (F.col("sure") + F.coalesce(F.col("extra"), F.lit(0.0))).cast("long")
    joined = aimed.join(extra, F.col("unit") == F.col("of"), "left").withColumn("copies", copies)
    return joined.select("id", "source", "size", "mark", "rows", "source_size", F.col("target").cast("double").alias("target"), F.floor(F.col("copies") / F.col("rows")).alias("whole"), F.pmod("copies", "rows").alias("more"))


def _size(text_column: str) -> Column:
    return F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")


def _repeated(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Every row as often as it says, numbered from 1, by arrays of bounded length."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / STRETCH)))
    stretch = F.sequence(F.col(name) * STRETCH + 1, F.least(times, (F.col(name) + 1) * STRETCH))
    return df.filter(times > 0).withColumn(name, part).withColumn(name, F.explode(stretch))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, copies, taken (copies times size)."""
    units = _units(docs, weights, ceiling, seed, id_column, source_column, text_column)
    copies = F.col("whole") + (F.col("row") <= F.col("more")).cast("long")
    out = _repeated(units, F.col("rows"), "row").withColumn("copies", copies)
    return out.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents without words are not taken."""
    of_id, of_source, of_mark, whole, more, copy, one = free_names(docs, "of_id", "of_source", "of_mark", "whole", "more", "copy", "one")
    units = _units(docs, weights, ceiling, seed, id_column, source_column, text_column).filter("whole > 0 or more > 0")
    # a unit of one row has that row's copies; of a unit of more rows, each has the whole ones, and any row stands for the others' one more
    copies, rest = F.when(F.col("rows") == 1, F.col("whole") + F.col("more")).otherwise(F.col("whole")), F.when(F.col("rows") == 1, 0).otherwise(F.col("more"))
    units = checkpointed(units.select(F.col("id").alias(of_id), F.col("source").alias(of_source), F.col("mark").alias(of_mark), copies.alias(whole), rest.alias(more)))
    on = docs[id_column].eqNullSafe(F.col(of_id)) & docs[source_column].eqNullSafe(F.col(of_source)) & (F.xxhash64(docs[text_column]) == F.col(of_mark))

    def met(wanted: DataFrame) -> DataFrame:
        few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows  # about 50 bytes a row
        return docs.join(F.broadcast(wanted) if few else wanted, on)

    out = _repeated(met(units.filter(F.col(whole) > 0)), F.col(whole), copy).select(docs.columns)
    odd = units.filter(F.col(more) > 0)
    if odd.isEmpty():
        return out
    rows = met(odd).groupBy(of_id, of_source, of_mark).agg(F.first(F.struct(*(docs[f"`{c}`"] for c in docs.columns))).alias(one), F.first(more).alias(more))
    return out.unionAll(_repeated(rows, F.col(more), copy).select(f"{one}.*"))
