"""Session-relative columns. All windows share ``partitionBy(ranker_id)``: one shuffle.

Windows without an order come first, then each order once. Ties are broken by an
explicit key; null values get a null rank and come last. A window over a session is one
task's work; ``session_ranks`` gives the ranks of tables whose sessions may be larger than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import ordered
from rankloom.sessions import GROUP, ITEM, LABEL, SCORE
from rankloom.storage import stored

#: Rows from which a session counts as too large for a window, and how many salts its rows' joins have.
GIANT, SALTS = 5_000_000, 32
#: A table of at most so many values (of a giant session) is broadcast.
BROADCAST_VALUES = 200_000


def within(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def ordinal_rank(value: str, group: str = GROUP, tie: str = ITEM, descending: bool = False) -> Column:
    """1, 2, 3, ... with ties in the order of ``tie``."""
    c = F.col(value)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.row_number().over(within(group).orderBy(order, F.col(tie))))


def average_rank(value: str, group: str = GROUP) -> Column:
    """Ranks from 1; equal values share the mean of their places."""
    c = F.col(value)
    low = F.rank().over(within(group).orderBy(c.asc_nulls_last()))
    return F.when(c.isNotNull(), low + (F.count(c).over(within(group, value)) - 1) / 2.0)


def dense_rank(value: str, group: str = GROUP) -> Column:
    c = F.col(value)
    return F.when(c.isNotNull(), F.dense_rank().over(within(group).orderBy(c.asc_nulls_last())))


def percentile_of(value: str, group: str = GROUP) -> Column:
    """(average rank - 1) / (values - 1); null in a session of one."""
    return F.try_divide(average_rank(value, group) - 1, (F.count(F.col(value)).over(within(group)) - 1).cast("double"))


def from_mean(value: str, group: str = GROUP) -> Column:
    return F.col(value) - F.avg(value).over(within(group))


def from_min(value: str, group: str = GROUP) -> Column:
    return F.col(value) - F.min(value).over(within(group))


def from_max(value: str, group: str = GROUP) -> Column:
    return F.col(value) - F.max(value).over(within(group))


def group_size(group: str = GROUP) -> Column:
    return F.count(F.lit(1)).over(within(group))


def position(order: str = "row_ord", group: str = GROUP) -> Column:
    """1-based place in the order in which the options came."""
    return F.row_number().over(within(group).orderBy(order))


def spread(value: str, group: str = GROUP) -> Column:
    return F.max(value).over(within(group)) - F.min(value).over(within(group))


def deviation(value: str, group: str = GROUP) -> Column:
    """Sample standard deviation; null in a session of one."""
    return F.stddev_samp(value).over(within(group))


def distinct_in_group(value: str, group: str = GROUP) -> Column:
    """Distinct values, null counting as one. Meant for columns of few values."""
    w = within(group)
    return F.size(F.collect_set(value).over(w)) + F.max(F.col(value).isNull().cast("int")).over(w)


def flag_rate(flag: str, group: str = GROUP) -> Column:
    return F.avg(F.col(flag).cast("int")).over(within(group))


def share_of_group(value: str, group: str = GROUP) -> tuple[Column, Column]:
    """(how often the row's value occurs in its session, its share of the session)."""
    n = F.count(value).over(within(group, value))
    return n, n / F.count(group).over(within(group))


def is_cheapest(price: str = "totalPrice", group: str = GROUP) -> Column:
    """True for every option at the lowest price."""
    return F.col(price) == F.min(price).over(within(group))


def most_expensive_chosen(df: DataFrame, price: str = "totalPrice", group: str = GROUP) -> DataFrame:
    """Chosen options that are the dearest of their session."""
    top = df.withColumn("__top", F.max(price).over(within(group)))
    return top.filter((F.col(LABEL) == 1) & (F.col(price) == F.col("__top"))).drop("__top")


def predicted_rank(score: str = SCORE, group: str = GROUP, tie: str = ITEM) -> Column:
    return F.row_number().over(within(group).orderBy(F.col(score).desc_nulls_last(), F.col(tie)))


def ideal_rank(label: str = LABEL, group: str = GROUP, tie: str = ITEM) -> Column:
    return F.row_number().over(within(group).orderBy(F.col(label).desc_nulls_last(), F.col(tie)))


def top_k(df: DataFrame, k: int, score: str = SCORE, group: str = GROUP, tie: str = ITEM) -> DataFrame:
    """The k best rows of each session; Spark limits each task's rows before the shuffle."""
    return df.withColumn("predicted_rank", predicted_rank(score, group, tie)).filter(F.col("predicted_rank") <= k)


def ranking_columns(df: DataFrame, value: str, group: str = GROUP) -> DataFrame:
    """``{value}_rank``, ``_dense_rank`` and ``_percentile`` within the session."""
    return df.withColumns({f"{value}_rank": average_rank(value, group), f"{value}_dense_rank": dense_rank(value, group), f"{value}_percentile": percentile_of(value, group)})


def session_ranks(df: DataFrame, value: str, group: str = GROUP, tie: str = ITEM, giant: int = GIANT) -> DataFrame:
    """``df`` with ``{value}_ordinal``, ``_rank``, ``_dense_rank``, ``_percentile``, ``_from_mean``, ``_from_min`` and ``_from_max`` within the session, whatever its size.

    Sessions of at most ``giant`` rows have them by windows. Of larger ones, of which there are few,
    the rows are cut into ranges of (value, tie): places within a range, plus the rows of the ranges before. Means
    and extremes are one aggregate; average and dense ranks come from the session's
    counted values. No task holds a giant session, nor all rows of a value in it.
    """
    v = F.col(value)
    ends = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__rows"), F.count(v).alias("__known"), F.avg(v).alias("__mean"), F.min(v).alias("__least"), F.max(v).alias("__most"))
    giants = stored(ends.filter(F.col("__rows") > giant))  # at most rows / giant of them
    by_window = lambda x: x.withColumns({
        f"{value}_ordinal": ordinal_rank(value, group, tie).cast("long"), f"{value}_rank": average_rank(value, group).cast("double"), f"{value}_dense_rank": dense_rank(value, group).cast("long"), f"{value}_percentile": percentile_of(value, group).cast("double"),
        f"{value}_from_mean": from_mean(value, group), f"{value}_from_min": from_min(value, group), f"{value}_from_max": from_max(value, group),
    })
    if giants.isEmpty():
        return by_window(df)
    same = F.col(group).eqNullSafe(F.col("__g"))
    small = by_window(df.join(F.broadcast(giants.select("__g")), same, "left_anti"))
    rows = df.join(F.broadcast(giants), same).withColumn("__key", F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(tie).alias("t"))))
    narrow = stored(rows.filter(v.isNotNull()).select("__g", "__key"))
    per_range = min(giant, ordered.PER_RANGE)
    ranged = ordered.in_ranges(rows, ["__g"], "__key", per_range, narrow)
    sizes = ordered.in_ranges(narrow, ["__g"], "__key", per_range).groupBy("__g", "__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col("__g").alias("__of"), F.col("__range").alias("__in"), (F.sum("__n").over(Window.partitionBy("__g").orderBy("__range")) - F.col("__n")).alias("__start"))  # a row for each range
    placed = ranged.join(F.broadcast(starts), F.col("__g").eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__in")), "left").drop("__of", "__in")
    placed = placed.withColumn("__ordinal", F.when(v.isNotNull(), F.row_number().over(Window.partitionBy("__g", "__range").orderBy(v, tie)) + F.col("__start")))
    counts = stored(narrow.groupBy("__g", F.col("__key.v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.lit(1).alias("__one")))
    counts = ordered.running(counts, ["__g"], "__v", "__n", "__upto", per_range).drop("__all")
    counts = stored(ordered.running(stored(counts), ["__g"], "__v", "__one", "__dense", per_range).select(F.col("__g").alias("__of"), "__v", "__n", "__upto", "__dense"))
    on = F.col("__g").eqNullSafe(F.col("__of")) & (v == F.col("__v"))
    if counts.count() <= BROADCAST_VALUES:
        joined = placed.join(F.broadcast(counts), on, "left")
    else:  # a value may be that of most rows
        salted = counts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.withColumn("__own", F.pmod(F.xxhash64(tie), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("__own") == F.col("__salt")), "left")
    rank = F.col("__upto") - F.col("__n") + 1 + (F.col("__n") - 1) / 2.0
    big = joined.select(
        *df.columns, F.col("__ordinal").alias(f"{value}_ordinal"), rank.alias(f"{value}_rank"), F.col("__dense").alias(f"{value}_dense_rank"),
        F.try_divide(rank - 1, (F.col("__known") - 1).cast("double")).alias(f"{value}_percentile"), (v - F.col("__mean")).alias(f"{value}_from_mean"), (v - F.col("__least")).alias(f"{value}_from_min"), (v - F.col("__most")).alias(f"{value}_from_max"),
    )
    return small.unionByName(big)
