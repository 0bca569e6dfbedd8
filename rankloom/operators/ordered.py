"""Places, running totals and exact quantiles in the order of values, without a task that sees all of them.

Everything here works on counted values: a table (groups..., value, n), one row for each
value of a group, a group being a column of a table, a session, a key and a fold, or nothing.
``counted`` makes one for many columns in one read of the input, and stores it.

The values of a group are cut into ranges at a sample of them (those of small
hashes; as many ranges as leave about ``PER_RANGE`` values each). The ranges' totals, one row
each, are summed up; places are then known by range, and only ranges that hold a wanted one
are sorted. The cuts only deal out the work: results are exact, the same for every
partitioning, for every type that can be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.storage import stored

#: Values of a range, about; a group has at most MOST_RANGES of them.
PER_RANGE, MOST_RANGES = 1_000_000, 4096
#: A table of cuts of at most so many groups is broadcast.
BROADCAST_GROUPS = 20_000
_HASH = 1 << 40


def counted(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(``keep``..., __column, __value, __n): the values of numeric columns as doubles with how often they occur, nulls left out; one read, stored."""
    keep = keep or []
    long = df.select(*keep, *(F.col(c).cast("double").alias(f"__v_{k}") for k, c in enumerate(columns))).unpivot(keep, [f"__v_{k}" for k in range(len(columns))], "__column", "__value")
    names = F.create_map(*(F.lit(x) for k, c in enumerate(columns) for x in (f"__v_{k}", c)))
    counts = long.filter("__value is not null").groupBy(*keep, "__column", "__value").agg(F.count(F.lit(1)).alias("__n"))
    return stored(counts.withColumn("__column", F.element_at(names, F.col("__column"))))


def _same(a: list[str], b: list[str]) -> Column:
    """Whether keys are equal, nulls too."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _meets(big: DataFrame, small: DataFrame, groups: list[str], few: bool) -> DataFrame:
    """``big`` with the columns of a table that has a row for each group (or for those that there is one of)."""
    renamed = small.withColumnsRenamed({g: f"__of_{k}" for k, g in enumerate(groups)})
    of = [f"__of_{k}" for k in range(len(groups))]
    return big.join(F.broadcast(renamed) if few else renamed, _same(groups, of), "left").drop(*of)


def in_ranges(values: DataFrame, groups: list[str], value: str, per_range: int = PER_RANGE, cut_by: DataFrame | None = None) -> DataFrame:
    """``values`` (groups, value, ...) with ``__range``, which rises with the value within a group; nulls are in the last one.

    Ranges hold like numbers of the rows of ``cut_by`` (of ``values`` itself if not given), which has a row for each value, or few.
    """
    known = (values if cut_by is None else cut_by).filter(F.col(value).isNotNull())
    many = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("__many")).filter(F.col("__many") > per_range)
    if many.isEmpty():
        return values.withColumn("__range", F.when(F.col(value).isNull(), 1).otherwise(0))
    big = stored(many)  # of groups that need cuts at all
    few = big.count() <= BROADCAST_GROUPS
    wanted = F.least(F.ceil(F.col("__many") / F.lit(float(per_range))), F.lit(MOST_RANGES))
    sampled = _meets(known, big, groups, few).filter(F.pmod(F.xxhash64(value), F.lit(_HASH)) * F.col("__many") < wanted * F.lit(_HASH))
    cuts = stored(sampled.groupBy(*groups).agg(F.sort_array(F.collect_set(value)).alias("__cuts")))  # about MOST_RANGES values at most for a group
    return _meets(values, cuts, groups, few).withColumn("__range", F.when(F.col(value).isNull(), 1 << 30).otherwise(_passed("__cuts", F.col(value)))).drop("__cuts")


def _passed(cuts: str, value: Column) -> Column:
    """How many of the sorted cuts are not above the value (0 without cuts), by steps of halving length."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((4 * MOST_RANGES).bit_length()))))
    below = lambda at, step: (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value)
    return F.when(F.col(cuts).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at)))


def _starts(ranged: DataFrame, groups: list[str], n: str) -> DataFrame:
    """(groups, __range, __total, __start, __all): the totals of the ranges; a row for each."""
    sizes = ranged.groupBy(*groups, "__range").agg(F.sum(n).alias("__total"))
    by_group = Window.partitionBy(*groups or [F.lit(0)])
    return sizes.select(*groups, "__range", "__total", (F.sum("__total").over(by_group.orderBy("__range")) - F.col("__total")).alias("__start"), F.sum("__total").over(by_group).alias("__all"))


def running(counts: DataFrame, groups: list[str], value: str, n: str, name: str = "__upto", per_range: int = PER_RANGE) -> DataFrame:
    """``counts`` with the sum of ``n`` up to and including the row within its group, nulls last, and ``__all``, that of the group."""
    ranged = in_ranges(counts, groups, value, per_range)
    within = F.sum(n).over(Window.partitionBy(*groups, "__range").orderBy(F.col(value).asc_nulls_last()))
    starts = stored(_starts(ranged, groups, n).drop("__total"))
    few = not groups or starts.count() <= BROADCAST_GROUPS
    return _meets(ranged.withColumn(name, within), starts, [*groups, "__range"], few).withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")


def at_places(counts: DataFrame, groups: list[str], value: str, n: str, places: Column, per_range: int = PER_RANGE) -> DataFrame:
    """(groups, __k, __place, __at, __first, __many): for each group the values (__at) at ``places``, an array of 0-based places made of ``__all``, the group's total.

    __k is where a place stands in the array, __first the first place that the value has, of __many.
    """
    counts = counts.filter(F.col(value).isNotNull())
    ranged = in_ranges(counts, groups, value, per_range)
    starts = _starts(ranged, groups, n).select("*", F.posexplode(places).alias("__k", "__place"))
    wanted = stored(starts.filter((F.col("__start") <= F.col("__place")) & (F.col("__place") < F.col("__start") + F.col("__total"))).select(*groups, "__range", "__start", "__k", "__place"))
    few = not groups or wanted.count() <= BROADCAST_GROUPS
    by_range = wanted.groupBy(*groups, "__range").agg(F.first("__start").alias("__start"), F.collect_list(F.struct("__k", "__place")).alias("__wanted"))
    held = _meets(ranged, by_range, [*groups, "__range"], few).filter("__wanted is not null")  # only ranges that hold a place are sorted
    upto = F.sum(n).over(Window.partitionBy(*groups, "__range").orderBy(value)) + F.col("__start")
    found = held.withColumn("__upto", upto).select("*", F.explode("__wanted").alias("__w")).filter((F.col("__w.__place") < F.col("__upto")) & (F.col("__w.__place") >= F.col("__upto") - F.col(n)))
    return found.select(*groups, "__w.__k", "__w.__place", F.col(value).alias("__at"), (F.col("__upto") - F.col(n)).alias("__first"), F.col(n).alias("__many"))


def quantiles_of(counts: DataFrame, groups: list[str], value: str, n: str, parts: list[float], *, discrete: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """(groups, quantiles): the exact quantiles of every group of counted values, interpolated, or (``discrete``) as values of the group."""
    where = [(F.col("__all") - 1) * F.lit(float(p)) for p in parts]
    if discrete:
        places = [F.greatest(F.ceil(F.col("__all") * F.lit(float(p))) - 1, F.lit(0)) for p in parts]
    else:
        places = [x for w in where for x in (F.floor(w), F.ceil(w), w)]
    found = at_places(counts, groups, value, n, F.array(*(x.cast("double") for x in places)), per_range)
    at = lambda k: F.max(F.when(F.col("__k") == k, F.col("__at").cast("double")))
    out = []
    for j in range(len(parts)):
        if discrete:
            out.append(at(j))
            continue
        low, high, whole = at(3 * j), at(3 * j + 1), F.max(F.when(F.col("__k") == 3 * j + 2, F.col("__place")))
        out.append(F.when(low == high, low).otherwise((F.ceil(whole) - whole) * low + (whole - F.floor(whole)) * high))
    return found.groupBy(*groups).agg(F.array(*out).alias("quantiles"))


def quantiles(df: DataFrame, column: str, parts: list[float], *, discrete: bool = False, name: str = "quantiles") -> DataFrame:
    """One row: the exact quantiles of a column; null each without values. The input is read once."""
    found = quantiles_of(counted(df, [column]), ["__column"], "__value", "__n", parts, discrete=discrete)
    one = df.sparkSession.range(1).select(F.lit(column).alias("__column"))
    return one.join(F.broadcast(found), "__column", "left").select(F.coalesce("quantiles", F.array_repeat(F.lit(None).cast("double"), len(parts))).alias(name))
