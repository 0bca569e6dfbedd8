"""Checks and profiles of an option table, each as one aggregate where it can be."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import counted, quantiles_of
from rankloom.sessions import GROUP, ITEM, LABEL

PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def one_positive(df: DataFrame, group: str = GROUP, label: str = LABEL) -> DataFrame:
    """One row: sessions whose labels do not sum to one, all sessions."""
    sums = df.groupBy(group).agg(F.sum(label).alias("s"))
    return sums.agg(F.count_if(F.coalesce(F.col("s") != 1, F.lit(True))).alias("invalid_groups"), F.count(F.lit(1)).alias("total_groups"))


def session_sizes(df: DataFrame, group: str = GROUP, more_than: int = 10) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.median("n").alias("median_size"), F.count_if(F.col("n") > more_than).alias("groups_over"), F.count_if(F.col("n") <= more_than).alias("groups_not_over"))


def _distinct(c: str, exact: bool) -> Column:
    count = F.count_distinct(c) if exact else F.approx_count_distinct(c)
    return count + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))


def table_stats(df: DataFrame, item: str = ITEM, group: str = GROUP, exact: bool = True) -> DataFrame:
    """Distinct ids and sessions (null counts as a value), rows."""
    return df.agg(_distinct(item, exact).alias("unique_ids"), _distinct(group, exact).alias("unique_groups"), F.count(F.lit(1)).alias("n_rows"))


def size_histogram(df: DataFrame, group: str = GROUP) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups")).orderBy("size")


def sizes_in_order(df: DataFrame, group: str = GROUP) -> DataFrame:
    """Session sizes in the order of the session key: a trainer's group vector."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).orderBy(group)


def _long(row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return row.unpivot([], columns, "column", value)


def missing_rates(df: DataFrame, first: int | None = None) -> DataFrame:
    """(column, rate) over all rows, or over the first ``first``; the divisor is the rows read."""
    rows = df if first is None else df.limit(first)
    return _long(rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)), df.columns, "rate")


def missing_percent(df: DataFrame) -> DataFrame:
    """Columns with nulls, and how many percent."""
    return missing_rates(df).select("column", (F.col("rate") * 100).alias("percent")).filter("percent > 0")


def outlier_profile(df: DataFrame, columns: list[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Per column p1 to p99, min, max, in one pass over all columns. Exact percentiles are values of the column, from counted values; approximate ones come from sketches."""
    if exact:
        counts = counted(df, columns)
        found = quantiles_of(counts, ["__column"], "__value", "__n", list(PERCENTS), discrete=True).withColumnRenamed("__column", "column")
        ends = counts.groupBy(F.col("__column").alias("column")).agg(F.min("__value").alias("min"), F.max("__value").alias("max"))
        found = _every(df, columns).join(F.broadcast(ends), "column", "left").join(F.broadcast(found), "column", "left")  # a row for each column
    else:
        one = df.agg(*(F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.percentile_approx(c, list(PERCENTS), accuracy).cast("array<double>").alias("quantiles")).alias(f"_{k}") for k, c in enumerate(columns)))
        found = one.select(F.inline(F.array(*(F.col(f"_{k}") for k in range(len(columns))))))
    return found.select("column", *(F.get("quantiles", F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(PERCENTS)), "min", "max")


def _every(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair (a, b), over rows where both are there; null at zero variance."""
    pairs = list(combinations_with_replacement(columns, 2))
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")).alias(f"_{k}"))
    half = df.agg(*aggs).select(F.inline(F.array(*(F.col(f"_{k}") for k in range(len(pairs))))))
    return half.unionAll(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def high_variance(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """(column, variance) of columns whose sample variance is above the threshold."""
    row = df.agg(*(F.var_samp(F.col(c).cast("double")).alias(c) for c in columns))
    return _long(row, columns, "variance").filter(F.col("variance") > threshold)


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, std, min, median, max; one pass for the medians, one for the rest, over all columns."""
    medians = quantiles_of(counted(df, columns), ["__column"], "__value", "__n", [0.5]).withColumnRenamed("__column", "column")
    one = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(f"_{k}") for k, c in enumerate(columns)))
    rows = one.select(F.inline(F.array(*(F.col(f"_{k}") for k in range(len(columns))))))
    return rows.join(F.broadcast(medians), "column", "left").select("column", "n", "mean", "std", "min", F.get("quantiles", F.lit(0)).alias("median"), "max")  # a row for each column


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values by falling frequency, ties by value; the ``most`` frequent if given."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out if most is None else out.limit(most)


def aggregated(df: DataFrame, keys: list[str], wanted: dict[str, list[str]]) -> DataFrame:
    """``{column: [functions]}`` by keys, as ``{column}_{function}``."""
    return df.groupBy(*keys).agg(*(F.expr(f"{fn}(`{c}`)").alias(f"{c}_{fn}") for c, fns in wanted.items() for fn in fns))


def no_label(df: DataFrame, label: str = LABEL) -> None:
    if label in df.columns:
        raise ValueError(f"the test table holds the label {label}")


def overview(df: DataFrame, group: str = GROUP, item: str = ITEM, label: str = LABEL) -> DataFrame:
    """The checks together, one row."""
    parts = [one_positive(df, group, label), session_sizes(df, group), table_stats(df, item, group)]
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each
