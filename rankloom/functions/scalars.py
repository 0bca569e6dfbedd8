"""Scalar expressions on options: durations, calendar parts, buckets, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import quantiles

#: The carriers' cabin codes.
CABINS = {1.0: "economy", 2.0: "business", 4.0: "premium"}
BIN_LABELS = ("very_cheap", "cheap", "medium", "expensive", "very_expensive")


def duration_minutes(column: Column) -> Column:
    """``H:M:S`` anywhere in a string to whole minutes; null where there is none."""
    part = lambda k: F.regexp_extract(column, r"(\d+):(\d+):(\d+)", k)
    number = lambda k: F.nullif(part(k), F.lit("")).cast("int")
    return number(1) * 60 + number(2)


def as_timestamp(column: Column) -> Column:
    """A string as a timestamp without zone; null where it is none."""
    return column.try_cast("timestamp_ntz")


def iso_weekday(column: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(column) + 1


def time_of_day(hour: Column) -> Column:
    """6-11 morning, 12-17 afternoon, 18-21 evening, else (and for null) night."""
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 21), "evening").otherwise("night")


def cabin_name(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, name in CABINS.items():
        out = out.when(code == value, name)
    return out.otherwise("unknown")


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from start to end, cut toward zero."""
    return F.timestamp_diff("DAY", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.timestamp_diff("SECOND", start, end) / 60).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flex_score(percent: Column) -> Column:
    return 1 - percent.cast("double") / 100


def bucket_of(key: Column, n: int = 100) -> Column:
    """A hash bucket of a key, 0 to n - 1."""
    return F.pmod(F.xxhash64(key), F.lit(n))


def downcast(df: DataFrame) -> DataFrame:
    """Longs to ints, doubles to floats; a long that does not fit becomes null."""
    narrow = {"bigint": "int", "double": "float"}
    return df.select([F.col(c).try_cast(narrow[t]).alias(c) if t in narrow else F.col(c) for c, t in df.dtypes])


def calendar(df: DataFrame, column: str) -> DataFrame:
    """Hour, ISO weekday, month and day of month of a column, as ``{column}_{part}``."""
    at = as_timestamp(F.col(column).cast("string"))
    return df.withColumns({f"{column}_hour": F.hour(at), f"{column}_weekday": iso_weekday(at), f"{column}_month": F.month(at), f"{column}_day": F.dayofmonth(at)})


def quantile_bins(df: DataFrame, column: str, name: str, labels: tuple[str, ...] = BIN_LABELS) -> DataFrame:
    """Equal-frequency bins of the whole table, by a CASE over exact break points.

    The break points are a one-row frame, joined by broadcast; a value equal to one
    is in the lower bin, null stays null.
    """
    parts = [k / len(labels) for k in range(1, len(labels))]
    out = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for k, label in enumerate(labels[:-1]):
        out = out.when(F.col(column) <= F.get("__breaks", F.lit(k)), label)
    return df.join(F.broadcast(quantiles(df, column, parts, name="__breaks")), F.lit(True)).withColumn(name, out.otherwise(labels[-1])).drop("__breaks")


def typed_for_learning(df: DataFrame) -> DataFrame:
    """Booleans to ints, timestamps to microseconds; strings stay, to be indexed."""
    out = []
    for c, t in df.dtypes:
        if t == "boolean":
            out.append(F.col(c).cast("int").alias(c))
        elif t.startswith("timestamp"):
            out.append(F.unix_micros(F.col(c).cast("timestamp")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)
