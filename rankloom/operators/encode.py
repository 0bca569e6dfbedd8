"""Encodings of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import running
from rankloom.storage import stored

#: A table of at most so many levels is broadcast.
BROADCAST_LEVELS = 100_000


def _small(levels: DataFrame) -> DataFrame:
    return F.broadcast(levels) if levels.limit(BROADCAST_LEVELS + 1).count() <= BROADCAST_LEVELS else levels


def collapse_rare(df: DataFrame, column: str, least: int = 50, other: str = "other") -> DataFrame:
    """Levels of fewer than ``least`` rows become ``other``; nulls stay. Counts are joined, so a hot level is no hot task."""
    levels = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__level")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < least)
    joined = df.join(_small(levels), F.col(column) == F.col("__level"), "left")
    return joined.withColumn(column, F.when(F.col("__level").isNotNull(), other).otherwise(F.col(column))).drop("__level", "__n")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``{column}_freq``: how many rows have the row's level; null for null."""
    levels = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__level")).agg(F.count(F.lit(1)).alias(f"{column}_freq"))
    return df.join(_small(levels), F.col(column) == F.col("__level"), "left").drop("__level")


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """``{column}_encoded``: 0-based place of the level in sorted order; null for null."""
    levels = df.select(F.col(column).alias("__level")).filter(F.col("__level").isNotNull()).distinct()
    placed = running(stored(levels.withColumn("__one", F.lit(1))), [], "__level", "__one", "__place")
    numbered = placed.select("__level", (F.col("__place") - 1).cast("int").alias(f"{column}_encoded"))
    return df.join(_small(numbered), F.col(column) == F.col("__level"), "left").drop("__level")


def encode(df: DataFrame, column: str, method: str = "ordinal") -> DataFrame:
    if method == "ordinal":
        return ordinal(df, column)
    if method == "frequency":
        return frequency(df, column)
    raise ValueError(f"unknown method {method}")
