"""Submissions: template, writer's frame, validator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.windows import predicted_rank
from rankloom.sessions import GROUP, ITEM, LABEL, SCORE

COLUMNS = (ITEM, GROUP, LABEL)


def template(options: DataFrame) -> DataFrame:
    """Every option with rank 1."""
    return options.select(ITEM, GROUP, F.lit(1).alias(LABEL))


def submission(scored: DataFrame, score: str = SCORE) -> DataFrame:
    """Id, session, and the rank of the score as ``selected``."""
    return scored.select(ITEM, GROUP, predicted_rank(score).alias(LABEL))


def validated(found: DataFrame, options: DataFrame) -> DataFrame:
    """One row of checks: columns, rows, ids, and ranks 1..N once each in every session; ``valid`` is all of them."""
    missing = [c for c in COLUMNS if c not in found.columns]
    if missing:
        return options.sparkSession.range(1).select(F.lit(False).alias("has_columns"), F.lit(False).alias("same_rows"), F.lit(False).alias("same_ids"), F.lit(False).alias("valid_ranks"), F.lit(False).alias("valid"))
    a = found.groupBy(ITEM).agg(F.count(F.lit(1)).alias("n_a"))
    b = options.groupBy(F.col(ITEM).alias("__id")).agg(F.count(F.lit(1)).alias("n_b"))
    ids = a.join(b, F.col(ITEM) == F.col("__id"), "full").agg(
        F.coalesce(F.bool_and(F.col("n_a").isNotNull() & F.col("n_b").isNotNull()), F.lit(True)).alias("same_ids"),
        (F.coalesce(F.sum("n_a"), F.lit(0)) == F.coalesce(F.sum("n_b"), F.lit(0))).alias("same_rows"),
    )
    sessions = found.groupBy(GROUP).agg((F.min(LABEL) == 1).alias("low"), (F.max(LABEL) == F.count(F.lit(1))).alias("high"), (F.count_distinct(LABEL) == F.count(F.lit(1))).alias("once"))
    ranks = sessions.agg(F.coalesce(F.bool_and(F.col("low") & F.col("high") & F.col("once")), F.lit(True)).alias("valid_ranks"))
    both = ids.join(ranks, F.lit(True))  # one row each
    return both.select(F.lit(True).alias("has_columns"), "same_rows", "same_ids", "valid_ranks", (F.col("same_rows") & F.col("same_ids") & F.col("valid_ranks")).alias("valid"))
