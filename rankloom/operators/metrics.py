"""Ranking metrics over scored options: (ranker_id, predicted_score, selected).

One window ranks the options, one aggregate makes a row per session, one makes the
numbers; all k are computed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import windows as W
from rankloom.sessions import GROUP, ITEM, LABEL, SCORE

KS = (1, 3, 5, 10)
MIN_SIZE = 11


def _checked(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def ranked(df: DataFrame, min_size: int = MIN_SIZE, group: str = GROUP, score: str = SCORE, label: str = LABEL, tie: str = ITEM) -> DataFrame:
    """Options of sessions of at least ``min_size`` with the rank of their score."""
    tie = tie if tie in df.columns else score
    _checked(df, (group, score, label))
    sized = df.withColumn("group_size", W.group_size(group)).filter(F.col("group_size") >= min_size)
    return sized.withColumn("rank", W.predicted_rank(score, group, tie))


def hit_rate(df: DataFrame, k: int = 3, min_size: int = MIN_SIZE, **columns) -> DataFrame:
    """One row: hits among the first k over sessions; 0.0 without any session."""
    group, label = columns.get("group", GROUP), columns.get("label", LABEL)
    rows = ranked(df, min_size, **columns)
    hits = F.count_if((F.col(label) == 1) & (F.col("rank") <= k)).cast("double")
    return rows.agg(F.coalesce(F.try_divide(hits, F.count_distinct(group).cast("double")), F.lit(0.0)).alias(f"hit_rate_{k}"))


def reciprocal_rank(df: DataFrame, min_size: int = MIN_SIZE, **columns) -> DataFrame:
    group, label = columns.get("group", GROUP), columns.get("label", LABEL)
    total = F.sum(F.when(F.col(label) == 1, 1.0 / F.col("rank")))
    return ranked(df, min_size, **columns).agg(F.coalesce(F.try_divide(total, F.count_distinct(group).cast("double")), F.lit(0.0)).alias("mrr"))


def per_session_ndcg(df: DataFrame, k: int = 3, min_size: int = MIN_SIZE, **columns) -> DataFrame:
    """DCG over ideal DCG of each session; null without a positive."""
    group, label, tie = columns.get("group", GROUP), columns.get("label", LABEL), columns.get("tie", ITEM)
    rows = ranked(df, min_size, **columns)
    rows = rows.withColumn("ideal", W.ideal_rank(label, group, tie if tie in df.columns else label))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    part = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log(F.col(r) + 1.0)).otherwise(0.0))
    return rows.groupBy(group).agg(part("rank").alias("dcg"), part("ideal").alias("idcg")).select(group, F.try_divide("dcg", "idcg").alias("ndcg"))


def ndcg(df: DataFrame, k: int = 3, min_size: int = MIN_SIZE, **columns) -> DataFrame:
    return per_session_ndcg(df, k, min_size, **columns).agg(F.avg("ndcg").alias(f"ndcg_{k}"))


def summary(df: DataFrame, ks: tuple[int, ...] = KS, min_size: int = MIN_SIZE, group: str = GROUP, score: str = SCORE, label: str = LABEL, tie: str = ITEM) -> DataFrame:
    """One row: sessions and options in all and evaluated, MRR, hit rate and NDCG at every k."""
    _checked(df, (group, score, label))
    rows = df.withColumns({"group_size": W.group_size(group), "rank": W.predicted_rank(score, group, tie), "ideal": W.ideal_rank(label, group, tie)})
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    part = lambda r, k: F.sum(F.when(F.col(r) <= k, gain / F.log(F.col(r) + 1.0)).otherwise(0.0))
    per = [F.first("group_size").alias("size"), F.sum(F.when(F.col(label) == 1, 1.0 / F.col("rank"))).alias("rr")]
    for k in ks:
        per += [F.count_if((F.col(label) == 1) & (F.col("rank") <= k)).alias(f"hits_{k}"), F.try_divide(part("rank", k), part("ideal", k)).alias(f"ndcg_{k}")]
    sessions = rows.groupBy(group).agg(*per)
    big = F.col("size") >= min_size
    n = F.count_if(big).cast("double")
    out = [F.count(F.lit(1)).alias("total_groups"), F.sum("size").alias("total_items"), F.count_if(big).alias("evaluated_groups"), F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).alias("evaluated_items")]
    out.append(F.coalesce(F.try_divide(F.sum(F.when(big, F.col("rr"))), n), F.lit(0.0)).alias("mrr"))
    for k in ks:
        out += [F.coalesce(F.try_divide(F.sum(F.when(big, F.col(f"hits_{k}"))).cast("double"), n), F.lit(0.0)).alias(f"hit_rate_{k}"), F.avg(F.when(big, F.col(f"ndcg_{k}"))).alias(f"ndcg_{k}")]
    return sessions.agg(*out)
