"""Descriptive reports over sessions: each function is one question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import windows as W
from rankloom.operators.metrics import ranked
from rankloom.operators.ordered import counted, quantiles_of
from rankloom.sessions import GROUP, LABEL

CARRIER = "legs0_segments0_marketingCarrier_code"
TRANSFER = "legs0_segments1_departureFrom_airport_iata"


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "group_size": W.group_size(), "position_in_group": W.position() - 1, "is_cheapest": W.is_cheapest(), "price_premium": W.from_min("totalPrice"),
        "is_direct": F.col(TRANSFER).isNull(), "duration": S.duration_minutes(F.col("legs0_duration")),
    })


def _chosen(df: DataFrame) -> DataFrame:
    return _marked(df).filter(F.col(LABEL) == 1)


def chosen_positions(df: DataFrame) -> DataFrame:
    """Per session: size, 0-based position of the chosen option, position over size."""
    picked = F.max(F.when(F.col(LABEL) == 1, F.col("position_in_group")))
    return _marked(df).groupBy(GROUP).agg(F.first("group_size").alias("group_size"), picked.alias("chosen_position"), (picked / F.first("group_size")).alias("relative_position"))


def price_policy(df: DataFrame) -> DataFrame:
    """One row: percent of choices that are cheapest, mean premium, percent compliant, percent direct."""
    share = lambda c: 100 * F.avg(F.col(c).cast("int"))
    return _chosen(df).agg(share("is_cheapest").alias("cheapest_percent"), F.avg("price_premium").alias("mean_premium"), share("pricingInfo_isAccessTP").alias("compliant_percent"), share("is_direct").alias("direct_percent"))


def premium_by(df: DataFrame, *keys: str) -> DataFrame:
    """Mean premium of choices over the cheapest, by columns (direct, VIP, compliance, ...)."""
    return _chosen(df).groupBy(*keys).agg(F.avg("price_premium").alias("mean_premium"), F.count(F.lit(1)).alias("n")).orderBy(*keys)


def chosen_carriers(df: DataFrame, most: int = 10) -> DataFrame:
    return _chosen(df).groupBy(CARRIER).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), CARRIER).limit(most)


def chosen_by_fee(df: DataFrame, fee: str = "miniRules0_monetaryAmount") -> DataFrame:
    return _chosen(df).groupBy(F.coalesce(fee, F.lit(0.0)).alias("fee")).agg(F.count(F.lit(1)).alias("n")).orderBy("fee")


def hits_by_size(df: DataFrame, k: int = 3) -> DataFrame:
    """Hit rate at k by session size: 11-20, 21-50, 51-200, over 200."""
    size = F.col("group_size")
    bucket = F.when(size <= 20, "11-20").when(size <= 50, "21-50").when(size <= 200, "51-200").otherwise(">200")
    hit = F.count_if((F.col(LABEL) == 1) & (F.col("rank") <= k)).cast("double")
    return ranked(df).withColumn("bucket", bucket).groupBy("bucket").agg(F.count_distinct(GROUP).alias("n_groups"), (hit / F.count_distinct(GROUP)).alias("hit_rate"))


def position_deciles(df: DataFrame) -> DataFrame:
    """Share of choices in each tenth of their list."""
    at = chosen_positions(df).filter("chosen_position is not null").withColumn("decile", F.least(F.floor(F.col("relative_position") * 10), F.lit(9)).cast("int"))
    counts = at.groupBy("decile").agg(F.count(F.lit(1)).alias("n"))
    total = at.agg(F.count(F.lit(1)).alias("all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("decile", "n", (F.col("n") / F.col("all")).alias("share")).orderBy("decile")


def position_size_correlation(df: DataFrame) -> DataFrame:
    a, b = F.col("group_size").cast("double"), F.col("relative_position").cast("double")
    return chosen_positions(df).filter("chosen_position is not null").agg(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("r"))


def compliance_when_possible(df: DataFrame, flag: str = "pricingInfo_isAccessTP") -> DataFrame:
    """Percent of compliant choices where the session had a compliant option."""
    can = F.max(F.col(flag).cast("int")).over(W.within(GROUP))
    return df.withColumn("__can", can).filter((F.col("__can") == 1) & (F.col(LABEL) == 1)).agg((100 * F.avg(F.col(flag).cast("int"))).alias("compliant_percent"), F.count(F.lit(1)).alias("n"))


def pareto(df: DataFrame, price: str = "totalPrice", duration: str = "duration") -> DataFrame:
    """``is_dominated``: another option of the session is no dearer and no longer, and better in one.

    A running minimum over options sorted by price, then duration: no pairs are made.
    Options without a duration are null.
    """
    frame = _marked(df) if duration == "duration" and duration not in df.columns else df
    d = F.col(duration)
    by_price = frame.groupBy(GROUP, price).agg(F.min(d).alias("__least"))
    before = F.min("__least").over(Window.partitionBy(GROUP).orderBy(price).rowsBetween(Window.unboundedPreceding, -1))
    best = by_price.withColumn("__before", before).withColumnsRenamed({GROUP: "__g", price: "__p"})
    joined = frame.join(best, F.col(GROUP).eqNullSafe(F.col("__g")) & F.col(price).eqNullSafe(F.col("__p")), "left")
    worse = F.coalesce(F.col("__before") <= d, F.lit(False)) | (F.col("__least") < d)
    return joined.withColumn("is_dominated", F.when(d.isNotNull(), worse)).drop("__g", "__p", "__least", "__before")


def drift(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index of a column between two tables, over quantile bins of the first; each is read once, for its counted values."""
    counts = [counted(df, [column]) for df in (a, b)]
    cuts = F.broadcast(quantiles_of(counts[0], [], "__value", "__n", [k / bins for k in range(1, bins)]))  # one row
    place = F.size(F.filter("quantiles", lambda at: F.col("__value") > at))  # equal cuts are passed together
    binned = lambda df, name: df.join(cuts, F.lit(True)).groupBy(place.alias("bin")).agg(F.sum("__n").alias(name))
    both = binned(counts[0], "n_a").join(binned(counts[1], "n_b").withColumnRenamed("bin", "__bin"), F.col("bin") == F.col("__bin"), "full").select(F.coalesce("bin", "__bin").alias("bin"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    total = both.agg(F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b"), F.count(F.lit(1)).alias("n"))
    share = lambda n, all_: (F.col(n) + 0.5) / (F.col(all_) + 0.5 * F.col("n"))
    p, q = share("n_a", "all_a"), share("n_b", "all_b")
    return both.join(F.broadcast(total), F.lit(True)).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def favourite(df: DataFrame, key: str, value: str = CARRIER) -> DataFrame:
    """The most frequent value per key (user, company), ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("__k", best).filter("__k = 1").drop("__k")


def loyalty_match(df: DataFrame, programmes: str = "frequentFlyer", carrier: str = CARRIER, separator: str = "/") -> DataFrame:
    """``loyalty_match``: the carrier is among the user's programmes; null if either is."""
    return df.withColumn("loyalty_match", F.array_contains(F.split(programmes, f"[{separator}]"), F.col(carrier)))


def traveller_age(df: DataFrame, born: str = "year_of_birth", asked: str = "request_time") -> DataFrame:
    return df.withColumn("traveller_age", F.year(S.as_timestamp(F.col(asked).cast("string"))) - F.col(born))


def seat_scarcity(df: DataFrame, seats: str = "legs0_segments0_seatsAvailable") -> DataFrame:
    """Seats over the most seats of the session."""
    return df.withColumn("seat_scarcity", S.ratio(F.col(seats), F.max(seats).over(W.within(GROUP))))
