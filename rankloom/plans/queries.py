"""The registered queries on session tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import documents, encode, features, learn, metrics, quality, reports, sketches, splits, submission
from rankloom.operators import windows as W
from rankloom.sessions import SESSIONS_SQL, order_sessions, read_table
from rankloom.sources import files, tables
from rankloom.storage import scratch, stored
from rankloom.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, raw: bool = False):
    """Registers a function, and its SQL: after the sessions view unless ``raw``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            more = "" if raw or sql.strip().startswith("select") else ","
            ORACLE_SQL[f.__name__] = sql if raw else f"with {SESSIONS_SQL}{more} {sql}"
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# -- windows and features -----------------------------------------------------


@_query("""
select ranker_id, Id,
  row_number() over (partition by ranker_id order by totalPrice, Id) as price_rank,
  row_number() over (partition by ranker_id order by totalPrice desc, Id) as price_rank_desc,
  round(totalPrice - avg(totalPrice) over (partition by ranker_id), 6) as price_diff_from_mean,
  round(totalPrice - min(totalPrice) over (partition by ranker_id), 6) as price_diff_from_min,
  round(totalPrice - max(totalPrice) over (partition by ranker_id), 6) as price_diff_from_max,
  round((rank() over (partition by ranker_id order by requestDate) + (count(*) over (partition by ranker_id, requestDate) - 1) / 2.0 - 1)
    / nullif(count(*) over (partition by ranker_id) - 1, 0), 6) as date_percentile,
  rank() over (partition by ranker_id order by requestDate) + (count(*) over (partition by ranker_id, requestDate) - 1) / 2.0 as date_rank,
  dense_rank() over (partition by ranker_id order by requestDate) as date_dense_rank,
  count(*) over (partition by ranker_id) as group_size,
  round(stddev_samp(totalPrice) over (partition by ranker_id), 6) as group_price_std,
  round(max(totalPrice) over (partition by ranker_id) - min(totalPrice) over (partition by ranker_id), 6) as group_price_range,
  totalPrice = min(totalPrice) over (partition by ranker_id) as is_cheapest,
  row_number() over (partition by ranker_id order by row_ord) as position
from sessions""")
def window_kit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, differences, percentiles, sizes and spreads within sessions."""
    df = order_sessions(spark, sf_dir)
    six = lambda c: F.round(c.cast("double"), 6)
    return df.select(
        "ranker_id", "Id", W.ordinal_rank("totalPrice").alias("price_rank"), W.ordinal_rank("totalPrice", descending=True).alias("price_rank_desc"),
        six(W.from_mean("totalPrice")).alias("price_diff_from_mean"), six(W.from_min("totalPrice")).alias("price_diff_from_min"), six(W.from_max("totalPrice")).alias("price_diff_from_max"),
        F.round(W.percentile_of("requestDate"), 6).alias("date_percentile"), W.average_rank("requestDate").cast("double").alias("date_rank"), W.dense_rank("requestDate").alias("date_dense_rank"),
        W.group_size().alias("group_size"), six(W.deviation("totalPrice")).alias("group_price_std"), six(W.spread("totalPrice")).alias("group_price_range"), W.is_cheapest().alias("is_cheapest"), W.position().alias("position"),
    )


@_query("""
x as (select case when ranker_id % 2 = 0 then 0 else ranker_id end as session, Id, cast(round(totalPrice, -4) as double) as price from sessions)
select session, Id, row_number() over (partition by session order by price, Id) as price_ordinal,
  rank() over (partition by session order by price) + (count(*) over (partition by session, price) - 1) / 2.0 as price_rank,
  dense_rank() over (partition by session order by price) as price_dense_rank,
  round((rank() over (partition by session order by price) + (count(*) over (partition by session, price) - 1) / 2.0 - 1) / nullif(count(price) over (partition by session) - 1, 0), 6) as price_percentile,
  round(price - avg(price) over (partition by session), 4) as price_from_mean, round(price - min(price) over (partition by session), 4) as price_from_min, round(price - max(price) over (partition by session), 4) as price_from_max
from x""")
def giant_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks where one session holds half the rows, with many ties: it is cut into ranges, the others have windows."""
    df = order_sessions(spark, sf_dir).select(F.when(F.col("ranker_id") % 2 == 0, 0).otherwise(F.col("ranker_id")).alias("session"), "Id", F.round(F.col("totalPrice"), -4).cast("double").alias("price"))
    return _rounded(W.session_ranks(df, "price", "session", giant=1000)).select("session", "Id", "price_ordinal", "price_rank", "price_dense_rank", "price_percentile", *(F.round(f"price_from_{x}", 4).alias(f"price_from_{x}") for x in ("mean", "min", "max")))


@_query("""
select user_id, event_id,
  row_number() over (partition by user_id order by value, event_id) as value_ordinal,
  rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 as value_rank,
  dense_rank() over (partition by user_id order by value) as value_dense_rank,
  round((rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 - 1) / nullif(count(value) over (partition by user_id) - 1, 0), 6) as value_percentile,
  count(*) over (partition by user_id, event_type) as type_count,
  round(count(*) over (partition by user_id, event_type) / count(*) over (partition by user_id), 6) as type_share
from events""")
def window_kit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table with ties."""
    df = W.ranking_columns(read_table(spark, sf_dir, "events"), "value", "user_id")
    often, share = W.share_of_group("event_type", "user_id")
    return df.select("user_id", "event_id", W.ordinal_rank("value", "user_id", "event_id").alias("value_ordinal"), F.col("value_rank").cast("double").alias("value_rank"), "value_dense_rank", F.round("value_percentile", 6).alias("value_percentile"), often.alias("type_count"), F.round(share, 6).alias("type_share"))


@_query("""
d as (select *, try_cast(legs0_departureAt as timestamp) as dep, try_cast(legs0_arrivalAt as timestamp) as arr,
   cast(split_part(legs0_duration, ':', 1) as int) * 60 + cast(split_part(legs0_duration, ':', 2) as int) as minutes from sessions),
q as (select quantile_cont(totalPrice, [0.2, 0.4, 0.6, 0.8]) as c from sessions)
select ranker_id, Id, round(totalPrice - taxes, 4) as base_price, round(taxes / nullif(totalPrice, 0), 6) as tax_rate,
  case when totalPrice <= c[1] then 'very_cheap' when totalPrice <= c[2] then 'cheap' when totalPrice <= c[3] then 'medium' when totalPrice <= c[4] then 'expensive' else 'very_expensive' end as price_bin,
  minutes as total_duration_minutes, hour(dep) as departure_hour, hour(arr) as arrival_hour, isodow(dep) as departure_weekday,
  case when hour(dep) between 6 and 11 then 'morning' when hour(dep) between 12 and 17 then 'afternoon' when hour(dep) between 18 and 21 then 'evening' else 'night' end as departure_time_category,
  case when minutes is null then null else rank() over (partition by ranker_id order by minutes nulls last) + (count(minutes) over (partition by ranker_id, minutes) - 1) / 2.0 end as duration_rank,
  date_sub('day', requestDate, dep) as booking_window_days,
  cast(hour(dep) >= 22 and hour(arr) <= 5 as int) as is_red_eye_flight,
  contains(searchRoute, '/') as is_roundtrip, legs0_segments0_marketingCarrier_code = legs0_segments0_operatingCarrier_code as same_marketing_operating,
  legs0_segments1_departureFrom_airport_iata is not null as has_connection,
  case legs0_segments0_cabinClass when 1 then 'economy' when 2 then 'business' when 4 then 'premium' else 'unknown' end as cabin_class_name,
  corporateTariffCode is not null as has_corporate_tariff, round(miniRules0_monetaryAmount / nullif(totalPrice, 0), 6) as cancellation_fee_rate,
  count(*) over (partition by ranker_id, legs0_segments0_marketingCarrier_code) as carrier_frequency_in_search,
  1 + cast(legs0_segments1_departureFrom_airport_iata is not null as int) as num_segments,
  count(*) over (partition by ranker_id) as group_size,
  round(avg(cast(pricingInfo_isAccessTP as int)) over (partition by ranker_id), 6) as group_policy_compliance_rate,
  round(totalPrice * minutes, 2) as price_duration_interaction, round(cast(isVip as int) * totalPrice, 4) as vip_price_interaction,
  cast(corporateTariffCode is not null as int) * cast(pricingInfo_isAccessTP as int) as corporate_policy_interaction,
  cast(hour(dep) between 7 and 21 as int) + cast(hour(arr) between 7 and 22 as int) as convenient_time_score,
  cast(isodow(dep) >= 6 as int) as weekend_departure, cast(legs0_segments0_cabinClass >= 2 as int) as premium_service_indicator
from d, q""")
def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten feature steps in order."""
    df = features.all_features(order_sessions(spark, sf_dir))
    six = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)
    return df.select(
        "ranker_id", "Id", six("base_price", 4), six("tax_rate"), "price_bin", "total_duration_minutes", "departure_hour", "arrival_hour", "departure_weekday", "departure_time_category",
        F.col("duration_rank").cast("double").alias("duration_rank"), "booking_window_days", "is_red_eye_flight", "is_roundtrip", "same_marketing_operating", "has_connection", "cabin_class_name",
        "has_corporate_tariff", six("cancellation_fee_rate"), "carrier_frequency_in_search", "num_segments", "group_size", six("group_policy_compliance_rate"), six("price_duration_interaction", 2),
        six("vip_price_interaction", 4), "corporate_policy_interaction", "convenient_time_score", "weekend_departure", "premium_service_indicator",
    )


@_query("""select ranker_id, Id, requestDate, hour(requestDate) as requestDate_hour, isodow(requestDate) as requestDate_weekday, month(requestDate) as requestDate_month, day(requestDate) as requestDate_day from sessions""")
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir).select("ranker_id", "Id", "requestDate")
    return S.calendar(df, "requestDate")


@_query("""
a as (select o_custkey as k, avg(l_extendedprice) as p from orders join lineitem on l_orderkey = o_orderkey group by 1)
select ranker_id, Id, round(totalPrice / nullif(p, 0), 6) as price_vs_avg_search_price, cast(totalPrice > p as int) as is_pricier_than_average
from sessions left join a on k = ranker_id""")
def document_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with joined session aggregates."""
    items = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggregates = items.groupBy(F.col("o_custkey").alias("ranker_id")).agg(F.avg("l_extendedprice").alias("avg_total_price"), F.lit(1.0).alias("avg_policy_compliant"))
    df = features.document_features(features.policy_features(order_sessions(spark, sf_dir).join(aggregates, "ranker_id", "left")))
    return df.select("ranker_id", "Id", F.round("price_vs_avg_search_price", 6).alias("price_vs_avg_search_price"), "is_pricier_than_average")


@_query("""select ranker_id, Id from (select *, max(totalPrice) over (partition by ranker_id) as top from sessions) where selected = 1 and totalPrice = top""")
def most_expensive_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.most_expensive_chosen(order_sessions(spark, sf_dir)).select("ranker_id", "Id")


@_query("""select ranker_id, Id, predicted_rank from (select *, row_number() over (partition by ranker_id order by predicted_score desc, Id) as predicted_rank from sessions) where predicted_rank <= 3""")
def top_k_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_k(order_sessions(spark, sf_dir), 3).select("ranker_id", "Id", "predicted_rank")


@_query("""
select ranker_id, count(distinct legs0_segments0_marketingCarrier_code) as carriers, count(distinct legs0_segments0_cabinClass) as cabins,
  count(distinct miniRules0_monetaryAmount) + max(cast(miniRules0_monetaryAmount is null as int)) as fees
from sessions group by ranker_id""")
def distinct_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir)
    pick = {"carriers": "legs0_segments0_marketingCarrier_code", "cabins": "legs0_segments0_cabinClass", "fees": "miniRules0_monetaryAmount"}
    return df.select("ranker_id", *(W.distinct_in_group(c).cast("long").alias(n) for n, c in pick.items())).distinct()


# -- metrics and submissions --------------------------------------------------

_RANKED = """
r as (select *, count(*) over (partition by ranker_id) as n, row_number() over (partition by ranker_id order by predicted_score desc, Id) as rk,
  row_number() over (partition by ranker_id order by selected desc, Id) as ideal from sessions),
s as (select ranker_id, any_value(n) as n, sum(case when selected = 1 then 1.0 / rk end) as rr,
"""
_KS = "".join(f"""  count(*) filter (where selected = 1 and rk <= {k}) as h{k},
  sum(case when rk <= {k} then (pow(2, selected) - 1) / ln(rk + 1) else 0 end) / nullif(sum(case when ideal <= {k} then (pow(2, selected) - 1) / ln(ideal + 1) else 0 end), 0) as g{k},
""" for k in metrics.KS).rstrip(",\n")


@_query(
    _RANKED + _KS + """ from r group by ranker_id)
select count(*) as total_groups, cast(sum(n) as bigint) as total_items, count(*) filter (where n >= 11) as evaluated_groups, cast(coalesce(sum(n) filter (where n >= 11), 0) as bigint) as evaluated_items,
 round(sum(rr) filter (where n >= 11) / nullif(count(*) filter (where n >= 11), 0), 6) as mrr,
""" + ",\n".join(f" round(coalesce(cast(sum(h{k}) filter (where n >= 11) as double) / nullif(count(*) filter (where n >= 11), 0), 0), 6) as hit_rate_{k}, round(avg(g{k}) filter (where n >= 11), 6) as ndcg_{k}" for k in metrics.KS) + " from s"
)
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and NDCG at 1, 3, 5, 10, and MRR, over sessions of eleven and more."""
    return _rounded(metrics.summary(order_sessions(spark, sf_dir)))


@_query("""r as (select *, count(*) over (partition by ranker_id) as n, row_number() over (partition by ranker_id order by predicted_score desc, Id) as rk from sessions)
select round(cast(count(*) filter (where selected = 1 and rk <= 3) as double) / count(distinct ranker_id), 6) as hit_rate_3 from r where n >= 11""")
def hit_rate_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.hit_rate(order_sessions(spark, sf_dir), 3))


@_query("""r as (select *, count(*) over (partition by ranker_id) as n, row_number() over (partition by ranker_id order by predicted_score desc, Id) as rk from sessions)
select round(sum(case when selected = 1 then 1.0 / rk end) / count(distinct ranker_id), 6) as mrr from r where n >= 11""")
def mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reciprocal_rank(order_sessions(spark, sf_dir)))


@_query(_RANKED + _KS + " from r group by ranker_id) select ranker_id, round(g3, 6) as ndcg from s where n >= 11")
def session_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.per_session_ndcg(order_sessions(spark, sf_dir), 3))


@_query("""select Id, ranker_id, row_number() over (partition by ranker_id order by predicted_score desc, Id) as selected from sessions""")
def submission_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission.submission(order_sessions(spark, sf_dir))


@_query("""select true as has_columns, true as same_rows, true as same_ids, count(*) = 0 as valid_ranks, count(*) = 0 as valid from sessions where false""")
def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir)
    return submission.validated(submission.submission(df), df)


@_query("select Id, ranker_id, 1 as selected from sessions")
def submission_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission.template(order_sessions(spark, sf_dir))


# -- quality ------------------------------------------------------------------


@_query("""
g as (select ranker_id, count(*) as n, sum(selected) as s from sessions group by 1)
select count(*) filter (where s <> 1) as invalid_groups, count(*) as total_groups, min(n) as min_size, max(n) as max_size, round(median(n), 6) as median_size,
  count(*) filter (where n > 10) as groups_over, count(*) filter (where n <= 10) as groups_not_over,
  (select count(distinct Id) from sessions) as unique_ids, (select count(distinct ranker_id) from sessions) as unique_groups, (select count(*) from sessions) as n_rows
from g""")
def table_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.overview(order_sessions(spark, sf_dir)))


@_query("select size, count(*) as n_groups from (select count(*) as size from sessions group by ranker_id) group by size")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.size_histogram(order_sessions(spark, sf_dir))


@_query("select ranker_id, count(*) as size from sessions group by 1")
def sizes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sizes_in_order(order_sessions(spark, sf_dir))


_SOME = ("legs0_duration", "corporateTariffCode", "miniRules0_monetaryAmount", "totalPrice")


@_query(" union all ".join(f"select '{c}' as \"column\", round(avg(cast({c} is null as int)), 6) as rate from sessions" for c in _SOME))
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.missing_rates(order_sessions(spark, sf_dir).select(*_SOME)))


@_query("select * from (" + " union all ".join(f"select '{c}' as \"column\", round(100 * avg(cast({c} is null as int)), 6) as percent from sessions" for c in _SOME) + ") where percent > 0")
def missing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.missing_percent(order_sessions(spark, sf_dir).select(*_SOME)))


_NUMBERS = ("totalPrice", "miniRules0_monetaryAmount", "legs0_segments0_cabinClass")


@_query(" union all ".join(f"select '{c}' as \"column\", " + ", ".join(f"round(cast(quantile_disc({c}, {p}) as double), 6) as p{round(100 * p)}" for p in quality.PERCENTS) + f", round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max from sessions" for c in _NUMBERS))
def outlier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.outlier_profile(order_sessions(spark, sf_dir), list(_NUMBERS)))


@_query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from sessions" for a in _NUMBERS for b in _NUMBERS))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.correlations(order_sessions(spark, sf_dir), list(_NUMBERS)))


@_query("select * from (" + " union all ".join(f"select '{c}' as \"column\", round(var_samp({c}), 2) as variance from sessions" for c in _NUMBERS) + ") where variance > 1")
def high_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.high_variance(order_sessions(spark, sf_dir), list(_NUMBERS), 1.0), 2)


@_query(" union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(cast(min({c}) as double), 4) as min, round(median({c}), 4) as median, round(cast(max({c}) as double), 4) as max from sessions where selected = 1" for c in _NUMBERS))
def described_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.described(order_sessions(spark, sf_dir).filter("selected = 1"), list(_NUMBERS)), 4)


@_query("select profileId, round(avg(totalPrice), 4) as \"totalPrice_avg\", round(max(totalPrice), 4) as \"totalPrice_max\", cast(sum(selected) as bigint) as selected_sum from sessions group by 1")
def named_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.aggregated(order_sessions(spark, sf_dir), ["profileId"], {"totalPrice": ["avg", "max"], "selected": ["sum"]}), 4)


@_query("select count(*) as n_rows from sessions")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_sessions(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))


@_query("select ranker_id, Id, cast(totalPrice as float) as \"totalPrice\", cast(Id as int) as small_id from sessions")
def downcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir).select("ranker_id", "Id", "totalPrice", F.col("Id").alias("small_id"))
    low = S.downcast(df)
    return low.select(F.col("ranker_id").cast("long").alias("ranker_id"), F.col("Id").cast("long").alias("Id"), "totalPrice", "small_id")


# -- splits and leakage -------------------------------------------------------

_HASH = "cast('0x' || substr(md5(cast({k} as varchar) || '|{s}'), 1, 15) as bigint)"


@_query(f"""
k as (select ranker_id, row_number() over (order by h, ranker_id) - 1 as place, count(*) over () as n from (select distinct ranker_id, {_HASH.format(k="ranker_id", s=42)} as h from sessions))
select ranker_id, count(*) as n, any_value(place < floor(k.n * 0.8)) as in_train from sessions join k using (ranker_id) group by 1""")
def split_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rest = splits.split_by_groups(order_sessions(spark, sf_dir))
    both = train.withColumn("in_train", F.lit(True)).unionByName(rest.withColumn("in_train", F.lit(False)))
    return both.groupBy("ranker_id").agg(F.count(F.lit(1)).alias("n"), F.first("in_train").alias("in_train"))


@_query(f"""
k as (select ranker_id, row_number() over (order by h, ranker_id) - 1 as place, count(*) over () as n from (select distinct ranker_id, {_HASH.format(k="ranker_id", s=42)} as h from sessions))
select ranker_id, cast(least(place // (n // 5), 4) as int) as group_fold from k""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_folds(order_sessions(spark, sf_dir), name="group_fold").select("ranker_id", "group_fold").distinct()


@_query(f"""
g as (select ranker_id, sum(selected) as pos, count(*) as n from sessions group by 1),
b as (select *, cast(floor(log2(pos + 1)) as bigint) * 64 + {_HASH.format(k="ranker_id", s="42b")} % 64 as band, {_HASH.format(k="ranker_id", s=42)} as h from g),
k as (select *, row_number() over (partition by band order by pos desc, n desc, h, ranker_id) - 1 + {_HASH.format(k="band", s=42)} % 10 as k from b),
f as (select *, cast(case when (k // 5) % 2 = 0 then k % 5 else 4 - k % 5 end as int) as group_fold from k)
select group_fold, count(*) as n_groups, cast(sum(pos) as bigint) as positives, cast(sum(n) as bigint) as n from f group by 1""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = splits.stratified_folds(order_sessions(spark, sf_dir), group="ranker_id", name="group_fold")
    return df.groupBy("group_fold").agg(F.count_distinct("ranker_id").alias("n_groups"), F.sum("selected").alias("positives"), F.count(F.lit(1)).alias("n"))


@_query("""
o as (select Id, row_number() over (order by requestDate, Id) as p, count(*) over () as n from sessions)
select Id, p <= floor(n * 0.8) as in_train from o""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rest = splits.temporal_split(order_sessions(spark, sf_dir), "requestDate")
    return train.select("Id", F.lit(True).alias("in_train")).unionByName(rest.select("Id", F.lit(False).alias("in_train")))


@_query("select distinct ranker_id from sessions where fold = 0 intersect select distinct ranker_id from sessions where requestDate < timestamp '2000-01-01'")
def shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir)
    return splits.shared_groups(df.filter("fold = 0"), df.filter("requestDate < timestamp_ntz '2000-01-01'"))


@_query("""
t as (select corporateTariffCode as k, fold, sum(totalPrice) as s, count(totalPrice) as n, max(totalPrice) as m from sessions group by 1, 2)
select Id, round((select sum(s) from t where t.k is not distinct from x.corporateTariffCode and t.fold <> x.fold) / (select sum(n) from t where t.k is not distinct from x.corporateTariffCode and t.fold <> x.fold), 4) as "totalPrice_mean",
  cast((select sum(n) from t where t.k is not distinct from x.corporateTariffCode and t.fold <> x.fold) as bigint) as "totalPrice_count",
  (select max(m) from t where t.k is not distinct from x.corporateTariffCode and t.fold <> x.fold) as "totalPrice_max"
from sessions x""")
def fold_aware_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by a nullable key, from the other folds."""
    df = splits.fold_aware(order_sessions(spark, sf_dir), ["corporateTariffCode"], {"totalPrice": ["mean", "count", "max"]})
    return df.select("Id", F.round("totalPrice_mean", 4).alias("totalPrice_mean"), "totalPrice_count", "totalPrice_max")


@_query("""
v as (select distinct profileId as k, fold as f from sessions)
select k as "profileId", f as fold, round(min(totalPrice), 4) as price_min, round(median(totalPrice), 4) as price_median, round(var_samp(totalPrice), 2) as price_var, round(min(miniRules0_monetaryAmount), 4) as fee_min,
  round(median(miniRules0_monetaryAmount), 4) as fee_median, round(max(miniRules0_monetaryAmount), 4) as fee_max
from v left join sessions on "profileId" = k and fold <> f group by 1, 2""")
def medians_of_other_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, extremes and variances of a traveller's prices and fees, for each fold from the others."""
    wanted = {"totalPrice": ["min", "median", "var"], "miniRules0_monetaryAmount": ["min", "median", "max"]}
    df = splits.fold_aware(order_sessions(spark, sf_dir), ["profileId"], wanted)
    names = {f"totalPrice_{f}": f"price_{f}" for f in wanted["totalPrice"]} | {f"miniRules0_monetaryAmount_{f}": f"fee_{f}" for f in wanted["miniRules0_monetaryAmount"]}
    once = df.groupBy("profileId", "fold").agg(*(F.first(a).alias(b) for a, b in names.items()))  # alike on all rows of a traveller and fold
    return _rounded(once.select("profileId", "fold", *(F.round(c, 2 if c == "price_var" else 4).alias(c) for c in names.values())), 4)


@_query("""
t as (select legs0_segments0_marketingCarrier_code as k, fold, sum(selected) as s, count(*) as n from sessions group by 1, 2),
a as (select k, sum(s) as s, sum(n) as n from t group by 1)
select Id, round((a.s - t.s) / (a.n - t.n), 6) as selected_mean from sessions x join t on t.k = x.legs0_segments0_marketingCarrier_code and t.fold = x.fold join a on a.k = t.k""")
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label of a carrier, out of fold."""
    df = splits.fold_aware(order_sessions(spark, sf_dir), ["legs0_segments0_marketingCarrier_code"], {"selected": ["mean"]})
    return df.select("Id", F.round("selected_mean", 6).alias("selected_mean"))


@_query(f"select Id from sessions order by {_HASH.format(k='Id', s=42)}, Id limit 100")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_rows(order_sessions(spark, sf_dir), 100, "Id").select("Id")


@_query(f"k as (select ranker_id from (select distinct ranker_id from sessions) order by {_HASH.format(k='ranker_id', s=42)}, ranker_id limit 20) select Id from sessions where ranker_id in (select ranker_id from k)")
def sampled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_keys(order_sessions(spark, sf_dir), 20).select("Id")


# -- encodings ----------------------------------------------------------------


@_query("""select p_partkey, case when count(*) over (partition by p_name) < 30 then 'other' else p_name end as p_name,
 count(*) over (partition by p_name) as p_name_freq, dense_rank() over (order by p_name) - 1 as p_name_encoded from part""", raw=True)
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare levels collapsed, frequency and ordinal codes."""
    df = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    coded = encode.encode(encode.encode(df, "p_name", "frequency"), "p_name", "ordinal")
    return encode.collapse_rare(coded, "p_name", 30).select("p_partkey", "p_name", "p_name_freq", F.col("p_name_encoded").cast("long").alias("p_name_encoded"))


# -- documents ----------------------------------------------------------------


def order_documents(spark: SparkSession, sf_dir: str, wrapped: bool = True) -> DataFrame:
    """(file, value): orders as session documents, lines as their options."""
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_discount", "l_quantity", "l_returnflag")
    rule = lambda c, v: F.struct(F.lit(c).alias("category"), v.cast("double").alias("monetaryAmount"))
    zero = F.struct(F.lit(31).alias("category"), F.lit(-1.0).alias("monetaryAmount"))

    def option(x):
        fare = F.struct(x["l_returnflag"].alias("fareFamilyKey"), F.lit(1.0).alias("cabinClass"), x["l_linenumber"].cast("int").alias("seatsAvailable"), F.struct(x["l_quantity"].cast("int").alias("quantity")).alias("baggageAllowance"))
        info = F.struct((x["l_returnflag"] == "N").alias("isAccessTP"), F.array(fare).alias("faresInfo"))
        pricing = F.struct(x["l_linenumber"].cast("string").alias("id"), x["l_extendedprice"].cast("double").alias("totalPrice"), F.array(zero, rule(31, x["l_tax"]), rule(33, x["l_discount"])).alias("miniRules"), F.array(info).alias("pricingInfo"))
        return F.struct(x["l_partkey"].cast("string").alias("id"), F.array(pricing).alias("pricings"))

    # rows are shuffled flat, and lists are collected where they are: nothing nested is sorted or sent
    lines = items.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(*(c for c in items.columns if c != "l_orderkey"))).alias("lines"))
    options = lines.select(F.col("l_orderkey").cast("string").alias("ranker_id"), F.transform("lines", option).alias("values"))
    data = F.struct(F.col("values").alias("$values")) if wrapped else F.col("values")
    key = F.col("ranker_id").cast("long")
    person = F.struct((1940 + key % 60).cast("int").alias("yearOfBirth"), (key % 2 == 0).alias("hasAssistant"), F.when(key % 5 != 0, key % 3 == 0).alias("isGlobal"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (key % n).cast("int")).cast("string")
    route = F.struct(day(300).alias("requestDepartureDate"), F.when(key % 4 != 0, day(365)).alias("requestReturnDate"))
    head = ["ranker_id", F.concat(day(200), F.lit("T10:20:30")).alias("request_time"), F.when(key % 7 != 0, person).alias("personalData"), route.alias("routeData")]
    return options.select(F.concat("ranker_id", F.lit(".json")).alias("file"), F.to_json(F.struct(*head, data.alias("data"))).alias("value"))


@_query("""
select cast(l_orderkey as varchar) as ranker_id, round(avg(l_extendedprice), 4) as avg_total_price, round(avg(cast(l_returnflag = 'N' as int)), 6) as avg_policy_compliant,
 cast(sum(l_linenumber) as bigint) as total_seats_available, round(avg(l_tax), 6) as avg_cancellation_fee, round(avg(l_discount), 6) as avg_exchange_fee, count(*) as json_options_count
from lineitem group by 1""", raw=True)
def document_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exploded to fares, and aggregated by session."""
    df = documents.session_aggregates(documents.fares(order_documents(spark, sf_dir)))
    six = lambda c, n=6: F.round(c, n).alias(c)
    return df.select("ranker_id", six("avg_total_price", 4), six("avg_policy_compliant"), "total_seats_available", six("avg_cancellation_fee"), six("avg_exchange_fee"), "json_options_count")


@_query("""
select cast(l_orderkey as varchar) as ranker_id, cast(l_partkey as varchar) as flight_id, cast(l_linenumber as varchar) as pricing_id, round(cast(l_extendedprice as double), 6) as total_price_json,
  l_returnflag as fare_family_key, -1.0::double as cancellation_fee, cast(l_quantity as int) as baggage_quantity from lineitem""", raw=True)
def document_pricings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light form: first info, first fare, first rule; ``data`` as a plain list."""
    return _rounded(documents.pricings(order_documents(spark, sf_dir, wrapped=False)))


@_query("""
with d as (select l_orderkey as k, count(*) as n, date '2024-01-01' as t from lineitem group by 1)
select cast(k as varchar) as ranker_id, cast(t + cast(k % 200 as int) as varchar) || 'T10:20:30' as request_time, case when k % 7 <> 0 then cast(1940 + k % 60 as int) end as year_of_birth,
  case when k % 7 <> 0 then k % 2 = 0 end as has_assistant, case when k % 7 <> 0 and k % 5 <> 0 then k % 3 = 0 end as is_global,
  cast(t + cast(k % 300 as int) as varchar) as request_departure_date, case when k % 4 <> 0 then cast(t + cast(k % 365 as int) as varchar) end as request_return_date,
  cast(n as int) as n_options, cast(case when k % 7 <> 0 then 2024 - (1940 + k % 60) end as int) as traveller_age from d""", raw=True)
def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document says of its session, and the traveller's age by it."""
    return reports.traveller_age(documents.headers(order_documents(spark, sf_dir)))


@_query("""
select cast(l_orderkey as varchar) as ranker_id, count(*) as n_prices, round(max(l_extendedprice), 4) as top from lineitem group by 1""", raw=True)
def document_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature map with wildcards over lists and objects."""
    wanted = [{"path": "data.*.*.pricings.*.totalPrice", "name": "prices", "dtype": "str"}]
    docs = order_documents(spark, sf_dir)
    found = documents.mapped(docs, wanted, tables.file_stem())
    numbers = F.transform(F.split("prices", ","), lambda s: s.cast("double"))
    return found.select("ranker_id", F.size(numbers).cast("long").alias("n_prices"), F.round(F.array_max(numbers), 4).alias("top"))


@_query("""
select 'k' as key_path, round(100.0 * count(*) filter (where json_exists(props, '$.k')) / count(*), 2) as percentage_present from events""", raw=True)
def key_path_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return documents.key_paths(events, "event_id")


@_query("""
a as (select c_custkey as ranker_id, c_acctbal from customer)
select Id, round(c_acctbal, 4) as c_acctbal from sessions left join a using (ranker_id)""")
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ranker_id"), "c_acctbal")
    joined = documents.join_blocks(order_sessions(spark, sf_dir), [block])
    return joined.select("Id", F.round(F.col("c_acctbal").cast("double"), 4).alias("c_acctbal"))


@_query("""
p as (select o_custkey as g, o_orderkey as k, round(o_totalprice + o_orderkey % 2, 2) as price from orders)
select Id, k is not null as priced from sessions left join p on g = ranker_id and k = Id and price = round(totalPrice, 2)""")
def joined_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice") + F.col("o_orderkey") % 2  # that of every other option is another one
    priced = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ranker_id"), F.col("o_orderkey").cast("string").alias("flight_id"), price.alias("total_price_json"))
    joined = documents.join_prices(order_sessions(spark, sf_dir), priced, digits=2)
    return joined.select("Id", F.col("total_price_json").isNotNull().alias("priced"))


# -- reports ------------------------------------------------------------------

_M = """
m as (select *, count(*) over (partition by ranker_id) as group_size, row_number() over (partition by ranker_id order by row_ord) - 1 as pos,
  totalPrice - min(totalPrice) over (partition by ranker_id) as premium, legs0_segments1_departureFrom_airport_iata is null as is_direct,
  max(cast(pricingInfo_isAccessTP as int)) over (partition by ranker_id) as can,
  cast(split_part(legs0_duration, ':', 1) as int) * 60 + cast(split_part(legs0_duration, ':', 2) as int) as duration from sessions)
"""


@_query(_M + """select round(100 * avg(cast(premium = 0 as int)), 6) as cheapest_percent, round(avg(premium), 4) as mean_premium, round(100 * avg(cast(pricingInfo_isAccessTP as int)), 6) as compliant_percent,
  round(100 * avg(cast(is_direct as int)), 6) as direct_percent from m where selected = 1""")
def price_policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.price_policy(order_sessions(spark, sf_dir))
    return df.select(F.round("cheapest_percent", 6).alias("cheapest_percent"), F.round("mean_premium", 4).alias("mean_premium"), F.round("compliant_percent", 6).alias("compliant_percent"), F.round("direct_percent", 6).alias("direct_percent"))


@_query(_M + "select ranker_id, any_value(group_size) as group_size, max(pos) filter (where selected = 1) as chosen_position, round(max(pos) filter (where selected = 1) / any_value(group_size), 6) as relative_position from m group by 1")
def chosen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rounded(reports.chosen_positions(order_sessions(spark, sf_dir)))
    return df.withColumn("chosen_position", F.col("chosen_position").cast("long"))


@_query(_M + "select is_direct, isVip as \"isVip\", round(avg(premium), 4) as mean_premium, count(*) as n from m where selected = 1 group by 1, 2")
def premium_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.premium_by(order_sessions(spark, sf_dir), "is_direct", "isVip"), 4)


@_query(_M + "select legs0_segments0_marketingCarrier_code, count(*) as n from m where selected = 1 group by 1 order by n desc, 1 limit 10")
def chosen_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chosen_carriers(order_sessions(spark, sf_dir))


@_query(_M + "select coalesce(miniRules0_monetaryAmount, 0) as fee, count(*) as n from m where selected = 1 group by 1")
def chosen_by_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chosen_by_fee(order_sessions(spark, sf_dir))


@_query("""r as (select *, count(*) over (partition by ranker_id) as n, row_number() over (partition by ranker_id order by predicted_score desc, Id) as rk from sessions)
select case when n <= 20 then '11-20' when n <= 50 then '21-50' when n <= 200 then '51-200' else '>200' end as bucket, count(distinct ranker_id) as n_groups,
  round(cast(count(*) filter (where selected = 1 and rk <= 3) as double) / count(distinct ranker_id), 6) as hit_rate from r where n >= 11 group by 1""")
def hits_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.hits_by_size(order_sessions(spark, sf_dir)))


@_query(_M + ", c as (select ranker_id, max(pos) filter (where selected = 1) / any_value(group_size) as p from m group by 1) select cast(least(floor(p * 10), 9) as int) as decile, count(*) as n, round(count(*) / (select count(*) from c), 6) as share from c group by 1")
def position_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.position_deciles(order_sessions(spark, sf_dir)))


@_query(_M + ", c as (select any_value(group_size) as n, max(pos) filter (where selected = 1) / any_value(group_size) as p from m group by ranker_id) select round(corr(n, p), 6) as r from c")
def position_size_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.position_size_correlation(order_sessions(spark, sf_dir)))


@_query(_M + "select round(100 * avg(cast(pricingInfo_isAccessTP as int)), 6) as compliant_percent, count(*) as n from m where can = 1 and selected = 1")
def compliance_when_possible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.compliance_when_possible(order_sessions(spark, sf_dir)))


@_query(_M + """select a.Id, case when a.duration is null then null else exists (select 1 from m b where b.ranker_id = a.ranker_id and b.totalPrice <= a.totalPrice and b.duration <= a.duration
  and (b.totalPrice < a.totalPrice or b.duration < a.duration)) end as is_dominated from m a""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pareto(order_sessions(spark, sf_dir)).select("Id", "is_dominated")


@_query(f"""
q as (select quantile_cont(totalPrice, {[k / 10 for k in range(1, 10)]}) as c from sessions where fold <> 0),
b as (select fold, {" + ".join(f"cast(totalPrice > c[{k}] as int)" for k in range(1, 10))} as bin from sessions, q),
t as (select count(*) filter (where fold <> 0) + 0.5 as a, count(*) filter (where fold = 0) + 0.5 as b from b group by bin),
s as (select a / sum(a) over () as p, b / sum(b) over () as q from t)
select round(sum((p - q) * ln(p / q)), 6) as psi from s""")
def price_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_sessions(spark, sf_dir)
    return _rounded(reports.drift(df.filter("fold <> 0"), df.filter("fold = 0"), "totalPrice"))


@_query("""c as (select "profileId", legs0_segments0_marketingCarrier_code, count(*) as n from sessions group by 1, 2)
select "profileId", legs0_segments0_marketingCarrier_code, n from (select *, row_number() over (partition by "profileId" order by n desc, legs0_segments0_marketingCarrier_code) as k from c) where k = 1""")
def favourite_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.favourite(order_sessions(spark, sf_dir), "profileId")


@_query("select Id, round(legs0_segments0_seatsAvailable / nullif(max(legs0_segments0_seatsAvailable) over (partition by ranker_id), 0), 6) as seat_scarcity from sessions")
def seat_scarcity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.seat_scarcity(order_sessions(spark, sf_dir)).select("Id", "seat_scarcity"))


# -- sources, sinks, streaming ------------------------------------------------


@_query("select event_id, value from events", raw=True)
def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through every file sink: Parquet, hash-partitioned directories, CSV."""
    path = scratch(spark)
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    tables.write_parquet(events, f"{path}/plain.parquet")
    tables.write_hash_partitioned(tables.read_by_extension(spark, f"{path}/plain.parquet"), f"{path}/hashed", "user_id", 16)
    tables.write_by_extension(tables.partitioned(spark, path, "hashed").select("event_id", "value"), f"{path}/out.csv")
    return tables.read_by_extension(spark, f"{path}/out.csv", "event_id long, value double")


@_query("""
select cast(l_orderkey as varchar) as ranker_id, count(*) as n_prices, round(sum(l_extendedprice), 4) as total from lineitem group by 1""", raw=True)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents in gzipped JSON files (a sixteenth of their texts), taken in by a stream that remembers them: a second run adds nothing."""
    path = scratch(spark)
    order_documents(spark, sf_dir).select("value").write.option("maxRecordsPerFile", 10_000).option("compression", "gzip").text(f"{path}/in")
    for _ in range(2):
        ingest.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state", documents.pricings, pattern="part-*", lines=True)
    found = spark.read.parquet(f"{path}/out").groupBy("ranker_id")
    return _rounded(found.agg(F.count(F.lit(1)).alias("n_prices"), F.sum("total_price_json").alias("total")), 4)


# -- learning -----------------------------------------------------------------

_FEATURES = ["totalPrice", "price_rank", "price_percentile", "departure_hour", "total_duration_minutes", "carrier_market_share"]


#: What a ranker's fit, its folds and its measures read beside the features.
_RANKED_BY = ["ranker_id", "Id", "selected", "fold"]


@_query()
def out_of_fold_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise rankers over five group folds, and their ranking summary."""
    df = features.all_features(order_sessions(spark, sf_dir), [*_RANKED_BY, *_FEATURES])
    oof, _ = learn.cross_validated(df, _FEATURES, learn.fit_pairwise)
    return _rounded(metrics.summary(oof))


@_query()
def ranker_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a boosted pointwise ranker weighs."""
    df = stored(features.all_features(order_sessions(spark, sf_dir), ["selected", *_FEATURES]))
    return learn.importance(learn.fit_pointwise(df, _FEATURES, trees=5, depth=3), _FEATURES)


# -- more of the same tables --------------------------------------------------


@_query(_M + """select ranker_id, Id, totalPrice as total_price, legs0_segments0_marketingCarrier_code as marketing_carrier, "profileId" as profile_id, miniRules0_monetaryAmount as cancellation_fee,
  cast(not (legs0_segments1_departureFrom_airport_iata is not null) as int) as is_direct, round(count(*) over (partition by ranker_id, legs0_segments0_marketingCarrier_code) / count(*) over (partition by ranker_id), 6) as carrier_market_share,
  row_number() over (partition by ranker_id order by totalPrice, Id) as price_rank, row_number() over (partition by ranker_id order by totalPrice desc, Id) as price_rank_desc,
  row_number() over (partition by ranker_id order by row_ord) as position,
  round(duration - avg(duration) over (partition by ranker_id), 6) as duration_diff_from_mean,
  case when duration is null then null else round(row_number() over (partition by ranker_id order by totalPrice, Id) + rank() over (partition by ranker_id order by duration nulls last) + (count(duration) over (partition by ranker_id, duration) - 1) / 2.0, 6) end as combined_rank_score
from m""")
def feature_copies_and_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed copies, ranks and interactions of the feature steps, key columns first."""
    df = features.key_columns_first(features.all_features(order_sessions(spark, sf_dir)))
    return _rounded(df.select("ranker_id", "Id", "total_price", "marketing_carrier", "profile_id", "cancellation_fee", "is_direct", "carrier_market_share", "price_rank", "price_rank_desc", "position", "duration_diff_from_mean", "combined_rank_score"))


@_query("""
a as (select o_custkey as k, avg(l_extendedprice) as p, avg(cast(l_returnflag = 'N' as int)) as c from orders join lineitem on l_orderkey = o_orderkey where o_custkey % 4 <> 0 group by 1),
m as (select *, try_cast(legs0_departureAt as timestamp) as dep, try_cast(legs0_arrivalAt as timestamp) as arr, case when Id % 7 = 0 then null else (Id % 7) * 50.0 end as fee,
  cast(split_part(legs0_duration, ':', 1) as int) * 60 + cast(split_part(legs0_duration, ':', 2) as int) as minutes from sessions left join a on k = ranker_id),
r as (select *, rank() over (partition by ranker_id order by totalPrice) + (count(*) over (partition by ranker_id, totalPrice) - 1) / 2.0 as price_place,
  case when minutes is not null then rank() over (partition by ranker_id order by minutes nulls last) + (count(minutes) over (partition by ranker_id, minutes) - 1) / 2.0 end as minutes_place from m)
select ranker_id, Id, round(taxes, 4) as tax_amount, round(totalPrice - avg(totalPrice) over w, 6) as price_diff_from_mean, round(totalPrice - min(totalPrice) over w, 4) as price_diff_from_min,
  round(totalPrice - max(totalPrice) over w, 4) as price_diff_from_max, round((price_place - 1) / nullif(count(*) over w - 1, 0), 6) as price_percentile,
  cast(dep as varchar) as departure_datetime, cast(arr as varchar) as arrival_datetime, round((minutes_place - 1) / nullif(count(minutes) over w - 1, 0), 6) as duration_percentile,
  searchRoute as search_route, case when Id % 2 = 0 then 'AAA' else 'BBB' end as origin_airport, concat('Z', cast(Id % 8 as varchar)) as destination_airport,
  legs0_segments0_operatingCarrier_code as operating_carrier, cast(null as varchar) as aircraft_code, legs0_segments0_cabinClass as cabin_class, legs0_segments0_seatsAvailable as seats_available,
  case when Id % 4 > 0 then Id % 4 end as baggage_quantity, corporateTariffCode as corporate_tariff, pricingInfo_isAccessTP as policy_compliant, companyID as company_id,
  Id % 2 = 1 as user_gender, Id % 50 as user_nationality, case when Id % 3 > 0 then concat('P', cast(Id % 3 as varchar)) end as frequent_flyer_programs, isVip as is_vip, Id % 5 > 0 as books_by_self,
  case when Id % 6 > 0 then Id % 2 end as can_cancel, Id % 3 as can_exchange, cast(fee as double) as exchange_fee, round(fee / nullif(totalPrice, 0), 8) as exchange_fee_rate,
  round(totalPrice / nullif(p, 0), 6) as price_vs_avg_search_price, cast(totalPrice > p as int) as is_pricier_than_average, round(cast(pricingInfo_isAccessTP as int) * c, 6) as policy_compliance_interaction,
  round(stddev_samp(totalPrice) over w, 4) as group_price_std, round(max(totalPrice) over w - min(totalPrice) over w, 4) as group_price_range,
  cast(count(distinct legs0_segments0_marketingCarrier_code) over w as bigint) as unique_carriers_in_group, cast(count(distinct legs0_segments0_cabinClass) over w as bigint) as unique_cabin_classes_in_group,
  cast(price_place as double) as price_position_in_group, cast(minutes_place as double) as duration_position_in_group
from r window w as (partition by ranker_id)""")
def other_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature columns that the other queries leave out, where the options hold the optional columns (but the aircraft) and some sessions have documents."""
    items = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders").filter("o_custkey % 4 <> 0"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggregates = items.groupBy(F.col("o_custkey").alias("ranker_id")).agg(F.avg("l_extendedprice").alias("avg_total_price"), F.avg((F.col("l_returnflag") == "N").cast("int")).alias("avg_policy_compliant"))
    key = F.col("Id")
    options = order_sessions(spark, sf_dir).withColumns({
        "legs0_segments0_departureFrom_airport_iata": F.when(key % 2 == 0, "AAA").otherwise("BBB"), "legs0_segments0_arrivalTo_airport_iata": F.concat(F.lit("Z"), (key % 8).cast("string")),
        "legs0_segments0_baggageAllowance_quantity": F.nullif(key % 4, F.lit(0)), "sex": key % 2 == 1, "nationality": key % 50, "frequentFlyer": F.when(key % 3 > 0, F.concat(F.lit("P"), (key % 3).cast("string"))),
        "bySelf": key % 5 > 0, "miniRules0_statusInfos": F.when(key % 6 > 0, key % 2), "miniRules1_statusInfos": key % 3, "miniRules1_monetaryAmount": F.when(key % 7 > 0, key % 7 * 50.0),
    })
    four = ("tax_amount", "price_diff_from_min", "price_diff_from_max", "group_price_std", "group_price_range")
    six = ("price_diff_from_mean", "price_percentile", "duration_percentile", "price_vs_avg_search_price", "policy_compliance_interaction")
    as_they_are = (
        "search_route", "origin_airport", "destination_airport", "operating_carrier", "aircraft_code", "cabin_class", "seats_available", "baggage_quantity", "corporate_tariff", "policy_compliant", "company_id", "user_gender",
        "user_nationality", "frequent_flyer_programs", "is_vip", "books_by_self", "can_cancel", "can_exchange", "exchange_fee", "is_pricier_than_average",
    )
    others = ("exchange_fee_rate", "departure_datetime", "arrival_datetime", "unique_carriers_in_group", "unique_cabin_classes_in_group", "price_position_in_group", "duration_position_in_group")
    df = features.training_frame(options, aggregates, columns=["ranker_id", "Id", *four, *six, *others, *as_they_are])
    return df.select(
        "ranker_id", "Id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in four), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in six), F.round("exchange_fee_rate", 8).alias("exchange_fee_rate"),
        *(F.col(c).cast("string").alias(c) for c in ("departure_datetime", "arrival_datetime")), *(F.col(c).cast("long").alias(c) for c in ("unique_carriers_in_group", "unique_cabin_classes_in_group")),
        *(F.col(c).cast("double").alias(c) for c in ("price_position_in_group", "duration_position_in_group")), *as_they_are,
    )


@_query("""
a as (select o_custkey as k, avg(l_extendedprice) as p, avg(cast(l_returnflag = 'N' as int)) as c from orders join lineitem on l_orderkey = o_orderkey group by 1)
select count(*) as n_rows, count(distinct ranker_id) as n_groups, round(avg(totalPrice / nullif(p, 0)), 6) as mean_ratio, round(avg(cast(pricingInfo_isAccessTP as int) * c), 6) as mean_compliance
from sessions left join a on k = ranker_id""")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, join of session aggregates, all features, key columns first."""
    items = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggregates = items.groupBy(F.col("o_custkey").alias("ranker_id")).agg(F.avg("l_extendedprice").alias("avg_total_price"), F.avg((F.col("l_returnflag") == "N").cast("int")).alias("avg_policy_compliant"))
    df = features.training_frame(order_sessions(spark, sf_dir), aggregates)
    return _rounded(df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ranker_id").alias("n_groups"), F.avg("price_vs_avg_search_price").alias("mean_ratio"), F.avg("policy_compliance_interaction").alias("mean_compliance")))


@_query("select legs0_segments0_marketingCarrier_code, count(*) as n from sessions group by 1")
def carrier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(order_sessions(spark, sf_dir), "legs0_segments0_marketingCarrier_code")


@_query("select Id from sessions where ranker_id in (select ranker_id from sessions where fold = 0) and ranker_id not in (select ranker_id from sessions where totalPrice > 400000)")
def semi_and_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of sessions of a fold that have no option above a price."""
    df = order_sessions(spark, sf_dir)
    keys = lambda c: df.filter(c).select("ranker_id").distinct()
    return df.join(keys("fold = 0"), "ranker_id", "left_semi").join(keys("totalPrice > 400000"), "ranker_id", "left_anti").select("Id")


@_query("select fold, count(*) as n, round(sum(totalPrice), 2) as total from sessions group by 1")
def folds_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of single folds as one."""
    df = order_sessions(spark, sf_dir)
    return _rounded(splits.out_of_fold([df.filter(F.col("fold") == k) for k in range(5)]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("totalPrice").alias("total")), 2)


@_query("""select c_custkey, contains('/' || upper(substr(c_mktsegment, 1, 2)) || '/' || upper(substr(c_mktsegment, 3, 2)) || '/', '/' || upper(substr(c_name, 1, 2)) || '/') as loyalty_match,
  year(timestamp '2020-06-01') - cast(1940 + c_nationkey as int) as traveller_age from customer""", raw=True)
def loyalty_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes that hold the carrier, and the traveller's age at the request."""
    two = lambda c, k: F.upper(F.substring(c, k, 2))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", two("c_mktsegment", 1), two("c_mktsegment", 3)).alias("frequentFlyer"), two("c_name", 1).alias("carrier"), (1940 + F.col("c_nationkey")).cast("int").alias("year_of_birth"), F.lit("2020-06-01").alias("request_time"))
    return reports.traveller_age(reports.loyalty_match(df, carrier="carrier")).select("c_custkey", "loyalty_match", "traveller_age")


@_query("""select o_orderkey, round(1 - o_orderkey % 100 / 100.0, 6) as flex_score from orders""", raw=True)
def flex_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A penalty block of a feature map, cast and derived."""
    raw = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("string").alias("penalty"))
    block = documents.feature_blocks(raw, [{"path": "p", "name": "penalty", "dtype": "float"}], penalty="penalty", join_key="o_orderkey")["penalty"]
    return _rounded(block.select("o_orderkey", "flex_score"))


@_query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1", raw=True)
def bucketed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table grouped by its key: no shuffle."""
    name = f"events_{uuid.uuid4().hex}"
    tables.write_bucketed(read_table(spark, sf_dir, "events").select("user_id", "value"), name, "user_id", 8)
    return _rounded(spark.table(name).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@_query(" union all ".join(f"select '{c}' as \"column\", case typeof(any_value({c})) when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'INTEGER' then 'int' else lower(typeof(any_value({c}))) end as type from orders" for c in _COLUMNS), raw=True)
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of some of the columns."""
    return tables.schema_info(spark, f"{sf_dir}/orders.parquet").filter(F.col("column").isin(*_COLUMNS)).select("column", "type")


@_query()
def search_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG over two folds for settings of the pairwise ranker."""
    df = features.all_features(order_sessions(spark, sf_dir), [*_RANKED_BY, "totalPrice", "price_rank"]).withColumn("fold", F.col("fold") % 2)
    return learn.search(df, ["totalPrice", "price_rank"], {"reg": [0.01, 0.1]}, fold="fold")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking_summary(spark, sf_dir)



# -- sources, sinks and features not met above ---------------------------------


@_query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'", raw=True)
def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of a table, and a filter that the scan takes."""
    return tables.scan(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).filter("l_returnflag = 'R'").drop("l_returnflag")


@_query("select o_orderkey from orders limit 100", raw=True)
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a file: the feature is the limit."""
    return tables.first_rows(spark, f"{sf_dir}/orders.parquet", 100).select("o_orderkey")


@_query("select o_orderkey, o_totalprice, o_orderstatus from orders", raw=True)
def split_and_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training table written in parts that are appended, and read as a split."""
    path = scratch(spark)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in ("F", "O", "P"):
        tables.append_parquet(orders.filter(F.col("o_orderstatus") == status), f"{path}/train.parquet")
    return tables.load_split(spark, path, "train")


@_query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1", raw=True)
def small_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one CSV file, read and written again as JSON lines."""
    path = scratch(spark)
    found = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
    tables.write_small_csv(found, f"{path}/report.csv")
    tables.write_report(tables.read_by_extension(spark, f"{path}/report.csv", "o_orderstatus string, n long, total double"), f"{path}/report.json")
    return spark.read.schema("o_orderstatus string, n long, total double").json(f"{path}/report.json")


@_query("select cast(event_id as varchar) as key, length(props) as n from events", raw=True)
def documents_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small JSON files, one for each document, by the names that Spark gave them: keys come from the text."""
    path = scratch(spark)
    read_table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "props")).alias("value")).repartition(64).write.text(f"{path}/a/b")
    files = spark.read.option("recursiveFileLookup", True).text(path)
    found = files.select(F.from_json("value", "event_id long, props string").alias("d")).select("d.*")
    return found.select(F.col("event_id").cast("string").alias("key"), F.length("props").alias("n"))


@_query("select Id, cast(pricingInfo_isAccessTP as int) as \"pricingInfo_isAccessTP\", cast(epoch_us(requestDate) as bigint) as \"requestDate\", \"searchRoute\" from sessions")
def learner_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as a learner takes them."""
    return S.typed_for_learning(order_sessions(spark, sf_dir).select("Id", "pricingInfo_isAccessTP", "requestDate", "searchRoute"))


@_query("""
x as (select *, cast(legs0_departureAt as timestamp) as dep, cast(legs0_arrivalAt as timestamp) + to_hours(Id % 11 - 3) as nxt, requestDate + to_days(cast(Id % 40 as int)) as back from sessions)
select Id, 1 + cast(legs0_segments1_departureFrom_airport_iata is not null as int) as num_segments, cast(60 * (Id % 11 - 3) as int) as layover_duration_minutes,
  cast(trunc(date_diff('second', dep, back) / 86400) as bigint) as trip_duration_days, cast(trunc(date_diff('second', requestDate, dep) / 86400) as bigint) as booking_window_days,
  cast(hour(dep) >= 22 and hour(cast(legs0_arrivalAt as timestamp)) <= 5 as int) as is_red_eye_flight from x""")
def layovers_and_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time features of tables that hold second segments and return dates."""
    df = order_sessions(spark, sf_dir)
    wait = F.make_dt_interval(F.lit(0), (F.col("Id") % 11 - 3).cast("int"))
    df = df.withColumns({
        "legs0_segments0_arrivalAt": F.col("legs0_arrivalAt"), "legs0_segments1_departureAt": (F.col("legs0_arrivalAt").cast("timestamp_ntz") + wait).cast("string"),
        "requestReturnDate": F.col("requestDate") + F.make_dt_interval((F.col("Id") % 40).cast("int")),
    })
    out = features.all_features(df)
    return out.select("Id", "num_segments", "layover_duration_minutes", "trip_duration_days", "booking_window_days", "is_red_eye_flight")


@_query("""
s as (select Id, ranker_id, case when Id % 50 = 0 then 1 else row_number() over (partition by ranker_id order by predicted_score desc, Id) end as r from sessions where Id % 97 <> 0),
g as (select min(r) = 1 and max(r) = count(*) and count(distinct r) = count(*) as ok from s group by ranker_id)
select true as has_columns, (select count(*) from s) = (select count(*) from sessions) as same_rows, (select count(*) from sessions where Id not in (select Id from s)) = 0 as same_ids,
  (select bool_and(ok) from g) as valid_ranks, false as valid""")
def spoilt_submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission that lacks rows and repeats ranks."""
    df = order_sessions(spark, sf_dir)
    spoilt = submission.submission(df).filter("Id % 97 <> 0").withColumn("selected", F.when(F.col("Id") % 50 == 0, 1).otherwise(F.col("selected")))
    return submission.validated(spoilt, df)


@_query("""
with c as (select split_part(p_name, ' ', 1) as v, count(*) as n from part group by 1)
select p_partkey, case when n < 20 then 'other' else v end as word, round(p_size * 1.0, 6) as size from part join c on v = split_part(p_name, ' ', 1)""", raw=True)
def rare_levels_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of a feature map, rare levels of the text one collapsed, joined in turn."""
    raw = read_table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("word"), F.col("p_size").cast("string").alias("size"))
    wanted = [{"path": "w", "name": "word", "dtype": "str"}, {"path": "s", "name": "size", "dtype": "float"}]
    blocks = documents.feature_blocks(raw, wanted, least=20, join_key="p_partkey")
    return _rounded(documents.join_blocks(raw.select("p_partkey"), list(blocks.values()), group="p_partkey"))


_INFO = "data.$values.pricings.pricingInfo"
#: Paths of the documents by the condition on the key that they occur under.
_PATHS = {
    "true": ["ranker_id", "request_time", "routeData", "routeData.requestDepartureDate", "data", "data.$values", *(f"data.$values.{x}" for x in ("id", "pricings", "pricings.id", "pricings.totalPrice", "pricings.miniRules", "pricings.miniRules.category", "pricings.miniRules.monetaryAmount")),
             _INFO, f"{_INFO}.isAccessTP", f"{_INFO}.faresInfo", *(f"{_INFO}.faresInfo.{x}" for x in ("fareFamilyKey", "cabinClass", "seatsAvailable", "baggageAllowance", "baggageAllowance.quantity"))],
    "l_orderkey % 7 <> 0": ["personalData", "personalData.yearOfBirth", "personalData.hasAssistant"],
    "l_orderkey % 7 <> 0 and l_orderkey % 5 <> 0": ["personalData.isGlobal"],
    "l_orderkey % 4 <> 0": ["routeData.requestReturnDate"],
}


@_query(" union all ".join(f"select unnest({paths}) as key_path, round(100.0 * count(distinct l_orderkey) filter (where {when}) / count(distinct l_orderkey), 2) as percentage_present from lineitem" for when, paths in _PATHS.items()), raw=True)
def document_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census of nested documents: all paths, optional ones too."""
    return documents.key_paths(order_documents(spark, sf_dir), "file")


@_query("select fold, count(*) as n, count(distinct ranker_id) as n_groups from sessions group by 1")
def out_of_fold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option is scored once, by the model that has not seen its fold."""
    df = features.all_features(order_sessions(spark, sf_dir), [*_RANKED_BY, "totalPrice", "price_rank"])
    oof, _ = learn.cross_validated(df, ["totalPrice", "price_rank"], learn.fit_pairwise)
    return oof.filter(F.col("predicted_score").isNotNull()).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ranker_id").alias("n_groups"))


# -- files of many parts, bands, sketches, fixed models ---------------------------


@_query("select o_orderkey from (select * from orders order by o_orderkey limit 5000)", raw=True)
def first_orders_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a folder whose files follow one another: the feature is the limit."""
    path = scratch(spark)
    read_table(spark, sf_dir, "orders").repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return tables.first_rows(spark, path, 5000).select("o_orderkey")


@_query("""
select cast(o_custkey as varchar) as ranker_id, count(*) as n_prices, round(sum(cast(o_totalprice as double)), 4) as total, max(o_orderpriority) as last_priority from orders group by 1""", raw=True)
def documents_below_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each customer, in ten folders by the key's last digit; whole files are read, packed and taken apart."""
    path = scratch(spark)
    fares = F.array(F.struct(F.array(F.struct(F.col("o_orderstatus").alias("fareFamilyKey"))).alias("faresInfo")))
    pricing = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("double").alias("totalPrice"), fares.alias("pricingInfo"))
    order = F.struct(F.col("o_orderpriority").alias("id"), F.array(pricing).alias("pricings"))
    docs = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("ranker_id")).agg(F.struct(F.collect_list(order).alias("$values")).alias("data"))
    name = F.format_string("folder=%d/%s.json", F.col("ranker_id").cast("long") % 10, F.col("ranker_id"))
    files.write_documents(docs.select(name.alias("name"), F.to_json(F.struct("ranker_id", "data")).alias("value")), f"{path}/in")
    packed = tables.pack_documents(spark, f"{path}/in", f"{path}/packed", file_bytes=1 << 20)
    found = documents.pricings(packed).groupBy("ranker_id")
    return _rounded(found.agg(F.count(F.lit(1)).alias("n_prices"), F.sum("total_price_json").alias("total"), F.max("flight_id").alias("last_priority")), 4)


@_query("""
p as (select o_custkey as g, o_orderkey as k, o_totalprice + unnest([0.4, -0.3, 7.0, 0.5000001]) * (1 + o_orderkey % 3) as price from orders)
select Id, (select arg_min(round(cast(price as double), 6), (abs(cast(totalPrice as double) - cast(price as double)), price)) from p where g = ranker_id and k = Id and abs(cast(totalPrice as double) - cast(price as double)) <= 0.75) as nearest from sessions""")
def prices_within_a_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest price of each option that is at most 0.75 away."""
    shift = F.explode(F.array(*(F.lit(x).cast("decimal(10,7)") for x in ("0.4", "-0.3", "7.0", "0.5000001")))).alias("shift")
    shifted = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", shift)
    price = (F.col("o_totalprice") + F.col("shift") * (1 + F.col("o_orderkey") % 3)).cast("double")
    priced = shifted.select(F.col("o_custkey").cast("string").alias("ranker_id"), F.col("o_orderkey").cast("string").alias("flight_id"), price.alias("total_price_json"))
    return documents.join_prices_within(order_sessions(spark, sf_dir), priced, 0.75).select("Id", F.round("total_price_json", 6).alias("nearest"))


_SKETCHED = ("totalPrice", "miniRules0_monetaryAmount", "ranker_id")


@_query(" union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_null, round(cast(min({c}) as double), 4) as least, round(cast(max({c}) as double), 4) as greatest, true as distinct_near, true as quantiles_near from sessions" for c in _SKETCHED))
def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each fold, stored, read back and put together; their figures beside the exact ones: distinct within 3 %, quantiles' ranks within 2 %."""
    df = order_sessions(spark, sf_dir)
    path = scratch(spark)
    sketches.sketched(df, list(_SKETCHED), ["fold"]).write.parquet(path)
    found = sketches.read_off(sketches.merged(spark.read.parquet(path)), (0.25, 0.5, 0.95))
    share = lambda c, p: F.struct(F.avg((F.col(c) < F.col(p)).cast("double")).alias("below"), F.avg((F.col(c) <= F.col(p)).cast("double")).alias("upto"))
    out = []
    for c in _SKETCHED:
        one = found.filter(F.col("column") == c).select("n_distinct", "p25", "p50", "p95")
        exact = df.select(F.col(c).cast("double").alias("x")).filter("x is not null").join(F.broadcast(one), F.lit(True))  # one row
        held = exact.agg(F.count_distinct("x").alias("d"), F.first("n_distinct").alias("e"), *(share("x", p).alias(p) for p in ("p25", "p50", "p95")))
        near = [(F.col(f"{p}.below") <= q + 0.02) & (F.col(f"{p}.upto") >= q - 0.02) for p, q in (("p25", 0.25), ("p50", 0.5), ("p95", 0.95))]
        out.append(held.select(F.lit(c).alias("of"), (F.abs(F.col("d") - F.col("e")) <= 0.03 * F.col("d")).alias("distinct_near"), (near[0] & near[1] & near[2]).alias("quantiles_near")))
    checks = out[0].unionAll(out[1]).unionAll(out[2])
    return _rounded(found.join(F.broadcast(checks), F.col("column") == F.col("of")).select("column", "n_rows", "n_null", "least", "greatest", "distinct_near", "quantiles_near"), 4)


@_query("""
a as (select o_custkey as k, avg(l_extendedprice) as p from orders join lineitem on l_orderkey = o_orderkey group by 1)
select Id, ranker_id, "profileId", selected, round(totalPrice / nullif(p, 0), 6) as price_vs_avg_search_price, count(*) over (partition by ranker_id) as group_size,
  row_number() over (partition by ranker_id order by totalPrice, Id) as price_rank from sessions left join a on k = ranker_id where "profileId" in (1, 4, 9)""")
def training_on_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training frame of chosen travellers."""
    items = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggregates = items.groupBy(F.col("o_custkey").alias("ranker_id")).agg(F.avg("l_extendedprice").alias("avg_total_price"))
    df = features.training_frame(order_sessions(spark, sf_dir), aggregates, profiles=[1, 4, 9])
    return _rounded(df.select("Id", "ranker_id", "profileId", "selected", "price_vs_avg_search_price", "group_size", "price_rank"))


@_query("""
select Id, round((-0.001 * totalPrice + 2 * coalesce(miniRules0_monetaryAmount, 0) + 0.5 * row_number() over (partition by ranker_id order by totalPrice, Id)) / 2, 6) as predicted_score from sessions""")
def averaged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of two rankers' scores, with given weights."""
    df = order_sessions(spark, sf_dir).withColumns({"price_rank": W.ordinal_rank("totalPrice"), "fee": F.coalesce("miniRules0_monetaryAmount", F.lit(0.0))})
    models = [learn.weighted({"totalPrice": -0.001, "fee": 2.0}), learn.weighted({"price_rank": 0.5})]
    return learn.averaged(df, models, ["totalPrice", "fee", "price_rank"]).select("Id", F.round("predicted_score", 6).alias("predicted_score"))


@_query(_RANKED + _KS + " from r group by ranker_id), f as (select fold, avg(g3) as g from s join (select distinct ranker_id, fold from sessions) using (ranker_id) where n >= 11 group by fold) select round(avg(g), 6) as ndcg_3 from f")
def mean_over_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the folds' mean NDCG: every fold weighs the same."""
    return _rounded(learn.mean_over_folds(order_sessions(spark, sf_dir), 3))


@_query(f"""
x as (select Id, ranker_id, selected, cast(totalPrice as double) / 100000 as a, row_number() over (partition by ranker_id order by totalPrice, Id) / 10.0 as b from sessions),
e as (select *, exp(0.3 * b - 0.5 * a) as e, 0.3 * b - 0.5 * a as s from x),
g as (select sum(e) as z, sum(s) filter (where selected = 1) as good, sum(e * a) as ea, sum(e * b) as eb, sum(a) filter (where selected = 1) as sa, sum(b) filter (where selected = 1) as sb from e group by ranker_id having sum(selected) > 0)
select count(*) as n_groups, round(avg(ln(z) - good), 6) as loss, round(avg(ea / z - sa), 6) as slope_a, round(avg(eb / z - sb), 6) as slope_b from g""")
def listwise_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient of the listwise ranker at given weights."""
    df = order_sessions(spark, sf_dir).select("ranker_id", "selected", F.array(F.col("totalPrice").cast("double") / 100000, W.ordinal_rank("totalPrice") / 10.0).alias("x"))
    found = learn.softmax_gradient(df, [-0.5, 0.3])
    return _rounded(found.select("n_groups", "loss", F.get("gradient", F.lit(0)).alias("slope_a"), F.get("gradient", F.lit(1)).alias("slope_b")))


@_query()
def listwise_and_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG at 3 of the two linear rankers, out of fold."""
    df = order_sessions(spark, sf_dir).withColumns({"price_rank": W.ordinal_rank("totalPrice"), "hour": F.hour(F.col("legs0_departureAt").cast("timestamp")), "fold": F.col("fold") % 2})
    df = stored(df.select(*_RANKED_BY, "totalPrice", "price_rank", "hour"))
    out = []
    for name, fit in (("pairwise", learn.fit_pairwise), ("listwise", learn.fit_listwise)):
        oof, _ = learn.cross_validated(df, ["totalPrice", "price_rank", "hour"], fit)
        out.append(learn.mean_over_folds(oof, 3).select(F.lit(name).alias("ranker"), "ndcg_3"))
    return out[0].unionAll(out[1])


@_query()
def halved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the pairwise ranker, halved on growing shares of the sessions."""
    df = order_sessions(spark, sf_dir).withColumns({"price_rank": W.ordinal_rank("totalPrice"), "fold": F.col("fold") % 2})
    df = df.select(*_RANKED_BY, "totalPrice", "price_rank")
    return learn.halved(df, ["totalPrice", "price_rank"], {"reg": [0.001, 0.01, 0.1, 1.0]}, keep=2, rounds=2)


@_query("""
m as (select avg(totalPrice) as p, avg(coalesce(miniRules0_monetaryAmount, 0)) as f from sessions),
w as (select Id, -0.001 * (cast(totalPrice as double) - p) as price, 2 * (coalesce(miniRules0_monetaryAmount, 0) - f) as fee from sessions, m where selected = 1)
select Id, 'totalPrice' as feature, round(price, 4) as gain from w union all select Id, 'fee', round(fee, 4) from w""")
def attributions_of_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of the chosen options under a linear ranker: each weight times the distance from the mean."""
    df = order_sessions(spark, sf_dir).withColumns({"fee": F.coalesce("miniRules0_monetaryAmount", F.lit(0.0)), "totalPrice": F.col("totalPrice").cast("double")})
    base = df.agg(F.avg("totalPrice").alias("totalPrice"), F.avg("fee").alias("fee")).first().asDict()
    found = learn.attributions(df.filter("selected = 1"), learn.weighted({"totalPrice": -0.001, "fee": 2.0}), ["totalPrice", "fee"], base, draws=3)
    return _rounded(found, 4)


# -- guards, and learning whose outcome is known ---------------------------------


def _refused(check, *args) -> bool:
    try:
        check(*args)
    except ValueError:
        return True
    return False


@_query("""
h as (select count(*) > 0 as met from (select ranker_id from sessions where Id % 2 = 0 intersect select ranker_id from sessions where Id % 2 = 1)),
f as (select count(*) > 0 as met from (select ranker_id from sessions where fold = 0 intersect select ranker_id from sessions where fold <> 0))
select 'sessions in both halves of the rows' as guard, met as refused from h union all select 'sessions in two folds', met from f
union all select 'label among the columns', true union all select 'label dropped', false""")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of splits and test tables refuse."""
    df = order_sessions(spark, sf_dir)
    found = [
        ("sessions in both halves of the rows", _refused(splits.assert_no_shared_groups, df.filter("Id % 2 = 0"), df.filter("Id % 2 = 1"))),
        ("sessions in two folds", _refused(splits.assert_no_shared_groups, df.filter("fold = 0"), df.filter("fold <> 0"))),
        ("label among the columns", _refused(quality.no_label, df)),
        ("label dropped", _refused(quality.no_label, df.drop("selected"))),
    ]
    return spark.createDataFrame(found, "guard string, refused boolean")


@_query("select ranker_id, count(*) as n, round(sum(totalPrice), 2) as total, round(avg(cast(legs0_segments0_seatsAvailable as double)), 6) as seats, 'legs9_duration' as lacking from sessions group by 1")
def sums_of_chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted columns, as far as the table has them; core columns that it lacks are named."""
    df = order_sessions(spark, sf_dir)
    wanted, lacking = features.chosen_features(df, ["totalPrice", "legs0_segments0_seatsAvailable", "no_such_column"], core=("totalPrice", "legs9_duration"))
    price, seats = wanted  # the third is not there
    found = df.groupBy("ranker_id").agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.avg(seats).alias("seats"), F.lit(",".join(lacking)).alias("lacking"))
    return found.select("ranker_id", "n", F.round(F.col("total").cast("double"), 2).alias("total"), F.round("seats", 6).alias("seats"), "lacking")


@_query("select 'totalPrice' as feature, cast(count(*) filter (where totalPrice > 150000) > 0 as double) as importance from sessions union all select 'fee', cast(0 as double)")
def importance_of_a_planted_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that one column decides: a stump's gain is all that column's."""
    df = order_sessions(spark, sf_dir).select("ranker_id", "Id", (F.col("totalPrice") > 150000).cast("int").alias("selected"), F.col("totalPrice").cast("double").alias("totalPrice"), F.coalesce("miniRules0_monetaryAmount", F.lit(0.0)).alias("fee"))
    return _rounded(learn.importance(learn.fit_pointwise(df, ["totalPrice", "fee"], trees=1, depth=1), ["totalPrice", "fee"]))


@_query("""
g as (select count(*) as n from sessions group by ranker_id)
select 'recency' as feature, count(*) filter (where n >= 11) > 0 as matters from g union all select 'totalPrice', false""")
def permuted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest option is the chosen one: a ranker by date loses when dates are dealt to other rows, and nothing by prices that it doesn't weigh."""
    df = order_sessions(spark, sf_dir).withColumn("recency", F.datediff(F.col("requestDate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double"))
    found = learn.permutation_importance(df, learn.weighted({"recency": 1.0, "totalPrice": 0.0}), ["recency", "totalPrice"], k=1)
    return found.select("feature", (F.col("drop") > 0.2).alias("matters"))


@_query("select Id, round(-0.002 * cast(totalPrice as double) + 3 * coalesce(miniRules0_monetaryAmount, 0), 6) as predicted_score from sessions")
def scores_of_a_loaded_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker written to the shared folder and read again."""
    path = f"{scratch(spark)}/ranker"
    learn.save(learn.weighted({"totalPrice": -0.002, "miniRules0_monetaryAmount": 3.0}), path)
    found = learn.scored(order_sessions(spark, sf_dir), learn.load(path), ["totalPrice", "miniRules0_monetaryAmount"])
    return _rounded(found.select("Id", "predicted_score"))


@_query("""
r as (select *, count(*) over (partition by w, ranker_id) as n, row_number() over (partition by w, ranker_id order by w * cast(totalPrice as double) desc, Id) as rk,
  row_number() over (partition by w, ranker_id order by selected desc, Id) as ideal from sessions, (values (-1.0), (1.0)) as t(w)),
s as (select w, ranker_id, fold, any_value(n) as n,
""" + _KS + """ from r group by w, ranker_id, fold),
f as (select w, fold, avg(g3) as g from s where n >= 11 group by w, fold)
select case when w < 0 then '{''weight'': -1.0}' else '{''weight'': 1.0}' end as setting, round(avg(g), 6) as ndcg from f group by w""")
def search_of_given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over rankers that have nothing to learn: the weight is the setting."""
    given = lambda d, f, weight: learn.weighted({f[0]: weight})
    return _rounded(learn.search(order_sessions(spark, sf_dir), ["totalPrice"], {"weight": [-1.0, 1.0]}, fit=given))
