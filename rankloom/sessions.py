"""The option table: one row per option, rows of one session share ``ranker_id``.

``order_sessions`` views the order tables as such a table (a customer is a
session, an order an option), for tests, benchmarks and the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = "ranker_id"
ITEM = "Id"
LABEL = "selected"
SCORE = "predicted_score"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fold(key, folds: int, seed: str = ""):
    """A fold number from the first 32 bits of the key's MD5: the same on every engine."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") % folds).cast("long")


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as sessions of options; nothing is shuffled but the rank of the latest order."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shift = F.make_dt_interval((key % 30).cast("int"), (key * 37 % 24).cast("int"))
    latest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("ranker_id"),
        key.alias("Id"),
        F.col("c_nationkey").alias("profileId"),
        (F.col("c_nationkey") % 7).alias("companyID"),
        key.alias("row_ord"),
        F.col("o_totalprice").alias("totalPrice"),
        (F.col("o_totalprice") * 0.1).alias("taxes"),
        F.col("o_orderdate").alias("requestDate"),
        (F.col("o_orderdate") + shift).cast("string").alias("legs0_departureAt"),
        (F.col("o_orderdate") + shift + F.make_dt_interval(F.lit(0), (key % 9).cast("int"))).cast("string").alias("legs0_arrivalAt"),
        F.when(key % 17 == 0, None).otherwise(F.concat(two(key * 37 % 24), F.lit(":"), two(key * 11 % 60), F.lit(":00"))).alias("legs0_duration"),
        F.col("o_orderpriority").alias("legs0_segments0_marketingCarrier_code"),
        F.when(key % 5 == 0, "OTHER").otherwise(F.col("o_orderpriority")).alias("legs0_segments0_operatingCarrier_code"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 2.0).otherwise(4.0).alias("legs0_segments0_cabinClass"),
        (key % 9).cast("double").alias("legs0_segments0_seatsAvailable"),
        F.when(key % 6 == 0, "HUB").alias("legs0_segments1_departureFrom_airport_iata"),
        F.when(key % 3 == 0, "A/B").otherwise("A").alias("searchRoute"),
        (F.col("o_orderstatus") != "P").alias("pricingInfo_isAccessTP"),
        (F.col("c_mktsegment") == "MACHINERY").alias("isVip"),
        F.nullif(F.col("c_nationkey") % 3, F.lit(0)).alias("corporateTariffCode"),
        F.when(key % 4 == 0, None).otherwise((key % 4 - 1) * 100.0).cast("double").alias("miniRules0_monetaryAmount"),
        F.when(latest == 1, 1).otherwise(0).alias("selected"),
        (-F.col("o_totalprice")).alias("predicted_score"),
        hash_fold(F.col("o_custkey"), 5).alias("fold"),
    )


#: The same view for DuckDB, as the common table expression ``sessions``.
SESSIONS_SQL = """
sessions as (
select o_custkey as ranker_id, o_orderkey as Id, c_nationkey as profileId, c_nationkey % 7 as companyID, o_orderkey as row_ord,
 o_totalprice as totalPrice, o_totalprice * 0.1 as taxes, o_orderdate as requestDate,
 cast(o_orderdate + to_days(cast(o_orderkey % 30 as int)) + to_hours(o_orderkey * 37 % 24) as varchar) as legs0_departureAt,
 cast(o_orderdate + to_days(cast(o_orderkey % 30 as int)) + to_hours(o_orderkey * 37 % 24) + to_hours(o_orderkey % 9) as varchar) as legs0_arrivalAt,
 case when o_orderkey % 17 = 0 then null else concat(lpad(cast(o_orderkey * 37 % 24 as varchar), 2, '0'), ':',
   lpad(cast(o_orderkey * 11 % 60 as varchar), 2, '0'), ':00') end as legs0_duration,
 o_orderpriority as legs0_segments0_marketingCarrier_code,
 case when o_orderkey % 5 = 0 then 'OTHER' else o_orderpriority end as legs0_segments0_operatingCarrier_code,
 cast(case o_orderstatus when 'F' then 1.0 when 'O' then 2.0 else 4.0 end as double) as legs0_segments0_cabinClass,
 cast(o_orderkey % 9 as double) as legs0_segments0_seatsAvailable,
 case when o_orderkey % 6 = 0 then 'HUB' end as legs0_segments1_departureFrom_airport_iata,
 case when o_orderkey % 3 = 0 then 'A/B' else 'A' end as searchRoute,
 o_orderstatus <> 'P' as pricingInfo_isAccessTP, c_mktsegment = 'MACHINERY' as isVip,
 nullif(c_nationkey % 3, 0) as corporateTariffCode,
 cast(case when o_orderkey % 4 = 0 then null else (o_orderkey % 4 - 1) * 100.0 end as double) as miniRules0_monetaryAmount,
 case when row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1 then 1 else 0 end as selected,
 -o_totalprice as predicted_score,
 cast('0x' || substr(md5(cast(o_custkey as varchar)), 1, 8) as bigint) % 5 as fold
from orders join customer on o_custkey = c_custkey)
"""
