"""The feature columns of an option table, step by step, and all of them together.

Each step takes and returns a DataFrame; a step whose inputs are missing leaves
its columns out or null, as its docstring says. All windows partition by session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import windows as W

#: Columns that the steps use if there, and take as null strings if not.
OPTIONAL_DATES = ("requestDate", "requestDepartureDate", "requestReturnDate")
COPIES_ROUTE = {
    "search_route": "searchRoute", "origin_airport": "legs0_segments0_departureFrom_airport_iata", "destination_airport": "legs0_segments0_arrivalTo_airport_iata",
    "marketing_carrier": "legs0_segments0_marketingCarrier_code", "operating_carrier": "legs0_segments0_operatingCarrier_code", "aircraft_code": "legs0_segments0_aircraft_code",
    "cabin_class": "legs0_segments0_cabinClass", "seats_available": "legs0_segments0_seatsAvailable", "baggage_quantity": "legs0_segments0_baggageAllowance_quantity",
}
COPIES_POLICY = {
    "corporate_tariff": "corporateTariffCode", "policy_compliant": "pricingInfo_isAccessTP", "profile_id": "profileId", "company_id": "companyID", "user_gender": "sex",
    "user_nationality": "nationality", "frequent_flyer_programs": "frequentFlyer", "is_vip": "isVip", "books_by_self": "bySelf", "can_cancel": "miniRules0_statusInfos",
    "can_exchange": "miniRules1_statusInfos", "cancellation_fee": "miniRules0_monetaryAmount", "exchange_fee": "miniRules1_monetaryAmount",
}


def copied(df: DataFrame, names: dict[str, str], missing: str = "string") -> DataFrame:
    """Columns under new names; a missing one becomes null."""
    return df.withColumns({new: F.col(old) if old in df.columns else F.lit(None).cast(missing) for new, old in names.items()})


def price_features(df: DataFrame, bins: bool = True) -> DataFrame:
    price, taxes = F.col("totalPrice"), F.col("taxes")
    out = df.withColumns({"total_price": price, "tax_amount": taxes, "base_price": price - taxes, "tax_rate": S.ratio(taxes, price)})
    out = out.withColumns({"price_diff_from_mean": W.from_mean("totalPrice"), "price_diff_from_min": W.from_min("totalPrice"), "price_diff_from_max": W.from_max("totalPrice")})
    out = out.withColumns({"price_rank": W.ordinal_rank("totalPrice"), "price_rank_desc": W.ordinal_rank("totalPrice", descending=True), "price_percentile": W.percentile_of("totalPrice")})
    return S.quantile_bins(out, "totalPrice", "price_bin") if bins else out


def time_features(df: DataFrame) -> DataFrame:
    out = df.withColumns({"departure_datetime": S.as_timestamp(F.col("legs0_departureAt")), "arrival_datetime": S.as_timestamp(F.col("legs0_arrivalAt")), "total_duration_minutes": S.duration_minutes(F.col("legs0_duration"))})
    out = out.withColumns({"departure_hour": F.hour("departure_datetime"), "arrival_hour": F.hour("arrival_datetime"), "departure_weekday": S.iso_weekday(F.col("departure_datetime"))})
    out = out.withColumn("departure_time_category", S.time_of_day(F.col("departure_hour")))
    return out.withColumns({"duration_diff_from_mean": W.from_mean("total_duration_minutes"), "duration_rank": W.average_rank("total_duration_minutes"), "duration_percentile": W.percentile_of("total_duration_minutes")})


def advanced_time_features(df: DataFrame) -> DataFrame:
    """Missing date columns count as null; all three leave the table."""
    dates = {c: (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")) for c in OPTIONAL_DATES}
    out = df.withColumns(dates)
    asked = S.as_timestamp(F.coalesce("requestDate", "requestDepartureDate"))
    back = S.as_timestamp(F.col("requestReturnDate"))
    leaves = S.as_timestamp(F.coalesce("requestDepartureDate", "legs0_departureAt"))
    red_eye = ((F.col("departure_hour") >= 22) & (F.col("arrival_hour") <= 5)).cast("int")
    return out.withColumns({"booking_window_days": S.whole_days(asked, F.col("departure_datetime")), "trip_duration_days": S.whole_days(leaves, back), "is_red_eye_flight": red_eye}).drop(*OPTIONAL_DATES)


def route_features(df: DataFrame) -> DataFrame:
    out = copied(df, COPIES_ROUTE)
    transfer = "legs0_segments1_departureFrom_airport_iata"
    connects = F.col(transfer).isNotNull() if transfer in df.columns else F.lit(False)
    return out.withColumns({"is_roundtrip": F.contains("search_route", F.lit("/")), "same_marketing_operating": F.col("marketing_carrier") == F.col("operating_carrier"), "has_connection": connects, "cabin_class_name": S.cabin_name(F.col("cabin_class"))})


def policy_features(df: DataFrame) -> DataFrame:
    out = copied(df, COPIES_POLICY)
    return out.withColumns({"has_corporate_tariff": F.col("corporate_tariff").isNotNull(), "cancellation_fee_rate": S.ratio(F.col("cancellation_fee"), F.col("totalPrice")), "exchange_fee_rate": S.ratio(F.col("exchange_fee"), F.col("totalPrice"))})


def carrier_features(df: DataFrame) -> DataFrame:
    often, share = W.share_of_group("marketing_carrier")
    return df.withColumns({"carrier_frequency_in_search": often, "carrier_market_share": share})


def complexity_features(df: DataFrame) -> DataFrame:
    """Segments per row that are there; one where the table has no segment columns."""
    segments = [c for c in df.columns if re.fullmatch(r"legs0_segments[1-9]\d*_departureFrom_airport_iata", c)]
    count = F.lit(1)
    for c in segments:
        count = count + F.col(c).isNotNull().cast("int")
    first, second = "legs0_segments0_arrivalAt", "legs0_segments1_departureAt"
    wait = S.minutes_between(S.as_timestamp(F.col(first)), S.as_timestamp(F.col(second))) if first in df.columns and second in df.columns else F.lit(0)
    return df.withColumns({"num_segments": count, "is_direct": (~F.col("has_connection")).cast("int"), "layover_duration_minutes": wait})


def document_features(df: DataFrame) -> DataFrame:
    """Needs the columns of the joined session documents; without them the columns are null."""
    out = copied(df, {c: c for c in ("avg_total_price", "avg_policy_compliant") if c not in df.columns}, "double")
    return out.withColumns({"price_vs_avg_search_price": S.ratio(F.col("totalPrice"), F.col("avg_total_price")), "is_pricier_than_average": (F.col("totalPrice") > F.col("avg_total_price")).cast("int"), "policy_compliance_interaction": F.col("policy_compliant").cast("int") * F.col("avg_policy_compliant")})


def group_features(df: DataFrame, order: str = "row_ord") -> DataFrame:
    out = df.withColumns({"group_size": W.group_size(), "group_price_std": W.deviation("totalPrice"), "group_price_range": W.spread("totalPrice"), "unique_carriers_in_group": W.distinct_in_group("marketing_carrier"), "unique_cabin_classes_in_group": W.distinct_in_group("cabin_class"), "group_policy_compliance_rate": W.flag_rate("policy_compliant")})
    place = W.position(order) if order in df.columns else F.lit(None).cast("int")
    return out.withColumns({"position": place, "price_position_in_group": W.average_rank("totalPrice"), "duration_position_in_group": W.average_rank("total_duration_minutes")})


def interaction_features(df: DataFrame, weekend_start: int = 6) -> DataFrame:
    flag = lambda c: F.col(c).cast("int")
    return df.withColumns({
        "price_duration_interaction": F.col("totalPrice") * F.col("total_duration_minutes"),
        "combined_rank_score": F.col("price_rank") + F.col("duration_rank"),
        "vip_price_interaction": flag("is_vip") * F.col("totalPrice"),
        "corporate_policy_interaction": flag("has_corporate_tariff") * flag("policy_compliant"),
        "convenient_time_score": F.col("departure_hour").between(7, 21).cast("int") + F.col("arrival_hour").between(7, 22).cast("int"),
        "weekend_departure": (F.col("departure_weekday") >= weekend_start).cast("int"),
        "premium_service_indicator": (F.col("cabin_class") >= 2).cast("int"),
    })


STEPS = (price_features, time_features, advanced_time_features, route_features, policy_features, carrier_features, complexity_features, document_features, group_features, interaction_features)


def all_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every step in order: later ones read columns of earlier ones. ``columns``: these alone, and no work for others."""
    for step in STEPS:
        if step is price_features and columns is not None and "price_bin" not in columns:
            df = price_features(df, bins=False)  # the bins' breaks take a count of all prices
        else:
            df = df.transform(step)
    return df if columns is None else df.select(*columns)


def key_columns_first(df: DataFrame, keys: tuple[str, ...] = ("selected", "ranker_id", "profileId")) -> DataFrame:
    first = [k for k in keys if k in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def chosen_features(df: DataFrame, wanted: list[str], core: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(wanted columns that exist, core columns that do not)."""
    return [c for c in wanted if c in df.columns], [c for c in core if c not in df.columns]


def training_frame(options: DataFrame, aggregates: DataFrame | None = None, profiles: list[int] | None = None, group: str = "ranker_id", columns: list[str] | None = None) -> DataFrame:
    """Options, left-joined session aggregates, all features (or ``columns``), key columns first.

    The filter on profiles comes before the windows: a profile owns whole sessions.
    """
    if profiles:
        options = options.filter(F.col("profileId").isin(profiles))
    if aggregates is not None:
        options = options.join(aggregates, group, "left")
    return key_columns_first(all_features(options, columns))
