"""Session documents: nested JSON, one document per session, to columns.

Schemas are given, never inferred. ``data`` may be a list, or an object that holds
the list under ``$values``. What is not an object where one is expected is skipped;
a document that is no JSON gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalars import flex_score
from rankloom.operators.encode import collapse_rare
from rankloom.sessions import GROUP
from rankloom.storage import shared_dir, stored

#: The rule categories of cancellation and exchange.
CANCEL, EXCHANGE = 31, 33

FARE = "struct<fareFamilyKey: string, cabinClass: double, seatsAvailable: int, baggageAllowance: struct<quantity: int>>"
INFO = f"struct<isAccessTP: boolean, faresInfo: array<{FARE}>>"
RULE = "struct<category: int, monetaryAmount: double>"
PRICING = f"struct<id: string, totalPrice: double, miniRules: array<{RULE}>, pricingInfo: array<{INFO}>>"
OPTION = f"struct<id: string, pricings: array<{PRICING}>>"
#: What ``pricings`` reads of an option: each field of a document costs a search.
PRICED = f"struct<id: string, pricings: array<struct<id: string, totalPrice: double, miniRules: array<{RULE}>, pricingInfo: array<struct<faresInfo: array<struct<fareFamilyKey: string, baggageAllowance: struct<quantity: int>>>>>>>>"
HEADER = "struct<ranker_id: string, request_time: string, personalData: struct<yearOfBirth: int, hasAssistant: boolean, isGlobal: boolean>, routeData: struct<requestDepartureDate: string, requestReturnDate: string>>"


def _options(variant: Column, option: str = OPTION) -> Column:
    """The options of a document, whichever form ``data`` has; not-objects become null."""
    return F.coalesce(*(F.try_variant_get(variant, at, f"array<{option}>") for at in ('$.data["$values"]', "$.data")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: as a generator's it is not copied into the filters (and the explodes) that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__doc`` (variant); documents that are no JSON go."""
    return _once(docs, "__doc", F.try_parse_json(text)).filter(F.col("__doc").isNotNull())


def parsed(docs: DataFrame, text: str = "value", head: str = HEADER, option: str = OPTION) -> DataFrame:
    """``docs`` with ``__doc`` (variant), ``__head``, ``__options``; documents that are no JSON go."""
    both = F.struct(F.try_variant_get("__doc", "$", head).alias("head"), _options(F.col("__doc"), option).alias("options"))
    out = _once(_parsed(docs, text), "__both", both)
    return out.withColumns({"__head": F.col("__both.head"), "__options": F.col("__both.options")}).drop("__both")


def headers(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per document: key, request time, traveller, dates, number of options."""
    h = "__head."
    rows = _parsed(docs, text).withColumns({"__head": F.try_variant_get("__doc", "$", HEADER), "__options": _options(F.col("__doc"), "struct<id: variant>")})
    return rows.select(
        F.col(h + "ranker_id").alias(GROUP), F.col(h + "request_time").alias("request_time"), F.col(h + "personalData.yearOfBirth").alias("year_of_birth"),
        F.col(h + "personalData.hasAssistant").alias("has_assistant"), F.col(h + "personalData.isGlobal").alias("is_global"),
        F.col(h + "routeData.requestDepartureDate").alias("request_departure_date"), F.col(h + "routeData.requestReturnDate").alias("request_return_date"),
        F.coalesce(F.size(F.filter("__options", lambda o: o.isNotNull())), F.lit(0)).alias("n_options"),
    )


def rule_amount(rules: Column, category: int, pick: str = "last") -> Column:
    """The amount of the last (or first) rule of a category; null without one."""
    amounts = F.transform(F.filter(rules, lambda r: r["category"] == category), lambda r: r["monetaryAmount"])
    return F.get(amounts, F.size(amounts) - 1 if pick == "last" else F.lit(0))


def fares(docs: DataFrame, text: str = "value", rule_pick: str = "last") -> DataFrame:
    """One row per option, pricing, pricing info and fare."""
    rows = parsed(docs, text).select(F.col("__head.ranker_id").alias(GROUP), F.explode("__options").alias("o"))
    rows = rows.select(GROUP, F.col("o.id").alias("flight_id"), F.explode("o.pricings").alias("p"))
    rows = rows.select(GROUP, "flight_id", F.col("p.id").alias("pricing_id"), F.col("p.totalPrice").alias("total_price"), rule_amount(F.col("p.miniRules"), CANCEL, rule_pick).alias("cancellation_fee"), rule_amount(F.col("p.miniRules"), EXCHANGE, rule_pick).alias("exchange_fee"), F.explode("p.pricingInfo").alias("i"))
    rows = rows.withColumn("f", F.explode("i.faresInfo"))
    return rows.select(GROUP, "flight_id", "pricing_id", "total_price", F.col("i.isAccessTP").alias("policy_compliant"), F.col("f.cabinClass").alias("cabin_class"), F.col("f.seatsAvailable").alias("seats_available"), F.col("f.baggageAllowance.quantity").alias("baggage_quantity"), "cancellation_fee", "exchange_fee")


def pricings(docs: DataFrame, text: str = "value", rule_pick: str = "first") -> DataFrame:
    """One row per option and pricing, by its first info and first fare; documents without a key and pricings with empty lists are skipped."""
    rows = parsed(docs, text, "struct<ranker_id: string>", PRICED).filter(F.col("__head.ranker_id").isNotNull()).select(F.col("__head.ranker_id").alias(GROUP), F.explode("__options").alias("o"))
    rows = rows.select(GROUP, F.col("o.id").alias("flight_id"), F.explode("o.pricings").alias("p"))
    first = F.get("p.pricingInfo", F.lit(0))
    rows = rows.withColumn("f", F.get(first["faresInfo"], F.lit(0))).filter(F.col("f").isNotNull())
    return rows.select(GROUP, "flight_id", F.col("p.id").alias("pricing_id"), F.col("p.totalPrice").alias("total_price_json"), F.col("f.fareFamilyKey").alias("fare_family_key"), rule_amount(F.col("p.miniRules"), CANCEL, rule_pick).alias("cancellation_fee"), F.col("f.baggageAllowance.quantity").alias("baggage_quantity"))


def session_aggregates(rows: DataFrame, group: str = GROUP) -> DataFrame:
    """Fare rows to one row per session."""
    return rows.groupBy(group).agg(
        F.avg("total_price").alias("avg_total_price"), F.avg(F.col("policy_compliant").cast("int")).alias("avg_policy_compliant"), F.sum("seats_available").alias("total_seats_available"),
        F.avg("cancellation_fee").alias("avg_cancellation_fee"), F.avg("exchange_fee").alias("avg_exchange_fee"), F.count(F.lit(1)).alias("json_options_count"),
    )


# -- paths of a feature map ---------------------------------------------------


def _values(v: Column, steps: list[str]) -> Column:
    """All values under a path of keys and ``*``, as an array of variants."""
    out = F.array(v)
    for step in steps:
        if step == "*":
            inner = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.map_values(F.try_variant_get(x, "$", "map<string, variant>")))
            out = F.flatten(F.filter(F.transform(out, inner), lambda a: a.isNotNull()))
        else:
            name = step.replace('"', '\\"')
            out = F.filter(_child(out, name), lambda x: x.isNotNull())
    return out


def _child(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: F.try_variant_get(x, f'$["{name}"]', "variant"))


#: Types that a feature map may name; others are strings.
DTYPES = {"str": "string", "int": "long", "float": "double", "bool": "boolean"}


def mapped(docs: DataFrame, feature_map: list[dict], key: Column, text: str = "value", join_key: str = GROUP) -> DataFrame:
    """One row per document: the key and each feature of the map (path, name, dtype).

    Paths are dotted, ``*`` stands for every element of a list or value of an
    object; several values are joined by commas; a value that its type does not
    take becomes null.
    """
    rows = _parsed(docs, text)
    out = [key.alias(join_key)]
    for x in feature_map:
        found = F.filter(F.transform(_values(F.col("__doc"), x["path"].split(".")), lambda v: v.try_cast("string")), lambda s: s.isNotNull())
        joined = F.when(F.size(found) > 0, F.array_join(found, ","))
        out.append(joined.try_cast(DTYPES.get(x.get("dtype", "str"), "string")).alias(x["name"]))
    return rows.select(out)


def _shape(v: Column) -> Column:
    """The type of a parsed document, null where lists mix kinds, so that the type doesn't tell all paths."""
    found = F.schema_of_variant(v)
    plain = F.when(F.contains(found, F.lit("`")), found).otherwise(F.regexp_replace(found, r"DECIMAL\(\d+,\d+\)", "DECIMAL"))
    return F.when(~F.contains(found, F.lit("VARIANT")), plain)


def _walked(rows: DataFrame) -> DataFrame:
    """Distinct (k, path) of ``rows`` (k, w: variant), level by level until a level is empty; each level is checkpointed, so none is taken apart twice."""
    level, found = rows.select("k", F.lit(None).cast("string").alias("path"), "w"), []
    while True:
        fields = F.map_entries(F.try_variant_get("w", "$", "map<string, variant>"))
        named = F.transform(fields, lambda e: F.struct(F.when(F.col("path").isNull(), e["key"]).otherwise(F.concat(F.col("path"), F.lit("."), e["key"])).alias("path"), e["value"].alias("w"), F.lit(True).alias("named")))
        items = F.transform(F.try_variant_get("w", "$", "array<variant>"), lambda x: F.struct(F.col("path").alias("path"), x.alias("w"), F.lit(False).alias("named")))
        level = level.select("k", F.explode(F.coalesce(named, items)).alias("c")).select("k", "c.path", "c.w", "c.named").checkpoint()
        if level.isEmpty():
            break
        found.append(level.filter("named").select("k", "path"))
    return reduce(DataFrame.unionAll, found).distinct() if found else rows.limit(0).select("k", F.lit("").alias("path"))


def key_paths(docs: DataFrame, document: str, text: str = "value") -> DataFrame:
    """(key_path, percentage_present): in how many of the documents each dotted path occurs.

    Items of a list have their list's path. Documents of one type (that of the parsed
    document) have the same paths, so one of each type is taken apart, and types are counted;
    documents whose lists mix kinds are taken apart one by one. A document's text may
    be spread over rows; text that is no JSON is left out. The documents are read twice, and may be
    written otherwise the second time (lists that a shuffle filled have no order of their own): one is
    known by its key and type, not by its text.
    """
    shared_dir(docs.sparkSession)
    parsed = _once(docs.select(F.col(document).alias("d"), F.col(text).alias("t")), "w", F.try_parse_json("t")).filter(F.col("w").isNotNull())
    own = F.concat(F.lit("d"), F.to_json(F.struct("d")))  # the key of a document of its own
    shaped = _once(parsed, "shape", _shape(F.col("w")))
    pairs = stored(shaped.groupBy("d", F.coalesce(F.concat(F.lit("s"), "shape"), own).alias("k")).agg(F.bool_or(F.col("shape").isNull()).alias("mixed")))
    chosen = pairs.filter(~F.col("mixed")).groupBy(F.col("k").alias("of")).agg(F.min(F.struct("d")).alias("by"))
    same = F.struct("d").eqNullSafe(F.col("by")) & (F.concat(F.lit("s"), "shape") == F.col("of"))
    texts = shaped.join(chosen, same, "left").filter("of is not null or shape is null").select(F.coalesce("of", own).alias("k"), "t").dropDuplicates()
    paths = stored(_walked(texts.select("k", F.try_parse_json("t").alias("w"))))
    of = pairs.groupBy("d").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("k"))  # nearly every document has one type
    single = of.filter("m = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(paths, "k").groupBy("path").agg(F.sum("n").alias("n"))
    several = pairs.select("d", "k").join(of.filter("m > 1").select("d"), "d", "left_semi").join(paths, "k").select("d", "path").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    each = single.unionAll(several).groupBy(F.col("path").alias("key_path")).agg(F.sum("n").alias("n_docs"))
    total = of.agg(F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(total), F.lit(True)).select("key_path", F.round(100.0 * F.col("n_docs") / F.col("n"), 2).alias("percentage_present")).orderBy(F.desc("percentage_present"), "key_path")


def feature_blocks(raw: DataFrame, feature_map: list[dict], penalty: str | None = None, least: int = 50, join_key: str = GROUP) -> dict[str, DataFrame]:
    """Per feature of the map a block (key, feature): cast, ``flex_score`` beside the penalty, rare levels of strings collapsed."""
    out = {}
    for x in feature_map:
        kind = DTYPES.get(x.get("dtype", "str"), "string")
        block = raw.select(join_key, F.col(x["name"]).try_cast(kind).alias(x["name"]))
        if x["name"] == penalty:
            block = block.withColumn("flex_score", flex_score(F.col(penalty)))
        if kind == "string":
            block = collapse_rare(block, x["name"], least)
        out[x["name"]] = block
    return out


def join_blocks(main: DataFrame, blocks: list[DataFrame], group: str = GROUP) -> DataFrame:
    """Left-joins blocks by the group key; a block with several rows for a key is refused."""
    for block in blocks:
        if not block.groupBy(group).count().filter("count > 1").isEmpty():
            raise ValueError(f"a block holds a {group} twice")
    return reduce(lambda a, b: a.join(b.withColumn(group, F.col(group).cast(main.schema[group].dataType)), group, "left"), blocks, main)


def join_prices(options: DataFrame, priced: DataFrame, digits: int | None = None) -> DataFrame:
    """Left join of pricings onto options by session, option and price; prices may be rounded first."""
    near = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    right = priced.withColumnRenamed(GROUP, "__g")
    on = (options[GROUP].cast("string") == F.col("__g")) & (options["Id"].cast("string") == F.col("flight_id")) & (near(options["totalPrice"]) == near(F.col("total_price_json")))
    return options.join(right.hint("merge"), on, "left").drop("__g", "flight_id")  # pricings are as many as options, whatever their files' sizes say


def join_prices_within(options: DataFrame, priced: DataFrame, within: float) -> DataFrame:
    """Left join of pricings onto options by session, option and nearest price, at most ``within`` away (ties: the lower price, then the other columns in order).

    A band join: an option goes to the bin of its price, as wide as the tolerance, and to
    both neighbours, a pricing to its own, so that pairs meet by equal bins, those near a bin's border too.
    Both joins are merges: the size of a table behind an explode is guessed too low to be broadcast by it.
    """
    if not within > 0:
        raise ValueError("the tolerance is above 0; use join_prices for equal prices")
    cents = lambda c: F.col(c).cast("double")
    bin_of = lambda c: F.floor(c / F.lit(float(within)))
    rest = [c for c in priced.columns if c not in (GROUP, "flight_id")]
    found = priced.select(F.col(GROUP).alias("__g"), F.col("flight_id").alias("__o"), F.struct(cents("total_price_json").alias("__at"), *rest).alias("__found")).filter("__found.__at is not null")
    near = found.withColumn("__bin", bin_of(F.col("__found.__at")))
    keys = options.select(F.col(GROUP).cast("string").alias("__kg"), F.col("Id").cast("string").alias("__ko"), cents("totalPrice").alias("__price")).distinct()
    own = keys.withColumn("__own", F.explode(F.array(*(bin_of(F.col("__price")) + k for k in (-1, 0, 1)))))
    met = own.join(near.hint("merge"), (F.col("__kg") == F.col("__g")) & (F.col("__ko") == F.col("__o")) & (F.col("__own") == F.col("__bin")))
    apart = F.abs(F.col("__price") - F.col("__found.__at"))
    best = met.filter(apart <= within).groupBy("__kg", "__ko", "__price").agg(F.min(F.struct(apart.alias("apart"), F.col("__found").alias("found"))).alias("__best"))
    on = (options[GROUP].cast("string") == F.col("__kg")) & (options["Id"].cast("string") == F.col("__ko")) & (options["totalPrice"].cast("double") == F.col("__price"))
    return options.join(best.hint("merge"), on, "left").select(*(options[c] for c in options.columns), *(F.col(f"__best.found.{c}").alias(c) for c in rest))
