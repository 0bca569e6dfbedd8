"""Splits by whole groups, and statistics that do not leak across folds.

Orders are hash orders of the key, so splits are the same on every engine and for
every partitioning, and differ by seed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordered import at_places, counted, quantiles_of
from rankloom.sessions import GROUP, LABEL
from rankloom.storage import stored

#: Aggregates that have an out-of-fold form.
OUT_OF_FOLD = ("sum", "count", "mean", "avg", "var", "min", "max", "median")

#: Groups that one task orders; more groups take more ranges of the hash.
RANGE_GROUPS = 100_000


def key_hash(key: str | Column, seed: int | str = 42) -> Column:
    """The first 60 bits of MD5 of the key and the seed, as a number."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")


def _place(keys: DataFrame, group: str, seed: int | str) -> DataFrame:
    """Distinct keys with their 0-based place in hash order.

    Keys are numbered within ranges of the hash, of some ``RANGE_GROUPS`` keys each; the sizes
    of the ranges, a row each, give where each range starts. No task sees all keys.
    """
    distinct = stored(keys.select(group).distinct())
    ranges = distinct.count() // RANGE_GROUPS + 1
    hashed = distinct.withColumn("__h", key_hash(group, seed)).withColumn("__b", F.floor(F.col("__h") / F.lit(2**60 // ranges)).cast("int"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", group)) - 1
    sizes = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col("__b").alias("__c"), (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    return hashed.join(F.broadcast(starts), F.col("__b") == F.col("__c")).select(group, (F.col("__start") + within).alias("__place"), "__all")


def split_by_groups(df: DataFrame, group: str = GROUP, ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, rest): ``floor(keys * ratio)`` whole groups in train."""
    train = _place(df, group, seed).filter(F.col("__place") < F.floor(F.col("__all") * ratio)).select(group)
    return df.join(train, group, "left_semi"), df.join(train, group, "left_anti")


def group_folds(df: DataFrame, group: str = GROUP, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """``df`` with a fold per group: equal numbers of groups, the last fold takes the rest."""
    each = F.greatest(F.floor(F.col("__all") / folds), F.lit(1))
    ids = _place(df, group, seed).select(group, F.least(F.floor(F.col("__place") / each), F.lit(folds - 1)).cast("int").alias(name))
    return df.join(ids, group)


def stratified_folds(df: DataFrame, group: str = "profileId", label: str = LABEL, folds: int = 5, seed: int = 42, name: str = "fold", least_buckets: int = 64) -> DataFrame:
    """Folds of whole groups with near equal positives: groups in order of positives are dealt back and forth.

    Groups are ordered within bands of similar numbers of positives (powers of two,
    then a hash into ``least_buckets`` or, with many groups, buckets of some
    ``RANGE_GROUPS``), so no task orders all groups.
    """
    sums = stored(df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("__pos"), F.count(F.lit(1)).alias("__rows")))
    buckets = max(least_buckets, sums.count() // RANGE_GROUPS + 1)
    banded = sums.withColumn("__band", F.floor(F.log2(F.col("__pos") + 1.0)) * buckets + F.pmod(key_hash(group, f"{seed}b"), F.lit(buckets)))
    order = Window.partitionBy("__band").orderBy(F.desc("__pos"), F.desc("__rows"), key_hash(group, seed), group)
    k = F.row_number().over(order) - 1 + F.pmod(key_hash("__band", seed), F.lit(2 * folds))
    lap, seat = F.floor(k / folds), F.pmod(k, F.lit(folds))
    fold = F.when(F.pmod(lap, F.lit(2)) == 0, seat).otherwise(folds - 1 - seat).cast("int")
    return df.join(banded.select(group, fold.alias(name)), group)


def temporal_split(df: DataFrame, date: str, ratio: float = 0.8, tie: str = "Id") -> tuple[DataFrame, DataFrame]:
    """(first ``floor(rows * ratio)`` rows by date, the rest). Rows of the date on the border go by ``tie``, then by a hash of the row; null dates come last, null ties first.

    The border is found by counted values: of the dates, then of the ties of the border date,
    then of the hashes of rows alike in both. The sides are filters of ``df`` by it, which
    a scan can take; nothing is numbered or shuffled for them. Only where the border goes
    through rows that are the same in all columns are these counted and written out again.
    """
    left = int(df.count() * ratio)
    before, there = F.lit(False), F.lit(True)  # rows before the border, and those on it as far as it is known
    hashed = F.xxhash64(*(c for c, t in df.dtypes if not t.startswith("map")))
    for key, nulls_first in ((F.col(date), False), (F.col(tie), True), (hashed, True)):
        counts = stored(df.filter(there).groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")))
        known, missing = counts.agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.sum(F.when(F.col("value").isNull(), F.col("n")))).first()
        known, missing = known or 0, missing or 0
        skipped = missing if nulls_first else 0
        if left < skipped or left - skipped >= known:  # the border is among the nulls, or after all
            on = key.isNull()
            first, size = (0, missing) if nulls_first else (known, missing)
            earlier = F.lit(False) if nulls_first else key.isNotNull()
            if not missing:  # nothing is left to be cut
                return df.filter(before | there), df.filter(~(before | there))
        else:
            row = at_places(counts, [], "value", "n", F.array(F.lit(left - skipped))).first()
            border = F.lit(row["__at"])
            on, first, size = key.eqNullSafe(border), row["__first"] + skipped, row["__many"]
            earlier = (key < border) | (key.isNull() if nulls_first else F.lit(False))
        before = before | (there & F.coalesce(earlier, F.lit(False)))
        there = there & on
        left -= first
        if not left:
            return df.filter(before), df.filter(~before)
        if left == size:
            return df.filter(before | there), df.filter(~(before | there))
    same = df.filter(there).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    copies = lambda n: same.select(*df.columns, F.explode(F.sequence(F.lit(1), n))).drop("col")
    return df.filter(before).unionAll(copies(F.lit(left))), df.filter(~before & ~there).unionAll(copies((F.col("__n") - left).cast("int")))


def shared_groups(a: DataFrame, b: DataFrame, group: str = GROUP) -> DataFrame:
    """Keys that both tables hold."""
    return a.select(group).intersect(b.select(group))


def assert_no_shared_groups(a: DataFrame, b: DataFrame, group: str = GROUP) -> None:
    found = [r[0] for r in shared_groups(a, b, group).limit(5).collect()]
    if found:
        raise ValueError(f"{group} in both tables, e.g. {found}")


def fold_aware(df: DataFrame, keys: list[str], wanted: dict[str, list[str]], fold: str = "fold") -> DataFrame:
    """Per row, statistics of the row's keys over the *other* folds, as ``{column}_{function}``.

    Whatever the number of folds, one aggregate over (keys, fold) and one join. sum, count,
    mean (avg) and var (sample variance) are totals less the fold's own share; min and max are those of the folds before
    and after, in the order of folds; median comes from counted values less the fold's own. Null where
    no other fold has the key; null keys match null keys; rows of a null fold get nulls.
    """
    for c, fns in wanted.items():
        if unknown := set(fns) - set(OUT_OF_FOLD):
            raise ValueError(f"no out-of-fold form of {sorted(unknown)} of {c}")
    known = df.filter(F.col(fold).isNotNull())
    parts = []
    for k, (c, fns) in enumerate(wanted.items()):
        x = F.col(c).cast("double")
        parts += [F.sum(c).alias(f"__s{k}"), F.count(c).alias(f"__n{k}")] if set(fns) & {"sum", "count", "mean", "avg", "var"} else []
        parts += [F.var_pop(x).alias(f"__v{k}")] if "var" in fns else []
        parts += [getattr(F, f)(c).alias(f"__{f}{k}") for f in ("min", "max") if f in fns]
    states = known.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("__rows"), *parts)
    every = Window.partitionBy(*keys)
    before, after = every.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1), every.orderBy(fold).rowsBetween(1, Window.unboundedFollowing)
    out = []
    for k, (c, fns) in enumerate(wanted.items()):
        own_s, own_n = F.coalesce(f"__s{k}", F.lit(0)), F.col(f"__n{k}")
        n = F.sum(f"__n{k}").over(every) - own_n
        s = F.when(n > 0, F.sum(own_s).over(every) - own_s)
        mean = F.try_divide(s.cast("double"), n.cast("double"))
        forms = {
            "sum": lambda s=s: s, "count": lambda n=n: n, "mean": lambda mean=mean: mean, "avg": lambda mean=mean: mean,
            "min": lambda k=k: F.least(F.min(f"__min{k}").over(before), F.min(f"__min{k}").over(after)), "max": lambda k=k: F.greatest(F.max(f"__max{k}").over(before), F.max(f"__max{k}").over(after)),
        }
        for fn in fns:
            if fn in forms:
                out.append(forms[fn]().alias(f"{c}_{fn}"))
            elif fn == "var":
                folds = F.collect_list(F.struct(F.col(fold).alias("f"), own_n.cast("double").alias("n"), own_s.cast("double").alias("s"), F.coalesce(f"__v{k}", F.lit(0.0)).alias("v"))).over(every)
                out.append(_pooled(F.filter(folds, lambda x: (x["f"] != F.col(fold)) & (x["n"] > 0))).alias(f"{c}_var"))
    table = states.select(*keys, fold, *out)
    medians = [c for c, fns in wanted.items() if "median" in fns]
    if medians:
        rest = _medians_elsewhere(known, keys, medians, fold)
        table = _null_safe(table, rest, [*keys, fold])
    return _null_safe(df, table, [*keys, fold])


def _pooled(folds: Column) -> Column:
    """The sample variance of folds (n, sum s, population variance v) together; null below two rows."""
    total = lambda f: F.aggregate(folds, F.lit(0.0), lambda a, x: a + f(x))
    n = total(lambda x: x["n"])
    mean = total(lambda x: x["s"]) / n
    squares = total(lambda x: x["n"] * (x["v"] + (x["s"] / x["n"] - mean) * (x["s"] / x["n"] - mean)))
    return F.when(n > 1, squares / (n - 1))


def _medians_elsewhere(df: DataFrame, keys: list[str], columns: list[str], fold: str) -> DataFrame:
    """(keys, fold, {column}_median): the medians of the key's values in the other folds, from the counts of values per key and fold."""
    counts = counted(df, columns, [*keys, fold])
    entry = F.struct(F.col(fold).alias("f"), F.col("__n").alias("n"))
    values = counts.groupBy(*keys, "__column", "__value").agg(F.sum("__n").alias("__all_n"), F.map_from_entries(F.collect_list(entry)).alias("__own"))  # an entry for each fold
    folds = df.groupBy(*keys).agg(F.collect_set(fold).alias("__folds"))
    apart = _null_safe(values, folds, keys).select(*keys, "__column", "__value", "__all_n", "__own", F.explode("__folds").alias(fold))
    left = stored(apart.select(*keys, fold, "__column", "__value", (F.col("__all_n") - F.coalesce(F.col("__own")[F.col(fold)], F.lit(0))).alias("__n")).filter("__n > 0"))
    found = quantiles_of(left, [*keys, fold, "__column"], "__value", "__n", [0.5])
    named = [F.max(F.when(F.col("__column") == c, F.col("quantiles")[0])).alias(f"{c}_median") for c in columns]
    return found.groupBy(*keys, fold).agg(*named)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, nulls matching; keys once."""
    b = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return a.join(b, on, "left").drop(*(f"__r_{k}" for k in keys))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same for every partitioning."""
    return df.withColumn("__h", key_hash(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def sample_keys(df: DataFrame, n: int, group: str = GROUP, seed: int = 42) -> DataFrame:
    """The rows of n groups."""
    keys = df.select(group).distinct().withColumn("__h", key_hash(group, seed)).orderBy("__h", group).limit(n)
    return df.join(keys.select(group), group, "left_semi")


def out_of_fold(parts: list[DataFrame]) -> DataFrame:
    """The folds' scored frames as one."""
    return reduce(DataFrame.unionByName, parts)
