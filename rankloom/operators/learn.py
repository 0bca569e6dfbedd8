"""Rankers with Spark ML: pairwise and pointwise, out-of-fold, searched, explained.

Every fit and transform is a Spark ML job; folds and parameter settings are few
and named, and each is one job.
"""

from __future__ import annotations

import itertools
import random
from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators.splits import key_hash
from rankloom.sessions import GROUP, ITEM, LABEL, SCORE
from rankloom.storage import stored

#: Rows that one task deals a column's values among.
BUCKET_ROWS = 100_000


def _vectors(features: list[str]) -> list:
    filled = [f"__{c}" for c in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True)]


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def fit_pairwise(df: DataFrame, features: list[str], group: str = GROUP, label: str = LABEL, negatives: int = 20, reg: float = 0.01, iterations: int = 15) -> PipelineModel:
    """A linear ranker: logistic regression on differences between the chosen option and others of its session.

    Each session gives at most ``negatives`` pairs (a stated training parameter: a
    hash picks them), so pairs grow with sessions, not with squares of their sizes;
    the sign of every second pair is turned, so both labels occur.
    """
    prepared = Pipeline(stages=_vectors(features)).fit(_doubles(df, features))
    rows = prepared.transform(_doubles(df, features)).select(group, label, ITEM, vector_to_array("features").alias("x"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(key_hash(ITEM), ITEM))
    losers = rows.filter(F.col(label) == 0).withColumn("__k", order).filter(F.col("__k") <= negatives).select(F.col(group).alias("__g"), F.col("x").alias("y"), "__k")
    pairs = rows.filter(F.col(label) == 1).join(losers, F.col(group) == F.col("__g"))
    sign = F.when(F.pmod(F.xxhash64(group, "__k"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    diffs = pairs.select(array_to_vector(F.zip_with("x", "y", lambda a, b: (a - b) * sign)).alias("features"), (sign > 0).cast("double").alias("label"))
    diffs = diffs.persist()
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=iterations).fit(diffs)
    diffs.unpersist()
    return PipelineModel(stages=[*prepared.stages, model])


def softmax_gradient(rows: DataFrame, weights: list[float], group: str = GROUP, label: str = LABEL) -> DataFrame:
    """One row: (n_groups, loss, gradient) of the mean session cross-entropy of a linear ranker over ``rows`` (group, label, x: array of doubles).

    A session's softmax is over all its options, whatever their number: scores are taken less their session's greatest,
    and sums over sessions and options are aggregates, so no task holds a session. Sessions without a positive say nothing.
    """
    score = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored_rows = rows.select(F.col(group).alias("__g"), F.col(label).cast("double").alias("y"), "x", score.alias("s"))
    tops = scored_rows.groupBy("__g").agg(F.max("s").alias("top"), F.sum("y").alias("positives"))
    open_ = scored_rows.join(tops.withColumnRenamed("__g", "__t"), F.col("__g").eqNullSafe(F.col("__t"))).filter("positives > 0").withColumn("e", F.exp(F.col("s") - F.col("top")))
    m = len(weights)
    at = lambda k: F.get("x", F.lit(k))
    sums = open_.groupBy("__g").agg(
        F.sum("e").alias("z"), F.first("positives").alias("n"), F.sum(F.col("y") * (F.col("s") - F.col("top"))).alias("good"),
        F.array(*(F.sum(F.col("e") * at(k)) for k in range(m))).alias("expected"), F.array(*(F.sum(F.col("y") * at(k)) for k in range(m))).alias("seen"),
    )
    loss = F.log("z") - F.col("good") / F.col("n")
    parts = [F.avg(F.get("expected", F.lit(k)) / F.col("z") - F.get("seen", F.lit(k)) / F.col("n")) for k in range(m)]
    return sums.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(loss).alias("loss"), F.array(*parts).alias("gradient"))


def fit_listwise(df: DataFrame, features: list[str], group: str = GROUP, label: str = LABEL, reg: float = 0.01, steps: int = 25, rate: float = 1.0) -> PipelineModel:
    """A linear ranker by a listwise loss: cross-entropy of the chosen option under its session's softmax.

    Gradient descent with a step that grows while the loss falls and is halved when it does not; each
    step is one distributed sum (``softmax_gradient``), and only the weights come to the driver.
    """
    prepared = Pipeline(stages=_vectors(features)).fit(_doubles(df, features))
    rows = stored(prepared.transform(_doubles(df, features)).select(group, label, vector_to_array("features").alias("x")))

    def at(weights: list[float]) -> tuple[float, list[float]]:
        row = softmax_gradient(rows, weights, group, label).first()
        if not row["n_groups"]:
            return 0.0, [0.0] * len(weights)
        return row["loss"] + reg / 2 * sum(w * w for w in weights), [g + reg * w for g, w in zip(row["gradient"], weights, strict=True)]

    weights = [0.0] * len(features)
    loss, slope = at(weights)
    for _ in range(steps):
        tried = [w - rate * g for w, g in zip(weights, slope, strict=True)]
        new, new_slope = at(tried)
        if new < loss:
            weights, loss, slope, rate = tried, new, new_slope, rate * 1.5
        else:
            rate /= 2
        if max(map(abs, slope), default=0.0) < 1e-4:
            break
    scaler = prepared.stages[-1]  # the weights are of scaled columns
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    plain = {f"__{c}": w / d if d else 0.0 for c, w, d in zip(features, weights, std, strict=True)}
    start = -sum(plain[f"__{c}"] * m for c, m in zip(features, mean, strict=True))
    return PipelineModel(stages=[prepared.stages[0], *weighted(plain, start).stages])


def fit_pointwise(df: DataFrame, features: list[str], label: str = LABEL, trees: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees on the label."""
    typed = _doubles(df, features).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[*_vectors(features), GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)]).fit(typed)


def scored(df: DataFrame, model: PipelineModel, features: list[str], score: str = SCORE) -> DataFrame:
    """``df`` with the model's score."""
    out = model.transform(_doubles(df.drop(score), features))
    helpers = [f"__{c}" for c in features] + ["__raw", "features", "rawPrediction", "probability", "prediction", "__against", "__for"]
    return out.withColumn(score, vector_to_array("rawPrediction")[1]).drop(*helpers)


def cross_validated(df: DataFrame, features: list[str], fit, fold: str = "fold") -> tuple[DataFrame, list[PipelineModel]]:
    """(out-of-fold scores of all rows, the model of each fold). ``df`` is stored: every fold's fit reads it several times."""
    return _over_folds(stored(df), features, fit, fold)


def _over_folds(df: DataFrame, features: list[str], fit, fold: str) -> tuple[DataFrame, list[PipelineModel]]:
    ids = sorted(r[0] for r in df.select(fold).distinct().collect())  # a handful of folds
    models = [fit(df.filter(F.col(fold) != i), features) for i in ids]
    parts = [scored(df.filter(F.col(fold) == i), m, features) for i, m in zip(ids, models, strict=True)]
    return reduce(DataFrame.unionByName, parts), models


def averaged(df: DataFrame, models: list[PipelineModel], features: list[str], score: str = SCORE) -> DataFrame:
    """``df`` with the mean of the models' scores."""
    out = df.drop(score)
    for k, m in enumerate(models):
        out = scored(out, m, features, f"__s{k}")
    mean = reduce(lambda a, b: a + b, (F.col(f"__s{k}") for k in range(len(models)))) / len(models)
    return out.withColumn(score, mean).drop(*(f"__s{k}" for k in range(len(models))))


def weighted(weights: dict[str, float], start: float = 0.0) -> PipelineModel:
    """A linear ranker of given weights, in the form that the fitted ones have; a missing value counts as 0."""
    total = f"{start!r}D + " + " + ".join(f"{w!r}D * coalesce(double(`{c}`), 0D)" for c, w in weights.items())
    return PipelineModel(stages=[SQLTransformer(statement=f"select *, 0D as __against, {total} as __for from __THIS__"), VectorAssembler(inputCols=["__against", "__for"], outputCol="rawPrediction")])


def mean_over_folds(df: DataFrame, k: int = 3, fold: str = "fold", score: str = SCORE) -> DataFrame:
    """One row: the mean over folds of each fold's mean NDCG at k, by one aggregate over sessions."""
    of = df.groupBy(F.col(GROUP).alias("__g")).agg(F.first(fold).alias("__fold"))  # a session is in one fold
    each = metrics.per_session_ndcg(df, k, score=score).join(of, F.col(GROUP).eqNullSafe(F.col("__g")))
    return each.groupBy("__fold").agg(F.avg("ndcg").alias("ndcg")).agg(F.avg("ndcg").alias(f"ndcg_{k}"))


def search(df: DataFrame, features: list[str], grid: dict[str, list], fit=fit_pairwise, fold: str = "fold", k: int = 3, most: int | None = None, seed: int = 42) -> DataFrame:
    """Mean NDCG@k over folds for each setting of the grid (or ``most`` of them, drawn by seed), best first."""
    settings = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    if most is not None and most < len(settings):
        settings = random.Random(seed).sample(settings, most)
    df = stored(df)
    found = []
    for s in settings:
        oof, _ = _over_folds(df, features, lambda d, f, s=s: fit(d, f, **s), fold)
        found.append((str(s), mean_over_folds(oof, k, fold).first()[0]))
    return df.sparkSession.createDataFrame(found, "setting string, ndcg double").orderBy(F.desc("ndcg"), "setting")


def halved(df: DataFrame, features: list[str], grid: dict[str, list], fit=fit_pairwise, fold: str = "fold", k: int = 3, keep: int = 3, rounds: int = 3, seed: int = 42) -> DataFrame:
    """(round, share, setting, ndcg): successive halving of the grid's settings; the best of the last round is the choice.

    A round scores its settings by the mean over folds on a share of the sessions (whole ones, by
    a hash; the last round on all) and hands the best ``1 / keep`` of them, one at least, to the next,
    whose share is ``keep`` times as large. So most settings are given up on few sessions.
    """
    settings = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    found = []
    for r in range(rounds):
        share = float(keep) ** (r + 1 - rounds)
        part = df.filter(F.pmod(key_hash(GROUP, f"{seed}h"), F.lit(1 << 20)) < F.lit(share * (1 << 20))) if share < 1 else df
        part = stored(part)
        scores = []
        for s in settings:
            oof, _ = _over_folds(part, features, lambda d, f, s=s: fit(d, f, **s), fold)
            scores.append((mean_over_folds(oof, k, fold).first()[0] or 0.0, s))
        scores.sort(key=lambda x: (-x[0], str(x[1])))
        found += [(r + 1, share, str(s), score) for score, s in scores]
        settings = [s for _, s in scores[: max(1, -(-len(scores) // keep))]]
    return df.sparkSession.createDataFrame(found, "round int, share double, setting string, ndcg double")


def attributions(df: DataFrame, model: PipelineModel, features: list[str], base: dict[str, float] | None = None, draws: int = 16, seed: int = 42, item: str = ITEM) -> DataFrame:
    """(item, feature, gain): sampled Shapley values of the rows of ``df``, a bounded sample of a table.

    ``item`` names a row. Features are taken from a base row (the means, if not given) to the row's own values one by one, in
    ``draws`` seeded orders; what a step adds to the score is the feature's, averaged over the orders. The gains
    of a row sum up to its score less the base's. Rows times draws times features are scored in one pass.
    """
    typed = _doubles(df, features)
    if base is None:
        base = typed.agg(*(F.avg(c).alias(c) for c in features)).first().asDict()
    base = {c: float(base[c] or 0.0) for c in features}
    rng, orders = random.Random(seed), []
    for draw in range(draws):
        place = list(range(len(features)))
        rng.shuffle(place)
        orders.append((draw, place))
    held = df.sparkSession.createDataFrame(orders, "__draw int, __place array<int>")
    steps = typed.select(item, *features).join(F.broadcast(held)).withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))  # draws: a few rows
    mixed = steps.withColumns({c: F.when(F.get("__place", F.lit(k)) < F.col("__step"), F.coalesce(F.col(c), F.lit(base[c]))).otherwise(F.lit(base[c])) for k, c in enumerate(features)})
    done = scored(mixed, model, features, "__score").select(item, "__draw", "__place", "__step", "__score")
    before = F.lag("__score").over(Window.partitionBy(item, "__draw").orderBy("__step"))
    gains = done.withColumn("gain", F.col("__score") - before).filter("__step > 0").withColumn("feature", F.element_at(F.array(*map(F.lit, features)), F.array_position("__place", F.col("__step") - 1).cast("int")))
    return gains.groupBy(item, "feature").agg(F.avg("gain").alias("gain"))


def importance(model: PipelineModel, features: list[str], most: int = 30) -> DataFrame:
    """(feature, importance): split gains of trees, absolute coefficients of a linear model."""
    last: Model = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(most)


def permutation_importance(df: DataFrame, model: PipelineModel, features: list[str], k: int = 3, seed: int = 42, min_size: int = metrics.MIN_SIZE, most: int | None = None) -> DataFrame:
    """(feature, drop): how much hit rate at k falls when a column's values are dealt to other rows.

    All columns are dealt over one exchange, within hash buckets of some ``BUCKET_ROWS`` rows, so nothing is
    sorted in one task; the rows then go through the model once for each feature and once
    as they are, in one pass. ``most``: about so many rows, in whole sessions chosen by a hash.
    """
    n = df.count()
    if most is not None and n > most:
        df = df.filter(F.pmod(key_hash(GROUP, f"{seed}p"), F.lit(1 << 20)) < F.lit(most / n * (1 << 20)))
        n = most
    bucket = F.pmod(F.xxhash64(F.col(ITEM), F.lit(seed)), F.lit(n // BUCKET_ROWS + 1))
    rows = _doubles(df.select(GROUP, ITEM, LABEL, *features), features).withColumn("__b", bucket)
    whole = Window.partitionBy("__b").orderBy
    dealt = {}
    for j, c in enumerate(features):
        w = whole(key_hash(ITEM, f"{seed}{c}"), ITEM)
        dealt[f"__d{j}"] = F.when(F.row_number().over(w) == 1, F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(F.lag(c).over(w))
    each = rows.withColumns(dealt).withColumn("__which", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    mixed = each.withColumns({c: F.when(F.col("__which") == j, F.col(f"__d{j}")).otherwise(F.col(c)) for j, c in enumerate(features)}).drop("__b", *dealt)
    ranked = metrics.ranked(scored(mixed, model, features).withColumn("__of", F.struct("__which", GROUP)), min_size, group="__of")
    hits = F.count_if((F.col(LABEL) == 1) & (F.col("rank") <= k)).cast("double")
    rates = ranked.groupBy("__which").agg(F.try_divide(hits, F.count_distinct("__of").cast("double")).alias("rate"))
    base = F.first(F.when(F.col("__which") == -1, F.col("rate")), ignorenulls=True)
    one = rates.agg(base.alias("base"), F.map_from_entries(F.collect_list(F.struct("__which", "rate"))).alias("of"))  # a row for each feature
    gains = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col("base") - F.try_element_at("of", F.lit(j)), F.lit(0.0)).alias("drop")) for j, c in enumerate(features)))).alias("x")
    return one.select(gains).select("x.*").orderBy(F.desc("drop"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
