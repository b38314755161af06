"""Candidate models of fraud scores: fitting, ranking, calibration, cross-source scoring and seed stability."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .evaluation import binary_metrics, recall_under_fpr, threshold_curve

# The seeds of the runs, the cap of the false-positive rate, and the positives that isotonic calibration needs.
SEEDS = [42, 123, 2026]
FPR_CAP = 0.05
MIN_ISOTONIC = 200


def _estimators(seed: int, trees: int, depth: int) -> dict:
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=50, **common),
        "boosted": GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), seed=seed, **common),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
    }


def weighted(train: DataFrame) -> DataFrame:
    """train (label 0 or 1) with the weight n / (2 n_class) of each row's class. The weights are stored: each pass of a fit joins
    them again."""
    n = train.groupBy("label").agg(F.count("*").alias("k"))
    n = stored(n.crossJoin(F.broadcast(n.agg(F.sum("k").alias("n")))).select("label", (F.col("n") / (2 * F.col("k"))).alias("weight")))
    return train.join(F.broadcast(n), "label")


def _encoded(features: list[str], categorical: list[str]) -> list:
    """Steps to one vector: numbers as they are, texts one-hot; a text that training has not seen has a place of its own."""
    steps = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    steps += [OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=False) for c in categorical]
    return [*steps, VectorAssembler(inputCols=[*features, *(f"{c}__v" for c in categorical)], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features")]


def fit(train: DataFrame, features: list[str], candidate: str, seed: int = 42, trees: int = 20, depth: int = 6, categorical: list[str] | None = None) -> PipelineModel:
    """The fitted candidate; train's features are numeric and without nulls, categorical ones are texts."""
    return Pipeline(stages=[*_encoded(features, categorical or []), _estimators(seed, trees, depth)[candidate]]).fit(weighted(train))


def fit_three_class(train: DataFrame, features: list[str], categorical: list[str], seed: int = 42, trees: int = 20, depth: int = 6) -> PipelineModel:
    """A forest over the three classes of label (texts), each class of the same weight; numbers without a value get the median,
    texts the most frequent one."""
    classes = StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc", handleInvalid="error")
    filled = Imputer(inputCols=features, outputCols=features, strategy="median")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="class", weightCol="weight", featureSubsetStrategy="sqrt")
    most = {}
    for c in categorical:
        row = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), c))[c]).first()
        most[c] = row[0] or ""
    n = train.groupBy("label").agg(F.count("*").alias("k"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("k").alias("n"), F.count("*").alias("c")))).select("label", (F.col("n") / (F.col("c") * F.col("k"))).alias("weight"))
    return Pipeline(stages=[filled, *_encoded(features, categorical), classes, forest]).fit(train.na.fill(most).join(F.broadcast(n), "label"))


def three_class_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p_<class> of each class."""
    names = model.stages[-2].labels
    d = model.transform(df).withColumn("__p", vector_to_array("probability"))
    return d.select(*df.columns, *(F.round(F.col("__p")[k], 6).alias(f"p_{c.lower()}") for k, c in enumerate(names)))


def rank_candidates(results: DataFrame) -> DataFrame:
    """The candidates but the dummy by their best run: average precision, then recall under the cap, then lower Brier score,
    then name; rank 1 is the one to keep. A row for each candidate, so that one task orders them."""
    best = F.max(F.struct("average_precision", "recall", (-F.col("brier")).alias("brier"), "seed")).alias("b")
    g = results.where("candidate <> 'dummy'").groupBy("candidate").agg(best)
    order = Window.orderBy(F.desc("b.average_precision"), F.desc("b.recall"), F.desc("b.brier"), "candidate")
    return g.select(F.row_number().over(order).alias("rank"), "candidate", "b.seed", "b.average_precision", "b.recall", (-F.col("b.brier")).alias("brier"))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with score, the probability of label 1; rounded, so that the curve is over a bounded set of scores."""
    return model.transform(df).select(*df.columns, F.round(vector_to_array("probability")[1], 6).alias("score"))


def _evaluated(s: DataFrame, candidate: str, seed: int) -> DataFrame:
    m = binary_metrics(s).crossJoin(recall_under_fpr(threshold_curve(s), FPR_CAP))
    return m.select(F.lit(candidate).alias("candidate"), F.lit(seed).alias("seed"), *m.columns)


def fit_candidates(train: DataFrame, tune: DataFrame, features: list[str], seeds: list[int] = SEEDS, trees: int = 20, depth: int = 6, categorical: list[str] | None = None) -> DataFrame:
    """(candidate, seed, metrics on tune) of the dummy, logistic, boosted and forest candidates; logistic has no seed of its own.

    Features of both sides are worked out once and stored for the fits and scores, which all read them; so is each score."""
    weights = weighted(train)
    encoder = Pipeline(stages=_encoded(features, categorical or [])).fit(weights)
    rows = stored(encoder.transform(weights).select("label", "weight", "features"))
    seen = stored(encoder.transform(tune).select("label", "features"))
    base = stored(train.agg(F.round(F.avg("label"), 6).alias("score")))
    out = _evaluated(seen.select("label").crossJoin(F.broadcast(base)), "dummy", seeds[0])
    for name in ("logistic", "boosted", "forest"):
        for seed in seeds[:1] if name == "logistic" else seeds:
            model = _estimators(seed, trees, depth)[name].fit(rows)
            out = out.unionByName(_evaluated(stored(scored(model, seen).select("label", "score")), name, seed))
    return out


def calibrate(first: DataFrame, second: DataFrame) -> DataFrame:
    """(method, brier, average_precision, chosen): fitted on first, judged on second. Sigmoid always, isotonic with enough
    positives; the lower Brier score is chosen, then the higher average precision, then the name.

    Both are worked out once for all methods. The isotonic fit weighs the counts of first's rows by label and score, as it
    brings all rows of a score into one task."""
    first, second = stored(first), stored(second)
    counts = stored(first.groupBy("label", "score").agg(F.count("*").alias("weight")))
    fitted = {"sigmoid": (LogisticRegression(featuresCol="x", labelCol="label"), first)}
    if (counts.where("label = 1").agg(F.sum("weight")).first()[0] or 0) >= MIN_ISOTONIC:
        fitted["isotonic"] = (IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="p"), counts)
    vector = VectorAssembler(inputCols=["score"], outputCol="x")
    b = vector.transform(second)
    out = None
    for name, (e, rows) in fitted.items():
        d = e.fit(vector.transform(rows)).transform(b)
        p = F.col("p") if name == "isotonic" else vector_to_array("probability")[1]
        m = binary_metrics(stored(d.select("label", p.alias("score")))).select(F.lit(name).alias("method"), "brier", "average_precision")
        out = m if out is None else out.unionByName(m)
    best = out.agg(F.min(F.struct("brier", (-F.col("average_precision")).alias("ap"), "method")).alias("b")).select(F.col("b.method").alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("method") == F.col("best")).drop("best")


def cross_source(models: dict[str, PipelineModel], tunes: dict[str, DataFrame]) -> DataFrame:
    """(trained_on, scored_on, metrics) of every model on every other source's rows, without a new fit."""
    out = None
    for a, model in models.items():
        for b, tune in tunes.items():
            if a != b:
                m = binary_metrics(stored(scored(model, tune).select("label", "score")))
                m = m.select(F.lit(a).alias("trained_on"), F.lit(b).alias("scored_on"), *m.columns)
                out = m if out is None else out.unionByName(m)
    return out


def seed_stability(results: DataFrame) -> DataFrame:
    return results.groupBy("candidate").agg(F.count("*").alias("n_seeds"), F.round(F.avg("average_precision"), 8).alias("mean_ap"), F.round(F.stddev_pop("average_precision"), 8).alias("stddev_ap"))
