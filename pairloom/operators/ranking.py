"""Pair features, classifiers and ranking."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.windows import PAIR, clean
from pairloom.operators import pairs as P
from pairloom.operators import spread as S

# The feature columns in their order.
FEATURES = ["eg_pvalue", "adf_pvalue", "kpss_pvalue", "johansen_trace_ratio", "hedge_ratio", "half_life", "half_life_norm", "spread_std", "hurst", "ou_kappa", "ou_sigma", "rolling_corr_mean", "rolling_corr_std", "rolling_corr_pct_above_07", "vol_ratio", "price_ratio_mean", "price_ratio_std", "zscore_std", "n_crossings", "days_of_data"]


def half_life_norm(df: DataFrame) -> DataFrame:
    """Min-max of the finite half-lives; the bounds are one row."""
    h = clean(F.col("half_life"))
    bounds = df.agg(F.min(h).alias("lo"), F.max(h).alias("hi"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("half_life_norm", (h - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).drop("lo", "hi")


def extras(rows: DataFrame, window: int = 60, floor: float = 0.7) -> DataFrame:
    """Per-pair features that need no unit-root test, from rows of log prices."""
    z = S.with_zscore(S.ols(rows), window)
    rolled = P.rolling(rows, window)
    base = z.groupBy(*PAIR).agg(
        F.count("*").alias("days_of_data"), F.try_divide(F.stddev_samp("a"), F.stddev_samp("b")).alias("vol_ratio"),
        F.avg(F.exp(F.col("a") - F.col("b"))).alias("price_ratio_mean"), F.stddev_samp(F.exp(F.col("a") - F.col("b"))).alias("price_ratio_std"), F.stddev_samp("zscore").alias("zscore_std"),
    )
    c = rolled.groupBy(*PAIR).agg(F.avg("corr").alias("rolling_corr_mean"), F.stddev_samp("corr").alias("rolling_corr_std"), F.avg((F.abs("corr") >= floor).cast("double")).alias("rolling_corr_pct_above_07"))
    ou = S.ou(z).select(*PAIR, F.col("kappa").alias("ou_kappa"), F.col("sigma").alias("ou_sigma"))
    return base.join(c, [*PAIR], "left").join(P.crossings(z), [*PAIR], "left").join(ou, [*PAIR], "left")


def features(coint: DataFrame, rows: DataFrame, window: int = 60) -> DataFrame:
    """The feature table with ``label``; a pair without prices keeps null features."""
    ratio = F.try_divide("johansen_trace_stat", F.when(F.col("johansen_trace_crit_90") != 0, F.col("johansen_trace_crit_90")))
    out = coint.withColumn("johansen_trace_ratio", ratio).join(extras(rows, window), [*PAIR], "left").join(S.hurst(S.ols(rows)), [*PAIR], "left")
    return half_life_norm(out).withColumn("label", F.col("is_cointegrated").cast("int"))


def feature_matrix(table: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Present feature columns, infinities as null, rows with any null dropped."""
    have = [c for c in columns if c in table.columns]
    return table.select(*PAIR, *[clean(F.col(c).cast("double")).alias(c) for c in have], *[c for c in ("label",) if c in table.columns]).dropna()


def pipeline(columns: list[str] = FEATURES, kind: str = "gbt", seed: int = 42, trees: int = 40) -> Pipeline:
    model = (
        GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=seed)
        if kind == "gbt" else RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, seed=seed)
        if kind == "forest" else MultilayerPerceptronClassifier(labelCol="label", featuresCol="x", layers=[len(columns), 16, 2], maxIter=30, seed=seed)
    )
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])


def folds(matrix: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``fold``, stratified by label and dealt by a hash of the pair."""
    order = Window.partitionBy("label").orderBy(F.xxhash64(*PAIR), *PAIR)
    return matrix.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def cross_validate(matrix: DataFrame, columns: list[str], k: int = 5, kind: str = "forest", seed: int = 42, trees: int = 40) -> DataFrame:
    """(metric, mean, std): area under ROC and precision-recall over stratified folds; std with ddof 0."""
    data, spark = folds(matrix, k).cache(), matrix.sparkSession
    rows = []
    for metric in ("areaUnderROC", "areaUnderPR"):
        model = pipeline(columns, kind, seed, trees)
        cv = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName=metric), foldCol="fold", numFolds=k, collectSubModels=False, seed=seed)
        done = cv.fit(data)
        rows.append((metric, float(done.avgMetrics[0]), float(done.stdMetrics[0])))
    return spark.createDataFrame(rows, "metric string, mean double, std double")


def search(matrix: DataFrame, columns: list[str], k: int = 5, seed: int = 42):
    """The best forest of a seeded grid by area under ROC."""
    model = pipeline(columns, "forest", seed)
    forest = model.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [3, 5]).addGrid(forest.numTrees, [20, 40]).addGrid(forest.minInstancesPerNode, [1, 2]).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), foldCol="fold", numFolds=k, seed=seed).fit(folds(matrix, k)).bestModel


def score(model, table: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker_a, ticker_b, ml_score) by P(label 1); infinities and nulls count as 0."""
    ready = table.select(*PAIR, *[F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return model.transform(ready).select(*PAIR, vector_to_array("probability")[1].alias("ml_score")).orderBy(F.col("ml_score").desc(), *PAIR)


def importance(model, columns: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.stages[-1].featureImportances.toArray())], "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def sequences(rows: DataFrame, columns: list[str], lookback: int = 60) -> DataFrame:
    """(ticker_a, ticker_b, date, sequence, label): the preceding ``lookback`` rows as float arrays, the label of the row itself."""
    w = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(-lookback, -1)
    item = F.array(*[F.col(c).cast("float") for c in columns])
    out = rows.withColumn("sequence", F.collect_list(item).over(w))
    return out.filter(F.size("sequence") == lookback).select(*PAIR, "date", "sequence", "label")


def _minmax(x: str):
    w = Window.partitionBy(F.lit(1))  # one row a surviving pair
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, 0.0).otherwise((F.col(x) - low) / (high - low))


def stat_score(coint: DataFrame, life: tuple[float, float] = (5, 60)) -> DataFrame:
    """Adds the statistical score in [0, 1]; 0 where any of its three terms is missing."""
    mid = (life[0] + life[1]) / 2
    near = 1 - F.abs(F.col("half_life") - mid) / mid
    central = F.when(near < 0, 0.0).when(near > 1, 1.0).otherwise(near)
    whole = 0.4 * (1 - _minmax("eg_pvalue")) + 0.3 * (1 - _minmax("adf_pvalue")) + 0.3 * central
    return coint.withColumn("stat_score", F.coalesce(whole, F.lit(0.0)))  # one missing term leaves no score


def rank(coint: DataFrame, ml: DataFrame | None = None, top: int = 20, life: tuple[float, float] = (5, 60), hurst_max: float = 0.5) -> DataFrame:
    """Cointegrated pairs within the bounds, by the mean of statistical and learned score (0.5 where none)."""
    kept = coint.filter(F.col("is_cointegrated") & F.col("half_life").between(*life))
    if "hurst" in coint.columns:
        kept = kept.filter(F.col("hurst") < hurst_max)
    scored = stat_score(kept, life)
    scored = scored.join(ml.select(*PAIR, "ml_score"), [*PAIR], "left") if ml is not None else scored.withColumn("ml_score", F.lit(None).cast("double"))
    scored = scored.withColumn("ml_score", F.coalesce("ml_score", F.lit(0.5))).withColumn("composite", 0.5 * F.col("stat_score") + 0.5 * F.col("ml_score"))
    return scored.orderBy(F.col("composite").desc(), *PAIR).limit(top)
