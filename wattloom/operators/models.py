"""Training, selection and scoring of tree regressors on temporal splits."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.operators.metrics import champion, error_metrics
from wattloom.session import stored

#: Share of rows for training, folds of cross-validation.
TRAIN_SHARE, FOLDS = 0.8, 3


def positions(df: DataFrame, keys: list[str], date: str = "FECHA") -> DataFrame:
    """Adds __n, the row's place in its key by date from 1, and __of, the key's rows."""
    return df.withColumns({"__n": F.row_number().over(Window.partitionBy(*keys).orderBy(date)), "__of": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def temporal_split(df: DataFrame, keys: list[str], shares: tuple[float, ...] = (TRAIN_SHARE,), names: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Adds split: the first int(n * share) rows of each key are names[0], and so on; shares are cumulative."""
    d = positions(df, keys)
    which = F.lit(names[-1])
    for share, name in reversed(list(zip(shares, names))):
        which = F.when(F.col("__n") <= F.floor(F.col("__of") * share), name).otherwise(which)
    return d.withColumn("split", which).drop("__n", "__of")


def cv_folds(df: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """Each row once for each fold that it is in, with fold (1 to folds) and role: test sets are the last
    `folds` runs of n // (folds + 1) rows, and all rows before a run train it."""
    d = positions(df, keys)
    size = F.floor(F.col("__of") / (folds + 1))
    first = lambda k: F.col("__of") - (folds - k + 1) * size  # noqa: E731  rows before fold k's test set
    role = lambda k: F.when(F.col("__n") <= first(k), "train").when(F.col("__n") <= first(k) + size, "test")
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("fold"), role(k).alias("role")) for k in range(1, folds + 1)]), lambda x: x["role"].isNotNull())
    return d.withColumn("__x", F.explode(each)).select(*df.columns, F.col("__x.fold").alias("fold"), F.col("__x.role").alias("role"))


def estimators(seed: int = 42, target: str = "TOTAL") -> dict[str, object]:
    """Two boosted and one bagged forest; the boosted ones differ in depth and step."""
    common = {"featuresCol": "__x", "labelCol": target, "predictionCol": "demanda_predicha", "seed": seed}
    return {
        "boosted_deep": GBTRegressor(maxDepth=5, maxIter=20, stepSize=0.1, subsamplingRate=0.8, **common),
        "boosted_flat": GBTRegressor(maxDepth=3, maxIter=30, stepSize=0.1, subsamplingRate=0.8, **common),
        "forest": RandomForestRegressor(maxDepth=8, numTrees=40, **common),
    }


def train(df: DataFrame, features: list[str], target: str = "TOTAL", models: dict | None = None) -> dict[str, PipelineModel]:
    """One model of each kind over the rows of all keys (the caller adds a key index to features if wanted).
    Rows need complete features and a target.

    The assembled rows are stored, not cached: a fit is some hundred jobs, and a task of a cached frame still carries
    the metrics of its whole lineage to the driver, in as many partitions as the last shuffle had."""
    assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    v = stored(assemble.transform(df), "train")
    return {name: PipelineModel([assemble, e.fit(v)]) for name, e in (models or estimators(target=target)).items()}


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("__x")


def evaluate(models: dict[str, PipelineModel], df: DataFrame, by: list[str], target: str = "TOTAL") -> DataFrame:
    """Metrics by (model, *by)."""
    out = None
    for name, m in models.items():
        d = score(m, df).withColumn("model", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return error_metrics(out, target, "demanda_predicha", ["model", *by])


def score_all(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """df with the predictions of all models side by side, as pred_{model}: one pass over the rows, one assembly."""
    d = next(iter(models.values())).stages[0].transform(df) if models else df
    for name, m in models.items():
        d = m.stages[-1].transform(d).withColumnRenamed("demanda_predicha", f"pred_{name}")
    return d.drop("__x")


def stacked(scored: DataFrame, models: list[str], cols: list[str]) -> DataFrame:
    """(cols, model, demanda_predicha): a row for each model."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("demanda_predicha")) for m in models])).alias("x")
    return scored.select(*cols, each).select(*cols, "x.*")


def fold_metrics(predictions: DataFrame, target: str = "TOTAL") -> DataFrame:
    """(model, fold, metrics) of predictions (model, fold, target, demanda_predicha): one aggregate for all folds and models."""
    return error_metrics(predictions, target, "demanda_predicha", ["model", "fold"])


def cv_summary(by_fold: DataFrame) -> DataFrame:
    """(model, mape_mean, mape_std, rmape_mean, rmape_std) over folds; population std."""
    return by_fold.groupBy("model").agg(*[f(c).alias(f"{c}_{n}") for c in ("mape", "rmape") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def cross_validate(df: DataFrame, features: list[str], keys: list[str], target: str = "TOTAL", models: dict | None = None, folds: int = FOLDS) -> DataFrame:
    """cv_summary over expanding folds.  The assembled rows are stored once; all models of all folds are then fitted
    at the same time, each fit a thread of the driver whose jobs share the cluster, and measured by one aggregate."""
    assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    d = stored(assemble.transform(cv_folds(df, keys, folds)).select(*keys, target, "fold", "role", "__x"), "folds")
    kinds = models or estimators(target=target)

    def fit(job: tuple[int, str]) -> DataFrame:
        k, name = job
        m = kinds[name].copy().fit(d.where(f"fold = {k} and role = 'train'"))
        return m.transform(d.where(f"fold = {k} and role = 'test'")).select(F.lit(name).alias("model"), "fold", target, "demanda_predicha")

    jobs = [(k, name) for k in range(1, folds + 1) for name in kinds]
    with ThreadPool(len(jobs)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(fit), jobs)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cv_summary(fold_metrics(out, target))


def champions(models: dict[str, PipelineModel], validation: DataFrame, keys: list[str], criterion: str = "rmape", target: str = "TOTAL") -> DataFrame:
    """(keys, model, metrics): the model that does best on each key's validation rows, all models scored in one pass."""
    names = list(models)
    metrics = error_metrics(stacked(score_all(models, validation), names, [*keys, target]), target, "demanda_predicha", [*keys, "model"])
    return champion(metrics, keys, criterion, names)


def save_models(models: dict[str, PipelineModel], best: DataFrame, path: str) -> None:
    """The fitted models, one folder each, and the table of champions."""
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/models/{name}")
    best.write.mode("overwrite").parquet(f"{path}/champions")
    best.sparkSession.createDataFrame([(k, n) for k, n in enumerate(models)], "place int, model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], DataFrame]:
    """What save_models wrote."""
    names = [r["model"] for r in spark.read.parquet(f"{path}/names").orderBy("place").collect()]  # one row a model
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in names}, spark.read.parquet(f"{path}/champions")


def score_with_champions(models: dict[str, PipelineModel], best: DataFrame, df: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """df with demanda_predicha and model: each row scored by its key's champion.  All models' predictions stand side by
    side and the champion's is picked, so no key is a job of its own; a key without champion takes `default`, or null."""
    names = list(models)
    chosen = best.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("model").alias("__c"))
    on = [df[k].eqNullSafe(chosen[f"__c_{k}"]) for k in keys]
    d = score_all(models, df.join(chosen, on, "left").drop(*[f"__c_{k}" for k in keys]))
    d = d.withColumn("model", F.coalesce("__c", F.lit(default).cast("string")))
    pick = F.coalesce(*[F.when(F.col("model") == n, F.col(f"pred_{n}")) for n in names])
    return d.withColumn("demanda_predicha", pick).drop("__c", *[f"pred_{n}" for n in names])


def importances(models: dict[str, PipelineModel], df: DataFrame, features: list[str]) -> DataFrame:
    """(model, feature, importance) as rows."""
    rows = [(name, f, float(v)) for name, m in models.items() for f, v in zip(features, m.stages[-1].featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
