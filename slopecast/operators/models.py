"""Susceptibility and size models with Spark ML, scored out of fold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .evaluate import auc, spearman

SEED = 42

# --- fixed values: the settings of the published susceptibility model (63 leaves need a depth of 6) ---
SUSCEPTIBILITY = {"iters": 600, "depth": 6, "step": 0.05, "least_leaf": 50, "row_share": 0.8, "column_share": "0.8"}
# -------------------------------------------------------------------------------------------------------


def _stages(numeric: Sequence[str], categories: Sequence[str]) -> list:
    """Categories keep their codes as nominal values; unseen codes get their own."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    return [*idx, VectorAssembler(inputCols=[*numeric, *[f"{c}__i" for c in categories]], outputCol="features")]


def _boosted(
    label: str, iters: int, depth: int, weight: str | None, step: float, row_share: float, column_share: str, least_leaf: int
) -> GBTClassifier:
    g = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=iters, maxDepth=depth, seed=SEED, maxBins=64, stepSize=step,
        subsamplingRate=row_share, featureSubsetStrategy=column_share, minInstancesPerNode=least_leaf,
    )
    return g.setWeightCol(weight) if weight else g


def _probability(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(
    df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), label: str = "label", iters: int = 20, depth: int = 5,
    weight: str | None = None, step: float = 0.1, row_share: float = 1.0, column_share: str = "all", least_leaf: int = 1,
) -> PipelineModel:
    """Boosted trees: learning rate ``step``, shares of rows and columns per tree, and the fewest rows of a leaf."""
    model = _boosted(label, iters, depth, weight, step, row_share, column_share, least_leaf)
    return Pipeline(stages=[*_stages(numeric, categories), model]).fit(df)


def fit_full(df: DataFrame, path: str, **kw) -> PipelineModel:
    """Fit on everything, save, and hand back the reloaded model."""
    fit(df, **kw).write().overwrite().save(path)
    return PipelineModel.load(path)


def score(model: PipelineModel, cells: DataFrame) -> DataFrame:
    """Batch scoring partition by partition; rows with a missing feature are left out by the caller."""
    return _probability(model.transform(cells))


def _stored(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Fold results written once and read back, so no fold is ever fitted twice."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    for i, p in enumerate(parts):
        p.write.parquet(f"{path}/part={i}")
    return spark.read.parquet(path).drop("part")


def oof_scores(df: DataFrame, keep: Sequence[str], fold: str = "fold", folds: Sequence = range(5), **kw) -> DataFrame:
    """Each fold scored by a model that never saw it. ``fold`` may equally be a region."""
    parts = []
    for f in folds:
        model = fit(df.where(F.col(fold) != f), **kw)
        parts.append(score(model, df.where(F.col(fold) == f)).select(*keep, fold, kw.get("label", "label"), "score"))
    return _stored(parts, "oof")


def importance(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Share of total gain per feature in percent, largest first."""
    gains = model.stages[-1].featureImportances.toArray()
    total = float(gains.sum()) or 1.0
    rows = [(n, 100.0 * float(g) / total) for n, g in zip(names, gains)]
    ranked = spark.createDataFrame(rows, "feature string, gain_percent double")
    return ranked.orderBy(F.desc("gain_percent"), "feature")


def ablate(df: DataFrame, groups: Mapping[str, Sequence[str]], numeric: Sequence[str], categories: Sequence[str] = (), folds: Sequence = range(5), **kw) -> DataFrame:
    """Out-of-fold AUC with each feature group left out in turn, beside the full set."""
    out = None
    for name, gone in {"none": (), **groups}.items():
        o = oof_scores(
            df, [], folds=folds, numeric=[c for c in numeric if c not in gone],
            categories=[c for c in categories if c not in gone], **kw,
        )
        row = auc(o, "score", "label").select(F.lit(name).alias("left_out"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def fit_logistic(df: DataFrame, numeric: Sequence[str], label: str = "label", most: int = 30, tol: float = 1e-6) -> PipelineModel:
    """An unpenalised logistic model."""
    return Pipeline(stages=[*_stages(numeric, ()), LogisticRegression(labelCol=label, featuresCol="features", maxIter=most, tol=tol)]).fit(df)


def logistic_cv(df: DataFrame, numeric: Sequence[str], rule: str, folds: Sequence = range(5), label: str = "label") -> DataFrame:
    """Cross-validated logistic baseline against an unfitted rule."""
    parts = []
    for f in folds:
        m = fit_logistic(df.where(F.col("fold") != f), numeric, label)
        parts.append(score(m, df.where(F.col("fold") == f)).select("fold", label, "score"))
    fitted = auc(_stored(parts, "logit"), "score", label).select(F.lit("logistic").alias("model"), "auc")
    return fitted.unionByName(auc(df, rule, label).select(F.lit("rule").alias("model"), "auc"))


def size_model_cv(df: DataFrame, numeric: Sequence[str], target: str, folds: Sequence = range(5), iters: int = 20, min_rows: int = 50) -> DataFrame:
    """Blocked-CV regression of a log size: rank correlation, R2 and typical error factor per fold.

    Every fold has its row and ``n``; the measures of a fold under ``min_rows`` are NULL.
    """
    out = None
    for f in folds:
        held = df.where(F.col("fold") == f)
        m = Pipeline(stages=[*_stages(numeric, ()), GBTRegressor(labelCol=target, featuresCol="features", maxIter=iters, seed=SEED)]).fit(
            df.where(F.col("fold") != f)
        )
        p = _stored([m.transform(held).select(target, F.col("prediction").alias("score"))], "size")
        mean = p.agg(F.avg(target).alias("m")).scalar()
        e = p.withColumn("_m", mean).agg(
            (1 - F.sum(F.pow(F.col(target) - F.col("score"), 2)) / F.sum(F.pow(F.col(target) - F.col("_m"), 2))).alias("r2"),
            F.pow(F.lit(10.0), F.sqrt(F.avg(F.pow(F.col(target) - F.col("score"), 2)))).alias("error_factor"),
            F.count(F.lit(1)).alias("n"),
        )
        row = e.withColumn("rho", spearman(p, "score", target).select("rho").scalar()).withColumn("fold", F.lit(f))
        row = row.withColumns({c: F.when(F.col("n") >= min_rows, F.col(c)) for c in ("r2", "error_factor", "rho")})
        out = row if out is None else out.unionByName(row)
    return out
