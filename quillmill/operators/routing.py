"""Choosing a cheap or a thorough strategy for each image, and a backend for each request.

Rules come first; only borderline images reach the trained model, or without one the heuristic.
NaN features satisfy no comparison, so such an image is borderline.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .imaging import FEATURES


def over(x: Column, y: float) -> Column:
    return ~F.isnan(x) & (x > y)


def quality(contrast: Column, sharpness: Column) -> Column:
    return contrast * 0.6 + sharpness * 0.4


def _choice(name: str, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("strategy"), confidence.alias("confidence"))


def rules(contrast: Column, sharpness: Column) -> Column:
    """struct<strategy, confidence>; null where the rules don't decide."""
    fast = over(contrast, 0.5) & over(sharpness, 0.4)
    return F.when(fast, _choice("fast", F.least(quality(contrast, sharpness), F.lit(0.95)))).when((contrast < 0.2) | (sharpness < 0.2), _choice("ensemble", F.lit(0.9)))


def heuristic(contrast: Column, sharpness: Column) -> Column:
    q = (contrast + sharpness) / 2
    return F.when(over(q, 0.5), _choice("fast", q)).otherwise(_choice("ensemble", 1 - q))


def strategy(contrast: Column, sharpness: Column) -> Column:
    """Rules, then the heuristic: the choice without a trained model."""
    return F.coalesce(rules(contrast, sharpness), heuristic(contrast, sharpness))


def training_rows(spark: SparkSession, seed: int = 42) -> DataFrame:
    """A hundred synthetic feature rows: 60 easy (label 0), 40 hard in three scenarios (label 1)."""
    u = lambda k, lo, hi: F.lit(lo) + F.rand(seed + k) * (hi - lo)
    easy, scenario = F.col("id") < 60, F.floor(F.rand(seed) * 3)
    pick = lambda *cases: F.when(easy, cases[0]).when(scenario == 0, cases[1]).when(scenario == 1, cases[2]).otherwise(cases[3])
    extreme = F.when(F.rand(seed + 1) < 0.5, u(2, 0.05, 0.25)).otherwise(u(3, 0.85, 1.0))
    return spark.range(0, 100, 1, 1).select(
        pick(u(4, 0.5, 0.85), u(5, 0.3, 0.7), extreme, u(6, 0.3, 0.8)).alias("brightness"),
        pick(u(7, 0.4, 0.9), u(8, 0.05, 0.25), u(9, 0.15, 0.4), u(10, 0.2, 0.5)).alias("contrast"),
        pick(u(11, 0.5, 1.0), u(12, 0.2, 0.6), u(13, 0.3, 0.7), u(14, 0.05, 0.3)).alias("sharpness"),
        F.floor(F.rand(seed + 15) * 2).cast("double").alias("has_color"), u(16, 0.2, 0.9).alias("size_ratio"),
        F.when(easy, 0.0).otherwise(1.0).alias("label"),
    )


def train(spark: SparkSession, seed: int = 42) -> PipelineModel:
    from pyspark.ml import Pipeline

    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(training_rows(spark, seed))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_or_train(spark: SparkSession, path: str, seed: int = 42) -> PipelineModel:
    """The model under ``path``; if none is there, one is trained and saved first, so later calls only load."""
    from py4j.protocol import Py4JJavaError

    try:
        return load(path)
    except (Py4JJavaError, AnalysisException):
        model = train(spark, seed)
        save(model, path)
        return model


def record(results: DataFrame, path: str) -> None:
    """Appends (features, strategy, success) rows to a feedback table."""
    results.select(*FEATURES, "strategy", "success").write.mode("append").parquet(path)


def importances(model: PipelineModel) -> dict[str, float]:
    return dict(zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def with_strategy(df: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """``df`` (with the feature columns) and ``strategy``, ``confidence``."""
    if model is None:
        chosen = strategy(F.col("contrast"), F.col("sharpness"))
        return df.withColumn("_c", chosen).select(*df.columns, "_c.strategy", "_c.confidence")
    ready = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in FEATURES})
    scored = model.transform(ready.withColumn("_rules", rules(F.col("contrast"), F.col("sharpness"))))
    model_choice = F.struct(F.when(F.col("prediction") == 0, "fast").otherwise("ensemble").alias("strategy"), F.get(vector_to_array("probability"), F.col("prediction").cast("int")).alias("confidence"))
    return scored.withColumn("_c", F.coalesce("_rules", model_choice)).select(*df.columns, "_c.strategy", "_c.confidence")


def dispatch(engine: Column, adaptive: Column, chosen: Column) -> Column:
    """What runs: 'fast' (one backend), 'ensemble' (all, merged)."""
    return F.when(engine != "ensemble", "fast").when(adaptive, chosen).otherwise("ensemble")


def backend(engine: Column, tesseract: Column, easyocr: Column) -> Column:
    """The single backend for a request given what is available; null if none is."""
    t, e = F.when(tesseract, "tesseract"), F.when(easyocr, "easyocr")
    return F.when(engine == "easyocr", F.coalesce(e, t)).otherwise(F.coalesce(t, e))


def available(tesseract: Column, easyocr: Column) -> Column:
    return F.array_compact(F.array(F.when(tesseract, "tesseract"), F.when(easyocr, "easyocr")))
