"""The learned pair scorer: gradient-boosted trees, out-of-fold scores, calibration, importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.operators.context import folds

#: Rounds, depth and the like. Trees are bounded by depth here, so the leaves of the original become a depth of 7.
DEFAULTS = {"rounds": 400, "depth": 7, "rate": 0.05, "least": 200, "rows": 0.8, "columns": "0.8"}


def assembled(pairs: DataFrame, feats: list[str]) -> DataFrame:
    """pairs with nulls made -1 and marked in an own column, as trees here take no missing values."""
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in feats}
    marks = {f"{f}_missing": F.col(f).isNull().cast("double") for f in feats}
    return pairs.withColumns({**{f"__{k}": v for k, v in filled.items()}, **{f"__{k}": v for k, v in marks.items()}})


def fit(pairs: DataFrame, feats: list[str], seed: int = 0, **params) -> PipelineModel:
    """Fit on pairs with y (and w, a weight, if it is there)."""
    p = DEFAULTS | params
    inputs = [f"__{f}" for f in feats] + [f"__{f}_missing" for f in feats]
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=p["rounds"], maxDepth=p["depth"], stepSize=p["rate"], minInstancesPerNode=p["least"],
        subsamplingRate=p["rows"], featureSubsetStrategy=p["columns"], seed=seed, **({"weightCol": "w"} if "w" in pairs.columns else {}),
    )
    rows = assembled(pairs, feats).withColumn("label", F.col("y").cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), trees]).fit(rows)


def predict(model: PipelineModel, pairs: DataFrame, feats: list[str]) -> DataFrame:
    """(rec_id, s1_id, p)."""
    scored = model.transform(assembled(pairs, feats))
    return scored.select("rec_id", "s1_id", F.get(vector_to_array("probability"), F.lit(1)).cast("float").alias("p"))


def out_of_fold(pairs: DataFrame, feats: list[str], k: int = 2, **params) -> DataFrame:
    """Scores of every pair by a model that saw none of its record's pairs."""
    marked = pairs.withColumn("__fold", folds(F.col("rec_id"), k, 0))
    out = None
    for i in range(k):
        model = fit(marked.filter(F.col("__fold") != i), feats, **params)
        part = predict(model, marked.filter(F.col("__fold") == i), feats)
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(oof: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """pred with p mapped by an isotonic fit of out-of-fold scores to labels, within 0 and 1."""
    marked = oof.join(truth.select("rec_id", "s1_id").distinct().withColumn("label", F.lit(1.0)), ["rec_id", "s1_id"], "left").na.fill(0.0, ["label"])
    model = IsotonicRegression(featuresCol="x", labelCol="label").fit(marked.withColumn("x", F.col("p").cast("double")))
    out = model.transform(pred.withColumn("x", F.col("p").cast("double")))
    return out.withColumn("p", F.greatest(F.least("prediction", F.lit(1.0)), F.lit(0.0))).select(*pred.columns)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importance(model: PipelineModel, feats: list[str], top: int = 8) -> list[tuple[str, float]]:
    """Features by gain, a feature's missing mark added to it."""
    gain = model.stages[-1].featureImportances.toArray()
    both = [(f, float(gain[i] + gain[i + len(feats)])) for i, f in enumerate(feats)]
    return sorted(both, key=lambda x: -x[1])[:top]

