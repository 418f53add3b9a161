"""The fused risk as a Spark ML pipeline, fitted on all rows where they lie.

Features are standardised by their population deviation, a balanced logistic (or boosted trees) is fitted for
each fold on the rows of the others, and calibrated on its own fold: isotonic where every class has 60 rows or
more, a sigmoid from 10 on, none below. The risk is the mean of the folds' calibrated probabilities. What
reaches the driver are means, deviations and class counts. The fitted pipeline is saved and loaded whole.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .terms import fold_of

ISOTONIC, SIGMOID = 60, 10


def logistic(label: str, features: str, weight: str, penalty: float, suffix: str) -> LogisticRegression:
    """c * loss + |w|^2 / 2, as Spark states it: the mean loss and ``penalty`` = 1 / (c * rows)."""
    return LogisticRegression(labelCol=label, featuresCol=features, weightCol=weight, regParam=penalty, standardization=False, tol=1e-12, maxIter=500, rawPredictionCol=f"__raw_{suffix}", probabilityCol=f"__p_{suffix}", predictionCol=f"__y_{suffix}")


def fit(rows: DataFrame, names: list[str], label: str, key: str, kind: str = "logistic", c: float = 0.7, folds: int = 5) -> PipelineModel:
    """The fitted pipeline of the labelled rows. Nulls count as 0; a fold without both classes is left out."""
    known = rows.where(F.col(label).isNotNull()).select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], F.col(label).cast("double").alias("__label"), fold_of(key, folds).alias("__fold"))
    stats = known.agg(*[f(n).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n"), F.sum("__label").alias("p")).first()
    n, p = stats["n"], stats["p"] or 0
    if not p or p == n:
        raise ValueError("both classes are needed")
    spread = [stats[f"s_{i}"] if stats[f"s_{i}"] >= 1e-8 else 1.0 for i in range(len(names))]
    cells = ", ".join(f"(coalesce(cast(`{x}` AS double), 0D) - {stats[f'm_{i}']!r}D) / {spread[i]!r}D AS __z{i}" for i, x in enumerate(names))
    scale = SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")
    wide = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(names))], outputCol="__x")
    ready = staged(wide.transform(scale.transform(known)).select("__x", "__label", "__fold"), "features")
    counts = {(r["__fold"], r["__label"]): r["count"] for r in ready.groupBy("__fold", "__label").count().collect()}
    small = min(p, n - p)
    calibrated = "isotonic" if small >= ISOTONIC else "sigmoid" if small >= SIGMOID else "none"
    stages = [scale, wide]
    # without calibration one model of all rows is all there is
    for k in range(folds) if calibrated != "none" else [-1]:
        n_k = n - sum(counts.get((k, y), 0) for y in (0.0, 1.0))
        p_k = p - counts.get((k, 1.0), 0)
        if not 0 < p_k < n_k or (k >= 0 and not (counts.get((k, 0.0)) and counts.get((k, 1.0)))):
            continue
        balanced = F.when(F.col("__label") == 1, n_k / (2 * p_k)).otherwise(n_k / (2 * (n_k - p_k)))
        taught = ready.where(F.col("__fold") != k).withColumn("__w", balanced)
        if kind == "logistic":
            first = logistic("__label", "__x", "__w", 1 / (c * n_k), f"m{k}")
        else:
            first = GBTClassifier(labelCol="__label", featuresCol="__x", weightCol="__w", maxIter=20, maxDepth=3, stepSize=0.2, seed=7, predictionCol=f"__y_m{k}").setRawPredictionCol(f"__raw_m{k}").setProbabilityCol(f"__p_m{k}")
        model = first.fit(taught)
        stages.append(model)
        if calibrated == "none":
            continue
        margin = VectorSlicer(inputCol=f"__raw_m{k}", outputCol=f"__margin_{k}", indices=[1])
        own = margin.transform(model.transform(ready.where(F.col("__fold") == k)))
        stages.append(margin)
        if calibrated == "isotonic":
            stages.append(IsotonicRegression(labelCol="__label", featuresCol=f"__margin_{k}", predictionCol=f"__cal_{k}").fit(own))
        else:
            last = LogisticRegression(labelCol="__label", featuresCol=f"__margin_{k}", regParam=0.0, standardization=False, tol=1e-12, maxIter=500, rawPredictionCol=f"__craw_{k}", probabilityCol=f"__cal_{k}", predictionCol=f"__cy_{k}")
            stages.append(last.fit(own))
    return PipelineModel(stages)


def risks(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``risk``, the mean of the folds' calibrated probabilities; rows without a label are scored too."""
    out = model.transform(rows)
    found = [x for x in out.columns if x.startswith("__cal_")] or [x for x in out.columns if x.startswith("__p_m")]
    kinds = dict(out.dtypes)
    each = [F.col(x) if kinds[x] == "double" else F.get(vector_to_array(x), 1) for x in found]
    return out.withColumn("risk", sum(each[1:], each[0]) / len(each)).select(*rows.columns, "risk")
