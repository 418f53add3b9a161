import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from parlance.functions import g711
from parlance.functions import models as M
from parlance.operators import fusion

NAMES = ["a", "b", "flat"]


def rows(spark, n, seed=0, share=0.5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(3, 2, n), rng.normal(size=n), np.full(n, 7.0)])
    y = (x[:, 0] - 3 + x[:, 1] + rng.normal(size=n) > np.quantile(x[:, 0] - 3 + x[:, 1], 1 - share)).astype(int)
    df = spark.createDataFrame([(k, *map(float, x[k]), int(y[k])) for k in range(n)], "id long, a double, b double, flat double, label int")
    return df.repartition(3), x, y


def test_weights_are_those_of_the_local_fit(spark):
    """Without calibration the pipeline is one logistic, to the last digits that of the penalised fit."""
    df, x, y = rows(spark, 80, share=0.02)
    assert min(y.sum(), len(y) - y.sum()) < fusion.SIGMOID
    model = fusion.fit(df, NAMES, "label", "id").stages[-1]
    mean, sd = M.standardiser(x)
    w, b = M.logistic_fit((x - mean) / sd, y, 0.7, balanced=True)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)
    assert model.intercept == pytest.approx(b, abs=1e-6)


@pytest.mark.parametrize(("kind", "n", "share"), [("logistic", 300, 0.5), ("logistic", 300, 0.1), ("trees", 300, 0.5)])
def test_calibrated_risks_survive_a_save(spark, tmp_path, kind, n, share):
    df, _, y = rows(spark, n, 1, share)
    odd = spark.createDataFrame([(n, None, 0.5, 7.0, None), (n + 1, 2.0, None, None, None)], df.schema)
    model = fusion.fit(df.unionByName(odd), NAMES, "label", "id", kind)
    kinds = {s.uid.split("_")[0] for s in model.stages}
    assert ("IsotonicRegressionModel" in kinds or any("Isotonic" in k for k in kinds)) == (share == 0.5)
    got = {r.id: r.risk for r in fusion.risks(df.unionByName(odd), model).collect()}
    assert len(got) == n + 2
    assert all(0 <= v <= 1 for v in got.values())
    risk = np.array([got[k] for k in range(n)])
    assert risk[y == 1].mean() > risk[y == 0].mean() + 0.25
    assert abs(risk.mean() - y.mean()) < 0.1
    model.write().overwrite().save(f"file://{tmp_path}/model")
    again = {r.id: r.risk for r in fusion.risks(df, PipelineModel.load(f"file://{tmp_path}/model")).collect()}
    assert all(again[k] == pytest.approx(got[k], abs=1e-12) for k in again)


def test_one_class_is_refused(spark):
    df, _, _ = rows(spark, 20)
    with pytest.raises(ValueError, match="both classes"):
        fusion.fit(df.withColumn("label", F.lit(1)), NAMES, "label", "id")


def test_every_sample_through_both_laws(spark):
    s = spark.range(-32768, 32768).select(F.col("id").cast("int").alias("pcm"))
    s = s.select("pcm", g711.ulaw_encode(F.col("pcm")).alias("u"), g711.alaw_encode(F.col("pcm")).alias("a"))
    s = s.select("*", g711.ulaw_decode(F.col("u")).alias("from_u"), g711.alaw_decode(F.col("a")).alias("from_a")).orderBy("pcm").toPandas()
    for code, back in (("u", "from_u"), ("a", "from_a")):
        assert s[code].between(0, 255).all()
        assert s[code].nunique() >= 255
        assert s[back].is_monotonic_increasing
        assert (np.abs(s[back] - s.pcm) <= np.maximum(16, np.abs(s.pcm) / 16)).all()
