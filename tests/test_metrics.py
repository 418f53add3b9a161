import math
import random

import numpy as np
import pytest

from parlance.operators import lexicon
from parlance.operators import metrics as M
from parlance.operators import modelling

NAN, INF = float("nan"), float("inf")


def area(rows):
    """By comparing all pairs of the classes; unusable scores take no part."""
    can = [(s, y) for s, y in rows if s is not None and not math.isnan(s) and y in (0, 1)]
    pos, neg = [s for s, y in can if y == 1], [s for s, y in can if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def frame(spark, groups):
    return spark.createDataFrame([(g, s, y) for g, rows in groups.items() for s, y in rows], "g string, score double, label int").repartition(3)


CASES = {
    "plain": [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)],
    "null": [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (None, 0)],
    "nan": [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (NAN, 1), (NAN, 0)],
    "infinite": [(INF, 1), (-INF, 0), (0.5, 1), (INF, 0), (-INF, 1), (0.5, 0), (1e308, 1), (-1e308, 0)],
    "ties": [(0.5, 1), (0.5, 0), (0.5, 1), (0.2, 0)],
    "one class": [(0.5, 1), (0.7, 1), (None, 0)],
    "none usable": [(None, 1), (NAN, 0)],
    "no label": [(0.5, None), (0.6, 1), (0.4, 0)],
    None: [(0.3, 0), (0.2, 1)],
}


def test_area_with_odd_scores(spark):
    rng = random.Random(1)
    many = {f"m{k}": [(rng.choice([None, NAN, INF, -INF, 0.0, -0.0, rng.random(), 1 - rng.random() * 1e-12, rng.gauss(0, 1e5), 1e-320]), rng.randint(0, 1)) for _ in range(rng.randint(1, 300))] for k in range(12)}
    got = {r.g: r.auc for r in M.roc_auc(frame(spark, CASES | many), ["g"]).collect()}
    for g, rows in (CASES | many).items():
        want = area(rows)
        assert (got.get(g) is None) if want is None else got[g] == pytest.approx(want)
        assert want is None or 0 <= got[g] <= 1
    assert "none usable" not in got


def test_curve_with_odd_scores(spark):
    got = {}
    for r in M.det_curve(frame(spark, CASES), ["g"]).collect():
        got.setdefault(r.g, []).append((r.threshold, r.fpr, r.fnr))
    assert got["none usable"] == [(INF, 0.0, 1.0)]
    for g in ("plain", "null", "nan"):
        points = sorted(got[g], key=lambda x: (-x[0], x[1]))
        assert points[0] == (INF, 0.0, 1.0)
        assert points[-1][1:] == (1.0, 0.0)
    assert sorted(x[0] for x in got["infinite"]) == [-INF, -1e308, 0.5, 1e308, INF, INF]
    assert {r.g: r.eer for r in M.equal_error(M.det_curve(frame(spark, CASES), ["g"]), ["g"]).collect()}["nan"] == pytest.approx(0)


def test_stretches_keep_the_order(spark):
    values = sorted([0.0, 1.0, -1.0, INF, -INF, 1e300, -1e300, 1e-300, 5e-324, *np.linspace(-3, 3, 4001).tolist(), *np.linspace(0.99, 1, 501).tolist(), *(1 - np.geomspace(1e-16, 1e-2, 200)).tolist()])
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", "x", M._stretch("x").alias("c")).orderBy("k").collect()
    assert all(a.c <= b.c for a, b in zip(rows, rows[1:]))
    assert len({r.c for r in rows if 0.99 <= r.x < 1}) > 100


def test_percentiles_by_selection(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700).round(2), "b": rng.integers(0, 3, 50).astype(float), "c": np.array([4.5]), "d": rng.random(2)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", NAN), ("e", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    at = {"least": 0.0, "p05": 0.05, "half": 0.5, "p90": 0.9, "top": 1.0}
    got = {r.g: r for r in M.percentiles(df, ["g"], "x", at).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, x in (groups | {None: np.array([1.0, 2.0])}).items():
        assert [got[g][n] for n in at] == pytest.approx([float(np.quantile(x, q)) for q in at.values()])
    whole = M.percentiles(df, [], "x", {"half": 0.5}).collect()
    assert [r.half for r in whole] == pytest.approx([float(np.median([v for _, v in rows if v is not None and v == v]))])
    assert [r.half for r in M.percentiles(df.limit(0), [], "x", {"half": 0.5}).collect()] == [None]


def test_samples_do_not_vanish(spark):
    """Of 10^12 rows a sample of 60 still takes some: its bound is no multiple of 2^-20."""
    df = spark.range(1000).toDF("call_id")
    for n, sample in ((10**12, 60), (10**9, 400), (500, 1000)):
        share = modelling.sample_share(sample, n)
        assert 0 < share <= 1
        assert share == pytest.approx(min(1, sample / n), rel=1e-6)
    kept = modelling.sampled(df, 500, 1000, "call_id").count()
    assert 400 < kept < 600
    assert modelling.sampled(df, 10**6, 1000, "call_id").count() == 1000


def test_an_empty_vocabulary_has_no_hits(spark):
    t = spark.createDataFrame([(1, 0, ["a", "b"])], "call_id long, turn_index long, tokens array<string>")
    empty = spark.createDataFrame([], "family string, term string, weight double")
    assert lexicon.token_hits(t, empty, ["call_id", "turn_index"]).count() == 0
