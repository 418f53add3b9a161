import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import toxicity


def weigh(emit, moves, start, path):
    s = sum(e for e, y in zip(emit, path, strict=True) if y) + (start if path and path[0] else 0)
    step = {(0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2], (0, 0): 0.0}
    return math.exp(s + sum(step[x] for x in itertools.pairwise(path)))


def test_marginals_against_all_paths():
    rng = np.random.default_rng(5)
    emit, moves, start = rng.normal(0, 2, (4, 6)), rng.normal(0, 1, 3), 0.4
    length = np.array([6, 1, 4, 3])
    got, pairs, log_z = toxicity.forward_backward(emit, length, moves, start)
    want_pairs = np.zeros(3)
    for c, n in enumerate(length):
        paths = {p: weigh(emit[c, :n], moves, start, p) for p in itertools.product((0, 1), repeat=n)}
        z = sum(paths.values())
        assert math.isclose(log_z[c], math.log(z), rel_tol=1e-9)
        for t in range(n):
            assert math.isclose(got[c, t], sum(w for p, w in paths.items() if p[t]) / z, rel_tol=1e-9)
        for p, w in paths.items():
            for k, pair in enumerate(((0, 1), (1, 0), (1, 1))):
                want_pairs[k] += w / z * sum(x == pair for x in itertools.pairwise(p))
        assert (got[c, n:] == 0).all()
    assert np.allclose(pairs, want_pairs)


def test_a_long_document_is_one_chain(monkeypatch):
    """Pieces of any length give the marginals, pairs and log Z of the whole chain."""
    rng = np.random.default_rng(8)
    tokens = np.array([23, 0, 4, 1, 9, 17])
    doc = np.repeat(np.arange(len(tokens)), tokens)
    emit, moves, start = rng.normal(0, 3, len(doc)), rng.normal(0, 1.5, 3), -0.7
    seen = []
    for size in (64, 4, 1, 3):
        monkeypatch.setattr(toxicity, "PIECE", size)
        piece, place, follows = toxicity.pieces(doc, len(tokens))
        length = np.bincount(piece, minlength=len(follows))
        marginal, pairs, log_z = toxicity.forward_backward(toxicity._padded(emit, piece, place, len(follows)), length, moves, start, follows)
        seen.append((marginal[piece, place], pairs, log_z.sum()))
        assert (follows.any()) == (size < 23)
    for other in seen[1:]:
        for x, y in zip(seen[0], other, strict=True):
            assert np.allclose(x, y, rtol=1e-9)


def test_training_slope_against_all_labellings(monkeypatch):
    """The value is the gold path's share of all paths, and the slope its difference quotient."""
    monkeypatch.setattr(toxicity, "PIECE", 2)
    rng = np.random.default_rng(3)
    tokens = [5, 1, 4]
    doc = np.repeat(np.arange(3), tokens)
    local = rng.integers(0, 6, (len(doc), 5))
    local[0, 0] = 5
    toxic = rng.random(len(doc)) < 0.4
    likelihood = toxicity.Likelihood(local, doc, 3, toxic, 0.1)
    params = rng.normal(0, 0.5, 10)

    def value(p):
        total = -0.1 * 3 / 2 * (p[:-4] ** 2).sum()
        for d, n in enumerate(tokens):
            emit, gold = p[local[doc == d]].sum(axis=1), tuple(int(x) for x in toxic[doc == d])
            paths = itertools.product((0, 1), repeat=n)
            total += math.log(weigh(emit, p[-4:-1], p[-1], gold) / sum(weigh(emit, p[-4:-1], p[-1], y) for y in paths))
        return total

    got, slope = likelihood.at(params)
    assert math.isclose(got, value(params), rel_tol=1e-9)
    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-5
        assert math.isclose(slope[k], (value(params + step) - value(params - step)) / 2e-5, rel_tol=1e-5, abs_tol=1e-7)


def made(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumble", "sneerzo" + rng.choice(plain)]) + rng.choice([".", ""]))
        rows.append((k, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((k, int(toxic) if rng.random() > 0.01 else 1 - int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = made(1500)
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, " ,, ")], "doc_id long, text string").withColumn("score", F.lit("clash")).drop("score")
    truth = dict(labels)
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, field, spans=0.5).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in truth if k % 5 == 0]
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.95 * len(held)
    assert got[9001].predicted == 0 and got[9001].score == got[9002].score == got[9003].score
    text = dict(rows)
    found = [text[k].encode()[s.start : s.end].decode().lower() for k, r in got.items() if k < 9000 for s in r.spans]
    assert sum("grumble" in w or "sneerzo" in w for w in found) > 0.9 * len(found) > 100


def test_one_row_of_an_id_teaches(spark):
    rows, labels = made(300)
    docs = spark.createDataFrame([*rows, *[(labels[0][0], f"row {k} of one id") for k in range(500)]], "doc_id long, text string")
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    again = toxicity.fit(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert field.weights.any() and (field.weights == again.weights).all()


def test_many_rows_and_many_labels_of_an_id(spark, monkeypatch):
    """1,000 rows and 1,000 labels of one id are one row of either label, not a million."""
    rows, labels = made(200)
    docs = spark.createDataFrame([*rows, *[(7, f"row {k} of one id") for k in range(1000)]], "doc_id long, text string")
    many = spark.createDataFrame([*labels, *[(7, k % 2) for k in range(1000)]], "doc_id long, toxic int")
    seen = []
    real = toxicity.train_field
    monkeypatch.setattr(toxicity, "train_field", lambda features, doc, y, *a: (seen.append(len(y)), real(features, doc, y, *a))[1])
    assert toxicity.fit(docs, many) is not None
    assert 100 < seen[0] <= 202


def test_nothing_to_learn_from(spark, docs, no_docs):
    none = spark.createDataFrame([(3, None), (6, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {r.score for r in toxicity.score(docs, None).select("score").collect()} == {0.0}
    assert toxicity.score(no_docs, None).count() == 0
