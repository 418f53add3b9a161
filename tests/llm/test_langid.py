import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import langid
from parlance.llm import textbytes as tb

STEMS = {"aa": "the ing of tion and er", "bb": "der ung keit sch über ein", "cc": "ción los ñ mente que ar"}


def rows(n, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(STEMS))
        words = ["".join(rng.choices(STEMS[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(6, 60))]
        out.append((k, " ".join(words), lang))
    return out


def test_presence_is_the_set_of_ngrams():
    texts = ["Abc d", "", "ééa", "zzzz"]
    got = langid.presence(*tb.utf8(pa.array(texts)))
    for text, bits in zip(texts, got, strict=True):
        held = re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode())
        want = {b for b in held if b != 0x20}
        for k, order in enumerate(langid._ORDERS):
            for i in range(len(held) - order + 1):
                h = int.from_bytes(held[i : i + order], "big") * 2654435761 % (1 << 32) >> (32 - langid._BITS)
                want.add(256 + (k << langid._BITS) + h)
        assert set(np.flatnonzero(bits)) == want


def brute_kernel(a, b):
    """Shared n-grams over the geometric mean of both numbers, pair by pair."""
    sets = [[set(np.flatnonzero(x)) for x in rows] for rows in (a, b)]
    return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets[1]] for x in sets[0]])


def test_against_kernel_ridge_regression_by_its_definition():
    """With all rows as landmarks the Nyström map loses nothing: the scores are those of the dual
    solution on the whole kernel matrix, one language against the rest, languages weighing alike."""
    data = rows(60, seed=9)
    bits = langid.presence(*tb.utf8(pa.array([t for _, t, _ in data])))
    learn, new, labels = bits[:40], bits[40:], [x for _, _, x in data[:40]]
    model = langid.fit(learn, labels, landmarks=40, ridge=0.05)
    kernel, languages = brute_kernel(learn, learn), sorted(set(labels))
    weight = np.diag([40 / (len(languages) * labels.count(x)) for x in labels])
    goal = np.array([[1.0 if x == y else -1.0 for y in languages] for x in labels])
    dual = np.linalg.solve(weight @ kernel + 0.05 * 40 / len(languages) * np.eye(40), weight @ goal)
    assert np.allclose(model.scores(new), brute_kernel(new, learn) @ dual, atol=2e-3)


def test_nystroem_is_the_projection_on_its_landmarks():
    """With few landmarks the map's inner products are K(x, m) K(m, m)^-1 K(m, y)."""
    data = rows(50, seed=2)
    bits = langid.presence(*tb.utf8(pa.array([t for _, t, _ in data])))
    labels = [x for _, _, x in data]
    model = langid.fit(bits, labels, landmarks=9, ridge=0.05)
    turn, chosen = {}, []
    for k, x in enumerate(labels):  # the languages take turns
        turn[x] = turn.get(x, -1) + 1
        chosen.append((turn[x], x, k))
    marks = bits[[k for _, _, k in sorted(chosen)[:9]]]
    to_marks = brute_kernel(bits, marks)
    kernel = to_marks @ np.linalg.pinv(brute_kernel(marks, marks), rcond=1e-6) @ to_marks.T
    languages = sorted(set(labels))
    weight = np.diag([50 / (len(languages) * labels.count(x)) for x in labels])
    goal = np.array([[1.0 if x == y else -1.0 for y in languages] for x in labels])
    dual = np.linalg.solve(weight @ kernel + 0.05 * 50 / len(languages) * np.eye(50), weight @ goal)
    assert np.allclose(model.scores(bits), kernel @ dual, atol=2e-3)


def test_an_id_that_many_rows_share_crowds_nothing_out(spark):
    data = rows(200) + [(3, "der ung keit", "bb")] * 400 + [(4, f"ing of tion {k}", "aa") for k in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    a, b = (langid.train(x, F.lit(True), fit_per_language=60) for x in (df, df.repartition(6)))
    assert a.languages == ["aa", "bb", "cc"] and np.allclose(a.weights, b.weights)


def test_held_out_accuracy_and_undetermined(spark):
    data = rows(900) + [(1000, None, "aa"), (1001, " 12 !?", "bb"), (1002, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("source", F.lit("x"))
    model = langid.train(df, F.col("doc_id") % 3 != 0, fit_per_language=100)
    got = {r.doc_id: r for r in langid.predict(df, model, keep=["doc_id"]).collect()}
    assert len(got) == len(data)
    held = [d for d in data[:900] if d[0] % 3 == 0]
    assert sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[k].lang_pred for k in (1000, 1001, 1002)} == {"und"}


def test_more_languages_than_landmarks(spark):
    """Every one of 200 languages has a landmark; the sample is bounded in all, not by language."""
    rng = random.Random(8)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for _ in range(200)]
    data = [(40 * k + j, " ".join(rng.choices(words[k], k=30)), f"l{k:03}") for k in range(200) for j in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df, F.col("doc_id") % 2 == 0, fit_rows=1200)
    assert len(model.languages) == 200
    assert model.landmarks.shape[1] == 200
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model, keep=["doc_id"]).collect()}
    held = [(d, x) for d, _, x in data if d % 2]
    assert sum(got[d] == x for d, x in held) > 0.95 * len(held)
    few = langid.train(df, F.lit(True), fit_languages=3)
    assert few.languages == ["l000", "l001", "l002"]


def test_without_labels_or_rows(spark, no_docs):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(df, F.lit(True)) is None
    assert [r.lang_pred for r in langid.predict(df, None).collect()] == ["und"]
    assert langid.predict(no_docs, langid.train(no_docs, F.lit(True))).count() == 0
