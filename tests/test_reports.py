"""Report operators, persistence and audio pairs against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import dsp
from parlance.functions import models as N
from parlance.operators import audio as A
from parlance.operators import modelling as D
from parlance.operators import reports as P
from parlance.plans import act_queries, catalog
from parlance.sources import transcripts as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("n", "most"), [(1, 5), (5, 5), (6, 5), (64, 11), (620, 9), (97, 2)])
def test_thinning(spark, n, most):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    got = sorted(r.id for r in P.evenly(df, ["g"], [F.col("id")], most).collect())
    assert got == (list(range(n)) if n <= most else sorted({j * (n - 1) // (most - 1) for j in range(most)}))
    every = sorted(r.id for r in P.thinned(df, ["g"], [F.col("id")], most).collect())
    assert every == list(range(n))[:: max(1, n // most)]


def test_models_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((300, 3)), (rng.random(300) < 0.5).astype(int)
    x[y == 1] += 1
    fused = D.Fusion(["a", "b", "c"]).fit(x, y)
    few = D.Fusion(["a", "b", "c"]).fit(x[:24], y[:24])
    gmm = N.DiagonalGMM(3).fit(x)
    crf = N.ChainCRF(["O", "B-X", "I-X"], D.SIZE).fit([D.token_features(["say", "the", "code"]), D.token_features(["code"])], [["O", "O", "B-X"], ["B-X"]], 20)
    intent = D.TermIntent(np.where(np.arange(D.SIZE) % 3 == 0, 1.5, 0.0)).fit(["pay now", "good day"], np.array([1, 0]))
    for k, m in enumerate((fused, few, gmm, crf, intent)):
        D.save_model(spark, m, f"{tmp_path}/{k}")
    a, b, c, d, e = (D.load_model(spark, f"{tmp_path}/{k}") for k in range(5))
    assert (a.risk(x) == fused.risk(x)).all() and a.kind == "isotonic" and (b.risk(x) == few.risk(x)).all()
    assert (c.log_density(x) == gmm.log_density(x)).all()
    assert d.decode(D.token_features(["the", "code"])) == crf.decode(D.token_features(["the", "code"])) == ["O", "B-X"]
    assert e.score("pay now") == intent.score("pay now") != e.score("good day")


def test_fusion_and_trees_as_queries(spark):
    got = catalog.QUERIES["fused_risk"](spark, SF).collect()
    risk, label = np.array([r.risk for r in got]), np.array([r.label for r in got])
    assert len(got) == spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    assert (risk >= 0).all() and (risk <= 1).all() and risk[label == 1].mean() >= risk[label == 0].mean()
    trees = catalog.QUERIES["boosted_voice"](spark, SF).collect()
    p, y = np.array([r.boosted for r in trees]), np.array([r.label for r in trees])
    assert len(trees) == 500 and (p[y == 1].mean() - p[y == 0].mean()) > 0.2


def test_first_reasons(spark):
    whole = {r.call_id: r.reasons for r in act_queries.reasons_rows(spark, SF).collect()}
    got = {r.call_id: r for r in catalog.QUERIES["first_reasons"](spark, SF).collect()}
    assert set(got) == set(whole)
    assert all(got[k].n == min(6, len(r)) and got[k].text == " ".join(r[:2]) for k, r in whole.items())


def test_results_with_their_origin(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.5), (1, None, None)], "k long, t string, x double")
    P.write_results(df, f"{tmp_path}/r", {"source": "tests"})
    [p] = spark.read.json(f"{tmp_path}/r/provenance").collect()
    assert p.rows == 2 and p.entries.source == "tests" and p.digest == P.fingerprint(df.orderBy("k"), df.columns).first().digest
    assert P.write_if_changed(df, f"{tmp_path}/w") and not P.write_if_changed(df.repartition(3), f"{tmp_path}/w")
    assert P.write_if_changed(df.limit(1), f"{tmp_path}/w") and spark.read.parquet(f"{tmp_path}/w/rows").count() == 1


def test_pairs_share_a_channel(spark):
    rng = np.random.default_rng(1)
    t = np.arange(12000) / 8000
    voice = np.sin(2 * np.pi * 700 * t) * (np.sin(2 * np.pi * 1.5 * t) > 0)
    real, made = voice + 0.02 * rng.standard_normal(len(t)), voice * 0.3
    before = abs(dsp.noise_floor_db(dsp.normalise(dsp.condition(real))) - dsp.noise_floor_db(dsp.normalise(dsp.condition(made))))
    df = spark.createDataFrame([(1, 8000, real.tolist(), made.tolist())], "signal_id long, sr int, real array<double>, made array<double>")
    [r] = A.matched_pairs(df).collect()
    after = abs(dsp.noise_floor_db(np.array(r.real)) - dsp.noise_floor_db(np.array(r.made)))
    assert before > 10 and after < 2.5


def test_emphasis_counts_syllables_not_noise():
    t = np.arange(16000) / 8000

    def bursts(levels):
        x = np.zeros(len(t))
        for k, level in enumerate(levels):
            a = 800 + k * 2000
            x[a : a + 1000] = level * np.hanning(1000) * np.sin(2 * np.pi * 400 * t[:1000])
        return x + 1e-4

    even, uneven = dsp.emphasis(bursts([0.5] * 7)), dsp.emphasis(bursts([0.1, 0.8, 0.2, 0.9, 0.1, 0.7, 0.3]))
    assert even < 0.5 < 4 < uneven
    assert dsp.emphasis(np.zeros(16000)) == 0 == dsp.emphasis(np.zeros(100))
    assert dsp.arousal_components(np.zeros(500)) is None and set(dsp.arousal_components(bursts([0.5] * 4))) == {"f0_cv", "f0_span", "emphasis_var", "rate_std", "voiced_ratio"}


def test_channel_statistics_tell_a_louder_floor(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 8000, (np.sin(np.arange(8000) * 0.5) * (np.arange(8000) % 4000 < 2000) + level * rng.standard_normal(8000)).tolist()) for k, level in enumerate((0.001, 0.1))]
    a, b = A.channel_statistics(spark.createDataFrame(rows, "signal_id long, sr int, samples array<double>")).orderBy("signal_id").collect()
    assert len(a.asDict()) == 11 and b.noise_floor_db > a.noise_floor_db + 10 and b.snr_proxy_db < a.snr_proxy_db
    assert all(np.isfinite(x) for x in [*a.asDict().values(), *b.asDict().values()])


def test_uploads_without_text_and_stems_without_rows(spark):
    t = spark.createDataFrame([(1, "", 4.0), (2, None, 3.0), (3, "hello", 2.0)], "k int, t string, s double")
    got = sorted((r.k, r.text, r.t_end) for r in T.manual_turns(t, "k", "t", seconds="s").collect())
    assert got == [(1, T.NO_TRANSCRIPT, 4.0), (2, T.NO_TRANSCRIPT, 3.0), (3, "hello", 2.0)]
    files = spark.createDataFrame([("/x/a.wav",), ("/x/b.wav",)], "path string")
    rows = spark.createDataFrame([(7, "m/a.txt"), (8, "m/c.txt")], "id int, path string")
    assert [(r.id, r.stem) for r in T.by_stem(rows, files).collect()] == [(7, "a")]
    assert sorted((r.id, r.stem) for r in T.by_stem(rows.limit(0), files).collect()) == [(None, "a"), (None, "b")]
    assert T.by_stem(rows.where("id > 100"), files.limit(0)).count() == 0


def test_token_hits_use_no_token_twice(spark):
    import random

    from parlance.operators import lexicon as L

    rng = random.Random(3)
    terms = {"urgency": ["last chance", "chance now", "last", "now last chance"], "threat": ["chance", "now now"]}
    vocab = L.vocabulary(spark, [(f, t, 1.0) for f, ts in terms.items() for t in ts])
    texts = [[rng.choice(["last", "chance", "now", "nao", "x"]) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    canon = {"nao": "now"}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, low array<string>")
    got = {}
    for r in L.token_hits(df, vocab, ["k"], "low", lambda w: F.when(w == "nao", "now").otherwise(w)).collect():
        got.setdefault(r.k, set()).add((r.family, r.term, r.tok_start, r.tok_end))
    for k, words in enumerate(texts):
        spelt, want = [canon.get(w, w) for w in words], set()
        for family, ts in terms.items():
            used = set()
            for term in sorted(ts, key=lambda t: (-len(t.split()), t)):
                n = len(term.split())
                for i in range(len(words) - n + 1):
                    if spelt[i : i + n] == term.split() and not used & set(range(i, i + n)):
                        used |= set(range(i, i + n))
                        want.add((family, term, i, i + n))
        assert got.get(k, set()) == want, words


def test_signals_that_fail_say_why(spark):
    rows = catalog.QUERIES["prosody_errors"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all((r.error is None) == (r.f0_mean is not None) for r in rows)


def test_voice_descriptions(spark):
    got = catalog.QUERIES["interpretable_features"](spark, SF).collect()
    assert len(got[0].asDict()) == 12 and all(np.isfinite(v) for r in got for v in r.asDict().values())
    assert set(dsp.prosody(np.zeros(4000))) == set(A._PROSODY) and dsp.prosody(np.zeros(4000))["pause_ratio"] == 1.0
    audit = {r.stat: r for r in catalog.QUERIES["channel_audit"](spark, SF).collect()}
    assert len(audit) == 10 and all(0.5 <= r.auc <= 1 for r in audit.values())
    manifest = catalog.QUERIES["call_manifest"](spark, SF).collect()
    assert {r.set: sum(x.n for x in manifest if x.set == r.set) for r in manifest} == dict.fromkeys(("split", "label_voice", "scenario", "split+label_voice"), 240)


def test_sparse_logistic_is_the_dense_one():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 12)) * (rng.random((80, 12)) < 0.3)
    y = (rng.random(80) < 0.4).astype(int)
    row, column = np.nonzero(x)
    dense, sparse = N.logistic_fit(x, y, 2.0, True), N.logistic_fit(N.Sparse(row, column, x[row, column], x.shape), y, 2.0, True)
    assert np.allclose(dense[0], sparse[0], atol=1e-6) and abs(dense[1] - sparse[1]) < 1e-6


def test_largest_weights_have_names(spark):
    rows = [(k, "pay the code now" if k % 2 else "what a lovely day", k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, text string, y int")
    model = D.train_intent(df, "text", "y", "k", sample=60)
    top = {(r.side, r.term) for r in D.top_terms(df, model, k=3).collect()}
    assert len(top) == 6 and {t for s, t in top if s == 1} <= {"pay", "the", "code", "now"} and {t for s, t in top if s == 0} <= {"what", "lovely", "day"}
    t = spark.createDataFrame([(["say", "the", "code"],)], "tokens array<string>")
    crf = N.ChainCRF(["O", "B-X", "I-X"], D.SIZE).fit([D.token_features(["say", "the", "code"])], [["O", "O", "B-X"]], 20)
    got = D.top_weights(t, crf, k=4).collect()
    assert len(got) == 4 and ("wcode", "B-X") in {(r.feature, r.label) for r in got} and abs(got[0].weight) >= abs(got[-1].weight)
