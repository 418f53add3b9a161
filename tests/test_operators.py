"""Operators against hand-made cases and direct restatements of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import text as X
from parlance.operators import lexicon as L
from parlance.operators import metrics as M
from parlance.operators import risk as R
from parlance.operators import sequences as S
from parlance.sources import transcripts as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_tokens_and_shapes(spark):
    assert one(spark, X.tokens("t"), t="Pay 1,250.50 now! it's über") == ["Pay", "1,250.50", "now", "!", "it's", "ü", "ber"]
    assert one(spark, X.word_shape(F.col("t")), t="McAbcde1234-x") == "XxXxxdd-x"
    assert one(spark, X.collapse_repeats(F.col("t")), t="soooo goood!!!") == "soo good!!"
    assert one(spark, X.clean_markup(F.col("t")), t="<b>a</b> & <i>b\n c</i>") == "a and b c"
    assert one(spark, X.ngrams(F.split("t", " "), 2), t="a b c") == ["a_b", "b_c"] and one(spark, X.ngrams(F.split("t", " "), 2), t="a") == []
    assert one(spark, X.sentences(F.col("t")), t="Go now. No. Come here! ok") == ["Go now.", "Come here!"]
    assert one(spark, X.canonical(F.col("t"), {"theek": "thik"}, {"pani"}), t="paanii") == "pani"
    assert one(spark, X.canonical(F.col("t"), {"theek": "thik"}, set()), t=" Theek") == "thik"


def test_language_votes(spark):
    v = {"hi": {"nahi"}, "en": {"bank"}}
    for token, want in {"Nahi": "hi", "bank": "en", "12": "univ", "xyz1": "univ", "going": "en", "karoo": "hi", "ok": "univ", "gooing": "univ"}.items():
        assert one(spark, X.token_language(F.col("t"), v, {"ok"}, {"hi": ["oo|aa"], "en": ["ing$"]}), t=token) == want


def brute_hits(text, terms):
    low = " " + re.sub(r"\s+", " ", text.lower().strip()) + " "
    taken, hits = [], []
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        for m in re.finditer(r"(?<![a-z])" + re.escape(term) + r"(?![a-z])", low):
            if not any(m.start() < e and s < m.end() for s, e in taken):
                taken.append(m.span())
                hits.append(term)
    return sorted(hits)


def test_phrases_longest_first(spark):
    rng = random.Random(2)
    terms = ["last", "last chance", "chance now", "6 digit", "otp", "a b a"]
    texts = ["LAST  chance now", "last chance", "a6 digit 6 digitx 6 digit", "otp1 éotp xotp otp", None, "a b a b a"]
    texts += [" ".join(rng.choices(["last", "chance", "now", "6", "digit", "otp", "a", "b", "é", "x-otp"], k=12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    vocab = L.vocabulary(spark, [("urgency", t, 1.0) for t in terms])
    got = {}
    for r in L.phrase_hits(df, vocab, ["k"]).collect():
        got.setdefault(r.k, []).append(r.term)
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == brute_hits(t or "", terms), t


def test_metric_worked_examples(spark):
    rows = [("sep", s, y) for s, y in zip((0.9, 0.8, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1), (1, 1, 1, 1, 0, 0, 0, 0), strict=True)]
    rows += [("mix", s, y) for s, y in zip((0.9, 0.8, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1), (1, 0, 1, 0, 1, 0, 1, 0), strict=True)] + [("one", 0.5, 1), ("tie", 0.5, 1), ("tie", 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    assert {r.g: r.auc for r in M.roc_auc(df, ["g"]).collect()} == {"sep": 1.0, "mix": 0.625, "one": None, "tie": 0.5}
    e = {r.g: r.eer for r in M.equal_error(M.det_curve(df.where("g IN ('sep', 'mix')"), ["g"]), ["g"]).collect()}
    assert e == {"sep": 0.0, "mix": 0.5}
    c = M.calibration(spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1), (1.0, 1), (0.3, 0)], "score double, label int"), [])
    assert {r.bin: r.n for r in c.collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 2}


def test_code_mixing_worked_examples(spark):
    seqs = {1: "hi hi hi", 2: "hi hi hi hi en", 3: "hi en univ", 4: "univ univ", 5: "en hi en hi"}
    rows = [(k, i, x) for k, s in seqs.items() for i, x in enumerate(s.split())]
    got = {r.k: r for r in S.code_mixing(spark.createDataFrame(rows, "k int, pos int, lang string"), "k", ["pos"], "hi", "en").collect()}
    assert [round(got[k].cmi, 9) for k in range(1, 6)] == [0, 0.2, 0.5, 0, 0.5]
    assert [got[k].switch_points for k in range(1, 6)] == [0, 1, 1, 0, 3]
    assert got[5].switch_rate == 1.0 and 0 < got[5].switch_entropy < 1


def test_slope_guards_and_fallback(spark):
    t = spark.createDataFrame([(1, 0, "caller", "GREET", 0.0), (1, 1, "callee", "VICTIM_RESIST", 0.0), (1, 2, "caller", "THREAT", 0.8), (2, 0, "caller", "INFORM", 0.1), (3, 0, "callee", "INFORM", 0.1)], "call_id int, turn_index int, speaker string, act string, rank double")
    got = {r.call_id: r for r in S.coercion(t).collect()}
    assert got[1].coercion_slope == pytest.approx(0.4) and got[1].callee_resist == 1.0 and got[1].peak_act == "THREAT" and got[1].first_pressure_turn == 2
    assert got[2].coercion_slope == 0 and got[3].coercion_peak == 0 and got[3].first_pressure_turn == -1
    df = spark.createDataFrame([(0.5, float("nan"), 1.0)], "intent_score double, as_score double, pim double")
    assert df.select(R.fallback_risk({c: F.col(c) for c in df.columns}).alias("x")).first().x == pytest.approx(0.35)
    assert len(schema.arm_features("full")) == 25 and len(schema.arm_features("late_fusion")) == 17


def test_transcripts(spark, tmp_path):
    t = spark.createDataFrame([(1, "Caller: hello there\n\n Victim: no\nnote: plain\nAgent:ok then", 10.0), (2, "", 1.0)], "k int, t string, s double")
    got = sorted((r.k, r.turn_index, r.speaker, r.text, round(r.t_start, 3), round(r.t_end, 3)) for r in T.manual_turns(t, "k", "t").collect())
    assert got == [(1, 0, "caller", "hello there", 0.0, 1.6), (1, 1, "callee", "no", 1.9, 3.2), (1, 2, "caller", "note: plain", 3.5, 5.4), (1, 3, "caller", "ok then", 5.7, 7.3)]
    assert [(r.k, round(r.t_end, 3)) for r in T.manual_turns(t, "k", "t", seconds="s").orderBy("k", "turn_index").collect()] == [(1, 2.5), (1, 5.0), (1, 7.5), (1, 10.0), (2, 1.0)]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "text").write_text("u1 first words\nu2\tother words\nbad\n\nu1 last words\n")
    assert sorted(map(tuple, T.read_kaldi(spark, f"{tmp_path}/k").collect())) == [("u1", "last words"), ("u2", "other words")]
    (tmp_path / "m.tsv").write_text("uid\tage\tcity\na\t30\tNA\nb\t\tx\n")
    assert {r.uid: r.meta for r in T.read_metadata(spark, f"{tmp_path}/m.tsv", "uid").collect()} == {"a": {"age": "30"}, "b": {"city": "x"}}


def test_calls_round_trip(spark, tmp_path):
    turn = {"index": 0, "speaker": "caller", "text": "pay now", "act": "INFORM", "tokens": [], "bio": [], "lang": [], "t_start": 2.0, "t_end": 1.0}
    row = {f.name: None for f in schema.CALL.fields} | {"call_id": "c1", "split": "dev", "turns": [turn], "label_scam": 1}
    calls = spark.createDataFrame([row], schema.CALL)
    T.write_calls(calls, f"{tmp_path}/c")
    back = T.read_calls(spark, f"{tmp_path}/c", "dev")
    assert back.count() == 1 and T.read_calls(spark, f"{tmp_path}/c", "test").count() == 0
    [t] = schema.turns_of(back).collect()
    assert (t.tokens, t.bio, t.lang, t.duration) == (["pay", "now"], ["O", "O"], ["univ", "univ"], 0.0)
    again = schema.calls_of_turns(schema.turns_of(back)).first().turns
    assert again[0].tokens == ["pay", "now"]
    with pytest.raises(Exception, match="differ in length"):
        schema.turns_of(spark.createDataFrame([row | {"turns": [turn | {"bio": ["O"]}]}], schema.CALL)).collect()
