"""The census's defined cases, and transliteration by examples."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import script as X
from parlance.operators import census as N

LANGS = ("en", "xx")
TURNS = "call_id long, turn_index int, n_tokens int, act string, rank double, lang array<string>, type array<string>, extra string"


def measures(spark, rows, speaker="s"):
    c = N.call_sums(spark.createDataFrame(rows, TURNS), LANGS)
    kind = F.when(F.col("call_id") < 10, "a")  # null above
    out = N.census(c, LANGS, scam=F.col("peak") >= 0.9, scenario=kind, cell=kind, split=kind, speaker=F.concat(F.lit(speaker), F.col("call_id") % 2), hard_negative=F.lit(None).cast("boolean"), mild_scam=F.lit(True))
    return {(r.measure, r.key): r.value for r in out.collect()}


def test_census_by_hand(spark):
    rows = [
        (1, 0, 4, "GREET", 0.0, ["en", "univ", "xx", "en"], [None, None, "OTP", "OTP"], "x"),
        (1, 1, 0, "INFORM", 0.1, [], [], None),  # says nothing: the next turn's change is from the turn before it
        (1, 2, 2, "THREAT", 0.8, ["xx", "xx"], [None, None], "y"),
        (2, 0, 1, "ISOLATE", 0.9, ["univ"], ["MONEY_AMOUNT"], None),
        (11, 0, None, None, None, None, None, None),
    ]
    m = measures(spark, rows)
    assert m["n_calls", ""] == 3 and m["n_turns", ""] == 5 and m["n_tokens", ""] == 7 and m["n_scam", ""] == 1 and m["n_benign", ""] == 2
    assert m["switch_points", ""] == 3 and m["lang_tokens", "en"] == 2 and m["lang_tokens", "xx"] == 3 and m["lang_tokens", "univ"] == 2
    assert m["mean_cmi", ""] == round((1 - 3 / 5) / 3, 3)
    assert m["entities", "OTP"] == 2 and m["entities", "MONEY_AMOUNT"] == 1 and m["entities", "BANK_ENTITY"] == 0 and m["n_entities", ""] == 3
    assert m["cmi_by_class.switch_rate", "benign"] == 60.0 and m["cmi_by_class.switch_rate", "scam"] == 0
    assert m["cmi_by_class.ent_lang_align", "benign"] == 0.5 and m["cmi_by_class.n_entity_tokens", "scam"] == 0
    assert m["splits", "a"] == 2 and m["splits", ""] == 1 and m["speakers_per_split", "a"] == 2 and m["scam_scenarios", "a"] == 1
    assert m["n_hard_negatives", ""] == 0 and m["n_mild_scams", ""] == 3
    assert ("acts", "CLOSE") not in m and m["acts", "THREAT"] == 1
    assert m["total_duration_s", ""] == pytest.approx(4 / 2.6 + 0.7 + 2 / 2.6 + 0.5 + 0.7 + 0.7, abs=1e-3)
    assert m["mean_coercion", "benign"] == round((0.3 + 0) / 2, 4)


def test_census_of_nothing(spark):
    assert measures(spark, []) == {}


def test_census_reads_once(spark):
    from parlance.plans.census_queries import corpus_census

    plan = corpus_census(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize(
    ("itrans", "want"),
    [("namaste", "नमस्ते"), ("rahA", "रहा"), ("maiM", "मैं"), ("ApkA", "आप्का"), ("bola", "बोल"), ("bol", "बोल्"), ("acChA", "अच्छा"), ("ghanTe", "घन्टे"), ("koI", "कोई"), ("kSh", "क्ष्"), ("", ""), ("k7", "क्7")],
)
def test_itrans(spark, itrans, want):
    assert spark.createDataFrame([(itrans,)], "x string").select(X.itrans_to_devanagari(F.col("x"))).first()[0] == want


def test_to_devanagari(spark):
    rows = [
        ("Raha bol, OTP 1234 hai!", "रहा बोल, OTP 1234 है!"),
        ("  aap \n ka\t", "आप का"),
        ("'quoted' ...", "'quoted' ..."),
        ("zz", "ज्ज"),
        ("", ""),
        (None, None),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select(X.to_devanagari(F.col("t"), {"otp"}).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_pinned_spellings_and_no_vocabulary(spark):
    df = spark.createDataFrame([("main nahi",)], "t string")
    assert df.select(X.to_devanagari(F.col("t"), None, {"main": "maiM", "nahi": "nahIM"})).first()[0] == "मैं नहीं"
    assert df.select(X.to_devanagari(F.col("t"), set(), {})).first()[0] == "मैन नहि"


def test_code_mixing(spark):
    from parlance.functions.mixing import code_mixing

    rows = [
        (["a", "b", "c", "d"], ["en", "xx", "univ", "en"], ["O", "B-X", "B-X", "I-X"], (4.0, 1 / 3, 0.5, 0.25, 0.25, 1.0, 2.0, 0.5)),
        ([], [], [], (0.0,) * 8),
        (None, None, None, (0.0,) * 8),
        (["a"], ["univ"], ["O"], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)),
    ]
    kind = "t array<string>, l array<string>, b array<string>"
    df = spark.createDataFrame([r[:3] for r in rows], kind)
    for bio in (F.col("b"), None):
        for r, (*_, want) in zip(df.select(code_mixing(F.col("t"), F.col("l"), bio, "en", "xx").alias("m")).collect(), rows, strict=True):
            assert tuple(r.m) == pytest.approx(want if bio is not None else (*want[:6], 0.0, 0.0))
    for odd in ((["a", "b"], ["en"], ["O", "O"]), (["a"], ["en"], [])):
        with pytest.raises(Exception, match="language tags for"):
            spark.createDataFrame([odd], kind).select(code_mixing(F.col("t"), F.col("l"), F.col("b"), "en", "xx")).collect()
