from pyspark.sql import functions as F

from parlance import schema
from parlance.operators import generate as G


def test_plan_is_disjoint_balanced_and_repeatable(spark):
    p = G.plan(spark, 200, 7)
    rows = p.collect()
    assert sorted(rows) == sorted(G.plan(spark, 200, 7).collect()) != sorted(G.plan(spark, 200, 8).collect())
    by = {}
    for r in rows:
        by.setdefault(r.speaker_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and {r.split for r in rows} == {"train", "dev", "test"}
    assert 70 <= sum(r.label_scam for r in rows) <= 130 and 70 <= sum(r.label_voice == "human" for r in rows) <= 130
    assert p.groupBy("topic").agg(F.count_distinct("label_scam").alias("k")).where("k < 2").count() == 0


def test_calls_are_well_formed(spark):
    calls = G.generate(G.plan(spark, 40, 3))
    turns = schema.turns_of(calls)
    assert calls.count() == 40 and turns.where("t_end < t_start").count() == 0
    for r in turns.collect():
        assert len(r.tokens) == len(r.bio) == len(r.lang)
        for a, b in zip(["O", *r.bio], r.bio, strict=False):
            assert not b.startswith("I-") or a[2:] == b[2:]
    types = {b[2:] for r in turns.collect() for b in r.bio if b != "O"}
    assert types <= set(schema.ENTITY_TYPES) and len(types) == 4


def test_grammar_is_a_parameter(spark, tmp_path):
    g = G.Grammar(arcs={0: (("caller", "GREET"),), 1: (("caller", "THREAT"), ("callee", "VICTIM_RESIST"))}, templates={"GREET": ("Hello {WHO}.",), "THREAT": ("Pay {WHO} now.",), "VICTIM_RESIST": ("No.",)}, slots={"WHO": ("BANK_ENTITY", ("the bank",))})
    assert g.faults() == [] == G.DEFAULT.faults() and g.fingerprint() != G.DEFAULT.fingerprint() == G.Grammar().fingerprint()
    [call] = G.generate_one(spark, "x1", 1, 5, grammar=g).collect()
    assert call.split == "none" and [t.act for t in call.turns] == ["THREAT", "VICTIM_RESIST"] and call.turns[0].bio[1:3] == ["B-BANK_ENTITY", "I-BANK_ENTITY"]
    bad = G.Grammar(arcs={0: (("caller", "SING"),), 1: (("caller", "GREET"),)}, templates={"GREET": ("To the bank, {WHO} and {ELSE}",)}, slots={"WHO": ("NOBODY", ("the bank",))})
    assert [f.split(":")[0] for f in bad.faults()] == ["no template", "unknown act", "no slot", "unknown type", "leak"]
    calls = G.generate(G.plan(spark, 20, seed=3))
    G.write_corpus(calls, f"{tmp_path}/c")
    rows = spark.read.json(f"{tmp_path}/c/manifest").collect()
    assert sum(r.n for r in rows if r.set == "split") == 20 and {r.grammar for r in rows} == {G.DEFAULT.fingerprint()}
