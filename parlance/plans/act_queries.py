"""Queries of the act rules and the reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lowered
from ..operators import lexicon as L
from ..operators import reasons as W
from ..operators import sequences as S
from ..operators.acts import act_labels
from . import base as B
from .sequence_queries import COERCION_SQL
from .text_queries import FLAGS_SQL

CUES = {
    "greet": {"on", "mit"}, "close": {"at"}, "close_phrases": {"of the", "la de"}, "self_id": {"is"}, "self_id_phrases": {"in the"}, "first_person": {"and"}, "authority": {"sur"}, "problem": {"or", "aux"},
    "reassure": {"be"}, "confirm": {"re"}, "smalltalk": {"en"}, "instruct": {"to"}, "escalate_phrases": {"by the", "der die"}, "clock_units": {"day"}, "clock_words": {"die"}, "clock_links": {"zu"}, "otherwise": {"con"},
    "wh": {"an"}, "resist": {"der"}, "resist_phrases": {"is the"}, "ack": {"it", "that"}, "backchannel": {"the"}, "comply_phrases": {"of and"}, "naming": {"the", "le"},
}


def act_label(spark, sf):
    t = B.turns(spark, sf).withColumn("low", lowered(F.col("tokens")))
    t = L.construction_flags(t, B.SETS)
    v = B.vocab(spark).withColumn("w", F.col("weight"))
    hits = t.select("call_id", "turn_index", F.explode("low").alias("term")).join(v, "term").groupBy("call_id", "turn_index").agg(
        F.bool_or((F.col("family") == "threat") & (F.col("term") != "of")).alias("threatening"), F.bool_or((F.col("family") == "urgency") & (F.col("w") >= 0.5)).alias("hard_urgency"), F.bool_or((F.col("family") == "isolation") & (F.col("term") == "pas")).alias("isolating"))
    t = t.join(hits, ["call_id", "turn_index"], "left").na.fill(False, ["threatening", "hard_urgency", "isolating"])
    return act_labels(t, CUES).select("call_id", "turn_index", "act")


def reasons_rows(spark, sf):
    c = S.coercion(B.acted(spark, sf))
    counts = B.entity_spans(spark, sf).groupBy("call_id").agg(F.count_if(F.col("type") == "OTP").alias("n_ent_otp"), F.count_if(F.col("type") == "BANK_ENTITY").alias("n_ent_bank"))
    df = c.join(counts, "call_id", "left").na.fill(0, ["n_ent_otp", "n_ent_bank"])
    for n in ("personal", "authority", "threat", "payment"):
        df = df.withColumn(f"n_ent_{n}", F.lit(0).cast("long"))
    df = df.withColumn("pim", F.round(F.col("coercion_peak") / 2, 2)).withColumn("intent_score", F.lit(0.7)).withColumn("as_score", F.when(F.col("call_id") % 2 == 0, F.col("coercion_mean"))).withColumn("risk", F.col("coercion_mean"))
    return W.write_reasons(df)


def reasons(spark, sf):
    return reasons_rows(spark, sf).select("call_id", F.array_join("reasons", " ").alias("text"))


QUERIES = {"act_label": act_label, "reasons": reasons}


def _has(k: str, n: int | None = None) -> str:
    low = "low" if n is None else f"low[1:{n}]"
    return f"list_has_any({low}, {sorted(CUES[k])})"


def _says(k: str) -> str:
    return "(" + " OR ".join(f"contains(j, ' {p} ')" for p in sorted(CUES[k])) + ")"


_NAMED = "len(list_filter(range(least(len(low), 4)), lambda i: list_contains(" + str(sorted(CUES["naming"])) + ", low[i + 1]) AND coalesce(regexp_matches(tokens[i + 2], '^\\p{Lu}'), false))) > 0"
_CLOCK = f"({_has('clock_units')} OR ({_has('clock_words')} AND {_has('clock_links')}))"
_INTRO = f"({_says('self_id_phrases')} OR {_NAMED} OR ({_has('first_person')} AND {_has('self_id')}))"
_AUTH = f"(authority_copula OR {_has('authority')})"
_f = lambda k: "format('{:.2f}', floor(" + k + " * 100 + 0.5) / 100)"
ORACLES = {
    "act_label": f"""WITH {FLAGS_SQL}, {B.VOCAB_SQL}, h AS (SELECT call_id, turn_index, bool_or(family = 'threat' AND term <> 'of') AS threatening, bool_or(family = 'urgency' AND weight >= 0.5) AS hard, bool_or(family = 'isolation' AND term = 'pas') AS isolating FROM (SELECT call_id, turn_index, unnest(low) AS term FROM lows) JOIN vocab USING (term) GROUP BY ALL),
      x AS (SELECT f.* EXCLUDE (low), l.low, l.tokens, ' ' || array_to_string(l.low, ' ') || ' ' AS j, coalesce(threatening, false) AS threatening, coalesce(hard, false) AS hard, coalesce(isolating, false) AS isolating FROM flags f JOIN lows l USING (call_id, turn_index) LEFT JOIN h USING (call_id, turn_index))
      SELECT call_id, turn_index, CASE WHEN len(low) = 0 THEN 'INFORM' WHEN speaker = 'callee' THEN CASE WHEN {_has('resist')} OR {_says('resist_phrases')} THEN 'VICTIM_RESIST' WHEN len(list_filter(low, lambda w: regexp_matches(w, '^[0-9]+$'))) > 0 OR {_says('comply_phrases')} THEN 'VICTIM_COMPLY'
        WHEN {_has('ack', 2)} AND len(low) <= 11 AND ({_has('backchannel')} OR len(low) <= 7) THEN 'CONFIRM' WHEN list_contains(low, '?') OR {_has('wh')} THEN 'VICTIM_QUESTION' WHEN {_has('ack', 2)} THEN 'VICTIM_COMPLY' WHEN {_has('greet', 2)} THEN 'GREET' ELSE 'INFORM' END
      ELSE CASE WHEN secrecy_command OR isolating THEN 'ISOLATE' WHEN imperative_sensitive THEN 'REQUEST_SENSITIVE' WHEN threatening AND {_CLOCK} THEN 'DEADLINE' WHEN {_CLOCK} AND {_has('otherwise')} THEN 'DEADLINE' WHEN {_says('escalate_phrases')} THEN 'PRESSURE_ESCALATE'
        WHEN threatening AND hard THEN 'PRESSURE_ESCALATE' WHEN threatening THEN 'THREAT' WHEN hard AND {_has('instruct')} THEN 'PRESSURE_ESCALATE' WHEN {_AUTH} AND {_INTRO} THEN 'IDENTIFY_SELF' WHEN {_AUTH} THEN 'AUTHORITY_ASSERT'
        WHEN {_has('close', 3)} OR {_says('close_phrases')} OR ({_has('close')} AND turn_index > 2) THEN 'CLOSE' WHEN {_has('greet', 2)} AND turn_index <= 1 THEN 'GREET' WHEN {_INTRO} AND turn_index <= 4 THEN 'IDENTIFY_SELF' WHEN {_has('reassure')} THEN 'REASSURE' WHEN {_has('instruct')} THEN 'INSTRUCT'
        WHEN {_has('problem')} THEN 'PROBLEM_STATE' WHEN {_has('smalltalk')} THEN 'SMALLTALK' WHEN {_has('confirm')} THEN 'CONFIRM' WHEN {_has('greet', 1)} THEN 'GREET' ELSE 'INFORM' END END AS act FROM x""",
    "reasons": f"""WITH {COERCION_SQL}, tk AS (SELECT call_id, unnest(tokens) AS token FROM turns), e AS (SELECT call_id, count(*) FILTER (type = 'OTP') AS otp, count(*) FILTER (type = 'BANK_ENTITY') AS bank FROM (SELECT call_id, {B.KIND_SQL} AS type FROM tk) WHERE type IS NOT NULL GROUP BY 1),
      x AS (SELECT co.*, coalesce(otp, 0) AS otp, coalesce(bank, 0) AS bank, round(coercion_peak / 2, 2) AS pim, CASE WHEN call_id % 2 = 0 THEN coercion_mean END AS voice FROM co LEFT JOIN e USING (call_id)),
      r AS (SELECT call_id, coercion_mean AS risk, list_filter([CASE WHEN otp > 0 THEN 'The caller asks about a one-time code (' || otp || CASE WHEN otp > 1 THEN ' mentions).' ELSE ' mention).' END END, CASE WHEN bank > 0 THEN 'The caller speaks of an account (' || bank || CASE WHEN bank > 1 THEN ' mentions).' ELSE ' mention).' END END,
        CASE WHEN coercion_slope > 0.05 THEN 'Pressure climbs through the call (slope ' || {_f('coercion_slope')} || ').' END, CASE WHEN peak_act IN {B.words(W.TOP_ACTS)} THEN 'The call reaches a ' || lower(replace(peak_act, '_', ' ')) || ' turn.' END,
        CASE WHEN pim >= 0.35 THEN 'Pressing words come with flat delivery (mismatch ' || {_f('pim')} || ').' WHEN pim < 0.15 THEN 'Delivery follows the words.' END,
        CASE WHEN voice IS NULL THEN 'No audio: the transcript alone is judged.' WHEN voice >= 0.6 THEN 'The voice looks synthetic (' || {_f('voice')} || ').' WHEN voice <= 0.3 THEN 'The voice varies as real speech does (' || {_f('voice')} || ').' END,
        CASE WHEN callee_resist > 0.3 THEN 'The called person resists or asks in ' || format('{{:.0f}}', floor(100 * callee_resist + 0.5)) || '% of their turns.' END], lambda s: s IS NOT NULL) AS s FROM x)
      SELECT call_id, array_to_string(CASE WHEN len(s) = 0 THEN ['Nothing stands out.'] ELSE s END || CASE WHEN risk < 0.35 THEN ['Overall risk is in the low band.'] ELSE []::VARCHAR[] END, ' ') AS text FROM r""",
}
