"""Queries of the sequence, coercion and risk operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import clip
from ..operators import risk as R
from ..operators import sequences as S
from ..operators.metrics import percentiles, with_percentiles
from ..storage import staged
from . import base as B
from .text_queries import RULES_SQL, rule_scores

def tags(spark, sf):
    """Gold and found tags of all tokens, by their length and place: with stray I-, B- within a span,
    tags that are none, and spans of several tokens."""
    t = B.flat_tokens(B.turns(spark, sf)).withColumn("seq", F.concat_ws(":", "call_id", "turn_index"))
    kind = F.when(F.length("token") % 4 == 0, "OTP").when((F.length("token") % 4 == 1) & (F.length("token") > 1), "MONEY")
    t = t.withColumn("kind", kind).withColumn("gold", F.when(F.col("kind").isNotNull(), F.concat(F.when(F.col("pos") % 3 == 0, "B-").otherwise("I-"), "kind")).when(F.col("pos") % 9 == 4, "X").otherwise("O"))
    found = F.when(F.col("pos") % 5 == 0, "O").when((F.col("pos") % 5 == 1) & F.col("kind").isNotNull(), F.concat(F.lit("B-"), "kind")).otherwise(F.col("gold"))
    return t.select("seq", "pos", "gold", found.alias("pred"))


TAGS_SQL = B.TOKENS_SQL + """, kinds AS (SELECT call_id || ':' || turn_index AS seq, pos, CASE WHEN length(token) % 4 = 0 THEN 'OTP' WHEN length(token) % 4 = 1 AND length(token) > 1 THEN 'MONEY' END AS kind FROM tok),
  golds AS (SELECT *, CASE WHEN kind IS NOT NULL THEN CASE WHEN pos % 3 = 0 THEN 'B-' ELSE 'I-' END || kind WHEN pos % 9 = 4 THEN 'X' ELSE 'O' END AS gold FROM kinds),
  tags AS (SELECT seq, pos, gold, CASE WHEN pos % 5 = 0 THEN 'O' WHEN pos % 5 = 1 AND kind IS NOT NULL THEN 'B-' || kind ELSE gold END AS pred FROM golds)"""


def spans_sql(column: str, name: str, source: str = "tags") -> str:
    kind = f"CASE WHEN {column} <> 'O' AND contains({column}, '-') THEN split_part({column}, '-', -1) END"
    return f"""{name}_k AS (SELECT *, {kind} AS type, lag({kind}) OVER (PARTITION BY seq ORDER BY pos) AS before FROM {source}),
  {name}_i AS (SELECT *, sum((type IS NOT NULL AND NOT (starts_with({column}, 'I-') AND type IS NOT DISTINCT FROM before))::INT) OVER (PARTITION BY seq ORDER BY pos) AS island FROM {name}_k),
  {name} AS (SELECT seq, type, min(pos) AS tok_start, max(pos) + 1 AS tok_end FROM {name}_i WHERE type IS NOT NULL GROUP BY seq, island, type)"""


def bio_decode(spark, sf):
    return S.bio_spans(tags(spark, sf), ["seq"], tag="gold")


def entity_prf(spark, sf):
    from ..operators.metrics import span_scores

    t = tags(spark, sf)
    g, p = S.bio_spans(t, ["seq"], tag="gold"), S.bio_spans(t, ["seq"], tag="pred")
    whole = span_scores(g, p, ["seq"]).withColumn("type", F.lit("all"))
    return B.rounded(span_scores(g, p, ["seq"], by_type=True).unionByName(whole), "precision", "recall", "f1")


def entity_density(spark, sf):
    totals = B.turns(spark, sf).groupBy("call_id").agg(F.sum("n_tokens").alias("n_tokens"))
    d = R.entity_density(B.entity_spans(spark, sf), totals)
    return B.rounded(d, *[c for c in d.columns if c != "call_id"])


def coercion(spark, sf):
    c = S.coercion(B.acted(spark, sf))
    return B.rounded(c, "coercion_slope", "coercion_peak", "coercion_mean", "callee_resist")


def coercion_slope(spark, sf):
    return coercion(spark, sf).select("call_id", "coercion_slope")


def coercion_peak(spark, sf):
    return coercion(spark, sf).select("call_id", "coercion_peak", "coercion_mean", "first_pressure_turn", "peak_act")


def callee_resist(spark, sf):
    return coercion(spark, sf).select("call_id", "callee_resist")


_S = "covar_pop(rank, turn_index::DOUBLE) FILTER (speaker = 'caller') / nullif(var_pop(turn_index::DOUBLE) FILTER (speaker = 'caller'), 0)"
COERCION_SQL = f"""{B.ACTED_SQL}, co AS (SELECT call_id,
    coalesce(CASE WHEN count(*) FILTER (speaker = 'caller') >= 2 THEN least(greatest({_S}, -1), 1) END, 0) AS coercion_slope,
    coalesce(max(rank) FILTER (speaker = 'caller'), 0) AS coercion_peak, coalesce(avg(rank) FILTER (speaker = 'caller'), 0) AS coercion_mean,
    coalesce(min(turn_index) FILTER (speaker = 'caller' AND rank >= 0.5), -1) AS first_pressure_turn,
    coalesce(avg((act IN ('VICTIM_RESIST', 'VICTIM_QUESTION'))::INT::DOUBLE) FILTER (speaker <> 'caller'), 0) AS callee_resist,
    arg_max(act, (rank, -turn_index)) FILTER (speaker = 'caller') AS peak_act
  FROM acted GROUP BY 1)"""


def labelled_acts(spark, sf):
    """Turns with acts; every third call counts as the positive class."""
    return B.acted(spark, sf).withColumn("label", (F.pmod("call_id", F.lit(3)) == 0).cast("int"))


def act_markov_fit(spark, sf):
    from ..schema import ACTS

    pi, trans = S.markov_fit(labelled_acts(spark, sf), "label", list(ACTS), 0.5)
    out = trans.unionByName(pi.select("label", F.lit("<start>").alias("act"), F.col("act").alias("next_act"), F.col("log_pi").alias("log_a")))
    return B.rounded(out, "log_a")


def act_llr(spark, sf):
    from ..schema import ACTS

    t = labelled_acts(spark, sf)
    pi, trans = S.markov_fit(t, "label", list(ACTS), 0.5)
    return B.rounded(S.markov_llr(t, pi, trans, "label"), "act_scam_llr")


MARKOV_SQL = f"""{B.ACTED_SQL}, lab AS (SELECT *, (call_id % 3 = 0)::INT AS label, lag(act) OVER (PARTITION BY call_id ORDER BY turn_index) AS before FROM acted),
  grid AS (SELECT unnest({list(B.ACTS)}) AS act), labels AS (SELECT unnest([0, 1]) AS label),
  f AS (SELECT label, act, count(*) AS n FROM lab WHERE before IS NULL GROUP BY ALL), s AS (SELECT label, before AS act, act AS next_act, count(*) AS n FROM lab WHERE before IS NOT NULL GROUP BY ALL),
  pi AS (SELECT label, act, ln((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY label)) AS log_pi FROM labels CROSS JOIN grid LEFT JOIN f USING (label, act)),
  trans AS (SELECT label, act, next_act, ln((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY label, act)) AS log_a
            FROM labels CROSS JOIN grid CROSS JOIN (SELECT act AS next_act FROM grid) LEFT JOIN s USING (label, act, next_act))"""


def turn_timings(spark, sf):
    t = S.timings(B.turns(spark, sf), "n_tokens")
    return B.rounded(t.select("call_id", "turn_index", "t_start", "t_end"), "t_start", "t_end", to=3)


TIMED_SQL = """timed AS (SELECT *, sum(len_) OVER w + 0.25 * (count(*) OVER w - 1) AS t_end, sum(len_) OVER w + 0.25 * (count(*) OVER w - 1) - len_ AS t_start
  FROM (SELECT *, greatest(0.7, n_tokens / 2.6) AS len_ FROM turns) WINDOW w AS (PARTITION BY call_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING))"""


def intent_pool(spark, sf):
    return B.rounded(R.intent_pool(rule_scores(spark, sf), "score"), "intent_max_turn", "intent_score")


def rule_pool(spark, sf):
    return B.rounded(R.rule_pool(rule_scores(spark, sf), "score"), "intent_score")


def pool_features(spark, sf):
    return B.rounded(R.pool_features(rule_scores(spark, sf), "score"), "top", "mean", "top2", "share_high", "log_n")


def arousal_traces(spark, sf):
    from ..operators.lexicon import lexical_arousal

    t = B.families(spark, sf).where("speaker = 'caller'")
    return t.select("call_id", "turn_index", lexical_arousal("n_tokens").alias("lex"), (F.pmod(F.length("text"), F.lit(101)) / 100.0).alias("aco"))


def pim_score(spark, sf):
    return B.rounded(R.mismatch(arousal_traces(spark, sf), "lex", "aco"), "gap", "corr", "incoherence", "pim")


def timeline_input(spark, sf):
    """Turns with everything that prefix scoring takes."""
    return S.timings(turn_features(spark, sf), "n_tokens")


def turn_features(spark, sf):
    """Turns with what their own text tells."""
    t = B.acted(spark, sf)
    s = rule_scores(spark, sf).select("call_id", "turn_index", "score")
    pressed = B.entity_spans(spark, sf).where(F.col("type").isin("OTP", "PERSONAL_INFO_REQ", "AUTHORITY_CLAIM", "THREAT_DEADLINE")).groupBy("call_id", "turn_index").agg(F.count("*").alias("n_pressed"))
    return t.join(s, ["call_id", "turn_index"]).join(pressed, ["call_id", "turn_index"], "left").na.fill(0, ["n_pressed"])


def prefix_risk(spark, sf):
    """The flagship: risk after every turn, by running aggregates."""
    t = R.prefix_timeline(timeline_input(spark, sf), THRESHOLD)
    return B.rounded(t.select("call_id", "turn_index", "risk", "band", "intent", "slope", "peak", "resist", "dt", "alert"), "risk", "intent", "slope", "peak", "resist", "dt", to=5)


THRESHOLD = 0.38
_N, _X, _Y, _XY, _XX = (f"sum({e}) FILTER (speaker = 'caller') OVER w" for e in ("1", "turn_index", "rank", "turn_index * rank", "turn_index * turn_index"))
TIMELINE_SQL = f"""{RULES_SQL}, acts AS (SELECT *, {B.ACT_SQL} AS act FROM turns), acted AS (SELECT *, {B.RANK_SQL} AS rank FROM acts), {TIMED_SQL},
  tokx AS (SELECT call_id, turn_index, unnest(tokens) AS token FROM turns), kx AS (SELECT call_id, turn_index, {B.KIND_SQL} AS type FROM tokx),
  pr AS (SELECT call_id, turn_index, count(*) AS n_pressed FROM kx WHERE type IN ('OTP', 'PERSONAL_INFO_REQ', 'AUTHORITY_CLAIM', 'THREAT_DEADLINE') GROUP BY ALL),
  input AS (SELECT acted.call_id, acted.turn_index, acted.speaker, act, rank, acted.n_tokens, score, t_end, coalesce(n_pressed, 0) AS n_pressed
            FROM acted JOIN rules USING (call_id, turn_index) JOIN timed USING (call_id, turn_index) LEFT JOIN pr USING (call_id, turn_index)),
  run AS (SELECT *, coalesce(least(greatest(0.6 * max(score) FILTER (speaker = 'caller') OVER w + 0.4 * avg(score) FILTER (speaker = 'caller') OVER w, 0), 1), 0) AS intent,
      CASE WHEN {_N} >= 2 AND {_N} * {_XX} - {_X} * {_X} > 1e-9 THEN least(greatest(({_N} * {_XY} - {_X} * {_Y}) / ({_N} * {_XX} - {_X} * {_X}), -1), 1) ELSE 0 END AS slope,
      coalesce(max(rank) FILTER (speaker = 'caller') OVER w, 0) AS peak, coalesce(avg((act IN ('VICTIM_RESIST', 'VICTIM_QUESTION'))::INT::DOUBLE) FILTER (speaker <> 'caller') OVER w, 0) AS resist,
      100.0 * sum(n_pressed) OVER w / greatest(sum(n_tokens) OVER w, 1) AS pressed, greatest(0, t_end - coalesce(lag(t_end) OVER (PARTITION BY call_id ORDER BY turn_index), 0)) AS dt
    FROM input WINDOW w AS (PARTITION BY call_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING)),
  risky AS (SELECT *, least(greatest(0.30 * intent + 0.14 * least(greatest(pressed / 6.0, 0), 1) + 0.14 * least(greatest(2.0 * slope, 0), 1), 0), 1) AS risk FROM run),
  line AS (SELECT *, risk >= {THRESHOLD} AND sum((risk >= {THRESHOLD})::INT) OVER (PARTITION BY call_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING) = 1 AS alert FROM risky)"""


def alert_edge(spark, sf):
    t = R.prefix_timeline(timeline_input(spark, sf), THRESHOLD)
    return t.where("alert").select("call_id", "turn_index")


def _ttd(spark, sf):
    return R.time_to_detection(R.prefix_timeline(timeline_input(spark, sf), THRESHOLD), THRESHOLD)


def time_to_detection(spark, sf):
    return B.rounded(_ttd(spark, sf), "ttd", to=5)


def ttd_stats(spark, sf):
    s = R.ttd_stats(_ttd(spark, sf), [])
    return B.rounded(s, *[c for c in s.columns if c not in ("detected", "total")], to=5)


def ttd_by_group(spark, sf):
    s = _ttd(spark, sf).withColumn("scenario", F.pmod("call_id", F.lit(4))).where("ttd IS NOT NULL")
    s = staged(s.select("scenario", "ttd"), "ttd")
    return B.rounded(with_percentiles(s.groupBy("scenario").agg(F.count("*").alias("n")), s, ["scenario"], "ttd", {"median": 0.5}), "median", to=5)


TTD_SQL = TIMELINE_SQL + f", ttd AS (SELECT call_id, arg_min(t_end, turn_index) FILTER (risk >= {THRESHOLD}) AS ttd, min(turn_index) FILTER (risk >= {THRESHOLD}) AS ttd_turns FROM line GROUP BY 1)"


def new_entities(spark, sf):
    s = B.entity_spans(spark, sf).withColumn("word", F.lower("token"))
    return R.new_entities(s, ["call_id", "type", "word"], ["turn_index", "tok_start"]).select("call_id", "type", "word", "turn_index", "tok_start")


def span_token_join(spark, sf):
    """Interval join of tokens with entity spans, as an equi-join by turn with a range filter."""
    spans = B.entity_spans(spark, sf).drop("token")
    t = B.flat_tokens(B.turns(spark, sf)).join(spans, ["call_id", "turn_index"]).where("pos >= tok_start AND pos < tok_end")
    return t.groupBy("call_id", "type").agg(F.count("*").alias("n"), F.count_distinct(F.lower("token")).alias("words"))


def span_anti_join(spark, sf):
    """Vocabulary words whose token no entity has taken."""
    t = B.flat_tokens(B.turns(spark, sf)).withColumn("term", F.lower("token")).join(B.vocab(spark), "term")
    taken = B.entity_spans(spark, sf).select("call_id", "turn_index", F.col("tok_start").alias("pos"))
    return t.join(taken, ["call_id", "turn_index", "pos"], "left_anti").groupBy("family", "term").agg(F.count("*").alias("n"))


MODEL = {"coercion_slope": (1.4, 0.0, 0.2), "coercion_peak": (-0.8, 0.5, 0.3), "callee_resist": (0.3, 0.1, 1e-9)}


def contributions(spark, sf):
    return R.linear_contributions(S.coercion(B.acted(spark, sf)), "call_id", MODEL)


def linear_shap(spark, sf):
    return B.rounded(contributions(spark, sf), "value", "contribution")


def top_contributions(spark, sf):
    return B.rounded(R.top_contributions(contributions(spark, sf), "call_id", 2).select("call_id", "feature", "place", "contribution"), "contribution")


SHAP_SQL = COERCION_SQL + ", shap AS (" + " UNION ALL ".join(f"SELECT call_id, '{n}' AS feature, {n} AS value, {w} * ({n} - {m}) / {s if s >= 1e-8 else 1.0} AS contribution FROM co" for n, (w, m, s) in MODEL.items()) + ")"


def feature_reference(spark, sf):
    c = S.coercion(B.acted(spark, sf)).select("coercion_slope", "coercion_peak", "callee_resist")
    long = c.unpivot([], c.columns, "feature", "value")
    return B.rounded(percentiles(long, ["feature"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), "p05", "p50", "p95")


def frames(spark, sf):
    """The embedding table as frames: a signal for each vector, a frame for each number."""
    return B.load(spark, sf, "embeddings").where("vec_id IS NOT NULL").select("vec_id", F.posexplode("embedding").alias("frame", "x")).withColumn("x", F.col("x").cast("double"))


FRAMES_SQL = "frames AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS frame FROM embeddings)"


def delta_regression(spark, sf):
    d = S.delta_regression(frames(spark, sf), "vec_id", "frame", "x").groupBy("vec_id").agg(F.sum("delta").alias("total"), F.max("delta").alias("top"), F.first("frame").isNotNull().alias("some"))
    return B.rounded(d.drop("some"), "total", "top")


def cmvn(spark, sf):
    d = S.normalised(frames(spark, sf), "vec_id", "x").groupBy("vec_id").agg(F.max("cmvn").alias("top"), F.sum(F.col("cmvn") * F.col("cmvn")).alias("energy"))
    return B.rounded(d, "top", "energy")


def context_stack(spark, sf):
    d = S.context_stack(frames(spark, sf), "vec_id", "frame", "x").groupBy("vec_id").agg(F.sum(F.col("context")[0] * F.col("context")[2]).alias("product"))
    return B.rounded(d, "product")


def voiced_runs(spark, sf):
    return S.true_runs(frames(spark, sf).withColumn("on", F.col("x") > 0), "vec_id", "frame", "on", 3)


def moments_pool(spark, sf):
    return B.rounded(S.moments(frames(spark, sf), "vec_id", "x"), "mean", "std", "skew", "kurtosis", to=5)


def cosine_consistency(spark, sf):
    """The mean cosine over all pairs of a label's vectors, from the sum of unit vectors: no pairs."""
    f = frames(spark, sf).join(B.load(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("vec_id")))
    unit = f.withColumn("u", F.col("x") / F.when(norm > 0, norm)).groupBy("label", "frame").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    c = unit.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return B.rounded(c.select("label", F.when(F.col("n") < 2, 1.0).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("consistency")), "consistency")


QUERIES = {f.__name__: f for f in (
    bio_decode, entity_prf, entity_density, coercion_slope, coercion_peak, callee_resist, act_markov_fit, act_llr, turn_timings, intent_pool, rule_pool, pool_features, pim_score, prefix_risk, alert_edge,
    time_to_detection, ttd_stats, ttd_by_group, new_entities, span_token_join, span_anti_join, linear_shap, top_contributions, feature_reference, delta_regression, cmvn, context_stack, voiced_runs, moments_pool, cosine_consistency,
)}
_PRF = "CASE WHEN tp + {x} > 0 THEN tp / (tp + {x}) ELSE 0 END"
_EDGE = "coalesce({f}(x, {n}) OVER w, {e}_value(x) OVER (PARTITION BY vec_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_LAG, _LEAD = (lambda n: _EDGE.format(f="lag", n=n, e="first")), (lambda n: _EDGE.format(f="lead", n=n, e="last"))
_AROUSAL = f"least(greatest(({B.saturated_sql(0.9)}) / (1 + ln(1 + greatest(n_tokens, 1) / 12.0)) / 1.6, 0), 1)"
_MIX = "FROM frames WINDOW w AS (PARTITION BY vec_id ORDER BY frame)"
ORACLES = {
    "bio_decode": f"WITH {TAGS_SQL}, {spans_sql('gold', 'g')} SELECT * FROM g",
    "entity_prf": f"""WITH {TAGS_SQL}, {spans_sql('gold', 'g')}, {spans_sql('pred', 'p')}, b AS (SELECT coalesce(g.type, p.type) AS type, g.seq IS NOT NULL AS ing, p.seq IS NOT NULL AS inp FROM g FULL JOIN p ON g.seq = p.seq AND g.type = p.type AND g.tok_start = p.tok_start AND g.tok_end = p.tok_end),
      c AS (SELECT type, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM (SELECT * FROM b UNION ALL SELECT 'all', ing, inp FROM b) GROUP BY 1)
      SELECT type, tp, fp, fn, round({_PRF.format(x='fp')}, 6) AS precision, round({_PRF.format(x='fn')}, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
    "entity_density": f"WITH {B.SPANS_SQL}, t AS (SELECT call_id, sum(n_tokens) AS n FROM turns GROUP BY 1), c AS (SELECT call_id, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {n}" for t, n in R.ENTITY_FEATURES.items()) + " FROM spans GROUP BY 1) SELECT call_id, " + ", ".join(f"round(100.0 * coalesce({n}, 0) / greatest(n, 1), 6) AS {n}" for n in R.ENTITY_FEATURES.values()) + " FROM t LEFT JOIN c USING (call_id)",
    "coercion_slope": f"WITH {COERCION_SQL} SELECT call_id, round(coercion_slope, 6) AS coercion_slope FROM co",
    "coercion_peak": f"WITH {COERCION_SQL} SELECT call_id, round(coercion_peak, 6) AS coercion_peak, round(coercion_mean, 6) AS coercion_mean, first_pressure_turn, peak_act FROM co",
    "callee_resist": f"WITH {COERCION_SQL} SELECT call_id, round(callee_resist, 6) AS callee_resist FROM co",
    "act_markov_fit": f"WITH {MARKOV_SQL} SELECT label, act, next_act, round(log_a, 6) AS log_a FROM trans UNION ALL SELECT label, '<start>', act, round(log_pi, 6) FROM pi",
    "act_llr": f"WITH {MARKOV_SQL}, v AS (SELECT call_id, CASE WHEN before IS NULL THEN (SELECT sum(CASE WHEN label = 1 THEN log_pi ELSE -log_pi END) FROM pi WHERE pi.act = lab.act) ELSE (SELECT sum(CASE WHEN label = 1 THEN log_a ELSE -log_a END) FROM trans WHERE trans.act = lab.before AND trans.next_act = lab.act) END AS v FROM lab) SELECT call_id, round(least(greatest(sum(v) / count(*), -10), 10), 6) AS act_scam_llr FROM v GROUP BY 1",
    "turn_timings": f"WITH {B.TURNS_SQL}, {TIMED_SQL} SELECT call_id, turn_index, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end FROM timed",
    "intent_pool": f"WITH {RULES_SQL} SELECT call_id, round(coalesce(max(score) FILTER (speaker = 'caller'), 0), 6) AS intent_max_turn, round(least(greatest(0.6 * coalesce(max(score) FILTER (speaker = 'caller'), 0) + 0.4 * coalesce(avg(score) FILTER (speaker = 'caller'), 0), 0), 1), 6) AS intent_score FROM rules GROUP BY 1",
    "rule_pool": f"WITH {RULES_SQL} SELECT call_id, round(0.5 * coalesce(avg(score) FILTER (speaker = 'caller'), 0) + 0.5 * coalesce(max(score) FILTER (speaker = 'caller'), 0), 6) AS intent_score FROM rules GROUP BY 1",
    "pool_features": f"WITH {RULES_SQL} SELECT call_id, round(max(score), 6) AS top, round(avg(score), 6) AS mean, round(list_avg(max(score, 2)), 6) AS top2, round(avg((score > 0.5)::INT), 6) AS share_high, round(ln(1 + count(*)), 6) AS log_n FROM rules GROUP BY 1",
    "pim_score": f"""WITH {B.FAMILIES_SQL}, tr AS (SELECT call_id, {_AROUSAL} AS lex, (length(text) % 101) / 100.0 AS aco FROM families WHERE speaker = 'caller'),
      m AS (SELECT call_id, CASE WHEN sum(lex) > 1e-9 THEN sum(lex * least(greatest(lex - aco, 0), 1)) / sum(lex) ELSE 0 END AS gap, CASE WHEN count(*) >= 3 AND stddev_pop(lex) > 1e-6 AND stddev_pop(aco) > 1e-6 THEN covar_pop(lex, aco) / (stddev_pop(lex) * stddev_pop(aco)) ELSE 0 END AS corr, least(greatest(max(lex), 0), 1) AS p FROM tr GROUP BY 1)
      SELECT call_id, round(gap, 6) AS gap, round(corr, 6) AS corr, round(least(greatest((1 - corr) / 2, 0), 1), 6) AS incoherence, round(least(greatest(0.65 * gap + 0.35 * least(greatest((1 - corr) / 2, 0), 1) * p, 0), 1), 6) AS pim FROM m""",
    "prefix_risk": f"WITH {TIMELINE_SQL} SELECT call_id, turn_index, round(risk, 5) AS risk, CASE WHEN risk < 0.35 THEN 'low' WHEN risk < 0.65 THEN 'elevated' WHEN risk < 0.85 THEN 'high' ELSE 'critical' END AS band, round(intent, 5) AS intent, round(slope, 5) AS slope, round(peak, 5) AS peak, round(resist, 5) AS resist, round(dt, 5) AS dt, alert FROM line",
    "alert_edge": f"WITH {TIMELINE_SQL} SELECT call_id, turn_index FROM line WHERE alert",
    "time_to_detection": f"WITH {TTD_SQL} SELECT call_id, round(ttd, 5) AS ttd, ttd_turns FROM ttd",
    "ttd_stats": f"WITH {TTD_SQL} SELECT count(ttd) AS detected, count(*) AS total, round(count(ttd) / count(*), 5) AS detection_rate, round(quantile_cont(ttd, 0.5), 5) AS median, round(avg(ttd), 5) AS mean, round(quantile_cont(ttd, 0.9), 5) AS p90, round(min(ttd), 5) AS min, round(max(ttd), 5) AS max, round(quantile_cont(ttd_turns::DOUBLE, 0.5), 5) AS median_turns FROM ttd",
    "ttd_by_group": f"WITH {TTD_SQL} SELECT call_id % 4 AS scenario, round(quantile_cont(ttd, 0.5), 5) AS median, count(*) AS n FROM ttd WHERE ttd IS NOT NULL GROUP BY 1",
    "new_entities": f"WITH {B.SPANS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id, type, lower(token) ORDER BY turn_index, tok_start) AS k FROM spans) SELECT call_id, type, lower(token) AS word, turn_index, tok_start FROM r WHERE k = 1",
    "span_token_join": f"WITH {B.SPANS_SQL} SELECT call_id, s.type, count(*) AS n, count(DISTINCT lower(t.token)) AS words FROM tok t JOIN spans s USING (call_id, turn_index) WHERE pos >= tok_start AND pos < tok_end GROUP BY ALL",
    "span_anti_join": f"WITH {B.SPANS_SQL}, {B.VOCAB_SQL} SELECT family, term, count(*) AS n FROM tok t JOIN vocab ON term = lower(token) WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.call_id = t.call_id AND s.turn_index = t.turn_index AND s.tok_start = t.pos) GROUP BY ALL",
    "linear_shap": f"WITH {SHAP_SQL} SELECT call_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM shap",
    "top_contributions": f"WITH {SHAP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY abs(contribution) DESC, feature) AS place FROM shap) SELECT call_id, feature, place, round(contribution, 6) AS contribution FROM r WHERE place <= 2",
    "feature_reference": f"WITH {COERCION_SQL}, u AS (SELECT unnest(['coercion_slope', 'coercion_peak', 'callee_resist']) AS feature, unnest([coercion_slope, coercion_peak, callee_resist]) AS value FROM co) SELECT feature, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM u GROUP BY 1",
    "delta_regression": f"WITH {FRAMES_SQL}, d AS (SELECT vec_id, (({_LEAD(1)} - {_LAG(1)}) + 2 * ({_LEAD(2)} - {_LAG(2)})) / 10 AS delta {_MIX}) SELECT vec_id, round(sum(delta), 6) AS total, round(max(delta), 6) AS top FROM d GROUP BY 1",
    "cmvn": f"WITH {FRAMES_SQL}, d AS (SELECT vec_id, CASE WHEN stddev_pop(x) OVER w > 1e-10 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS c FROM frames WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, round(max(c), 6) AS top, round(sum(c * c), 6) AS energy FROM d GROUP BY 1",
    "context_stack": f"WITH {FRAMES_SQL}, d AS (SELECT vec_id, {_LAG(1)} * {_LEAD(1)} AS p {_MIX}) SELECT vec_id, round(sum(p), 6) AS product FROM d GROUP BY 1",
    "voiced_runs": f"WITH {FRAMES_SQL}, r AS (SELECT *, row_number() OVER w - sum((x > 0)::INT) OVER (PARTITION BY vec_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k {_MIX}) SELECT vec_id, min(frame) AS start, max(frame) + 1 AS \"end\" FROM r WHERE x > 0 GROUP BY vec_id, k HAVING count(*) >= 3",
    "moments_pool": f"WITH {FRAMES_SQL}, m AS (SELECT vec_id, avg(x) AS mean, stddev_pop(x) AS std FROM frames GROUP BY 1) SELECT vec_id, round(any_value(mean), 5) AS mean, round(any_value(std), 5) AS std, round(avg(((x - mean) / std) ** 3), 5) AS skew, round(avg(((x - mean) / std) ** 4) - 3, 5) AS kurtosis FROM frames JOIN m USING (vec_id) GROUP BY 1",
    "cosine_consistency": "SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS consistency FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
}
