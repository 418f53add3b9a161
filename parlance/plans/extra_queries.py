"""Queries of the fallback scores, feature vectors and call files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk as R
from ..schema import FEATURES, calls_of_turns, turns_of
from ..sources import transcripts as T
from . import base as B

_MEASURED = {"jitter": 0.02, "shimmer": 0.1, "spec_flatness_var": 0.005, "hnr": 30.0, "spk_consistency": 0.3}


def measured(spark, sf):
    """Five voice measurements from a vector's first numbers; every ninth is missing."""
    e = B.load(spark, sf, "embeddings")
    cells = [(F.abs(F.col("embedding")[k]).cast("double") * scale).alias(n) for k, (n, scale) in enumerate(_MEASURED.items())]
    return e.select("vec_id", *cells).withColumn("jitter", F.when(F.col("vec_id") % 9 == 0, None).otherwise(F.col("jitter")))


def heuristic_voice(spark, sf):
    return B.rounded(measured(spark, sf).select("vec_id", R.heuristic_voice().alias("raw")), "raw")


def fallback_risk(spark, sf):
    m = measured(spark, sf).select("vec_id", F.col("jitter").alias("intent_score"), F.col("shimmer").alias("as_score"), F.col("hnr").alias("ent_otp"), (F.col("spk_consistency") - 0.01).alias("coercion_slope"))
    cols = {c: F.col(c) for c in m.columns if c != "vec_id"}
    return B.rounded(m.select("vec_id", R.fallback_risk(cols).alias("risk")), "risk", to=5)


def feature_vector(spark, sf):
    """The late-fusion arm of 17 features, summed: absent ones count as 0."""
    m = measured(spark, sf).withColumn("pim", F.lit(5.0))
    v = R.feature_vector(m, "vec_id", "late_fusion")
    return B.rounded(v.select("vec_id", sum((F.col(c) for c in v.columns if c != "vec_id"), F.lit(0.0)).alias("total"), F.lit(len(v.columns) - 1).alias("n")), "total")


def upload_turns(spark, sf):
    """Pasted transcripts with a known length: turns share the time."""
    d = B.load(spark, sf, "documents").select("doc_id", F.concat(F.lit("customer: "), F.regexp_replace("text", "[\r:]", " ")).alias("t"), (F.col("n_chars") / 7.0).alias("s"))
    t = T.manual_turns(d, "doc_id", "t", callees=("callee", "victim", "customer"), seconds="s")
    return B.rounded(t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "callee").alias("callee"), F.max("t_end").alias("t_end"), F.avg("t_start").alias("mean_start")), "t_end", "mean_start", to=4)


def sidecar_stems(spark, sf):
    p = B.load(spark, sf, "documents").select(F.concat(F.lit("a/b/rec"), F.pmod("doc_id", F.lit(30)).cast("string"), F.element_at(F.array(F.lit(""), F.lit("_ulaw"), F.lit("_gsm_noisy"), F.lit("_x")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")), F.lit(".wav")).alias("p"))
    return p.groupBy(T.sidecar_stem(F.col("p")).alias("stem")).agg(F.count("*").alias("n"))


def nested_calls(spark, sf):
    """Turns to nested calls and back to turns."""
    t = B.acted(spark, sf).withColumn("split", F.when(F.col("call_id") % 2 == 0, "train").otherwise("test"))
    calls = calls_of_turns(t, "split")
    flat = turns_of(calls).join(calls.select("call_id", "split"), "call_id")
    return flat.groupBy("call_id", "split").agg(F.count("*").alias("turns"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size("bio")).alias("bio"), F.max_by("act", "turn_index").alias("last_act"))


QUERIES = {f.__name__: f for f in (heuristic_voice, fallback_risk, feature_vector, upload_turns, sidecar_stems, nested_calls)}
_VALUES = ", ".join(f"abs(embedding[{k + 1}])::DOUBLE * {s} AS {n}" for k, (n, s) in enumerate(_MEASURED.items()))
_M = f"m AS (SELECT * REPLACE (CASE WHEN vec_id % 9 = 0 THEN NULL ELSE jitter END AS jitter) FROM (SELECT vec_id, {_VALUES} FROM embeddings))"
_c = lambda e: f"least(greatest({e}, -2), 2)"
_r = lambda n, ref: _c(f"ln(greatest({ref} / greatest(coalesce({n}, 0), 1e-6), 1e-6))")
_RAW = f"1.10 * {_r('jitter', 0.008)} + 0.90 * {_r('shimmer', 0.045)} + 0.35 * {_r('spec_flatness_var', 0.0022)} + 0.55 * {_c('(coalesce(hnr, 0) - 13) / 6')} + 0.45 * {_c('coalesce(spk_consistency, 0) / 0.1')}"
MEASURED_SQL = f"{_M}, raws AS (SELECT *, {_RAW} AS raw FROM m)"
ORACLES = {
    "heuristic_voice": f"WITH {MEASURED_SQL} SELECT vec_id, round(raw, 6) AS raw FROM raws",
    "fallback_risk": f"WITH {_M} SELECT vec_id, round(least(greatest(0.30 * coalesce(jitter, 0) + 0.22 * shimmer + 0.14 * least(greatest(hnr / 6.0, 0), 1) + 0.14 * least(greatest(2.0 * (spk_consistency - 0.01), 0), 1), 0), 1), 5) AS risk FROM m",
    "feature_vector": f"WITH {_M} SELECT vec_id, round(coalesce(jitter, 0) + shimmer + spec_flatness_var + hnr + spk_consistency, 6) AS total, {sum(g in ('voice', 'intent') for _, g, _ in FEATURES)} AS n FROM m",
    "upload_turns": r"""WITH l AS (SELECT doc_id, n_chars / 7.0 AS s, list_filter(list_transform(string_split('customer: ' || regexp_replace(text, '[\r:]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
      t AS (SELECT doc_id, s, len(l) AS n, unnest(range(len(l))) AS i, unnest(l) AS line FROM l)
      SELECT doc_id, count(*) AS n, count(*) FILTER (starts_with(line, 'customer:')) AS callee, round(max((i + 1) * (s / n)), 4) AS t_end, round(avg(i * (s / n)), 4) AS mean_start FROM t GROUP BY 1""",
    "sidecar_stems": "SELECT 'rec' || doc_id % 30 || CASE WHEN doc_id % 4 = 3 THEN '_x' ELSE '' END AS stem, count(*) AS n FROM documents GROUP BY 1",
    "nested_calls": f"WITH {B.ACTED_SQL} SELECT call_id, CASE WHEN call_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS turns, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT AS bio, arg_max(act, turn_index) AS last_act FROM acted GROUP BY ALL",
}
