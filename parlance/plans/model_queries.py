"""Queries of the models, edits and the planner. What SQL can't express is tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits
from ..functions import text as X
from ..operators import generate as G
from ..operators import modelling as M
from ..operators import pos
from . import base as B
from .text_queries import TWICE, X_SQL


def wer(spark, sf):
    """Each benchmark item against itself without its every seventh word."""
    b = B.load(spark, sf, "benchmark").withColumn("hyp", F.array_join(F.filter(F.split(F.trim("text"), r"\s+"), lambda w, i: i % 7 != 3), " "))
    return b.select("item_id", edits.word_errors("text", "hyp").alias("e")).select("item_id", "e.*")


def wer_corpus(spark, sf):
    w = wer(spark, sf)
    return B.rounded(w.agg((F.sum(F.col("sub") + F.col("del") + F.col("ins")) / F.sum("n")).alias("corpus"), F.avg("wer").alias("mean")), "corpus", "mean")


def wer_shuffled(spark, sf):
    """Each benchmark item against the item whose id follows, by whole texts; the spelling is squeezed."""
    b = B.load(spark, sf, "benchmark")
    pair = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp")), "item_id")
    canon = lambda w: X.canonical(w, {"der": "the"}, {"tin"})
    return pair.select("item_id", edits.word_errors("text", "hyp", canon).alias("e")).select("item_id", "e.*")


def token_spans(spark, sf):
    t = B.turns(spark, sf).select("call_id", "turn_index", F.explode(edits.token_spans("text")).alias("s"))
    return t.groupBy("call_id").agg(F.count("*").alias("n"), F.max("s.end").alias("last"), F.sum("s.start").alias("starts"), F.count_if(F.col("s.end") - F.col("s.start") == F.length("s.token")).alias("whole"))


def normalize_text(spark, sf):
    return B.turns(spark, sf).select("call_id", "turn_index", edits.for_match(edits.normalise("text")).alias("text"))


def normalized_tokens(spark, sf):
    """Tokens by their spelling without marks and long repeats; none is lost."""
    t = B.turns(spark, sf).select(F.size("tokens").alias("n"), edits.normalise_tokens("tokens").alias("spelt"))
    return t.where(F.size("spelt") == F.col("n")).select(F.explode("spelt").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tfidf_intent(spark, sf):
    """Toxic labels as the intent of documents, scored by term weights."""
    d = B.load(spark, sf, "documents").select("doc_id", "text")
    rows = d.join(B.load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    model = M.train_intent(rows, "text", "label", "doc_id", sample=400)
    return M.score_intent(rows, model).select("doc_id", "label", F.round("intent", 6).alias("intent"))


def crf_tags(spark, sf):
    """Tags of all turns, those without a token too; only the tagger's sample is of turns of 1 to 60 tokens."""
    t = B.turns(spark, sf).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    low = F.transform("tokens", lambda w: F.when(F.lower(w).isin("the", "der", "le"), "B-X").otherwise("O"))
    t = t.withColumn("bio", low)
    model = M.train_tagger(t.where("n_tokens BETWEEN 1 AND 60"), ["O", "B-X", "I-X"], sample=60, steps=8)
    return M.tag(t, model).select("call_id", "turn_index", F.size("predicted").alias("n"), F.size(F.filter(F.zip_with("predicted", "bio", lambda a, b: a == b), lambda x: x)).alias("right"))


def pos_tags(spark, sf):
    t = B.flat_tokens(B.turns(spark, sf)).withColumn("tag", pos.pos_tag(F.col("token"), pos.CLOSED, {"bank": "NOUN"}))
    return pos.distribution(t)


def call_plan(spark, sf):
    return G.plan(spark, 120, seed=7)


def generated_calls(spark, sf):
    return G.generate(G.plan(spark, 24, seed=7)).select("call_id", "label_scam", "scenario", "split", F.size("turns").alias("n_turns"))


QUERIES = {f.__name__: f for f in (wer, wer_corpus, wer_shuffled, token_spans, normalize_text, normalized_tokens, tfidf_intent, crf_tags, pos_tags, call_plan, generated_calls)}
_POS = "CASE WHEN NOT regexp_matches(token, '[A-Za-z0-9]') THEN 'PUNCT' WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' " + " ".join(f"WHEN lower(token) IN {B.words(w)} THEN '{k}'" for k, w in pos.CLOSED.items()) + " WHEN lower(token) = 'bank' THEN 'NOUN' " + " ".join(f"WHEN regexp_matches(lower(token), '{p}') THEN '{k}'" for p, k in pos.SUFFIXES) + " WHEN regexp_matches(token, '^[A-Z][a-z]') THEN 'PROPN' ELSE 'NOUN' END"
_T = X.TOKEN.replace("'", "''")
_WORDS = "len(list_filter(regexp_extract_all(lower({text}), '" + _T + r"'), lambda t: regexp_matches(t, '^[\p{{L}}\p{{N}}]+$')))"
# the hypothesis is part of the reference, so nothing but deletions is cheapest
_WER = r"s AS (SELECT item_id, text, string_split_regex(trim(text), '\s+') AS l FROM benchmark), h AS (SELECT item_id, text, array_to_string(list_transform(list_filter(range(len(l)), lambda i: i % 7 <> 3), lambda i: l[i + 1]), ' ') AS hyp FROM s), w AS (SELECT item_id, " + _WORDS.format(text="text") + " AS n, " + _WORDS.format(text="hyp") + " AS m FROM h)"
ORACLES = {
    "pos_tags": f"WITH {B.TOKENS_SQL}, t AS (SELECT {_POS} AS tag FROM tok) SELECT tag, coalesce(n, 0) AS n FROM (SELECT unnest({list(pos.TAGS)}) AS tag) LEFT JOIN (SELECT tag, count(*) AS n FROM t GROUP BY 1) USING (tag)",
    "wer": f"WITH {_WER} SELECT item_id, 0 AS sub, n - m AS del, 0 AS ins, n, (n - m) / n AS wer FROM w",
    "wer_corpus": f"WITH {_WER} SELECT round(sum(n - m) / sum(n), 6) AS corpus, round(avg((n - m) / n), 6) AS mean FROM w",
    # between the tokens lies white space alone, so running sums of both are the tokens' places
    "token_spans": rf"""WITH p AS (SELECT conv_id AS call_id, turn, unnest(regexp_extract_all(text, '\s+|{_T}')) AS piece, generate_subscripts(regexp_extract_all(text, '\s+|{_T}'), 1) AS k FROM conversations),
      s AS (SELECT call_id, piece, sum(length(piece)) OVER (PARTITION BY call_id, turn ORDER BY k) AS e FROM p)
      SELECT call_id, count(*) AS n, max(e)::INT AS last, sum(e - length(piece))::BIGINT AS starts, count(*) AS whole FROM s WHERE NOT regexp_matches(piece, '^\s') GROUP BY 1""",
    "normalize_text": rf"WITH c AS (SELECT conv_id AS call_id, turn AS turn_index, string_split(lower(strip_accents(text)), '') AS c FROM conversations) SELECT call_id, turn_index, trim(regexp_replace(regexp_replace({X_SQL.format(keep=TWICE)}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM c",
    "normalized_tokens": f"WITH {B.TOKENS_SQL}, c AS (SELECT string_split(lower(strip_accents(token)), '') AS c FROM tok) SELECT {X_SQL.format(keep=TWICE)} AS token, count(*) AS n FROM c GROUP BY 1",
}
