"""Queries of the text, vocabulary and rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexicon as L
from ..operators import sequences as S
from ..schema import risk_band
from . import base as B


def tokenize_counts(spark, sf):
    return B.turns(spark, sf).select("call_id", "turn_index", "n_tokens")


def document_tokens(spark, sf):
    t = B.load(spark, sf, "documents").select("doc_id", F.explode(X.tokens("text")).alias("token"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(X.is_digit_run(F.col("token"))).alias("digit_runs"), F.count_if(F.col("token").rlike("^[A-Za-z]")).alias("words"))


def lang_tags(spark, sf):
    return B.tagged(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.lower("token")).alias("kinds"))


def mixing(spark, sf):
    t = B.tagged(spark, sf)
    return S.code_mixing(t, "call_id", ["turn_index", "pos"], "en", "xx")


MIX_SQL = B.TAGGED_SQL + """, counts AS (SELECT call_id, count(*) AS n, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'xx') AS b FROM tagged GROUP BY 1),
  pairs AS (SELECT call_id, lag(lang) OVER (PARTITION BY call_id ORDER BY turn_index, pos) AS x, lang AS y FROM tagged WHERE lang <> 'univ'),
  steps AS (SELECT call_id, x, y, count(*) AS c FROM pairs WHERE x IS NOT NULL GROUP BY ALL),
  total AS (SELECT *, c / sum(c) OVER (PARTITION BY call_id) AS p FROM steps),
  per AS (SELECT call_id, coalesce(sum(c) FILTER (x <> y), 0) AS s, -sum(p * log2(p)) / 2 AS e FROM total GROUP BY 1),
  mix AS (SELECT call_id, n AS n_tokens, CASE WHEN a + b > 0 THEN 1 - greatest(a, b) / (a + b) ELSE 0 END AS cmi, coalesce(s, 0)::BIGINT AS switch_points,
          coalesce(s, 0) / greatest(1, a + b - 1) AS switch_rate, coalesce(e, 0) AS switch_entropy FROM counts LEFT JOIN per USING (call_id))"""


def cmi_by_call(spark, sf):
    """The smallest whole query: turns, tokens, languages, mixing and a band."""
    m = mixing(spark, sf)
    return B.rounded(m.select("call_id", "n_tokens", "cmi", risk_band(F.col("cmi")).alias("band")), "cmi")


def switch_points(spark, sf):
    return B.rounded(mixing(spark, sf).select("call_id", "switch_points", "switch_rate"), "switch_rate")


def switch_entropy(spark, sf):
    return B.rounded(mixing(spark, sf).select("call_id", "switch_entropy"), "switch_entropy")


def caller_mixing(spark, sf):
    m = S.code_mixing(B.tagged(spark, sf).where("speaker = 'caller'"), "call_id", ["turn_index", "pos"], "en", "xx")
    return B.rounded(m.select("call_id", "cmi", "switch_points"), "cmi")


def lexicon_hits(spark, sf):
    hits = L.phrase_hits(B.turns(spark, sf), B.vocab(spark), ["call_id", "turn_index"])
    return B.rounded(hits.groupBy("call_id", "turn_index", "family", "term").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "weight")


def urgency_density(spark, sf):
    f = B.families(spark, sf).groupBy("call_id").agg((100.0 * F.sum(F.col("n_urgency") + F.col("n_threat") + F.col("n_isolation")) / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("urgency_density"))
    return B.rounded(f, "urgency_density")


def lexicon_fallback(spark, sf):
    return B.rounded(B.families(spark, sf).select("call_id", "turn_index", L.fallback_score().alias("score")), "score")


def lexical_arousal(spark, sf):
    return B.rounded(B.families(spark, sf).select("call_id", "turn_index", L.lexical_arousal("n_tokens").alias("arousal")), "arousal")


def flagged(spark, sf):
    t = B.turns(spark, sf).withColumn("low", X.lowered(F.col("tokens")))
    return L.construction_flags(t, B.SETS)


def construction_flags(spark, sf):
    return flagged(spark, sf).select("call_id", "turn_index", *L.PATTERN_WEIGHTS)


def rule_scores(spark, sf):
    """Rule scores: the lexicon's words by token, and the constructions."""
    low = F.explode("low").alias("term")
    own = flagged(spark, sf)
    weight = F.create_map(*[F.lit(x) for f, w in L.PRESSURE.items() for x in (f, w)])
    sums = own.select("call_id", "turn_index", low).join(B.vocab(spark), "term").groupBy("call_id", "turn_index").agg(F.sum(F.col("weight") * weight[F.col("family")]).alias("w"))
    scored = own.join(sums, ["call_id", "turn_index"], "left")
    return scored.select("call_id", "turn_index", "speaker", L.rule_score(F.col("n_tokens"), F.coalesce("w", F.lit(0.0))).alias("score"))


def rule_score(spark, sf):
    return B.rounded(rule_scores(spark, sf).select("call_id", "turn_index", "score"), "score")


def _places_sql(name: str) -> str:
    return f"list_filter(range(len(low)), lambda i: list_contains({sorted(B.SETS[name])}, low[i + 1]))"


FLAGS_SQL = B.TURNS_SQL + ", lows AS (SELECT *, list_transform(tokens, lambda x: lower(x)) AS low FROM turns), places AS (SELECT *, " + ", ".join(f"{_places_sql(k)} AS p_{k}" for k in B.SETS) + """ FROM lows),
  clocked AS (SELECT * REPLACE (p_time || list_filter(range(len(low) - 1), lambda i: regexp_matches(low[i + 1], '^[0-9]+$') AND low[i + 2] = 'day') AS p_time) FROM places),
  flags AS (SELECT call_id, turn_index, speaker, n_tokens, low,
    len(list_filter(p_threat, lambda x: len(list_filter(p_time, lambda y: abs(x - y) <= 8)) > 0)) > 0 AS threat_near_time,
    len(list_filter(p_sensitive, lambda x: len(list_filter(p_imperative, lambda y: abs(x - y) <= 5)) > 0)) > 0 AS imperative_sensitive,
    coalesce(list_min(p_first_person) < list_min(p_authority) AND list_max(p_speak) > list_min(p_first_person), false) AS authority_copula,
    len(list_filter(p_negative, lambda i: len(list_filter(p_secrecy, lambda j: abs(i - j) <= 4)) > 0 AND len(list_filter(p_imperative, lambda j: j >= i AND j < i + 4)) > 0)) > 0 AS secrecy_command,
    len(list_filter(p_sensitive, lambda s: len(list_filter(p_negation, lambda g: abs(g - s) <= 5)) > 0 AND coalesce(list_min(p_first_person) < s + 4, false))) > 0 AS never_ask_disclaimer,
    len(list_filter(p_conditional, lambda i: i + 1 < len(low) AND len(list_filter(p_threat, lambda j: j >= i AND j < i + 8)) > 0)) > 0 AS conditional_threat
  FROM clocked)"""
_FLAG_SUM = " + ".join(f"CASE WHEN {k} THEN {w} ELSE 0 END" for k, w in L.PATTERN_WEIGHTS.items())
_PRESS = "CASE family " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in L.PRESSURE.items()) + " END"
RULES_SQL = FLAGS_SQL + f", {B.VOCAB_SQL}, lex AS (SELECT call_id, turn_index, sum(weight * {_PRESS}) AS w FROM (SELECT call_id, turn_index, unnest(low) AS term FROM lows) JOIN vocab USING (term) GROUP BY ALL), rules AS (SELECT call_id, turn_index, speaker, CASE WHEN n_tokens <= 0 THEN 0 ELSE 1 / (1 + exp(-least(greatest(1.10 * (coalesce(w, 0) + {_FLAG_SUM} - 1.40), -40), 40))) END AS score FROM flags LEFT JOIN lex USING (call_id, turn_index))"


def word_shapes(spark, sf):
    t = B.flat_tokens(B.turns(spark, sf)).select(X.word_shape(F.col("token")).alias("shape"))
    return t.groupBy("shape").agg(F.count("*").alias("n"))


def clean_pages(spark, sf):
    return B.load(spark, sf, "pages").select("page_id", F.length(X.clean_markup(F.col("html"))).alias("n_chars"), F.substring(X.clean_markup(F.col("html")), 1, 60).alias("head"))


def token_bigrams(spark, sf):
    t = B.turns(spark, sf).select(F.explode(X.ngrams(X.lowered(F.col("tokens")), 2)).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


def sentence_counts(spark, sf):
    return B.turns(spark, sf).select("call_id", "turn_index", F.size(X.sentences(F.col("text"))).alias("n"))


def squeezed_words(spark, sf):
    t = B.flat_tokens(B.turns(spark, sf)).select(X.canonical(F.col("token"), {"der": "the", "reen": "rin"}, {"rin", "tin"}).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("n"))


def repeat_lengths(spark, sf):
    return B.load(spark, sf, "documents").select("doc_id", F.length(X.collapse_repeats(F.col("text"))).alias("n"))


# Characters of a list c, by place: ``keep`` says which stay. A line break repeats as often as it likes.
X_SQL = "array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: {keep}), lambda i: c[i]), '')"
TWICE = "NOT coalesce(i > 2 AND c[i] <> chr(10) AND c[i] = c[greatest(i - 1, 1)] AND c[i] = c[greatest(i - 2, 1)], false)"
_ONCE = "NOT coalesce(i > 1 AND c[i] <> chr(10) AND c[i] = c[greatest(i - 1, 1)] AND ((i > 2 AND c[i] = c[greatest(i - 2, 1)]) OR c[i] = c[i + 1]), false)"
QUERIES = {
    "tokenize_counts": tokenize_counts, "document_tokens": document_tokens, "lang_tags": lang_tags, "cmi_by_call": cmi_by_call, "switch_points": switch_points, "switch_entropy": switch_entropy,
    "caller_mixing": caller_mixing, "lexicon_hits": lexicon_hits, "urgency_density": urgency_density, "lexicon_fallback": lexicon_fallback, "lexical_arousal": lexical_arousal,
    "construction_flags": construction_flags, "rule_score": rule_score, "word_shapes": word_shapes, "clean_pages": clean_pages, "token_bigrams": token_bigrams, "sentence_counts": sentence_counts,
    "squeezed_words": squeezed_words, "repeat_lengths": repeat_lengths,
}
_P = B.TOKEN.replace("'", "''")
_SHAPE = "regexp_replace(regexp_replace(regexp_replace(token, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&', ' and ', 'g'), '\s+', ' ', 'g'))"
ORACLES = {
    "tokenize_counts": f"WITH {B.TURNS_SQL} SELECT call_id, turn_index, n_tokens FROM turns",
    "document_tokens": f"SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(token, '^[0-9]{{4,}}$')) AS digit_runs, count(*) FILTER (regexp_matches(token, '^[A-Za-z]')) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_P}')) AS token FROM documents) GROUP BY 1",
    "lang_tags": f"WITH {B.TAGGED_SQL} SELECT lang, count(*) AS n, count(DISTINCT lower(token)) AS kinds FROM tagged GROUP BY 1",
    "cmi_by_call": f"WITH {MIX_SQL} SELECT call_id, n_tokens, round(cmi, 6) AS cmi, CASE WHEN cmi < 0.35 THEN 'low' WHEN cmi < 0.65 THEN 'elevated' WHEN cmi < 0.85 THEN 'high' ELSE 'critical' END AS band FROM mix",
    "switch_points": f"WITH {MIX_SQL} SELECT call_id, switch_points, round(switch_rate, 6) AS switch_rate FROM mix",
    "switch_entropy": f"WITH {MIX_SQL} SELECT call_id, round(switch_entropy, 6) AS switch_entropy FROM mix",
    "caller_mixing": f"WITH {MIX_SQL.replace('AS lang FROM tok)', 'AS lang FROM tok WHERE speaker = ' + chr(39) + 'caller' + chr(39) + ')')} SELECT call_id, round(cmi, 6) AS cmi, switch_points FROM mix",
    "lexicon_hits": f"WITH {B.HITS_SQL} SELECT call_id, turn_index, family, term, count(*) AS n, round(sum(weight), 6) AS weight FROM hits GROUP BY ALL",
    "urgency_density": f"WITH {B.FAMILIES_SQL} SELECT call_id, round(100 * sum(n_urgency + n_threat + n_isolation) / greatest(sum(n_tokens), 1), 6) AS urgency_density FROM families GROUP BY 1",
    "lexicon_fallback": f"WITH {B.FAMILIES_SQL}, s AS (SELECT *, {B.saturated_sql(0.8)} AS s FROM families) SELECT call_id, turn_index, round(CASE WHEN s = 0 THEN 0.12 ELSE least(greatest(0.5 + 0.32 * s, 0), 1) END, 6) AS score FROM s",
    "lexical_arousal": f"WITH {B.FAMILIES_SQL} SELECT call_id, turn_index, round(least(greatest(({B.saturated_sql(0.9)}) / (1 + ln(1 + greatest(n_tokens, 1) / 12.0)) / 1.6, 0), 1), 6) AS arousal FROM families",
    "construction_flags": f"WITH {FLAGS_SQL} SELECT call_id, turn_index, {', '.join(L.PATTERN_WEIGHTS)} FROM flags",
    "rule_score": f"WITH {RULES_SQL} SELECT call_id, turn_index, round(score, 6) AS score FROM rules",
    "word_shapes": f"WITH {B.TOKENS_SQL}, s AS (SELECT {_SHAPE} AS shape FROM tok) SELECT regexp_replace(regexp_replace(regexp_replace(shape, 'XXX+', 'XX', 'g'), 'xxx+', 'xx', 'g'), 'ddd+', 'dd', 'g') AS shape, count(*) AS n FROM s GROUP BY 1",
    "clean_pages": f"SELECT page_id, length({_CLEAN}) AS n_chars, substr({_CLEAN}, 1, 60) AS head FROM pages",
    "token_bigrams": f"WITH {B.TURNS_SQL}, g AS (SELECT unnest(list_transform(range(1, len(tokens)), lambda i: lower(tokens[i]) || '_' || lower(tokens[i + 1]))) AS gram FROM turns) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 50",
    # a break is put where the text is split, as SQL has no look-behind
    "sentence_counts": r"WITH s AS (SELECT conv_id AS call_id, turn AS turn_index, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations) SELECT call_id, turn_index, greatest(1, len(list_filter(s, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 2))) AS n FROM s",
    "squeezed_words": f"""WITH {B.TOKENS_SQL}, q AS (SELECT lower(trim(token)) AS t, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(token)), 'aa+', 'a', 'g'), 'ee+', 'i', 'g'), 'oo+', 'u', 'g'), 'ii+', 'i', 'g'), 'uu+', 'u', 'g'), '') AS c FROM tok),
      s AS (SELECT t, {X_SQL.format(keep=_ONCE)} AS s FROM q)
      SELECT CASE WHEN t = 'der' THEN 'the' WHEN t = 'reen' THEN 'rin' WHEN s = 'der' THEN 'the' WHEN s = 'reen' THEN 'rin' WHEN s IN ('rin', 'tin') THEN s ELSE t END AS word, count(*) AS n FROM s GROUP BY 1""",
    "repeat_lengths": f"WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents) SELECT doc_id, length({X_SQL.format(keep=TWICE)})::INT AS n FROM c",
}
