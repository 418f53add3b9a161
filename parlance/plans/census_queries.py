"""The corpus in numbers, and transcripts in another script: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import script as X
from ..functions.mixing import code_mixing
from ..operators import census as N
from ..schema import ACTS, ENTITY_TYPES
from . import base as B

LANGS = ("en", "xx")


def _attributes() -> dict:
    """What the given conversations say of themselves stands for the annotation of calls."""
    c, scam = F.col, F.col("peak") >= 0.95
    digest = F.md5(F.col("call_id").cast("string").cast("binary"))
    return {
        "scam": scam, "scenario": F.lower("first_act"), "cell": F.concat(F.when(scam, "scam").otherwise("benign"), F.lit("_x_"), F.when(c("tokens") % 2 == 0, "real").otherwise("synthetic")),
        "split": F.when(F.substring(digest, 1, 1) < "b", "train").when(F.substring(digest, 1, 1) < "d", "dev").otherwise("test"), "speaker": F.concat(F.lit("spk_"), F.substring(digest, 1, 2)),
        "hard_negative": ~scam & (c("peak") >= 0.5), "mild_scam": scam & (c("coercion") < 0.3),
    }


def corpus_census(spark, sf):
    """All measures of a corpus by one reading of conversations."""
    kind = lambda w: F.coalesce(*[F.when(F.lower(w).isin(*sorted(v)), k) for k, v in B.ENTITY_WORDS.items()])
    t = B.acted(spark, sf).withColumn("lang", F.transform("tokens", B.lang)).withColumn("type", F.transform("tokens", kind))
    return N.census(N.call_sums(t, LANGS), LANGS, **_attributes())


#: Words that stay and spellings that are pinned: parameters, here some of the given tables' frequent words.
KEEP = {"account", "bank", "code", "data", "the", "and", "of"}
PINNED = {"der": "der", "mein": "meM", "und": "uND", "main": "maiM"}


def devanagari_texts(spark, sf):
    """Whole documents in another script: the digest of each, and how many of its characters are new."""
    d = B.load(spark, sf, "documents").select("doc_id", X.to_devanagari(F.col("text"), KEEP, PINNED).alias("said"))
    return d.select("doc_id", F.length("said").alias("n_chars"), F.regexp_count("said", F.lit("[\u0900-\u097F]")).alias("n_written"), F.md5(F.col("said").cast("binary")).alias("digest"))


def turn_mixing(spark, sf):
    """Code mixing of every turn; tokens of the entity words are tagged."""
    words = sorted({w for v in B.ENTITY_WORDS.values() for w in v})
    t = B.turns(spark, sf).withColumn("lang", F.transform("tokens", B.lang)).withColumn("bio", F.transform("tokens", lambda w: F.when(F.lower(w).isin(*words), "B-X").otherwise("O")))
    t = t.select("call_id", "turn_index", code_mixing(F.col("tokens"), F.col("lang"), F.col("bio"), *LANGS).alias("m")).select("call_id", "turn_index", "m.*")
    return B.rounded(t, *t.columns[3:])


QUERIES = {f.__name__: f for f in (corpus_census, devanagari_texts, turn_mixing)}

_TYPED = ", ".join(f"count(*) FILTER (type = '{t}') AS type_{t}" for t in ENTITY_TYPES)
_pairs = lambda prefix, names: f"unnest({list(names)}) AS key, unnest([{', '.join(f'sum({prefix}_{n})' for n in names)}]) AS value"
_ACTED = B.ACTED_SQL.replace(B.TURNS_SQL, "").lstrip(", ")
_map = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
_spelt = "w"
for _a, _b in X.SPELLINGS:
    _spelt = f"replace({_spelt}, '{_a}', '{_b}')"
_is = lambda u, names: f"coalesce({u} IN ({', '.join(repr(n) for n in names)}), false)"
_WRITTEN = f"""CASE WHEN {_is('u[i]', X.CONSONANTS)} THEN map_extract({_map(X.CONSONANTS)}, u[i])[1] || CASE WHEN {_is('u[i + 1]', X.VOWELS)} THEN '' ELSE '{X.VIRAMA}' END
  WHEN {_is('u[i]', X.VOWELS)} THEN CASE WHEN i > 1 AND {_is('u[greatest(i - 1, 1)]', X.CONSONANTS)} THEN map_extract({_map({k: v for k, (_, v) in X.VOWELS.items()})}, u[i])[1] ELSE map_extract({_map({k: v for k, (v, _) in X.VOWELS.items()})}, u[i])[1] END
  ELSE coalesce(map_extract({_map(X.SIGNS)}, u[i])[1], u[i]) END"""
ORACLES = {
    "turn_mixing": f"""WITH {B.TAGGED_SQL}, c AS (SELECT call_id, turn_index, count(*) AS n, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'xx') AS b, count(*) FILTER (lang = 'univ') AS u, count(*) FILTER (lang = 'en' AND {B.KIND_SQL} IS NOT NULL) AS ea, count(*) FILTER (lang = 'xx' AND {B.KIND_SQL} IS NOT NULL) AS eb FROM tagged GROUP BY ALL),
      s AS (SELECT call_id, turn_index, count(*) FILTER (x <> lang) AS s FROM (SELECT call_id, turn_index, lang, lag(lang) OVER (PARTITION BY call_id, turn_index ORDER BY pos) AS x FROM tagged WHERE lang <> 'univ') GROUP BY ALL)
      SELECT call_id, turn_index, coalesce(n, 0)::DOUBLE AS n_tokens, round(CASE WHEN a + b > 0 THEN (a + b - greatest(a, b)) / (a + b) ELSE 0 END, 6) AS cmi, round(coalesce(a / n, 0), 6) AS first_ratio, round(coalesce(b / n, 0), 6) AS second_ratio, round(coalesce(u / n, 0), 6) AS univ_ratio,
        round(coalesce(s / greatest(a + b - 1, 1), 0), 6) AS switch_rate, coalesce(ea + eb, 0)::DOUBLE AS ent_tokens, round(CASE WHEN ea + eb > 0 THEN eb / (ea + eb) ELSE 0 END, 6) AS ent_lang_align FROM turns LEFT JOIN c USING (call_id, turn_index) LEFT JOIN s USING (call_id, turn_index)""",
    "devanagari_texts": f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ts FROM documents),
      f AS (SELECT DISTINCT unnest(ts) AS token FROM t), c AS (SELECT token, lower(regexp_replace(token, '^[{X.MARKS}]+|[{X.MARKS}]+$', '', 'g')) AS w FROM f),
      s AS (SELECT token, w, {_spelt} AS x FROM c WHERE regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN {B.words(KEEP)}),
      i AS (SELECT token, regexp_extract_all(coalesce(map_extract({_map(PINNED)}, w)[1], CASE WHEN ends_with(x, 'a') THEN left(x, -1) || 'A' WHEN NOT regexp_matches(x, '[{X.LONG_ENDS}]$') THEN x || 'a' ELSE x END), '{X.UNIT}') AS u FROM s),
      m AS (SELECT token, array_to_string(list_transform(range(1, len(u) + 1), lambda i: {_WRITTEN}), '') || regexp_replace(token, '[^{X.MARKS}]', '', 'g') AS said FROM i),
      p AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM t), j AS (SELECT doc_id, string_agg(coalesce(m.said, p.token), ' ' ORDER BY pos) AS said FROM p LEFT JOIN m USING (token) GROUP BY 1),
      o AS (SELECT doc_id, CASE WHEN ts IS NOT NULL THEN coalesce(said, '') END AS said FROM t LEFT JOIN j USING (doc_id))
      SELECT doc_id, length(said) AS n_chars, len(regexp_extract_all(said, '[\\x{{0900}}-\\x{{097F}}]')) AS n_written, md5(said) AS digest FROM o""",
    "corpus_census": f"""WITH {B.TAGGED_SQL}, {_ACTED}, kinds AS (SELECT *, {B.KIND_SQL} AS type FROM tagged),
      tk AS (SELECT call_id, count(*) FILTER (lang = 'en') AS lang_en, count(*) FILTER (lang = 'xx') AS lang_xx, count(*) FILTER (lang = 'univ') AS lang_univ, count(*) FILTER (lang = 'en' AND type IS NOT NULL) AS in_en, count(*) FILTER (lang = 'xx' AND type IS NOT NULL) AS in_xx, {_TYPED} FROM kinds GROUP BY 1),
      sw AS (SELECT call_id, count(*) FILTER (x <> lang) AS switches FROM (SELECT call_id, lang, lag(lang) OVER (PARTITION BY call_id ORDER BY turn_index, pos) AS x FROM tagged WHERE lang <> 'univ') GROUP BY 1),
      tu AS (SELECT call_id, count(*) AS turns, sum(n_tokens) AS tokens, sum(greatest(0.7::DOUBLE, n_tokens / 2.6::DOUBLE)) + 0.25 * (count(*) - 1) AS seconds, avg(rank) AS coercion, max(rank) AS peak, arg_min(act, turn_index) AS first_act, {', '.join(f"count(*) FILTER (act = '{a}') AS act_{a}" for a in ACTS)} FROM acted GROUP BY 1),
      c AS (SELECT *, coalesce(switches, 0) AS s, peak >= 0.95 AS scam, CASE WHEN lang_en + lang_xx > 0 THEN 1 - greatest(lang_en, lang_xx) / (lang_en + lang_xx) ELSE 0 END AS cmi, md5(call_id::VARCHAR) AS h FROM tu LEFT JOIN tk USING (call_id) LEFT JOIN sw USING (call_id)),
      d AS (SELECT *, CASE WHEN scam THEN 'scam' ELSE 'benign' END AS class, CASE WHEN scam THEN 'scam' ELSE 'benign' END || '_x_' || CASE WHEN tokens % 2 = 0 THEN 'real' ELSE 'synthetic' END AS cell, CASE WHEN h[1] < 'b' THEN 'train' WHEN h[1] < 'd' THEN 'dev' ELSE 'test' END AS split, h[1:2] AS speaker, lower(first_act) AS scenario FROM c),
      k AS (SELECT unnest(['scam', 'benign']) AS class), bc AS (SELECT k.class, avg(coercion) AS co, avg(cmi) AS cmi, sum(s) AS s, sum(lang_en) AS en, sum(lang_en + lang_xx) AS n, sum(in_en) AS ien, sum(in_en + in_xx) AS ent FROM k LEFT JOIN d USING (class) GROUP BY 1),
      m AS (SELECT unnest(['n_calls', 'n_turns', 'n_tokens', 'n_entities', 'n_scam', 'n_benign', 'n_hard_negatives', 'n_mild_scams', 'mean_cmi', 'switch_points', 'mean_turns_per_call', 'mean_tokens_per_turn', 'mean_duration_s', 'total_duration_s']) AS measure, '' AS key,
          unnest([count(*)::DOUBLE, sum(turns), sum(tokens), sum({' + '.join(f'type_{t}' for t in ENTITY_TYPES)}), count(*) FILTER (scam), count(*) FILTER (NOT scam), count(*) FILTER (NOT scam AND peak >= 0.5), count(*) FILTER (scam AND coercion < 0.3), avg(cmi), sum(s), avg(turns), sum(tokens) / sum(turns), avg(seconds), sum(seconds)]) AS value FROM d
        UNION ALL SELECT 'entities', {_pairs('type', ENTITY_TYPES)} FROM d UNION ALL SELECT 'entities_per_type', {_pairs('type', ENTITY_TYPES)} FROM d
        UNION ALL SELECT * FROM (SELECT 'acts' AS measure, {_pairs('act', ACTS)} FROM d) WHERE value > 0 UNION ALL SELECT * FROM (SELECT 'lang_tokens' AS measure, {_pairs('lang', ('en', 'xx', 'univ'))} FROM d) WHERE value > 0
        UNION ALL SELECT 'scenarios', scenario, count(*) FROM d GROUP BY 2 UNION ALL SELECT DISTINCT class || '_scenarios', scenario, 1 FROM d
        UNION ALL SELECT 'cells', cell, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'splits', split, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'cells_by_split', split || '/' || cell, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'speakers_per_split', split, count(DISTINCT speaker) FROM d GROUP BY 2
        UNION ALL SELECT unnest(['mean_coercion', 'cmi_by_class.cmi', 'cmi_by_class.switch_rate', 'cmi_by_class.en_ratio', 'cmi_by_class.ent_lang_align', 'cmi_by_class.n_entity_tokens']), class, unnest([coalesce(co, 0)::DOUBLE, coalesce(cmi, 0), CASE WHEN n > 0 THEN 100 * s / n ELSE 0 END, CASE WHEN n > 0 THEN en / n ELSE 0 END, CASE WHEN ent > 0 THEN ien / ent ELSE 0 END, coalesce(ent, 0)]) FROM bc)
      SELECT measure, key, CASE WHEN measure IN ({', '.join(repr(x) for x in N.PLACES)}) THEN round(value, 3) ELSE round(value, 4) END AS value FROM m""",
}
