"""What the registered queries start from, on Spark and as SQL: turns, tokens, languages, acts, scores.

The given tables are neither annotated nor in the languages of telephone fraud, so vocabularies and
acts are stated here as data: function words of the four languages stand for the vocabulary's
families, and an act is drawn from a text's length and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, lowered, token_language, tokens
from ..operators.lexicon import PRESSURE, family_sums, phrase_hits, vocabulary
from ..schema import ACT_RANK, ACTS, turns_of_conversations

FIRST = {"the", "of", "and", "to", "in", "is", "it", "for", "on", "with", "that", "this", "by", "at", "are", "as"}
SECOND = {"der", "die", "das", "und", "le", "la", "les", "de", "et", "un", "une", "el", "los", "que", "con", "pas"}
UNIVERSAL = {"en", "par"}
PATTERNS = {"en": ["(ing|tion|able|ed)$", "^(th|wh|sh)"], "xx": ["(keit|lich|ung|eau|eux|cion)$", "(sch|que|ll)"]}
LANGS = {"en": FIRST, "xx": SECOND}
VOCABULARY = [
    ("urgency", "the", 0.35), ("urgency", "und", 0.45), ("urgency", "les", 0.55), ("threat", "of", 0.5), ("threat", "mit", 0.6), ("threat", "que", 0.4),
    ("authority", "in", 0.3), ("authority", "der", 0.5), ("authority", "los", 0.4), ("bank", "is", 0.3), ("bank", "die", 0.4), ("bank", "un", 0.5),
    ("payment", "by", 0.5), ("payment", "von", 0.6), ("personal", "with", 0.6), ("personal", "zu", 0.5), ("personal", "par", 0.5),
    ("isolation", "for", 0.4), ("isolation", "nicht", 0.7), ("isolation", "pas", 0.6), ("benign", "that", 0.5), ("benign", "das", 0.5), ("benign", "las", 0.4),
]
SETS = {
    "threat": {"of", "mit", "que"}, "time": {"the", "und"}, "time_unit": {"day"}, "imperative": {"by", "von", "to"}, "sensitive": {"with", "zu", "par"}, "authority": {"in", "der"},
    "first_person": {"and", "die", "on"}, "speak": {"is", "un", "at"}, "negative": {"for", "nicht"}, "secrecy": {"that", "das", "it"}, "negation": {"for", "nicht", "as"}, "conditional": {"this", "con"},
}
ENTITY_WORDS = {"OTP": {"by", "von"}, "AUTHORITY_CLAIM": {"in", "der"}, "THREAT_DEADLINE": {"of", "mit"}, "PAYMENT_HANDLE": {"with"}, "PERSONAL_INFO_REQ": {"for", "par"}, "BANK_ENTITY": {"is", "un"}}


def load(spark: SparkSession, sf_dir: str | dict[str, DataFrame], table: str) -> DataFrame:
    """A table of the folder, or of a mapping of tables (what a stream has brought so far)."""
    return sf_dir[table] if isinstance(sf_dir, dict) else spark.read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns_of_conversations(load(spark, sf_dir, "conversations"))
    return t.withColumn("tokens", tokens("text")).withColumn("n_tokens", F.size("tokens"))


def flat_tokens(t: DataFrame) -> DataFrame:
    return t.select("call_id", "turn_index", "speaker", F.posexplode("tokens").alias("pos", "token"))


def lang(token: Column) -> Column:
    return token_language(token, LANGS, UNIVERSAL, PATTERNS)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_tokens(turns(spark, sf_dir)).withColumn("lang", lang(F.col("token")))


def act_of(length: Column, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTS]), (F.pmod(length + 3 * place, F.lit(len(ACTS))) + 1).cast("int"))


def rank_of(act: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ACT_RANK.items() for x in kv])
    return F.try_element_at(table, act)


def acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("act", act_of(F.length("text"), F.col("turn_index")))
    return t.withColumn("rank", rank_of(F.col("act")))


def vocab(spark: SparkSession) -> DataFrame:
    return vocabulary(spark, VOCABULARY)


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the sums of their vocabulary hits by family."""
    t = turns(spark, sf_dir)
    hits = phrase_hits(t, vocab(spark), ["call_id", "turn_index"])
    out = t.join(family_sums(hits, ["call_id", "turn_index"]), ["call_id", "turn_index"], "left")
    return out.na.fill(0.0, [f"w_{f}" for f in PRESSURE]).na.fill(0, [f"n_{f}" for f in PRESSURE])


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, turn_index, type, tok_start, tok_end) by single words."""
    t = flat_tokens(turns(spark, sf_dir)).withColumn("low", F.lower("token"))
    kind = F
    for k, v in ENTITY_WORDS.items():
        kind = kind.when(F.col("low").isin(*sorted(v)), k)
    return t.withColumn("type", kind).where("type IS NOT NULL").select("call_id", "turn_index", "type", F.col("pos").alias("tok_start"), (F.col("pos") + 1).alias("tok_end"), "token")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, label, score): labelled documents with a deterministic text score."""
    d, y = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    hits = F.regexp_count(F.lower("text"), F.lit("[aeiou]"))
    score = F.round(hits / F.greatest(F.length("text"), F.lit(1)) * 2, 2)
    return y.join(d, "doc_id").select("doc_id", "lang", "source", F.col("toxic").alias("label"), F.col("quality"), score.alias("score"))


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


# ---- the same as SQL


def words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


TURNS_SQL = f"""turns AS (
  SELECT conv_id AS call_id, turn AS turn_index, CASE role WHEN 'assistant' THEN 'caller' WHEN 'user' THEN 'callee' ELSE 'system' END AS speaker, text,
         regexp_extract_all(text, '{TOKEN.replace("'", "''")}') AS tokens, len(regexp_extract_all(text, '{TOKEN.replace("'", "''")}')) AS n_tokens
  FROM conversations)"""
TOKENS_SQL = TURNS_SQL + """, tok AS (
  SELECT call_id, turn_index, speaker, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM turns)"""


def _votes(name: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(lower(token), '{p}') THEN 1 ELSE 0 END" for p in PATTERNS[name])


LANG_SQL = f"""CASE WHEN NOT regexp_matches(lower(token), '^\\p{{L}}+$') THEN 'univ' WHEN lower(token) IN {words(UNIVERSAL)} THEN 'univ'
  WHEN lower(token) IN {words(FIRST)} THEN 'en' WHEN lower(token) IN {words(SECOND)} THEN 'xx'
  WHEN {_votes("en")} > {_votes("xx")} THEN 'en' WHEN {_votes("xx")} > {_votes("en")} THEN 'xx' ELSE 'univ' END"""
TAGGED_SQL = TOKENS_SQL + f", tagged AS (SELECT *, {LANG_SQL} AS lang FROM tok)"
ACT_SQL = "([" + ", ".join(f"'{a}'" for a in ACTS) + f"])[((length(text) + 3 * turn_index) % {len(ACTS)} + 1)::INT]"
RANK_SQL = "CASE act " + " ".join(f"WHEN '{a}' THEN {r}::DOUBLE" for a, r in ACT_RANK.items()) + " END"
ACTED_SQL = TURNS_SQL + f", acts AS (SELECT *, {ACT_SQL} AS act FROM turns), acted AS (SELECT *, {RANK_SQL} AS rank FROM acts)"
VOCAB_SQL = "vocab(family, term, weight) AS (VALUES " + ", ".join(f"('{f}', '{t}', {w}::DOUBLE)" for f, t, w in VOCABULARY) + ")"
HITS_SQL = TURNS_SQL + f", {VOCAB_SQL}" + """, runs AS (SELECT call_id, turn_index, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM turns),
  hits AS (SELECT call_id, turn_index, family, term, weight FROM runs JOIN vocab ON run = term)"""
FAMILIES_SQL = HITS_SQL + ", sums AS (SELECT call_id, turn_index, " + ", ".join(f"coalesce(sum(weight) FILTER (family = '{f}'), 0) AS w_{f}, count(*) FILTER (family = '{f}') AS n_{f}" for f in PRESSURE) + " FROM hits GROUP BY ALL), families AS (SELECT turns.*, " + ", ".join(f"coalesce(w_{f}, 0) AS w_{f}, coalesce(n_{f}, 0) AS n_{f}" for f in PRESSURE) + " FROM turns LEFT JOIN sums USING (call_id, turn_index))"


def saturated_sql(rate: float) -> str:
    return " + ".join(f"({w} * (1 - exp(-{rate} * w_{f})))" for f, w in PRESSURE.items())


KIND_SQL = "CASE " + " ".join(f"WHEN lower(token) IN {words(v)} THEN '{k}'" for k, v in ENTITY_WORDS.items()) + " END"
SPANS_SQL = TOKENS_SQL + f", kinds AS (SELECT *, {KIND_SQL} AS type FROM tok), spans AS (SELECT call_id, turn_index, type, pos AS tok_start, pos + 1 AS tok_end, token FROM kinds WHERE type IS NOT NULL)"
SCORED_SQL = """scored AS (
  SELECT doc_id, lang, source, toxic AS label, quality, round(len(regexp_extract_all(lower(text), '[aeiou]')) / greatest(length(text), 1) * 2, 2) AS score
  FROM labels JOIN documents USING (doc_id))"""
