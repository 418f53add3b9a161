"""Queries of what reports are made of: top rows, thinned curves, grids, ladders, checks, sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audio as A
from ..operators import corpus as C
from ..operators import generate as G
from ..operators import lexicon as L
from ..operators import metrics as M
from ..operators import modelling as D
from ..operators import pos as W
from ..operators import reasons as E
from ..operators import reports as P
from ..operators import risk as R
from ..operators import sequences as S
from ..sources import transcripts as T
from . import base as B
from .act_queries import ORACLES as ACT_ORACLES
from .act_queries import reasons_rows
from .extra_queries import MEASURED_SQL, measured
from .metric_queries import ARMS_SQL, arms, auc_sql, curve_sql, rates_sql
from .sequence_queries import ORACLES as SEQUENCE_ORACLES
from .sequence_queries import SHAP_SQL, TAGS_SQL, contributions, frames, pool_features, spans_sql, tags
from .sequence_queries import entity_density as density
from .text_queries import MIX_SQL, mixing


def entity_tokens(spark, sf):
    """Tokens with their language and whether a word list makes them an entity."""
    words = sorted(w for v in B.ENTITY_WORDS.values() for w in v)
    return B.tagged(spark, sf).withColumn("entity", F.lower("token").isin(*words))


_ENTITY = "lower(token) IN " + B.words({w for v in B.ENTITY_WORDS.values() for w in v})


def labels_of_calls(spark, sf):
    return B.turns(spark, sf).select("call_id").distinct().withColumn("label", F.pmod("call_id", F.lit(2)).cast("int"))


def mixing_by_class(spark, sf):
    out = P.mixing_by_class(entity_tokens(spark, sf), mixing(spark, sf), labels_of_calls(spark, sf), "call_id", "en", "xx")
    return B.rounded(out, "cmi", "switch_rate", "second_ratio", "ent_lang_align", to=4)


def entity_alignment(spark, sf):
    return B.rounded(P.entity_alignment(entity_tokens(spark, sf), "call_id", "en", "xx"), "ent_lang_align")


def antispoof_grid(spark, sf):
    """Every score as if by two feature sets and two models, under three codecs and one without any score."""
    d = B.scored_documents(spark, sf)
    cells = [(fs, m, c) for fs in ("lfcc", "mfcc") for m in ("gbm", "gmm") for c in ("clean", "ulaw", "gsm", "lost")]
    grid = F.array(*[F.struct(F.lit(a).alias("features"), F.lit(b).alias("model"), F.lit(c).alias("codec")) for a, b, c in cells])
    x = d.select("doc_id", "label", "score", F.explode(grid).alias("g")).select("doc_id", "label", "score", "g.*")
    turned = F.when(F.col("features") == "mfcc", 1 - F.col("score")).otherwise(F.col("score"))
    loud = F.when(F.col("codec") == "ulaw", F.round(turned * 0.5, 4)).when((F.col("codec") == "gsm") & (F.pmod("doc_id", F.lit(3)) == 0), F.lit(float("nan"))).when(F.col("codec") == "lost", F.lit(float("nan"))).otherwise(turned)
    x = x.withColumn("score", loud).where((F.col("model") == "gmm") | (F.col("label") == 1) | (F.col("codec") != "clean"))
    return B.rounded(P.detection_grid(x, ["features", "model", "codec"]), "eer", "min_tdcf", to=4)


def antispoof_table(spark, sf):
    """The grid's equal error rates with a column for each codec."""
    return P.by_condition(antispoof_grid(spark, sf), ["features", "model"], "codec", ["clean", "ulaw", "gsm", "lost"], "eer")


_GRID = f"""{B.SCORED_SQL}, x AS (SELECT doc_id, label, features, model, codec, CASE codec WHEN 'ulaw' THEN round(t * 0.5, 4) WHEN 'gsm' THEN CASE WHEN doc_id % 3 = 0 THEN NULL ELSE t END WHEN 'lost' THEN NULL ELSE t END AS score
    FROM (SELECT *, CASE WHEN features = 'mfcc' THEN 1 - score ELSE score END AS t FROM scored, (SELECT unnest(['lfcc', 'mfcc']) AS features), (SELECT unnest(['gbm', 'gmm']) AS model), (SELECT unnest(['clean', 'ulaw', 'gsm', 'lost']) AS codec)) WHERE model = 'gmm' OR label = 1 OR codec <> 'clean'),
  usable AS (SELECT *, features || model || codec AS cell FROM x WHERE score IS NOT NULL), {curve_sql('usable', 'cell')},
  cost AS (SELECT cell, min(0.05 * fnr + 9.5 * fpr) / 0.05 AS min_tdcf FROM curve GROUP BY 1),
  grid AS (SELECT features, model, codec, n, round(eer, 4) AS eer, CASE WHEN eer IS NOT NULL THEN round(min_tdcf, 4) END AS min_tdcf FROM (SELECT features, model, codec, features || model || codec AS cell, count(*) AS n FROM x GROUP BY ALL) LEFT JOIN eer USING (cell) LEFT JOIN cost USING (cell))"""


def intent_by_model(spark, sf):
    return B.rounded(M.confusion(arms(spark, sf), ["arm"], 0.65), "accuracy", "precision", "recall", "f1")


def tagger_grid(spark, sf):
    """Two taggers on the words as given and as heard, where every third sequence has lost a word."""
    t = tags(spark, sf).withColumn("late", F.when(F.col("pos") % 7 == 0, "O").otherwise(F.col("gold")))
    tagger = F.array(*[F.struct(F.lit(n).alias("tagger"), F.col(c).alias("tag")) for n, c in (("rules", "pred"), ("lists", "late"))])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("tag")))), lambda x: x["tag"])
    gold = t.groupBy("seq").agg(ordered("gold").alias("tags"))
    made = t.select("seq", "pos", F.explode(tagger).alias("x")).select("seq", "pos", "x.*").groupBy("tagger", "seq").agg(ordered("tag").alias("tags"))
    lost = F.when(F.pmod(F.size("tags"), F.lit(3)) == 0, F.slice("tags", 1, F.size("tags") - 1)).otherwise(F.col("tags"))
    found = made.withColumn("source", F.lit("gold")).unionByName(made.withColumn("source", F.lit("heard")).withColumn("tags", lost))
    whole = P.tagging_grid(gold, found, ["seq"], ["tagger", "source"]).withColumn("type", F.lit("all"))
    return B.rounded(P.tagging_grid(gold, found, ["seq"], ["tagger", "source"], by_type=True).unionByName(whole), "precision", "recall", "f1")


_TAGGERS = f"""{TAGS_SQL}, all_tags AS (SELECT tagger || ':' || source || ':' || seq AS seq, tagger, source, pos, gold, CASE WHEN source = 'heard' AND n % 3 = 0 THEN 'O' WHEN tagger = 'rules' THEN pred WHEN pos % 7 = 0 THEN 'O' ELSE gold END AS pred
    FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM tags), (SELECT unnest(['rules', 'lists']) AS tagger), (SELECT unnest(['gold', 'heard']) AS source)),
  {spans_sql('gold', 'g', 'all_tags')}, {spans_sql('pred', 'p', 'all_tags')},
  b AS (SELECT split_part(coalesce(g.seq, p.seq), ':', 1) AS tagger, split_part(coalesce(g.seq, p.seq), ':', 2) AS source, coalesce(g.type, p.type) AS type, g.seq IS NOT NULL AS ing, p.seq IS NOT NULL AS inp FROM g FULL JOIN p ON g.seq = p.seq AND g.type = p.type AND g.tok_start = p.tok_start AND g.tok_end = p.tok_end),
  c AS (SELECT tagger, source, type, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM b GROUP BY ALL UNION ALL SELECT tagger, source, 'all', count(*) FILTER (ing AND inp), count(*) FILTER (NOT ing), count(*) FILTER (NOT inp) FROM b GROUP BY ALL)"""


def top_spans(spark, sf):
    """The 25 weightiest hits of each call's caller, by the size of their pressing weight."""
    t = B.turns(spark, sf).where("speaker = 'caller'")
    press = F.create_map(*[F.lit(x) for kv in L.PRESSURE.items() for x in kv])
    hits = L.phrase_hits(t, B.vocab(spark), ["call_id", "turn_index"]).withColumn("weight", F.round(F.col("weight") * press[F.col("family")], 6))
    return P.top_rows(hits, ["call_id"], F.col("weight"), 25, ["turn_index", "family", "term"]).select("call_id", "place", "turn_index", "family", "term", "weight")


def top_drivers(spark, sf):
    """Up to three contributions above .15 of each call."""
    top = P.top_rows(contributions(spark, sf).where("contribution > 0.15"), ["call_id"], F.col("contribution"), 3, ["feature"])
    return B.rounded(top.select("call_id", "place", "feature", "contribution"), "contribution")


def first_reasons(spark, sf):
    """The first six reasons of each call."""
    return reasons_rows(spark, sf).select("call_id", F.size(P.first_items(F.col("reasons"), 6)).alias("n"), F.array_join(P.first_items(F.col("reasons"), 2), " ").alias("text"))


def first_sentences(spark, sf):
    """The first 24 sentences of each document, each a turn of its own."""
    s = B.load(spark, sf, "documents").select("doc_id", F.posexplode(P.first_items(X.sentences(F.col("text")), 24)).alias("turn_index", "text"))
    return s.groupBy("doc_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def det_thinned(spark, sf):
    c = M.det_curve(B.scored_documents(spark, sf), ["lang"])
    return B.rounded(P.thinned(c, ["lang"], [F.desc("threshold")], 12).where("threshold < 1e9"), "fpr", "fnr")


def spectrum_thinned(spark, sf):
    return B.rounded(P.evenly(frames(spark, sf), ["vec_id"], [F.col("frame")], 11), "x")


def intent_ladder(spark, sf):
    """A turn's intent by the model, else by the rules, else by the vocabulary."""
    t = B.families(spark, sf).withColumn("model", F.when(F.col("n_tokens") % 3 == 0, None).when(F.col("n_tokens") % 5 == 0, float("nan")).otherwise(F.col("n_tokens") / 100.0)).withColumn("rules", F.when(F.col("n_tokens") % 2 == 0, None).otherwise(F.col("w_urgency") - 1))
    score, backend = P.ladder({"tfidf": F.col("model"), "rules": F.col("rules")}, L.fallback_score())
    return B.rounded(t.select("call_id", "turn_index", score.alias("score"), backend.alias("backend")), "score")


def voice_ladder(spark, sf):
    """A voice score by the network, the trees, the mixtures, or the five measurements alone."""
    m = measured(spark, sf).withColumn("net", F.when(F.col("vec_id") % 4 == 0, F.col("shimmer"))).withColumn("trees", F.when(F.col("vec_id") % 4 == 1, float("inf")).when(F.col("vec_id") % 4 == 2, F.col("shimmer") * 2)).withColumn("mixtures", F.when(F.col("vec_id") % 3 == 0, F.col("hnr") - 10))
    score, backend = P.ladder({"rawnet": F.col("net"), "gbm": F.col("trees"), "gmm": F.when(F.col("mixtures").isNotNull(), X.sigmoid(F.col("mixtures")))}, X.sigmoid(R.heuristic_voice()), "heuristic")
    return B.rounded(m.select("vec_id", score.alias("score"), backend.alias("backend")), "score")


ANCHORS = {"f0_cv": (0.01, 0.05), "f0_span": (0.1, 0.4), "emphasis_var": (0.001, 0.009), "rate_std": (5.0, 25.0)}


def anchored_arousal(spark, sf):
    m = measured(spark, sf).select("vec_id", F.col("jitter").alias("f0_cv"), F.col("shimmer").alias("f0_span"), F.col("spec_flatness_var").alias("emphasis_var"), F.col("hnr").alias("rate_std"), F.col("spk_consistency").alias("voiced_ratio"))
    return B.rounded(P.anchored_arousal(m, ANCHORS).select("vec_id", "at_f0_cv", "arousal"), "at_f0_cv", "arousal", to=5)


def _part(n: str) -> str:
    low, high = ANCHORS[n]
    return f"coalesce(least(greatest(({n} - {low}) / {high - low!r}, 0), 1), 0)"


_RAW = " + ".join(f"{w} * {_part(n)}" for n, w in P.AROUSAL_WEIGHTS.items())


def channel_lift(spark, sf):
    m = measured(spark, sf).select("vec_id", (-60 + F.col("hnr")).alias("floor_real"), (-60 + 100 * F.col("shimmer")).alias("floor_made"))
    return B.rounded(P.channel_lift(m), "floor_real", "floor_made", "target", "lift_real", "lift_made", to=4)


def paired_sets(spark, sf):
    """Pages as recordings and documents of two languages as renderings of the same number."""
    p, d = B.load(spark, sf, "pages").select(F.col("page_id").alias("key"), F.length("html").alias("n")), B.load(spark, sf, "documents").where(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("key"), F.length("text").alias("n"))
    return P.paired(p, d, "key")


def pair_splits(spark, sf):
    """Speakers of the pairs: three quarters train, the rest dev, none in both."""
    speakers = B.load(spark, sf, "customer").select("c_custkey")
    n = speakers.count()
    parts = spark.createDataFrame([("train", n * 3 // 4, 0), ("dev", n - n * 3 // 4, 1)], "name string, n long, pos int")
    out = C.assign_splits(speakers, parts, F.md5(F.concat_ws(":", F.lit("pairs"), F.col("c_custkey")).cast("binary")), "c_custkey")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def borrowed_negatives(spark, sf):
    d = B.scored_documents(spark, sf)
    own, others = d.where("lang IN ('de', 'es')"), d.where("lang IN ('en', 'fr')")
    return B.rounded(P.with_borrowed_negatives(own, others).groupBy("borrowed", "lang").agg(F.count("*").alias("n"), F.sum("label").alias("positive"), F.avg("score").alias("mean")), "mean")


def split_overlap(spark, sf):
    d = B.load(spark, sf, "documents").select("lang", F.concat_ws(":", "source", F.pmod("doc_id", F.lit(7))).alias("speaker"))
    return P.shared_members(d, "lang", "speaker")


def corpus_faults(spark, sf):
    return P.corpus_faults(tags(spark, sf).withColumn("gold", F.when(F.col("pos") % 31 == 3, "B-ELSE").otherwise(F.col("gold"))), ["seq"], "gold", ["OTP", "MONEY"])


def entity_leaks(spark, sf):
    s = B.entity_spans(spark, sf).withColumn("split", F.pmod("call_id", F.lit(3)))
    return P.leaks(s, "split", "token")


def table_fingerprint(spark, sf):
    return P.fingerprint(B.load(spark, sf, "documents"), ["doc_id", "text", "lang", "source"])


GAZETTEER = X.first_types([("OTP", {"by", "von"}), ("BANK_ENTITY", {"is", "by", "un"}), ("PAYMENT_HANDLE", {"with", "the"})])


def gazetteer_types(spark, sf):
    canon = lambda w: X.canonical(w, {"der": "the"}, {"tin"})
    t = B.flat_tokens(B.turns(spark, sf)).withColumn("type", X.gazetteer_type(F.col("token"), GAZETTEER, canon))
    return t.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct(F.lower("token")).alias("words"))


def urgency_words(spark, sf):
    canon = lambda w: X.canonical(w, {"der": "the"}, {"tin"})
    d = X.word_density(F.col("tokens"), {"the und", "les", "in of"}, canon)
    return B.rounded(B.turns(spark, sf).select("call_id", "turn_index", d.alias("density")), "density")


def detokenized(spark, sf):
    """Tokens back to text, and whether that is cut to the same tokens."""
    t = B.turns(spark, sf).withColumn("said", X.detokenize(F.col("tokens")))
    return t.select("call_id", "turn_index", F.md5(F.col("said").cast("binary")).alias("digest"), (X.tokens("said") == F.col("tokens")).alias("same"))


def difference_moments(spark, sf):
    d = S.differences(frames(spark, sf), "vec_id", "frame", "x")
    return B.rounded(S.moments(d, "vec_id", "x"), "mean", "std", "skew", "kurtosis", to=5)


def call_features(spark, sf):
    """What a call-level pooler sees: the turn scores' summary and the entity densities."""
    return pool_features(spark, sf).join(density(spark, sf), "call_id")


def event_props(spark, sf):
    """A number out of each event's JSON; what cannot be read is null."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = B.load(spark, sf, "events").select("event_type", k.alias("k"), F.get_json_object("props", "$.none").alias("none"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"), F.count("none").alias("none"))


def sidecar_lookup(spark, sf):
    """Recordings' call files, by four places and two stems; every seventh has none."""
    d = B.load(spark, sf, "documents").select("doc_id", F.concat(F.lit("/a/wav/rec"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "_ulaw").otherwise(""), F.lit(".wav")).alias("p"))
    place = F.element_at(F.array(F.lit("/a/wav"), F.lit("/a/wav/calls"), F.lit("/a/calls"), F.lit("/corpus")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    files = d.where("doc_id % 7 <> 0").select(F.concat(place, F.lit("/rec"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    return T.first_existing(d, files, T.sidecar_candidates(F.col("p"), "/corpus"), "doc_id")


def stem_fallback(spark, sf):
    """Without any metadata rows the recordings come alone."""
    none = B.load(spark, sf, "pages").where("page_id < 0").select("page_id", F.lit("").alias("path"))
    files = B.load(spark, sf, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return T.by_stem(none, files).select("page_id", "stem", "audio_path")


def corpus_measures(spark, sf):
    """(measure, key, value): the corpus in numbers, by one pass over turns, tokens and calls each."""
    t = S.timings(B.acted(spark, sf), "n_tokens").withColumn("label", F.when(F.col("call_id") % 2 == 1, "scam").otherwise("benign"))
    calls = t.groupBy("call_id", "label").agg(F.count("*").alias("turns"), F.sum("n_tokens").alias("tokens"), F.max("t_end").alias("seconds"), F.avg("rank").alias("coercion"))
    wide = calls.agg(F.count("*").alias("n_calls"), F.sum("turns").alias("n_turns"), F.sum("tokens").alias("n_tokens"), F.avg("turns").alias("mean_turns_per_call"), (F.sum("tokens") / F.sum("turns")).alias("mean_tokens_per_turn"), F.avg("seconds").alias("mean_duration_s"), F.sum("seconds").alias("total_duration_s"))
    numbers = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]).unpivot([], wide.columns, "measure", "value").withColumn("key", F.lit(""))
    mix = mixing(spark, sf).agg(F.avg("cmi").alias("mean_cmi"), F.sum("switch_points").cast("double").alias("switch_points"), F.sum("n_tokens").cast("double").alias("tagged_tokens")).unpivot([], ["mean_cmi", "switch_points", "tagged_tokens"], "measure", "value").withColumn("key", F.lit(""))
    grouped = lambda df, name, key, value=F.count("*"): df.groupBy(F.col(key).alias("key")).agg(value.cast("double").alias("value")).withColumn("measure", F.lit(name))
    parts = [
        numbers, mix, grouped(calls, "calls", "label"), grouped(calls, "mean_coercion", "label", F.avg("coercion")), grouped(t, "acts", "act"), grouped(B.tagged(spark, sf), "lang_tokens", "lang"),
        grouped(B.entity_spans(spark, sf), "entities", "type"), grouped(t, "speakers", "speaker"), grouped(calls, "turns_by_class", "label", F.sum("turns")),
    ]
    out = parts[0].select("measure", "key", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("measure", "key", "value"))
    return B.rounded(out, "value", to=4)


_LABEL = "CASE WHEN call_id % 2 = 1 THEN 'scam' ELSE 'benign' END"


def fusion_rows(spark, sf):
    """Labelled documents with four features."""
    d = B.scored_documents(spark, sf).join(B.load(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("size"), F.regexp_count("text", F.lit("[!?]")).cast("double").alias("marks")), "doc_id")
    return d.select("doc_id", "label", "score", "size", "marks", F.col("quality").cast("double").alias("quality"))


def fused_risk(spark, sf):
    """The fused score of every labelled document: standardised, logistic, calibrated on held-out folds."""
    rows = fusion_rows(spark, sf)
    model = D.train_fusion(rows, ["score", "size", "marks", "quality"], "label", "doc_id", sample=4000)
    return D.apply_fusion(rows, model).select("doc_id", "label", F.round("risk", 6).alias("risk"), F.round(F.col("contributions")["size"], 6).alias("by_size"))


def boosted_voice(spark, sf):
    """Boosted trees on all vectors' numbers, fitted where the rows lie."""
    e = B.load(spark, sf, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("label"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(64)])
    return D.boosted_scores(e, [f"x{k}" for k in range(64)], "label").select("vec_id", "label", F.round("boosted", 6).alias("boosted"))


def tones(spark, sf):
    from .audio_queries import tones as made

    return made(spark, sf)


def channel_audit(spark, sf):
    """How well each of the ten channel statistics tells even pages from odd ones."""
    s = A.channel_statistics(tones(spark, sf))
    return B.rounded(P.audit(s, {c: F.col(c) for c in s.columns if c != "signal_id"}, F.pmod("signal_id", F.lit(2))), "auc", "mean_1", "mean_0", to=5)


def interpretable_features(spark, sf):
    return A.interpretable_features(tones(spark, sf))


def prosody_errors(spark, sf):
    """Prosody of all pages, every tenth of which is no signal: its row says why."""
    t = tones(spark, sf).withColumn("samples", F.when(F.col("signal_id") % 10 == 0, F.transform("samples", lambda x: F.lit(float("nan")))).otherwise(F.col("samples")))
    return A.prosody_features(t, errors=True)


def rule_hits(spark, sf):
    """Terms of one and two tokens, as they stand or by their spelling, no token twice in a family."""
    v = B.vocab(spark).unionByName(L.vocabulary(spark, TWO_WORDS))
    canon = lambda w: X.canonical(w, {"der": "the"}, {"tin"})
    return L.token_hits(B.turns(spark, sf).withColumn("low", X.lowered(F.col("tokens"))), v, ["call_id", "turn_index"], "low", canon)


TWO_WORDS = [("urgency", "the und", 0.9), ("urgency", "and the", 0.8), ("threat", "of the", 0.7), ("threat", "the of", 0.6), ("authority", "in the", 0.5)]


def mixed_pos_tags(spark, sf):
    """Word classes with endings of verbs in one language, capitals by place, and what is no word."""
    t = B.flat_tokens(B.turns(spark, sf))
    tag = W.pos_tag(F.col("token"), W.CLOSED, {"bank": "NOUN"}, verb_ends="(er|en|ar)$", lang=B.lang(F.col("token")) == "xx", index=F.col("pos"))
    return W.distribution(t.withColumn("tag", tag))


def pos_ngrams(spark, sf):
    """Pairs of word classes within turns."""
    t = B.turns(spark, sf).select(F.transform("tokens", lambda w: W.pos_tag(w, W.CLOSED, {"bank": "NOUN"})).alias("tags"))
    return t.select(F.explode(X.ngrams(F.col("tags"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def call_manifest(spark, sf):
    """The generator's plan by split, voice, scenario and both of the first."""
    return C.counts_by(G.plan(spark, 240, seed=11), [["split"], ["label_voice"], ["scenario"], ["split", "label_voice"]])


def evidence_spans(spark, sf):
    """What a reader is shown of each turn: pressing words and entities."""
    hits = L.token_hits(B.turns(spark, sf).withColumn("low", X.lowered(F.col("tokens"))), B.vocab(spark), ["call_id", "turn_index"])
    return E.evidence(hits, B.entity_spans(spark, sf), ["call_id", "turn_index"])


def risk_drivers(spark, sf):
    """What each term of the untrained risk adds."""
    m = measured(spark, sf)
    return B.rounded(R.fallback_contributions(m, "vec_id", {"intent_score": F.col("jitter"), "as_score": F.col("shimmer"), "ent_otp": F.col("hnr"), "coercion_slope": F.col("spk_consistency") - 0.01}), "contribution")


def concat_timings(spark, sf):
    """Pages laid one behind the other, five rows of them, with a gap."""
    p = B.load(spark, sf, "pages").select("page_id", F.pmod("page_id", F.lit(5)).alias("tape"), (F.length("html") / 100.0).alias("seconds"))
    return B.rounded(S.laid_out(p, "tape", ["page_id"], "seconds").drop("seconds"), "t_start", "t_end", to=4)


def top_terms(spark, sf):
    """The words that speak most for and against toxic documents."""
    rows = B.load(spark, sf, "documents").select("doc_id", "text").join(B.load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return B.rounded(D.top_terms(rows, D.train_intent(rows, "text", "label", "doc_id", sample=400)), "weight")


def arousal_components(spark, sf):
    return A.arousal_components(tones(spark, sf))


def channel_statistics(spark, sf):
    return A.channel_statistics(tones(spark, sf))


QUERIES = {f.__name__: f for f in (
    mixing_by_class, entity_alignment, antispoof_grid, antispoof_table, intent_by_model, tagger_grid, top_spans, top_drivers, first_reasons, first_sentences, det_thinned, spectrum_thinned, intent_ladder, voice_ladder, anchored_arousal, channel_lift,
    paired_sets, pair_splits, borrowed_negatives, split_overlap, corpus_faults, entity_leaks, table_fingerprint, gazetteer_types, urgency_words, detokenized, difference_moments, call_features, event_props, sidecar_lookup, stem_fallback, corpus_measures,
    fused_risk, boosted_voice, arousal_components, channel_statistics, channel_audit, interpretable_features, prosody_errors, rule_hits, mixed_pos_tags, pos_ngrams, call_manifest, evidence_spans, risk_drivers, concat_timings, top_terms,
)}
_CANON = "CASE WHEN lower(token) = 'der' THEN 'the' ELSE lower(token) END"
_LOGIT = "1 / (1 + exp(-least(greatest({x}, -40), 40)))"
_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 2)"
_HUG = "list_contains(string_split(',.?!;:)]}%@', ''), w[i])"
_CLOSED = " ".join(f"WHEN lower(token) IN {B.words(w)} THEN '{k}'" for k, w in W.CLOSED.items())
_ENDS = " ".join(f"WHEN regexp_matches(lower(token), '{p}') THEN '{k}'" for p, k in W.SUFFIXES)
_OPEN = "CASE WHEN NOT regexp_matches(token, '[A-Za-z0-9]') THEN 'PUNCT' WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' " + _CLOSED + " WHEN lower(token) = 'bank' THEN 'NOUN' "
ORACLES = {
    "evidence_spans": f"WITH {B.SPANS_SQL}, {B.VOCAB_SQL} SELECT call_id, turn_index, pos::INT AS tok_start, (pos + 1)::INT AS tok_end, family AS type, term AS text, weight, 'lexicon' AS source FROM tok JOIN vocab ON lower(token) = term UNION ALL SELECT call_id, turn_index, tok_start::INT, tok_end::INT, type, token, 0.0, 'entity' FROM spans",
    "risk_drivers": f"WITH {MEASURED_SQL}, c AS (SELECT vec_id, unnest(['intent_score', 'as_score', 'pim', 'entities', 'coercion_slope']) AS feature, unnest([0.30 * coalesce(jitter, 0), 0.22 * shimmer, 0.0, 0.14 * least(greatest(hnr / 6.0, 0), 1), 0.14 * least(greatest(2.0 * (spk_consistency - 0.01), 0), 1)]) AS contribution FROM m) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY abs(contribution) DESC, feature)::INT AS place, feature, round(contribution, 6) AS contribution FROM c",
    "concat_timings": "WITH p AS (SELECT page_id, page_id % 5 AS tape, length(html) / 100.0 AS s FROM pages), e AS (SELECT page_id, tape, s, sum(s) OVER w + 0.25 * (count(*) OVER w - 1) AS t_end FROM p WINDOW w AS (PARTITION BY tape ORDER BY page_id)) SELECT page_id, tape, round(t_end - s, 4)::DOUBLE AS t_start, round(t_end, 4)::DOUBLE AS t_end FROM e",
    "mixed_pos_tags": f"WITH {B.TAGGED_SQL}, t AS (SELECT {_OPEN} WHEN lang = 'xx' AND regexp_matches(lower(token), '(er|en|ar)$') THEN 'VERB' {_ENDS} WHEN pos > 0 AND regexp_matches(token, '^\\p{{Lu}}\\p{{Ll}}+$') THEN 'PROPN' WHEN regexp_matches(token, '^\\p{{Lu}}{{2,}}$') THEN 'PROPN' WHEN NOT regexp_matches(lower(token), '^\\p{{L}}+$') THEN 'X' ELSE 'NOUN' END AS tag FROM tagged) SELECT tag, coalesce(n, 0) AS n FROM (SELECT unnest({list(W.TAGS)}) AS tag) LEFT JOIN (SELECT tag, count(*) AS n FROM t GROUP BY 1) USING (tag)",
    "pos_ngrams": f"WITH {B.TOKENS_SQL}, t AS (SELECT call_id, turn_index, pos, {_OPEN} {_ENDS} WHEN regexp_matches(token, '^[A-Z][a-z]') THEN 'PROPN' ELSE 'NOUN' END AS tag FROM tok), g AS (SELECT lag(tag) OVER (PARTITION BY call_id, turn_index ORDER BY pos) || '_' || tag AS gram FROM t) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY 1",
    "mixing_by_class": f"WITH {MIX_SQL}, t AS (SELECT call_id % 2 AS label, count(*) FILTER (lang <> 'univ') AS n, count(*) FILTER (lang = 'xx') AS b, count(*) FILTER (lang <> 'univ' AND {_ENTITY}) AS en, count(*) FILTER (lang = 'xx' AND {_ENTITY}) AS eb FROM tagged GROUP BY 1), c AS (SELECT call_id % 2 AS label, avg(cmi) AS cmi, sum(switch_points) AS s FROM mix GROUP BY 1) SELECT label::INT AS label, round(cmi, 4) AS cmi, round(CASE WHEN n > 0 THEN 100 * s / n ELSE 0 END, 4) AS switch_rate, round(CASE WHEN n > 0 THEN b / n ELSE 0 END, 4) AS second_ratio, round(CASE WHEN en > 0 THEN eb / en ELSE 0 END, 4) AS ent_lang_align, en AS n_entity_tokens FROM t JOIN c USING (label)",
    "entity_alignment": f"WITH {B.TAGGED_SQL}, t AS (SELECT call_id, count(*) FILTER (lang <> 'univ' AND {_ENTITY}) AS n, count(*) FILTER (lang = 'xx' AND {_ENTITY}) AS b FROM tagged GROUP BY 1) SELECT call_id, n AS ent_tokens, round(CASE WHEN n > 0 THEN b / n ELSE 0 END, 6) AS ent_lang_align FROM t",
    "antispoof_grid": f"WITH {_GRID} SELECT * FROM grid",
    "antispoof_table": f"WITH {_GRID} SELECT features, model, " + ", ".join(f"max(eer) FILTER (codec = '{c}') AS {c}" for c in ("clean", "ulaw", "gsm", "lost")) + " FROM grid GROUP BY ALL",
    "intent_by_model": f"WITH {ARMS_SQL}, {rates_sql('arms', 'arm', 0.65)} SELECT * FROM conf",
    "tagger_grid": f"WITH {_TAGGERS} SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c",
    "top_spans": f"WITH {B.HITS_SQL}, h AS (SELECT hits.call_id, hits.turn_index, family, term, round(weight * CASE family " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in L.PRESSURE.items()) + " END, 6) AS weight FROM hits JOIN turns USING (call_id, turn_index) WHERE speaker = 'caller') SELECT * FROM (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY abs(weight) DESC, turn_index, family, term) AS place, turn_index, family, term, weight FROM h) WHERE place <= 25",
    "top_drivers": f"WITH {SHAP_SQL} SELECT * FROM (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY abs(contribution) DESC, feature) AS place, feature, round(contribution, 6) AS contribution FROM shap WHERE contribution > 0.15) WHERE place <= 3",
    "first_sentences": f"WITH s AS (SELECT doc_id, CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} ELSE [text] END AS s FROM documents) SELECT doc_id, least(len(s), 24) AS turns, list_sum(list_transform(s[1:24], lambda x: length(x)))::BIGINT AS chars FROM s",
    "det_thinned": f"WITH {B.SCORED_SQL}, {curve_sql('scored', 'lang')}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY threshold DESC) - 1 AS k, greatest(1, floor(count(*) OVER (PARTITION BY lang) / 12)) AS step FROM curve) SELECT lang, threshold, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM k WHERE k % step = 0 AND threshold < 1e9",
    "spectrum_thinned": "WITH f AS (SELECT vec_id, embedding, unnest(list_distinct(list_transform(range(11), lambda j: (j * (len(embedding) - 1)) // 10))) AS frame FROM embeddings) SELECT vec_id, frame::INT AS frame, round(embedding[frame + 1]::DOUBLE, 6) AS x FROM f",
    "intent_ladder": f"WITH {B.FAMILIES_SQL}, s AS (SELECT *, {B.saturated_sql(0.8)} AS s FROM families) SELECT call_id, turn_index, round(CASE WHEN n_tokens % 3 <> 0 AND n_tokens % 5 <> 0 THEN least(n_tokens / 100.0, 1) WHEN n_tokens % 2 = 1 THEN least(greatest(w_urgency - 1, 0), 1) WHEN s = 0 THEN 0.12 ELSE least(greatest(0.5 + 0.32 * s, 0), 1) END, 6) AS score, CASE WHEN n_tokens % 3 <> 0 AND n_tokens % 5 <> 0 THEN 'tfidf' WHEN n_tokens % 2 = 1 THEN 'rules' ELSE 'lexicon' END AS backend FROM s",
    "voice_ladder": f"WITH {MEASURED_SQL} SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 THEN least(shimmer, 1) WHEN vec_id % 4 = 2 THEN least(shimmer * 2, 1) WHEN vec_id % 3 = 0 THEN {_LOGIT.format(x='(hnr - 10)')} ELSE {_LOGIT.format(x='raw')} END, 6) AS score, CASE WHEN vec_id % 4 = 0 THEN 'rawnet' WHEN vec_id % 4 = 2 THEN 'gbm' WHEN vec_id % 3 = 0 THEN 'gmm' ELSE 'heuristic' END AS backend FROM raws",
    "anchored_arousal": f"WITH {MEASURED_SQL}, c AS (SELECT vec_id, jitter AS f0_cv, shimmer AS f0_span, spec_flatness_var AS emphasis_var, hnr AS rate_std, spk_consistency AS v FROM m), a AS (SELECT vec_id, v, {_part('f0_cv')} AS at_f0_cv, {_RAW} AS raw FROM c) SELECT vec_id, round(at_f0_cv, 5) AS at_f0_cv, round(least(greatest(CASE WHEN v < 0.25 THEN v / 0.25 * raw + (1 - v / 0.25) * 0.5 ELSE raw END, 0), 1), 5) AS arousal FROM a",
    "channel_lift": f"WITH {MEASURED_SQL}, c AS (SELECT vec_id, -60 + hnr AS a, -60 + 100 * shimmer AS b FROM m), t AS (SELECT *, greatest(a, b) + 1 AS t FROM c) SELECT vec_id, round(a, 4) AS floor_real, round(b, 4) AS floor_made, round(t, 4) AS target, round(10 * log10(pow(10, t / 10) - pow(10, a / 10)), 4) AS lift_real, round(10 * log10(pow(10, t / 10) - pow(10, b / 10)), 4) AS lift_made FROM t",
    "paired_sets": "WITH p AS (SELECT page_id AS key, length(html)::INT AS n FROM pages), d AS (SELECT doc_id AS key, length(text)::INT AS n FROM documents WHERE lang IN ('en', 'fr')) SELECT key, n, 0 AS label FROM p WHERE key IN (SELECT key FROM d) UNION ALL SELECT key, n, 1 FROM d WHERE key IN (SELECT key FROM p)",
    "pair_splits": "WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('pairs:' || c_custkey), c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) SELECT CASE WHEN k < floor(n * 0.75) THEN 'train' ELSE 'dev' END AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM k GROUP BY 1",
    "borrowed_negatives": f"WITH {B.SCORED_SQL} SELECT label = 0 AS borrowed, lang, count(*) AS n, sum(label)::BIGINT AS positive, round(avg(score), 6) AS mean FROM scored WHERE (lang IN ('de', 'es') AND label = 1) OR (lang IN ('en', 'fr') AND label = 0) GROUP BY ALL",
    "split_overlap": "WITH d AS (SELECT DISTINCT lang, source || ':' || doc_id % 7 AS speaker FROM documents WHERE lang IS NOT NULL) SELECT a.lang AS first, b.lang AS second, count(*) AS n FROM d a JOIN d b ON a.speaker = b.speaker AND a.lang < b.lang GROUP BY ALL",
    "corpus_faults": f"WITH {TAGS_SQL}, t AS (SELECT seq, pos, CASE WHEN pos % 31 = 3 THEN 'B-ELSE' ELSE gold END AS gold FROM tags), b AS (SELECT gold, lag(gold) OVER (PARTITION BY seq ORDER BY pos) AS before FROM t), c AS (SELECT count(*) FILTER (gold <> 'O' AND NOT regexp_matches(gold, '^[BI]-.')) AS no_tag, count(*) FILTER (gold LIKE '_-%' AND split_part(gold, '-', 2) NOT IN ('OTP', 'MONEY')) AS unknown_type, count(*) FILTER (gold LIKE 'I-%' AND NOT coalesce(before LIKE '_-%' AND split_part(before, '-', 2) = split_part(gold, '-', 2), false)) AS stray_inside, count(*) AS tokens FROM b) SELECT unnest(['no_tag', 'unknown_type', 'stray_inside', 'tokens']) AS fault, unnest([no_tag, unknown_type, stray_inside, tokens]) AS n FROM c",
    "entity_leaks": f"WITH {B.SPANS_SQL} SELECT type, lower(token) AS value, count(DISTINCT call_id % 3) AS splits FROM spans GROUP BY ALL HAVING count(DISTINCT call_id % 3) > 1",
    "table_fingerprint": "WITH r AS (SELECT md5(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)))) AS h FROM documents) SELECT count(*) AS rows, md5(count(*) || ':' || sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR) AS digest FROM r",
    "gazetteer_types": f"WITH {B.TOKENS_SQL}, t AS (SELECT token, CASE WHEN {_CANON} IN ('by', 'von') THEN 'OTP' WHEN {_CANON} IN ('is', 'un') THEN 'BANK_ENTITY' WHEN {_CANON} IN ('with', 'the') THEN 'PAYMENT_HANDLE' END AS type FROM tok) SELECT type, count(*) AS n, count(DISTINCT lower(token)) AS words FROM t GROUP BY 1",
    "urgency_words": f"WITH {B.TOKENS_SQL}, t AS (SELECT call_id, turn_index, count(*) FILTER ({_CANON} IN ('the', 'und', 'les')) AS k, count(*) AS n FROM tok GROUP BY ALL) SELECT call_id, turn_index, round(coalesce(100.0 * k / n, 0), 6) AS density FROM turns LEFT JOIN t USING (call_id, turn_index)",
    "detokenized": f"WITH {B.TURNS_SQL}, d AS (SELECT call_id, turn_index, tokens, array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN i = 1 OR list_contains(string_split(',.?!;:)]}}%@', ''), tokens[i]) OR list_contains(string_split('([{{@', ''), tokens[greatest(i - 1, 1)]) THEN tokens[i] ELSE ' ' || tokens[i] END), '') AS said FROM turns) SELECT call_id, turn_index, md5(said) AS digest, regexp_extract_all(said, '{B.TOKEN.replace(chr(39), chr(39) * 2)}') = tokens AS same FROM d",
    "difference_moments": "WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS frame FROM embeddings), d AS (SELECT vec_id, x - lag(x) OVER (PARTITION BY vec_id ORDER BY frame) AS x FROM f), m AS (SELECT vec_id, avg(x) AS mean, var_pop(x) AS v, avg(x * x * x) AS x3, avg(x * x) AS x2, avg(x * x * x * x) AS x4 FROM d WHERE x IS NOT NULL GROUP BY 1) SELECT vec_id, round(mean, 5) AS mean, round(sqrt(v), 5) AS std, round(CASE WHEN v > 1e-10 THEN (x3 - 3 * mean * x2 + 2 * mean ** 3) / v ** 1.5 ELSE 0 END, 5) AS skew, round(CASE WHEN v > 1e-10 THEN (x4 - 4 * mean * x3 + 6 * mean ** 2 * x2 - 3 * mean ** 4) / v ** 2 - 3 ELSE 0 END, 5) AS kurtosis FROM m",
    "call_features": f"SELECT * FROM ({SEQUENCE_ORACLES['pool_features']}) JOIN ({SEQUENCE_ORACLES['entity_density']}) USING (call_id)",
    "event_props": "SELECT event_type, count(json_extract_string(props, '$.k')::INT) AS n, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS total, max(json_extract_string(props, '$.k')::INT) AS top, 0 AS none FROM events GROUP BY 1",
    "sidecar_lookup": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN ['/a/wav', '/a/wav/calls', '/a/calls', '/corpus'][(doc_id % 4 + 1)::INT] || '/rec' || doc_id || '.json' END AS path FROM documents",
    "stem_fallback": "SELECT NULL::BIGINT AS page_id, doc_id::VARCHAR AS stem, '/x/' || doc_id || '.wav' AS audio_path FROM documents",
    "corpus_measures": f"""WITH {MIX_SQL.replace(B.TURNS_SQL, B.ACTED_SQL)}, {B.SPANS_SQL.split('tok AS (')[1].split('), ', 1)[1]}, tm AS (SELECT *, greatest(0.7, n_tokens / 2.6) AS len FROM acted),
      c AS (SELECT call_id, {_LABEL} AS label, count(*) AS turns, sum(n_tokens) AS tokens, sum(len) + 0.25 * (count(*) - 1) AS seconds, avg(rank) AS coercion FROM tm GROUP BY ALL),
      w AS (SELECT count(*) AS a, sum(turns) AS b, sum(tokens) AS c, avg(turns) AS d, sum(tokens) / sum(turns) AS e, avg(seconds) AS f, sum(seconds) AS g FROM c), x AS (SELECT avg(cmi) AS a, sum(switch_points) AS b, sum(n_tokens) AS c FROM mix)
      SELECT measure, key, round(value::DOUBLE, 4) AS value FROM (
      SELECT unnest(['n_calls', 'n_turns', 'n_tokens', 'mean_turns_per_call', 'mean_tokens_per_turn', 'mean_duration_s', 'total_duration_s']) AS measure, '' AS key, unnest([a::DOUBLE, b::DOUBLE, c::DOUBLE, d, e, f, g]) AS value FROM w
      UNION ALL SELECT unnest(['mean_cmi', 'switch_points', 'tagged_tokens']), '', unnest([a, b::DOUBLE, c::DOUBLE]) FROM x
      UNION ALL SELECT 'calls', label, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'mean_coercion', label, avg(coercion) FROM c GROUP BY 2 UNION ALL SELECT 'acts', act, count(*) FROM acted GROUP BY 2
      UNION ALL SELECT 'lang_tokens', lang, count(*) FROM tagged GROUP BY 2 UNION ALL SELECT 'entities', type, count(*) FROM spans GROUP BY 2 UNION ALL SELECT 'speakers', speaker, count(*) FROM acted GROUP BY 2 UNION ALL SELECT 'turns_by_class', label, sum(turns) FROM c GROUP BY 2)""",
}
