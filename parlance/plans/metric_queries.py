"""Queries of the metrics, the corpus statistics and the planner."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import g711
from ..functions.text import finite
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import reports as P
from ..operators import sequences as S
from ..schema import risk_band
from ..sources import transcripts as T
from ..storage import staged
from . import base as B


def roc_auc(spark, sf):
    return B.rounded(M.roc_auc(B.scored_documents(spark, sf), ["lang"]), "auc")


def det_curve(spark, sf):
    return B.rounded(M.det_curve(B.scored_documents(spark, sf), ["lang"]).where("threshold < 1e9"), "fpr", "fnr")


def eer(spark, sf):
    return B.rounded(M.equal_error(M.det_curve(B.scored_documents(spark, sf), ["lang"]), ["lang"]), "eer", "threshold")


def min_tdcf(spark, sf):
    return B.rounded(M.min_tdcf(M.det_curve(B.scored_documents(spark, sf), ["lang"]), ["lang"]), "min_tdcf")


def confusion_threshold(spark, sf):
    return B.rounded(M.confusion(B.scored_documents(spark, sf), ["lang"], 0.65), "accuracy", "precision", "recall", "f1")


def arms(spark, sf):
    """Three arms of scores, a row for each."""
    d = B.scored_documents(spark, sf).withColumn("half", F.col("score") / 2).withColumn("turned", 1 - F.col("score"))
    return d.withColumnRenamed("score", "full").unpivot(["doc_id", "lang", "source", "label", "quality"], ["full", "half", "turned"], "arm", "score")


ARMS_SQL = B.SCORED_SQL + ", arms AS (SELECT doc_id, lang, source, label, quality, unnest(['full', 'half', 'turned']) AS arm, unnest([score, score / 2, 1 - score]) AS score FROM scored)"


def ablation(spark, sf):
    a = staged(arms(spark, sf).select("arm", "score", "label"), "arms")  # made once, read by each metric
    out = M.roc_auc(a, ["arm"]).join(M.confusion(a, ["arm"], 0.65), "arm").join(M.equal_error(M.det_curve(a, ["arm"]), ["arm"]).drop("threshold"), "arm")
    return B.rounded(out, "auc", "accuracy", "precision", "recall", "f1", "eer")


def per_cell_accuracy(spark, sf):
    """Accuracy by arm and cell; a cell without rows stays, with a null."""
    a = arms(spark, sf).withColumn("cell", F.concat_ws("x", "lang", F.col("label").cast("string")))
    own = a.groupBy("arm", "cell").agg(F.avg(((F.col("score") >= 0.65).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    langs = spark.createDataFrame([(f"{x}x{y}",) for x in ("de", "en", "es", "fr", "it") for y in (0, 1)], "cell string")
    grid = spark.createDataFrame([("full",), ("half",), ("turned",)], "arm string").crossJoin(langs)  # 30 rows
    return B.rounded(grid.join(own, ["arm", "cell"], "left").na.fill(0, ["n"]), "accuracy")


def hard_subset(spark, sf):
    """Metrics of the rows of low quality, where there are enough of both classes."""
    d = B.scored_documents(spark, sf).where("quality = 0")
    ok = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).where("n >= 8 AND k = 2").drop("k")
    return B.rounded(M.roc_auc(d, ["lang"]).join(ok, "lang"), "auc")


def calibration_bins(spark, sf):
    return B.rounded(M.calibration(B.scored_documents(spark, sf), ["lang"]), "predicted", "observed")


def brier_ece(spark, sf):
    d = B.scored_documents(spark, sf)
    return B.rounded(M.brier(d, ["lang"]).join(M.calibration_error(M.calibration(d, ["lang"]), ["lang"]), "lang"), "brier", "ece")


def codec_sweep(spark, sf):
    d = B.scored_documents(spark, sf).withColumn("score", F.when(F.pmod("doc_id", F.lit(5)) == 0, float("nan")).when(F.pmod("doc_id", F.lit(11)) == 0, None).otherwise(F.col("score")))
    return B.rounded(C.codec_sweep(d, ["source"], M.roc_auc), "auc")


def odd_scores(spark, sf):
    """Scores some of which are null, no number, or infinite."""
    of = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    odd = F.when(of(5), None).when(of(7), float("nan")).when(of(11), float("inf")).when(of(13), float("-inf")).otherwise(F.col("score"))
    return B.scored_documents(spark, sf).withColumn("score", odd)


ODD_SQL = B.SCORED_SQL + """, odd AS (SELECT lang, source, label, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 11 = 0 THEN 'infinity'::DOUBLE WHEN doc_id % 13 = 0 THEN '-infinity'::DOUBLE ELSE score END AS score FROM scored),
  can AS (SELECT * FROM odd WHERE score IS NOT NULL AND NOT isnan(score))"""


def auc_odd_scores(spark, sf):
    """Areas over the rows that can be ranked; infinities rank at the ends."""
    d = odd_scores(spark, sf)
    both = M.roc_auc(d.withColumn("kind", F.lit("lang")), ["kind", "lang"]).unionByName(M.roc_auc(d.select(F.lit("source").alias("kind"), F.col("source").alias("lang"), "score", "label"), ["kind", "lang"]))
    return B.rounded(both.withColumnRenamed("lang", "value"), "auc")


def det_odd_scores(spark, sf):
    """The error curves of the same rows; an infinite threshold is named by its sign."""
    c = M.det_curve(odd_scores(spark, sf), ["lang"])
    end = F.when(F.col("threshold") == float("inf"), 1).when(F.col("threshold") == float("-inf"), -1).otherwise(0)
    return B.rounded(c.select("lang", "fpr", "fnr", end.alias("infinite"), F.when(end == 0, F.col("threshold")).alias("threshold")), "fpr", "fnr")


def score_quantiles(spark, sf):
    """Exact percentiles by selection, of the usable scores of each source and of all."""
    d = odd_scores(spark, sf).where("score IS NULL OR abs(score) < 10 OR isnan(score)")
    at = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0, "least": 0.0}
    by = M.percentiles(d, ["source"], "score", at)
    return B.rounded(by.unionByName(M.percentiles(d, [], "score", at).withColumn("source", F.lit("all"))), *at)


def confound_audit(spark, sf):
    """How well each channel statistic alone tells the classes apart, with a status."""
    d = B.load(spark, sf, "documents").join(B.load(spark, sf, "labels"), "doc_id")
    stats = {"length": F.length("text").cast("double"), "lines": F.regexp_count("text", F.lit("\n")).cast("double"), "commas": F.regexp_count("text", F.lit(",")).cast("double"), "n_chars": F.col("n_chars").cast("double")}
    return B.rounded(P.audit(d, stats, F.col("toxic")), "auc", "mean_1", "mean_0", to=5)


def ood_recall(spark, sf):
    d = staged(B.scored_documents(spark, sf).select("lang", "score", "label"), "scores")
    own = d.where("label = 1")
    out = M.with_percentiles(own.groupBy("lang").agg(F.avg((F.col("score") >= 0.7).cast("double")).alias("recall"), F.avg("score").alias("mean")), own, ["lang"], "score", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    alarms = d.where("label = 0").groupBy("lang").agg(F.avg((F.col("score") >= 0.7).cast("double")).alias("false_alarms"))
    return B.rounded(out.join(alarms, "lang"), "recall", "mean", "p10", "median", "p90", "false_alarms")


def act_confusion(spark, sf):
    """The eight most frequent confusions of two act labellings."""
    t = B.acted(spark, sf).withColumn("other", B.act_of(F.length("text"), F.col("turn_index") + F.pmod("call_id", F.lit(2))))
    return t.where("act <> other").groupBy("act", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "act", "other").limit(8)


def act_accuracy(spark, sf):
    t = B.acted(spark, sf).withColumn("other", B.act_of(F.length("text"), F.col("turn_index") + F.pmod("call_id", F.lit(2))))
    return B.rounded(t.groupBy("act").agg(F.avg((F.col("act") == F.col("other")).cast("double")).alias("accuracy"), F.count("*").alias("n")), "accuracy")


def corpus_counts(spark, sf):
    d = B.load(spark, sf, "documents").join(B.load(spark, sf, "labels"), "doc_id").withColumn("cell", F.concat_ws("x", F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean")))
    return C.counts_by(d, [["lang"], ["cell"], ["source"], ["source", "cell"]])


def corpus_stats(spark, sf):
    t = B.acted(spark, sf)
    c = t.groupBy("call_id").agg(F.count("*").alias("turns"), F.sum("n_tokens").alias("tokens"), F.max("rank").alias("peak"))
    out = c.agg(F.count("*").alias("calls"), F.sum("turns").alias("turns"), F.avg("turns").alias("turns_per_call"), (F.sum("tokens") / F.sum("turns")).alias("tokens_per_turn"), F.avg("peak").alias("mean_peak"))
    return B.rounded(out, "turns_per_call", "tokens_per_turn", "mean_peak")


def per_speaker_counts(spark, sf):
    """Calls of each speaker of a pool, those without any included."""
    pool = spark.range(12).select(F.format_string("spk_%02d", F.col("id").cast("int")).alias("speaker_id"))
    calls = B.turns(spark, sf).select("call_id").distinct().select(F.format_string("spk_%02d", F.pmod("call_id", F.lit(10)).cast("int")).alias("speaker_id")).groupBy("speaker_id").agg(F.count("*").alias("n"))
    return C.with_all(pool, calls, "speaker_id")


def corpus_search(spark, sf):
    return C.search(B.load(spark, sf, "documents").select("doc_id", "lang", "source"), "RC1", ["source", "lang"], ["doc_id"])


def corpus_listing(spark, sf):
    """A row for each call: its turns, roles, times, acts and the digest of all that the caller says."""
    t = S.timings(B.acted(spark, sf), "n_tokens")
    calls = t.groupBy("call_id").agg(F.count("*").alias("n_turns"), F.sum("n_tokens").alias("n_tokens"), F.max_by("act", "turn_index").alias("last_act"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("speaker") == "caller", F.struct("turn_index", "text")))), lambda x: x["text"]), "|").alias("caller_text"), F.avg("rank").alias("mean_rank"),
        F.min_by("act", "turn_index").alias("first_act"), F.count_if(F.col("speaker") == "callee").alias("callee_turns"), F.count_if(F.col("rank") >= 0.8).alias("pressing"), F.max("rank").alias("peak"), F.max_by("t_end", "turn_index").alias("seconds"), F.count_distinct("act").alias("acts"))
    return B.rounded(calls.withColumn("caller_text", F.md5(F.col("caller_text").cast("binary"))), "mean_rank").withColumn("seconds", F.round("seconds", 4))


def risk_bands(spark, sf):
    return B.scored_documents(spark, sf).groupBy(risk_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.sum("label").alias("positive"))


def finite_guard(spark, sf):
    x = F.when(F.pmod("event_id", F.lit(7)) == 0, float("nan")).when(F.pmod("event_id", F.lit(11)) == 0, float("inf")).otherwise(F.col("value"))
    return B.rounded(B.load(spark, sf, "events").select("event_type", finite(x).alias("v")).groupBy("event_type").agg(F.sum("v").alias("total"), F.count("*").alias("n")), "total", to=3)


def g711_codes(spark, sf):
    """The embeddings' numbers as 16-bit samples through both laws and back, summed by code."""
    x = B.load(spark, sf, "embeddings").select(F.explode("embedding").alias("x"))
    s = x.select(F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(F.col("x").cast("double") * 32767))).cast("int").alias("pcm"))
    s = s.withColumn("u", g711.ulaw_encode(F.col("pcm"))).withColumn("a", g711.alaw_encode(F.col("pcm")))
    s = s.withColumn("from_u", g711.ulaw_decode(F.col("u"))).withColumn("from_a", g711.alaw_decode(F.col("a")))
    u = s.groupBy(F.col("u").alias("code")).agg(F.count("*").alias("n_u"), F.max("from_u").alias("level_u"), F.min("pcm").alias("low_u"))
    a = s.groupBy(F.col("a").alias("code")).agg(F.count("*").alias("n_a"), F.max("from_a").alias("level_a"), F.min("pcm").alias("low_a"))
    return u.join(a, "code", "full")


def largest_remainder(spark, sf):
    w = B.load(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").cast("double").alias("weight"))
    return C.largest_remainder(w, 97)


def split_assign(spark, sf):
    """Customers dealt to splits by a hash of their key."""
    speakers = B.load(spark, sf, "customer").select("c_custkey")
    n = speakers.count()
    parts = C.largest_remainder(spark.createDataFrame([("train", 0.5), ("dev", 0.25), ("test", 0.25)], "name string, weight double"), n)
    parts = parts.withColumn("pos", F.when(F.col("name") == "train", 0).when(F.col("name") == "dev", 1).otherwise(2))
    return C.assign_splits(speakers, parts, F.md5(F.col("c_custkey").cast("string").cast("binary")), "c_custkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def waveform_peaks(spark, sf):
    e = B.load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return B.rounded(C.waveform_peaks(e.withColumn("x", F.col("x").cast("double")), "vec_id", "pos", "x", 10), "peak")


def pim_anchors(spark, sf):
    t = B.turns(spark, sf).select((F.col("n_tokens") / 10.0).alias("v"), F.pmod("call_id", F.lit(2)).alias("y"))
    return B.rounded(C.anchors(t, "v", "y"), "p10", "p90", "low", "high", "gap")


def manual_transcript(spark, sf):
    """Whole documents as pasted transcripts: their lines, some with a role, between two further turns."""
    text = F.regexp_replace(F.regexp_replace("text", r"[\r\x0B\x{0085}\x{2028}\x{2029}]", " "), r"\. ", "\nvictim: ")
    lines = F.concat_ws("\n", F.lit("Caller: hello there"), text, F.lit("  "), F.lit("note: this is a longer line"))
    t = T.manual_turns(B.load(spark, sf, "documents").select("doc_id", lines.alias("t")), "doc_id", "t")
    return B.rounded(t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "callee").alias("callee"), F.max("t_end").alias("t_end")), "t_end", to=3)


def kaldi_parse(spark, sf):
    d = B.load(spark, sf, "documents").select(F.concat(F.lit("utt"), F.pmod("doc_id", F.lit(97)).cast("string"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "\t").otherwise(" "), F.when(F.pmod("doc_id", F.lit(13)) == 0, "").otherwise(F.regexp_replace("text", r"[\r\n\x0B\f\x{0085}\x{2028}\x{2029}]", " "))).alias("value"), F.col("doc_id").alias("place"))
    return T.kaldi_lines(d)


def metadata_maps(spark, sf):
    n = B.load(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.when(F.pmod("c_custkey", F.lit(5)) == 0, "NA").otherwise(F.col("c_name")).alias("name"), F.when(F.pmod("c_custkey", F.lit(7)) == 0, "").otherwise(F.lit("x")).alias("flag"))
    m = T.metadata_rows(n, "uid")
    return m.select("uid", F.size("meta").alias("n"), F.try_element_at("meta", F.lit("name")).alias("name"))


def robocall_clean(spark, sf):
    d = B.load(spark, sf, "documents").select("doc_id", "text", F.when(F.pmod("doc_id", F.lit(4)) == 0, None).otherwise(F.col("lang")).alias("language"))
    return T.spoken_rows(d).groupBy("language").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def stem_join(spark, sf):
    p = B.load(spark, sf, "pages").select("page_id", F.concat(F.lit("a/b/"), F.col("page_id").cast("string"), F.lit(".v1.wav")).alias("path"))
    f = B.load(spark, sf, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".v1.txt")).alias("path"))
    return T.by_stem(p, f).select("page_id", "stem", "audio_path")


def utterance_join(spark, sf):
    files = B.load(spark, sf, "events").select(F.concat_ws("-", F.lit("s"), F.pmod("user_id", F.lit(50)).cast("string"), F.col("event_id").cast("string")).alias("uid"), F.col("value").alias("seconds"))
    texts = files.where(F.length("uid") % 2 == 0).select("uid", F.lit("words").alias("text"))
    meta = files.where(F.col("uid").endswith("1")).select("uid", F.lit("m").alias("meta"))
    u = T.utterances(files, texts, meta)
    return u.groupBy("speaker").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count("meta").alias("metas"))


def audio_paths(spark, sf):
    d = B.load(spark, sf, "pages").select("page_id", F.concat(F.lit("/abs/"), F.col("page_id").cast("string")).alias("a"), F.concat(F.lit("rel/"), F.col("page_id").cast("string")).alias("b"))
    listing = B.load(spark, sf, "pages").select(F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).when(F.pmod("page_id", F.lit(3)) == 1, F.concat(F.lit("rel/"), F.col("page_id").cast("string"))).otherwise("none").alias("path"))
    return T.first_existing(d, listing, [F.col("a"), F.col("b")], "page_id")


def majority_tags(spark, sf):
    """The most frequent language of each word: the per-word baseline tagger."""
    t = B.tagged(spark, sf).select(F.lower("token").alias("word"), F.when(F.length("token") > 3, "long").otherwise(F.col("lang")).alias("tag"))
    c = t.groupBy("word", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word").orderBy(F.desc("n"), "tag")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


QUERIES = {f.__name__: f for f in (
    roc_auc, det_curve, eer, min_tdcf, confusion_threshold, ablation, per_cell_accuracy, hard_subset, calibration_bins, brier_ece, codec_sweep, auc_odd_scores, det_odd_scores, score_quantiles, confound_audit, ood_recall, act_confusion, act_accuracy, corpus_counts, corpus_stats,
    per_speaker_counts, corpus_search, corpus_listing, risk_bands, finite_guard, g711_codes, largest_remainder, split_assign, waveform_peaks, pim_anchors, manual_transcript, kaldi_parse, metadata_maps, robocall_clean, stem_join, utterance_join, audio_paths, majority_tags,
)}


def auc_sql(source: str, group: str, score: str = "score") -> str:
    return f"""auc AS (SELECT {group}, CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / 2 AS r FROM {source}) GROUP BY 1)"""


def curve_sql(source: str, group: str) -> str:
    return f"""curve AS (SELECT {group}, threshold, CASE WHEN neg > 0 THEN fp / neg END AS fpr, 1 - CASE WHEN pos > 0 THEN tp / pos END AS fnr FROM (
    SELECT {group}, score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {group}) AS pos, sum(n) OVER (PARTITION BY {group}) AS neg
    FROM (SELECT {group}, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {group} ORDER BY score DESC))
  UNION ALL SELECT DISTINCT {group}, 'inf'::DOUBLE, 0, 1 FROM {source}),
  eer AS (SELECT {group}, arg_min((fpr + fnr) / 2, (abs(fpr - fnr), -threshold)) AS eer, arg_min(threshold, (abs(fpr - fnr), -threshold)) AS threshold FROM curve WHERE fpr IS NOT NULL AND fnr IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""


def rates_sql(source: str, group: str, threshold: float) -> str:
    r = "round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END, 6)"
    return f"""conf AS (SELECT {group}, tp, fp, fn, tn, {r.format(a='tp + tn', b='tp + fp + fn + tn')} AS accuracy, {r.format(a='tp', b='tp + fp')} AS precision, {r.format(a='tp', b='tp + fn')} AS recall, {r.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1
  FROM (SELECT {group}, count(*) FILTER (score >= {threshold} AND label = 1) AS tp, count(*) FILTER (score >= {threshold} AND label = 0) AS fp, count(*) FILTER (score < {threshold} AND label = 1) AS fn, count(*) FILTER (score < {threshold} AND label = 0) AS tn FROM {source} GROUP BY 1))"""


_S = B.SCORED_SQL
_BINS = "bins AS (SELECT lang, CASE " + " ".join(f"WHEN score >= {k / 10}::DOUBLE AND score {'<=' if k == 9 else '<'} {(k + 1) / 10}::DOUBLE THEN {k}" for k in range(10)) + " END AS bin, score, label FROM scored), cal AS (SELECT lang, bin, count(*) AS n, avg(score) AS predicted, avg(label) AS observed FROM bins WHERE bin IS NOT NULL GROUP BY ALL)"
_OTHER = f"{B.ACTED_SQL}, two AS (SELECT *, {B.ACT_SQL.replace('turn_index', '(turn_index + call_id % 2)')} AS other FROM acted)"
_REM = "row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, name) <= {total} - sum(floor(raw)) OVER ()"
_MANUAL = rf"""m AS (SELECT doc_id, list_filter(list_transform(string_split('Caller: hello there' || chr(10) || regexp_replace(regexp_replace(text, '[\r\x0B\x{{0085}}\x{{2028}}\x{{2029}}]', ' ', 'g'), '\. ', chr(10) || 'victim: ', 'g') || chr(10) || '  ' || chr(10) || 'note: this is a longer line', chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
      l AS (SELECT doc_id, unnest(l) AS line FROM m), r AS (SELECT doc_id, line, lower(trim(regexp_extract(line, '^([^:]{{1,11}}):(.*)$', 1))) AS role, trim(regexp_extract(line, '^([^:]{{1,11}}):(.*)$', 2)) AS rest FROM l),
      t AS (SELECT doc_id, role IN ('callee', 'victim', 'user') AS callee, 1 + 0.3 * len(regexp_extract_all(CASE WHEN role IN ('callee', 'victim', 'user', 'caller', 'agent') THEN rest ELSE line END, '{B.TOKEN.replace(chr(39), chr(39) * 2)}')) AS seconds FROM r)"""
ORACLES = {
    "roc_auc": f"WITH {_S}, {auc_sql('scored', 'lang')} SELECT lang, round(auc, 6) AS auc FROM auc",
    "det_curve": f"WITH {_S}, {curve_sql('scored', 'lang')} SELECT lang, threshold, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM curve WHERE threshold < 1e9",
    "auc_odd_scores": f"WITH {ODD_SQL}, byl AS (SELECT 'lang' AS kind, lang AS value, score, label FROM can UNION ALL SELECT 'source', source, score, label FROM can), kv AS (SELECT *, kind || ':' || value AS g FROM byl), {auc_sql('kv', 'g')} SELECT kv.kind, kv.value, round(any_value(auc), 6) AS auc FROM auc JOIN kv USING (g) GROUP BY 1, 2",
    "det_odd_scores": f"""WITH {ODD_SQL}, c AS (SELECT lang, score AS threshold, sum((label = 0)::INT) AS n, sum((label = 1)::INT) AS p FROM can GROUP BY 1, 2),
      r AS (SELECT lang, threshold, sum(n) OVER w / nullif(sum(n) OVER a, 0) AS fpr, 1 - sum(p) OVER w / nullif(sum(p) OVER a, 0) AS fnr FROM c WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC), a AS (PARTITION BY lang)),
      u AS (SELECT * FROM r UNION ALL SELECT DISTINCT lang, 'infinity'::DOUBLE, 0, 1 FROM odd)
      SELECT lang, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, CASE WHEN isinf(threshold) THEN sign(threshold)::INT ELSE 0 END AS infinite, CASE WHEN NOT isinf(threshold) THEN threshold END AS threshold FROM u""",
    "score_quantiles": f"WITH {ODD_SQL}, k AS (SELECT source, score FROM can WHERE abs(score) < 10), u AS (SELECT * FROM k UNION ALL SELECT 'all', score FROM k) SELECT source, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS {n}" for n, q in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p99", 0.99), ("top", 1.0), ("least", 0.0))) + " FROM u GROUP BY 1",
    "eer": f"WITH {_S}, {curve_sql('scored', 'lang')} SELECT lang, round(eer, 6) AS eer, round(threshold, 6) AS threshold FROM eer",
    "min_tdcf": f"WITH {_S}, {curve_sql('scored', 'lang')} SELECT lang, round(min(0.05 * fnr + 9.5 * fpr) / 0.05, 6) AS min_tdcf FROM curve GROUP BY 1",
    "confusion_threshold": f"WITH {_S}, {rates_sql('scored', 'lang', 0.65)} SELECT * FROM conf",
    "ablation": f"WITH {ARMS_SQL}, {auc_sql('arms', 'arm')}, {curve_sql('arms', 'arm')}, {rates_sql('arms', 'arm', 0.65)} SELECT conf.*, round(auc, 6) AS auc, round(eer, 6) AS eer FROM conf JOIN auc USING (arm) JOIN eer USING (arm)",
    "per_cell_accuracy": f"WITH {ARMS_SQL}, own AS (SELECT arm, lang || 'x' || label AS cell, avg(((score >= 0.65)::INT = label)::INT) AS accuracy, count(*) AS n FROM arms GROUP BY ALL), grid AS (SELECT arm, l || 'x' || y AS cell FROM (SELECT unnest(['full', 'half', 'turned']) AS arm), (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS l), (SELECT unnest([0, 1]) AS y)) SELECT arm, cell, round(accuracy, 6) AS accuracy, coalesce(n, 0) AS n FROM grid LEFT JOIN own USING (arm, cell)",
    "hard_subset": f"WITH {_S}, hard AS (SELECT * FROM scored WHERE quality = 0), {auc_sql('hard', 'lang')} SELECT lang, round(auc, 6) AS auc, n FROM auc JOIN (SELECT lang, count(*) AS n FROM hard GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT label) = 2) USING (lang)",
    "calibration_bins": f"WITH {_S}, {_BINS} SELECT lang, bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM cal",
    "brier_ece": f"WITH {_S}, {_BINS} SELECT lang, round(brier, 6) AS brier, round(ece, 6) AS ece FROM (SELECT lang, avg((score - label) * (score - label)) AS brier FROM scored GROUP BY 1) JOIN (SELECT lang, sum(n * abs(predicted - observed)) / sum(n) AS ece FROM cal GROUP BY 1) USING (lang)",
    "codec_sweep": f"WITH {_S}, x AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN NULL ELSE score END AS score) FROM scored), u AS (SELECT * FROM x WHERE score IS NOT NULL), {auc_sql('u', 'source')}, e AS (SELECT source, count(*) AS n, count(score) AS finite FROM x GROUP BY 1) SELECT source, n, finite, CASE WHEN finite >= greatest(8, ceil(0.6 * n)) THEN round(auc, 6) END AS auc FROM e LEFT JOIN auc USING (source)",
    "confound_audit": "WITH d AS (SELECT toxic AS label, length(text)::DOUBLE AS length, len(regexp_extract_all(text, chr(10)))::DOUBLE AS lines, len(regexp_extract_all(text, ','))::DOUBLE AS commas, n_chars::DOUBLE AS n_chars FROM documents JOIN labels USING (doc_id)), long AS (SELECT label, unnest(['length', 'lines', 'commas', 'n_chars']) AS stat, unnest([length, lines, commas, n_chars]) AS value FROM d), " + auc_sql("long", "stat", "value") + ", a AS (SELECT stat, greatest(auc, 1 - auc) AS auc FROM auc) SELECT stat, round(auc, 5) AS auc, round(m1, 5) AS mean_1, round(m0, 5) AS mean_0, CASE WHEN auc > 0.75 THEN 'stop' WHEN auc > 0.62 THEN 'warn' ELSE 'ok' END AS status FROM a JOIN (SELECT stat, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0 FROM long GROUP BY 1) USING (stat)",
    "ood_recall": f"WITH {_S} SELECT lang, round(avg((score >= 0.7)::INT) FILTER (label = 1), 6) AS recall, round(avg(score) FILTER (label = 1), 6) AS mean, round(quantile_cont(score, 0.1) FILTER (label = 1), 6) AS p10, round(quantile_cont(score, 0.5) FILTER (label = 1), 6) AS median, round(quantile_cont(score, 0.9) FILTER (label = 1), 6) AS p90, round(avg((score >= 0.7)::INT) FILTER (label = 0), 6) AS false_alarms FROM scored GROUP BY 1 HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0",
    "act_confusion": f"WITH {_OTHER} SELECT act, other, count(*) AS n FROM two WHERE act <> other GROUP BY ALL ORDER BY n DESC, act, other LIMIT 8",
    "act_accuracy": f"WITH {_OTHER} SELECT act, round(avg((act = other)::INT), 6) AS accuracy, count(*) AS n FROM two GROUP BY 1",
    "corpus_counts": "WITH d AS (SELECT lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END || 'x' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS cell FROM documents JOIN labels USING (doc_id)) SELECT lang, cell, source, CASE grouping(lang, cell, source) WHEN 3 THEN 'lang' WHEN 5 THEN 'cell' WHEN 6 THEN 'source' ELSE 'source+cell' END AS set, count(*) AS n FROM d GROUP BY GROUPING SETS ((lang), (cell), (source), (source, cell))",
    "corpus_stats": f"WITH {B.ACTED_SQL}, c AS (SELECT call_id, count(*) AS turns, sum(n_tokens) AS tokens, max(rank) AS peak FROM acted GROUP BY 1) SELECT count(*) AS calls, sum(turns)::BIGINT AS turns, round(avg(turns), 6) AS turns_per_call, round(sum(tokens) / sum(turns), 6) AS tokens_per_turn, round(avg(peak), 6) AS mean_peak FROM c",
    "per_speaker_counts": "SELECT format('spk_{:02d}', i) AS speaker_id, coalesce(n, 0) AS n FROM range(12) r(i) LEFT JOIN (SELECT call_id % 10 AS k, count(*) AS n FROM (SELECT DISTINCT conv_id AS call_id FROM conversations) GROUP BY 1) ON k = i",
    "corpus_search": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(source), 'rc1') OR contains(lower(lang), 'rc1') ORDER BY doc_id LIMIT 400",
    "corpus_listing": f"WITH {B.ACTED_SQL} SELECT call_id, count(*) AS n_turns, sum(n_tokens)::BIGINT AS n_tokens, arg_max(act, turn_index) AS last_act, md5(coalesce(string_agg(text, '|' ORDER BY turn_index) FILTER (speaker = 'caller'), '')) AS caller_text, round(avg(rank), 6) AS mean_rank, arg_min(act, turn_index) AS first_act, count(*) FILTER (speaker = 'callee') AS callee_turns, count(*) FILTER (rank >= 0.8) AS pressing, max(rank) AS peak, round(sum(greatest(0.7, n_tokens / 2.6)) + 0.25 * (count(*) - 1), 4) AS seconds, count(DISTINCT act) AS acts FROM acted GROUP BY 1",
    "risk_bands": f"WITH {_S} SELECT CASE WHEN score < 0.35 THEN 'low' WHEN score < 0.65 THEN 'elevated' WHEN score < 0.85 THEN 'high' ELSE 'critical' END AS band, count(*) AS n, sum(label)::BIGINT AS positive FROM scored GROUP BY 1",
    "finite_guard": "SELECT event_type, round(sum(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0 ELSE value END), 3) AS total, count(*) AS n FROM events GROUP BY 1",
    "g711_codes": """WITH x AS (SELECT greatest(-32768, least(32767, round(unnest(embedding)::DOUBLE * 32767)))::INT AS i FROM embeddings), s AS (SELECT i AS pcm, i >> 2 AS p, i >> 3 AS q FROM x WHERE i IS NOT NULL),
      v AS (SELECT *, least(abs(p), 8159) + 33 AS v, CASE WHEN q >= 0 THEN q ELSE -q - 1 END AS w FROM s),
      g AS (SELECT *, CASE WHEN v <= 63 THEN 0 WHEN v <= 127 THEN 1 WHEN v <= 255 THEN 2 WHEN v <= 511 THEN 3 WHEN v <= 1023 THEN 4 WHEN v <= 2047 THEN 5 WHEN v <= 4095 THEN 6 WHEN v <= 8191 THEN 7 ELSE 8 END AS us,
            CASE WHEN w <= 31 THEN 0 WHEN w <= 63 THEN 1 WHEN w <= 127 THEN 2 WHEN w <= 255 THEN 3 WHEN w <= 511 THEN 4 WHEN w <= 1023 THEN 5 WHEN w <= 2047 THEN 6 ELSE 7 END AS s FROM v),
      c AS (SELECT pcm, CASE WHEN us >= 8 THEN xor(127, CASE WHEN p < 0 THEN 127 ELSE 255 END) ELSE xor((least(us, 7) << 4) | ((v >> (least(us, 7) + 1)) & 15), CASE WHEN p < 0 THEN 127 ELSE 255 END) END AS u,
            xor((s << 4) | ((w >> (CASE WHEN s < 2 THEN 1 ELSE s END)) & 15), CASE WHEN q >= 0 THEN 213 ELSE 85 END) AS a FROM g),
      t AS (SELECT *, 255 - u AS y, xor(a, 85) AS z FROM c),
      d AS (SELECT *, ((((y & 15) << 3) + 132) << ((y & 112) >> 4)) AS ut, (z & 112) >> 4 AS zs, (z & 15) << 4 AS zt FROM t),
      e AS (SELECT pcm, u, a, CASE WHEN (y & 128) <> 0 THEN 132 - ut ELSE ut - 132 END AS fu, CASE WHEN (z & 128) <> 0 THEN 1 ELSE -1 END * CASE WHEN zs = 0 THEN zt + 8 WHEN zs = 1 THEN zt + 264 ELSE (zt + 264) << (zs - 1) END AS fa FROM d)
      SELECT * FROM (SELECT u AS code, count(*) AS n_u, max(fu) AS level_u, min(pcm) AS low_u FROM e GROUP BY 1) FULL JOIN (SELECT a AS code, count(*) AS n_a, max(fa) AS level_a, min(pcm) AS low_a FROM e GROUP BY 1) USING (code)""",
    "largest_remainder": f"WITH w AS (SELECT source AS name, 97 * count(*)::DOUBLE / sum(count(*)) OVER () AS raw FROM documents GROUP BY 1) SELECT name, (floor(raw) + ({_REM.format(total=97)})::INT)::BIGINT AS n FROM w",
    "split_assign": "WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer), w AS (SELECT name, s, n * s AS raw, n FROM (SELECT unnest(['train', 'dev', 'test']) AS name, unnest([0.5, 0.25, 0.25]) AS s), (SELECT count(*) AS n FROM customer)), q AS (SELECT name, floor(raw) + (row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, name) <= n - sum(floor(raw)) OVER ())::INT AS m FROM w), c AS (SELECT max(m) FILTER (name = 'train') AS a, max(m) FILTER (name = 'dev') AS b FROM q) SELECT CASE WHEN k < a THEN 'train' WHEN k < a + b THEN 'dev' ELSE 'test' END AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM k, c GROUP BY 1",
    "waveform_peaks": "WITH e AS (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS x, unnest(range(len(embedding))) AS pos, len(embedding) AS n FROM embeddings), p AS (SELECT vec_id, floor(pos * 10 / n)::INT AS bin, max(x) AS peak FROM e GROUP BY ALL) SELECT vec_id, bin, round(peak / max(peak) OVER (PARTITION BY vec_id), 6) AS peak FROM p",
    "pim_anchors": f"WITH {B.TURNS_SQL}, a AS (SELECT count(*) AS n, quantile_cont(n_tokens / 10.0, 0.1) AS p10, quantile_cont(n_tokens / 10.0, 0.9) AS p90, quantile_cont(n_tokens / 10.0, 0.5) FILTER (call_id % 2 = 0) AS low, quantile_cont(n_tokens / 10.0, 0.5) FILTER (call_id % 2 = 1) AS high FROM turns), g AS (SELECT *, (high - low) / nullif(p90 - p10, 0) AS gap FROM a) SELECT n, round(p10, 6) AS p10, round(p90, 6) AS p90, round(low, 6) AS low, round(high, 6) AS high, round(gap, 6) AS gap, CASE WHEN n < 30 THEN 'few' WHEN gap IS NULL OR abs(gap) < 0.05 THEN 'flat' WHEN gap < 0 THEN 'wrong' ELSE 'ok' END AS status FROM g",
    "manual_transcript": f"WITH {_MANUAL} SELECT doc_id, count(*) AS n, count(*) FILTER (callee) AS callee, round(sum(seconds) + 0.3 * (count(*) - 1), 3)::DOUBLE AS t_end FROM t GROUP BY 1",
    "kaldi_parse": r"WITH l AS (SELECT 'utt' || doc_id % 97 || CASE WHEN doc_id % 3 = 0 THEN chr(9) ELSE ' ' END || CASE WHEN doc_id % 13 = 0 THEN '' ELSE regexp_replace(text, '[\r\n\x0B\f\x{0085}\x{2028}\x{2029}]', ' ', 'g') END AS value, doc_id FROM documents), p AS (SELECT regexp_extract(value, '^(\S+)[\t ]+(.*\S)\s*$', 1) AS uid, regexp_extract(value, '^(\S+)[\t ]+(.*\S)\s*$', 2) AS text, doc_id FROM l) SELECT uid, arg_max(text, doc_id) AS text FROM p WHERE uid <> '' GROUP BY 1",
    "metadata_maps": "SELECT c_custkey AS uid, (c_custkey % 5 <> 0)::INT + (c_custkey % 7 <> 0)::INT AS n, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer",
    "robocall_clean": r"SELECT CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE coalesce(lang, 'en') END AS language, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE len(regexp_extract_all(text, '[^\s]+')) >= 4 GROUP BY 1",
    "stem_join": "SELECT page_id, page_id || '.v1' AS stem, '/x/' || page_id || '.v1.txt' AS audio_path FROM pages JOIN documents ON page_id = doc_id",
    "utterance_join": "WITH f AS (SELECT 's-' || user_id % 50 || '-' || event_id AS uid, 's-' || user_id % 50 AS speaker FROM events WHERE value BETWEEN 1.5 AND 20) SELECT speaker, count(*) AS n, count(*) FILTER (length(uid) % 2 = 0) AS texts, count(*) FILTER (ends_with(uid, '1')) AS metas FROM f GROUP BY 1",
    "audio_paths": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'rel/' || page_id END AS path FROM pages",
    "majority_tags": f"WITH {B.TAGGED_SQL}, c AS (SELECT lower(token) AS word, CASE WHEN length(token) > 3 THEN 'long' ELSE lang END AS tag, count(*) AS n FROM tagged GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS k FROM c) SELECT word, tag, n FROM r WHERE k = 1",
}
