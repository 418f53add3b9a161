"""From turn scores to a call's risk: pooling, densities, mismatch, prefix scoring and its timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, finite
from ..schema import FEATURES, arm_features, risk_band
from ..storage import staged
from .metrics import with_percentiles
from .sequences import running

# The entity types that are features.
ENTITY_FEATURES = {"OTP": "ent_otp", "AUTHORITY_CLAIM": "ent_authority", "THREAT_DEADLINE": "ent_threat", "PAYMENT_HANDLE": "ent_payment", "PERSONAL_INFO_REQ": "ent_personal", "BANK_ENTITY": "ent_bank"}


def pooled_intent(peak: Column, mean: Column) -> Column:
    return clip(0.6 * peak + 0.4 * mean, 0.0, 1.0)


def intent_pool(turns: DataFrame, score: str, key: str = "call_id") -> DataFrame:
    """(key, intent_max_turn, intent_score) over the caller's turns; none: 0."""
    own = F.when(F.col("speaker") == "caller", F.col(score))
    peak, mean = F.coalesce(F.max(own), F.lit(0.0)), F.coalesce(F.avg(own), F.lit(0.0))
    return turns.groupBy(key).agg(peak.alias("intent_max_turn"), pooled_intent(peak, mean).alias("intent_score"))


def rule_pool(turns: DataFrame, score: str, key: str = "call_id") -> DataFrame:
    """(key, intent_score) as half mean and half peak of the caller's turns; none: 0."""
    own = F.when(F.col("speaker") == "caller", F.col(score))
    return turns.groupBy(key).agg((0.5 * F.coalesce(F.avg(own), F.lit(0.0)) + 0.5 * F.coalesce(F.max(own), F.lit(0.0))).alias("intent_score"))


def pool_features(turns: DataFrame, score: str, key: str = "call_id") -> DataFrame:
    """(key, top, mean, top2, share_high, log_n): what a call-level pooler sees of its turn scores."""
    top = F.slice(F.sort_array(F.collect_list(score), False), 1, 2)  # a call's own turns
    return turns.groupBy(key).agg(F.max(score).alias("top"), F.avg(score).alias("mean"), F.aggregate(top, F.lit(0.0), lambda a, x: a + x).alias("__s"), F.size(top).alias("__n"), F.avg((F.col(score) > 0.5).cast("double")).alias("share_high"), F.log1p(F.count(score)).alias("log_n")).withColumn("top2", F.col("__s") / F.col("__n")).drop("__s", "__n")


def entity_density(spans: DataFrame, totals: DataFrame, key: str = "call_id") -> DataFrame:
    """(key, one column per entity feature): spans of each type in 100 tokens of all turns."""
    counts = spans.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in ENTITY_FEATURES.items()])
    per = lambda n: (100.0 * F.coalesce(F.col(n), F.lit(0)) / F.greatest(F.col("n_tokens"), F.lit(1))).alias(n)
    return totals.join(counts, key, "left").select(key, *[per(n) for n in ENTITY_FEATURES.values()])


def mismatch(turns: DataFrame, lex: str, aco: str, key: str = "call_id") -> DataFrame:
    """(key, gap, corr, incoherence, pim) of the two arousal traces of each call."""
    low, flat = F.col(lex), F.col(aco)
    short = clip(low - flat, 0.0, 1.0)
    gap = F.when(F.sum(low) > 1e-9, F.sum(low * short) / F.sum(low)).otherwise(0.0)
    spread = (F.count("*") >= 3) & (F.stddev_pop(lex) > 1e-6) & (F.stddev_pop(aco) > 1e-6)
    corr = F.when(spread, F.coalesce(F.try_divide(F.covar_pop(lex, aco), F.stddev_pop(lex) * F.stddev_pop(aco)), F.lit(0.0))).otherwise(0.0)
    out = turns.groupBy(key).agg(gap.alias("gap"), corr.alias("corr"), clip(F.max(lex), 0.0, 1.0).alias("__p"))
    inc = clip((1 - F.col("corr")) / 2, 0.0, 1.0)
    return out.select(key, "gap", "corr", inc.alias("incoherence"), clip(0.65 * F.col("gap") + 0.35 * inc * F.col("__p"), 0.0, 1.0).alias("pim"))


def fallback_risk(f: dict[str, Column] | None = None) -> Column:
    """The untrained risk of the features given (columns of those names by default, absent: 0)."""
    get = lambda n: finite(f[n]) if f and n in f else (F.lit(0.0) if f is not None else finite(F.col(n)))
    pressed = clip((get("ent_otp") + get("ent_personal") + get("ent_authority") + get("ent_threat")) / 6.0, 0.0, 1.0)
    climb = clip(2.0 * get("coercion_slope"), 0.0, 1.0)
    return clip(0.30 * get("intent_score") + 0.22 * get("as_score") + 0.20 * get("pim") + 0.14 * pressed + 0.14 * climb, 0.0, 1.0)


def fallback_contributions(features: DataFrame, key: str, f: dict[str, Column]) -> DataFrame:
    """(key, feature, contribution): what each of the untrained risk's five terms adds, largest first."""
    get = lambda n: finite(f[n]) if n in f else F.lit(0.0)
    terms = {
        "intent_score": 0.30 * get("intent_score"), "as_score": 0.22 * get("as_score"), "pim": 0.20 * get("pim"),
        "entities": 0.14 * clip((get("ent_otp") + get("ent_personal") + get("ent_authority") + get("ent_threat")) / 6.0, 0.0, 1.0), "coercion_slope": 0.14 * clip(2.0 * get("coercion_slope"), 0.0, 1.0),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("contribution")) for n, c in terms.items()])
    ranked = F.array_sort(cells, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return features.select(key, F.posexplode(ranked).alias("place", "x")).select(key, (F.col("place") + 1).alias("place"), "x.feature", "x.contribution")


def running_slope(w, x: Column, y: Column) -> Column:
    """The least-squares slope up to each row, from running sums; null points do not count."""
    x = F.when(y.isNotNull(), x)
    n, sx, sy, sxy, sxx = F.count(y).over(w), F.sum(x).over(w), F.sum(y).over(w), F.sum(x * y).over(w), F.sum(x * x).over(w)
    spread = n * sxx - sx * sx
    return F.when((n >= 2) & (spread > 1e-9), clip((n * sxy - sx * sy) / spread, -1.0, 1.0)).otherwise(0.0)


def prefix_timeline(turns: DataFrame, threshold: float = 0.65, key: str = "call_id") -> DataFrame:
    """The risk after each turn of each call, by running aggregates: one window, no re-scoring.

    Turns carry speaker, rank, score (the turn's intent), n_tokens, n_pressed (entities of the four
    pressing types), t_end. Adds intent, slope, peak, resist, risk, band, dt and alert (the first
    turn at or above the threshold).
    """
    w = running(key, order=["turn_index"])
    own = F.col("speaker") == "caller"
    rank, score = F.when(own, F.col("rank")), F.when(own, F.col("score"))
    intent = F.coalesce(pooled_intent(F.max(score).over(w), F.avg(score).over(w)), F.lit(0.0))
    slope = running_slope(w, F.col("turn_index").cast("double"), rank)
    pressed = 100.0 * F.sum("n_pressed").over(w) / F.greatest(F.sum("n_tokens").over(w), F.lit(1))
    resist = F.coalesce(F.avg(F.when(~own, F.col("act").isin("VICTIM_RESIST", "VICTIM_QUESTION").cast("double"))).over(w), F.lit(0.0))
    out = turns.withColumns({"intent": intent, "slope": slope, "peak": F.coalesce(F.max(rank).over(w), F.lit(0.0)), "resist": resist, "__e": pressed})
    risk = fallback_risk({"intent_score": F.col("intent"), "ent_otp": F.col("__e"), "coercion_slope": F.col("slope")})
    out = out.withColumn("risk", risk).withColumn("band", risk_band(F.col("risk"))).drop("__e")
    before = Window.partitionBy(key).orderBy("turn_index")
    out = out.withColumn("dt", F.greatest(F.lit(0.0), F.col("t_end") - F.coalesce(F.lag("t_end").over(before), F.lit(0.0))))
    high = (F.col("risk") >= threshold).cast("int")
    return out.withColumn("alert", (high == 1) & (F.sum(high).over(w) == 1))


def time_to_detection(timeline: DataFrame, threshold: float, key: str = "call_id") -> DataFrame:
    """(key, ttd, ttd_turns) of the first turn at or above the threshold; null where none is."""
    high = F.when(F.col("risk") >= threshold, F.col("turn_index"))
    return timeline.groupBy(key).agg(F.min_by("t_end", high).alias("ttd"), F.min(high).alias("ttd_turns"))


def ttd_stats(found: DataFrame, group: list[str]) -> DataFrame:
    """(group, counts, rate, mean, extremes, percentiles) of detection times; calls never detected count in the rate.
    The times are staged: they are read once for each summary, and made once."""
    found = staged(found.select(*group, "ttd", "ttd_turns"), "ttd")
    c = found.groupBy(*group).agg(F.count("ttd").alias("detected"), F.count("*").alias("total"), (F.count("ttd") / F.count("*")).alias("detection_rate"), F.avg("ttd").alias("mean"), F.min("ttd").alias("min"), F.max("ttd").alias("max"))
    c = with_percentiles(c, found, group, "ttd", {"median": 0.5, "p90": 0.9})
    return with_percentiles(c, found, group, "ttd_turns", {"median_turns": 0.5})


def new_entities(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of the spans that share their keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return spans.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def linear_contributions(features: DataFrame, key: str, model: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(key, feature, value, contribution) of a linear model name -> (weight, mean, deviation): weight
    times the standardised value; a deviation under 1e-8 counts as 1."""
    cells = [F.struct(F.lit(n).alias("feature"), finite(F.col(n).cast("double")).alias("value"), (w * (finite(F.col(n).cast("double")) - m) / (s if s >= 1e-8 else 1.0)).alias("contribution")) for n, (w, m, s) in model.items()]
    return features.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")


def top_contributions(contributions: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def feature_vector(df: DataFrame, key: str, arm: str = "full") -> DataFrame:
    """(key, the arm's features): absent ones are 0, unusable values too."""
    return df.select(key, *[(finite(F.col(n).cast("double")) if n in df.columns else F.lit(0.0)).alias(n) for n in arm_features(arm)])


def heuristic_voice() -> Column:
    """The fallback log-odds of a synthetic voice, from five measurements. The references, scales and
    weights are fixed values."""
    ratio = lambda n, ref, w: w * clip(F.log(F.greatest(ref / F.greatest(finite(F.col(n)), F.lit(1e-6)), F.lit(1e-6))), -2.0, 2.0)
    diff = lambda n, ref, scale, w: w * clip((finite(F.col(n)) - ref) / scale, -2.0, 2.0)
    return ratio("jitter", 0.0080, 1.10) + ratio("shimmer", 0.0450, 0.90) + ratio("spec_flatness_var", 0.0022, 0.35) + diff("hnr", 13.0, 6.0, 0.55) + diff("spk_consistency", 0.0, 0.10, 0.45)


def feature_groups() -> dict[str, str]:
    return {name: group for name, group, _ in FEATURES}
