"""Window and sequence operators over flat tables (turns, tokens, frames)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip
from ..storage import staged


def running(*keys: str, order: list[str]):
    """From the first row of the key to the present one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def bio_spans(tagged: DataFrame, keys: list[str], pos: str = "pos", tag: str = "tag") -> DataFrame:
    """(keys, type, tok_start, tok_end) of each span of BIO tags; the end is exclusive.

    A span starts at any tag with a type, but for an I- behind a tag of the same type; a stray I-
    starts one. Tags without a hyphen are outside.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    kind = F.when((F.col(tag) != "O") & F.col(tag).contains("-"), F.substring_index(F.col(tag), "-", -1))
    df = tagged.withColumn("__type", kind).withColumn("__prev", F.lag(kind).over(w))
    start = F.col("__type").isNotNull() & ~(F.col(tag).startswith("I-") & F.col("__type").eqNullSafe(F.col("__prev")))
    df = df.withColumn("__island", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = df.where(F.col("__type").isNotNull())
    return inside.groupBy(*keys, "__island", F.col("__type").alias("type")).agg(F.min(pos).alias("tok_start"), (F.max(pos) + 1).alias("tok_end")).drop("__island")


def language_switches(tagged: DataFrame, key: str, order: list[str], lang: str = "lang", universal: str = "univ") -> DataFrame:
    """(key, from, to) for each adjacent pair of language tokens, universal ones left out."""
    w = Window.partitionBy(key).orderBy(*order)
    only = tagged.where(F.col(lang) != universal)
    return only.select(key, F.lag(lang).over(w).alias("before"), F.col(lang).alias("after")).where("before IS NOT NULL")


def code_mixing(tagged: DataFrame, key: str, order: list[str], first: str, second: str, lang: str = "lang") -> DataFrame:
    """The code-mixing summary of each key: counts, ratios over all tokens, the index, switch points,
    their rate and the normalised entropy of transitions. No language tokens: 0 throughout."""
    counts = tagged.groupBy(key).agg(F.count("*").alias("n_tokens"), F.count_if(F.col(lang) == first).alias("n_first"), F.count_if(F.col(lang) == second).alias("n_second"))
    pairs = language_switches(tagged, key, order, lang).groupBy(key, "before", "after").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(key))
    p = F.col("c") / total
    steps = pairs.select(key, "before", "after", "c", (-p * F.log2(p)).alias("h")).groupBy(key).agg(F.sum(F.when(F.col("before") != F.col("after"), F.col("c")).otherwise(0)).alias("s"), (F.sum("h") / 2).alias("e"))
    n, mixed = F.col("n_tokens"), F.col("n_first") + F.col("n_second")
    return counts.join(steps, key, "left").select(
        key, n.alias("n_tokens"), (F.col("n_first") / n).alias("first_ratio"), (F.col("n_second") / n).alias("second_ratio"), ((n - mixed) / n).alias("univ_ratio"),
        F.when(mixed > 0, 1 - F.greatest("n_first", "n_second") / mixed).otherwise(0.0).alias("cmi"),
        F.coalesce("s", F.lit(0)).cast("long").alias("switch_points"), (F.coalesce("s", F.lit(0)) / F.greatest(F.lit(1), mixed - 1)).alias("switch_rate"), F.coalesce("e", F.lit(0.0)).alias("switch_entropy"),
    )


@F.pandas_udf(T.DoubleType())
def _covariance(x: pd.Series, y: pd.Series) -> pd.Series:
    """The population covariance of two arrays, in one pass in their order; none for empty arrays."""

    def one(xs, ys):
        mean_x = mean_y = moment = 0.0
        for n, (a, b) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True), 1):
            off = a - mean_x
            mean_x += off / n
            mean_y += (b - mean_y) / n
            moment = math.fma(off, b - mean_y, moment)
        return moment / len(xs) if len(xs) else None

    return pd.Series([one(*p) for p in zip(x, y, strict=True)], dtype=float)


def slope(points: str, spread: str) -> Column:
    """Least squares of y on x for an array of points (x, y), in order, and the variance of x; 0 without any
    spread of x, clipped to one. Products are added with one rounding and in a stated order: a slope that is
    compared with a bound or with zero comes out as in SQL, on any number of tasks."""
    covariance = _covariance(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))
    return clip(F.when(F.col(spread) > 0, F.try_divide(covariance, F.col(spread))).otherwise(0.0), -1.0, 1.0)


def coercion(turns: DataFrame, key: str = "call_id") -> DataFrame:
    """(key, coercion_slope, coercion_peak, coercion_mean, first_pressure_turn, callee_resist, peak_act)
    of turns with act and rank: the caller's turns, but for resistance, the share of the others."""
    caller, other = F.col("speaker") == "caller", F.col("speaker") != "caller"
    t = turns.withColumn("__x", F.when(caller, F.col("turn_index").cast("double"))).withColumn("__y", F.when(caller, F.col("rank")))
    point = F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    spread = F.when((F.count("__x") >= 2) & (F.var_pop("__x") * F.count("__x") > 1e-12), F.var_pop("__x"))
    out = t.groupBy(key).agg(
        F.sort_array(F.collect_list(point)).alias("__points"), spread.alias("__spread"), F.coalesce(F.max("__y"), F.lit(0.0)).alias("coercion_peak"), F.coalesce(F.avg("__y"), F.lit(0.0)).alias("coercion_mean"),
        F.coalesce(F.min(F.when(F.col("__y") >= 0.5, F.col("turn_index"))), F.lit(-1)).alias("first_pressure_turn"),
        F.coalesce(F.avg(F.when(other, F.col("act").isin("VICTIM_RESIST", "VICTIM_QUESTION").cast("double"))), F.lit(0.0)).alias("callee_resist"),
        F.max_by(F.when(caller, F.col("act")), F.when(caller, F.struct("__y", -F.col("turn_index")))).alias("peak_act"),
    )
    return out.select(key, slope("__points", "__spread").alias("coercion_slope"), "coercion_peak", "coercion_mean", "first_pressure_turn", "callee_resist", "peak_act")


def markov_fit(turns: DataFrame, label: str, acts: list[str], alpha: float, key: str = "call_id") -> tuple[DataFrame, DataFrame]:
    """Add-alpha act chains by class: (label, act, log_pi) and (label, act, next_act, log_a), dense over
    the 18 acts. Acts out of the list are dropped before they are paired."""
    spark = turns.sparkSession
    w = Window.partitionBy(key).orderBy("turn_index")
    known = turns.where(F.col("act").isin(*acts)).select(label, "act", F.lag("act").over(w).alias("before"))
    grid = spark.createDataFrame([(a,) for a in acts], "act string").coalesce(1)
    labels = spark.createDataFrame([(0,), (1,)], f"{label} int").coalesce(1)
    firsts = known.where("before IS NULL").groupBy(label, "act").agg(F.count("*").alias("n"))
    steps = known.where("before IS NOT NULL").groupBy(label, F.col("before").alias("act"), F.col("act").alias("next_act")).agg(F.count("*").alias("n"))
    per = Window.partitionBy(label)
    a = F.coalesce("n", F.lit(0)) + alpha
    pi = labels.crossJoin(grid).join(firsts, [label, "act"], "left").select(label, "act", F.log(a / F.sum(a).over(per)).alias("log_pi"))  # 36 rows
    row = Window.partitionBy(label, "act")
    dense = labels.crossJoin(grid).crossJoin(grid.withColumnRenamed("act", "next_act"))  # 648 rows
    trans = dense.join(steps, [label, "act", "next_act"], "left").select(label, "act", "next_act", F.log(a / F.sum(a).over(row)).alias("log_a"))
    return pi, trans


def markov_llr(turns: DataFrame, pi: DataFrame, trans: DataFrame, label: str, key: str = "call_id") -> DataFrame:
    """(key, act_scam_llr): the log-likelihood ratio for each act of a call, clipped to ten."""
    w = Window.partitionBy(key).orderBy("turn_index")
    first = pi.groupBy(F.col("act")).agg(F.sum(F.when(F.col(label) == 1, F.col("log_pi")).otherwise(-F.col("log_pi"))).alias("lp"))
    step = trans.groupBy("act", "next_act").agg(F.sum(F.when(F.col(label) == 1, F.col("log_a")).otherwise(-F.col("log_a"))).alias("la"))
    known = turns.join(F.broadcast(first), "act").select(key, "turn_index", "act", "lp")
    known = known.withColumn("before", F.lag("act").over(w))
    joined = known.join(F.broadcast(step.withColumnsRenamed({"act": "before", "next_act": "now"})).withColumnRenamed("before", "b"), (F.col("before") == F.col("b")) & (F.col("act") == F.col("now")), "left")
    value = F.when(F.col("before").isNull(), F.col("lp")).otherwise(F.col("la"))
    return joined.groupBy(key).agg(clip(F.sum(value) / F.count("*"), -10.0, 10.0).alias("act_scam_llr"))


def timings(turns: DataFrame, n_tokens: str, key: str = "call_id", rate: float = 2.6, least: float = 0.7, pause: float = 0.0, gap: float = 0.25) -> DataFrame:
    """Adds (t_start, t_end) estimated from token counts: max(least, n / rate) and a pause, then a gap."""
    w = Window.partitionBy(key).orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    length = F.greatest(F.lit(least), F.col(n_tokens) / rate) + pause
    end = F.sum(length).over(w) + gap * (F.count("*").over(w) - 1)
    return turns.withColumn("t_end", end).withColumn("t_start", F.col("t_end") - length)


def running_totals(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds, under new names, the sums of columns over all rows of the group up to each row, in order, and
    ``<name>_all``, those over the whole group; groups may be few and large.

    Two steps: rows are dealt to ranges of (group, order) and staged, each range is a window of its own, and
    the ranges' sums are added up in a second, small window. So no task holds a group."""
    ranges = df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    own = ranges.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    parts = Window.partitionBy(*group)
    before = parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = own.select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums], *[F.sum(f"__{n}").over(parts).alias(f"{n}_all") for n in sums])
    same = F.col("__part") == F.col("__of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    within = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(offsets, same)
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).select(*df.columns, *sums, *[f"{n}_all" for n in sums])


def laid_out(parts: DataFrame, key: str, order: list[str], seconds: str, gap: float = 0.25) -> DataFrame:
    """Adds (t_start, t_end) of parts that follow each other with a gap between them."""
    t = running_totals(parts, [key], order, {"__upto": F.col(seconds), "__place": F.lit(1)})
    return t.withColumn("t_end", F.col("__upto") + gap * (F.col("__place") - 1)).withColumn("t_start", F.col("t_end") - F.col(seconds)).select(*parts.columns, "t_end", "t_start")


def delta_regression(frames: DataFrame, key: str, pos: str, value: str, reach: int = 2) -> DataFrame:
    """Adds ``delta``: the regression slope over ``reach`` frames to either side, edges replicated."""
    w = Window.partitionBy(key).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    up = sum((n * (F.coalesce(F.lead(value, n).over(w), last) - F.coalesce(F.lag(value, n).over(w), first)) for n in range(1, reach + 1)), F.lit(0.0))
    return frames.withColumn("delta", up / (2 * sum(n * n for n in range(1, reach + 1))))


def normalised(frames: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``cmvn``: the value by mean and population deviation of its key; constants become 0."""
    w = Window.partitionBy(key)
    sd = F.stddev_pop(value).over(w)
    return frames.withColumn("cmvn", F.when(sd > 1e-10, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def context_stack(frames: DataFrame, key: str, pos: str, value: str, left: int = 1, right: int = 1) -> DataFrame:
    """Adds ``context``: the neighbours' values as an array, edges replicated."""
    w = Window.partitionBy(key).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    cells = [F.coalesce(F.lag(value, n).over(w), first) for n in range(left, 0, -1)] + [F.col(value)] + [F.coalesce(F.lead(value, n).over(w), last) for n in range(1, right + 1)]
    return frames.withColumn("context", F.array(*cells))


def true_runs(frames: DataFrame, key: str, pos: str, flag: str, least: int = 1) -> DataFrame:
    """(key, start, end) of maximal runs of true of ``least`` frames or more; the end is exclusive."""
    w = Window.partitionBy(key).orderBy(pos)
    on = frames.withColumn("__k", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(flag)
    return on.groupBy(key, "__k").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).where(F.col("end") - F.col("start") >= least).drop("__k")


def differences(frames: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, pos, value) of each frame's step from the one before."""
    w = Window.partitionBy(key).orderBy(pos)
    return frames.select(key, pos, (F.col(value) - F.lag(value).over(w)).alias(value)).where(F.col(value).isNotNull())


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, std, skew, kurtosis): population moments; skew and excess kurtosis are 0 where the
    variance is."""
    flat = F.var_pop(value) <= 1e-10
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.when(flat, 0.0).otherwise(F.skewness(value)).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis(value)).alias("kurtosis"))


def voice_rescoring(turns: DataFrame, value: str, gap_ms: int = 4000, window_ms: int = 20000, key: str = "call_id") -> DataFrame:
    """(key, turn_index, t_ms, rescored, scored_at, voice): the throttled voice score after each turn.

    A score is taken anew once ``gap_ms`` of audio have come since the last one, on the turns that end
    within the trailing ``window_ms``; until then the last one stands. The trailing means are one RANGE
    frame; which of them count is a fold over a call's own turns, since each reset depends on the last."""
    order = Window.partitionBy(key).orderBy("turn_index")
    length = F.greatest(F.lit(700), F.round(F.col("n_tokens") * 1000 / 2.6)).cast("long")
    t = turns.withColumn("t_ms", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 250 * (F.row_number().over(order) - 1))
    trailing = Window.partitionBy(key).orderBy("t_ms").rangeBetween(1 - window_ms, 0)
    t = t.withColumn("__mean", F.avg(value).over(trailing))
    calls = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("turn_index").cast("long").alias("turn_index"), "t_ms", "__mean"))).alias("x"))  # a call's own turns
    none = F.expr("CAST(array() AS array<struct<turn_index:long,t_ms:long,rescored:boolean,scored_at:long,voice:double>>)")

    def after(done, x):
        last = F.try_element_at(done, F.lit(-1))
        fresh = (F.size(done) == 0) | (x["t_ms"] - last["scored_at"] >= gap_ms)
        row = F.struct(x["turn_index"].alias("turn_index"), x["t_ms"].alias("t_ms"), fresh.alias("rescored"), F.when(fresh, x["t_ms"]).otherwise(last["scored_at"]).alias("scored_at"), F.when(fresh, x["__mean"]).otherwise(last["voice"]).alias("voice"))
        return F.concat(done, F.array(row))

    return calls.select(key, F.explode(F.aggregate("x", none, after)).alias("r")).select(key, "r.*")


def hangover(frames: DataFrame, key: str, order: str, on: str, gap: int, burst: int, pad: int) -> DataFrame:
    """(key, start, end) of the smoothed true stretches of frames numbered from 0: silences of fewer than
    ``gap`` frames are filled, then bursts of fewer than ``burst`` dropped, then each stretch is padded by
    ``pad`` frames within the signal, and those that meet are one. A null frame is silence.

    Each step works on runs, not frames: only the first window sees a row for each frame."""
    value = F.coalesce(F.col(on), F.lit(False))
    t = frames.select(key, F.col(order).alias("__o"), value.alias("__v")).withColumn("__new", F.coalesce((F.col("__v") != F.lag("__v").over(Window.partitionBy(key).orderBy("__o"))).cast("int"), F.lit(1)))
    t = t.withColumn("__run", F.sum("__new").over(Window.partitionBy(key).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy(key, "__run", F.col("__v").alias("v")).agg(F.min("__o").alias("start"), (F.max("__o") + 1).alias("end"))
    filled = runs.withColumn("v", F.col("v") | (F.col("end") - F.col("start") < gap))
    by = Window.partitionBy(key).orderBy("start")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col("v") != F.lag("v").over(by)).cast("int"), F.lit(1))
    merged = filled.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(upto)).groupBy(key, "__run", "v").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    size = F.max("end").over(Window.partitionBy(key))
    wide = merged.withColumn("__size", size).where(F.col("v") & (F.col("end") - F.col("start") >= burst))
    wide = wide.select(key, F.greatest(F.lit(0), F.col("start") - pad).alias("start"), F.least("__size", F.col("end") + pad).alias("end"))
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = wide.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(upto))
    return joined.groupBy(key, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")
