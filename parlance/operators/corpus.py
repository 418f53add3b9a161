"""Corpus statistics, planning and source-shaped transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .metrics import with_percentiles


def counts_by(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts by several groupings in one pass: (grouping columns as text, absent ones null, set, n).

    ``set`` names the grouping; one aggregate with grouping sets replaces a scan for each.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    df = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F
    for s in sets:
        bits = sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in s)
        name = name.when(F.col("g") == bits, "+".join(s))
    return grouped.select(*names, name.alias("set"), "n")


def largest_remainder(weights: DataFrame, total: int, key: str = "name", weight: str = "weight") -> DataFrame:
    """(key, n): ``total`` split by weight into whole parts; the largest remainders get one more."""
    all_ = Window.partitionBy()
    raw = weights.withColumn("__raw", total * F.col(weight) / F.sum(weight).over(all_)).withColumn("__low", F.floor("__raw"))
    order = Window.orderBy(F.desc(F.round(F.col("__raw") - F.col("__low"), 9)), key)  # one row for each part
    left = F.lit(total) - F.sum("__low").over(all_)
    return raw.select(key, (F.col("__low") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("long").alias("n"))


def assign_splits(speakers: DataFrame, parts: DataFrame, place: Column, speaker: str = "speaker_id") -> DataFrame:
    """(speaker, split): speakers in the order of ``place``, a text such as a digest, dealt to splits of
    (name, n), in the order of the parts' ``pos``. A speaker belongs to one split.

    Ranks come in two steps: speakers are numbered within stretches of equal first characters, and the
    stretches' counts are added up, so no task holds all speakers.
    """
    placed = speakers.select(speaker, place.alias("__place")).withColumn("__cut", F.substring("__place", 1, 3))
    counts = placed.groupBy("__cut").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch
    within = F.row_number().over(Window.partitionBy("__cut").orderBy("__place", speaker)) - 1
    offsets = counts.select(F.col("__cut").alias("__of"), before.alias("__before"))
    ranked = placed.withColumn("__k", within).join(offsets, F.col("__cut").eqNullSafe(F.col("__of"))).withColumn("__k", F.col("__k") + F.col("__before"))
    split, end = F, 0
    for part in parts.orderBy("pos").collect():  # a few splits
        end += part["n"]
        split = split.when(F.col("__k") < end, part["name"])
    return ranked.select(speaker, split.alias("split")).where("split IS NOT NULL")


def with_all(dim: DataFrame, counts: DataFrame, on: str, n: str = "n") -> DataFrame:
    """Counts for every member of a dimension, absent ones 0."""
    return dim.join(counts, on, "left").na.fill(0, [n])


def waveform_peaks(samples: DataFrame, key: str, pos: str, value: str, bins: int = 520) -> DataFrame:
    """(key, bin, peak): the largest absolute sample of each of ``bins`` equal stretches, over the
    signal's largest."""
    n = F.count("*").over(Window.partitionBy(key))
    b = F.floor(F.col(pos) * bins / n).cast("int")
    peaks = samples.select(key, b.alias("bin"), F.abs(value).alias("__a")).groupBy(key, "bin").agg(F.max("__a").alias("peak"))
    top = F.max("peak").over(Window.partitionBy(key))
    return peaks.withColumn("peak", F.when(top > 0, F.col("peak") / top).otherwise(0.0))


def search(df: DataFrame, needle: str, columns: list[str], order: list[str], limit: int = 400) -> DataFrame:
    """The first ``limit`` rows in which any of the columns holds the needle, whatever its case."""
    low = needle.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False))
    return df.where(hit).orderBy(*order).limit(limit)


def anchors(turns: DataFrame, value: str, label: str, least: int = 30, tolerance: float = 0.05) -> DataFrame:
    """(p10, p90, low, high, gap, status) of a trace over all turns of two classes: the medians' gap over
    the span; ok, flat or wrong; too few turns: ``few``."""
    own = turns.select(F.col(value).alias("v"), F.when(F.col(label) == 0, F.col(value)).alias("v0"), F.when(F.col(label) == 1, F.col(value)).alias("v1"))
    own = staged(own, "trace")  # made once, read for each summary
    a = with_percentiles(own.agg(F.count("v").alias("n")), own, [], "v", {"p10": 0.1, "p90": 0.9})
    a = with_percentiles(with_percentiles(a, own, [], "v0", {"low": 0.5}), own, [], "v1", {"high": 0.5})
    gap = F.try_divide(F.col("high") - F.col("low"), F.col("p90") - F.col("p10"))
    status = F.when(F.col("n") < least, "few").when(gap.isNull() | (F.abs(gap) < tolerance), "flat").when(gap < 0, "wrong").otherwise("ok")
    return a.select("n", "p10", "p90", "low", "high", gap.alias("gap"), status.alias("status"))


def codec_sweep(scores: DataFrame, group: list[str], curve_of, score: str = "score", label: str = "label") -> DataFrame:
    """(group, n, finite, auc): null unless enough scores are usable and both classes occur; failures are
    rows that count, never zeros."""
    usable = F.col(score).isNotNull() & ~F.isnan(score)
    enough = scores.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(usable).alias("finite"))
    auc = curve_of(scores.where(usable), group, score, label)
    ok = F.col("finite") >= F.greatest(F.lit(8), F.ceil(0.6 * F.col("n")))
    return enough.join(auc, group, "left").withColumn("auc", F.when(ok, F.col("auc")))
