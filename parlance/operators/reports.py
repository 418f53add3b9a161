"""What reports are made of: top rows of groups, thinned curves, grids of conditions, ladders of scores,
checks of a corpus and the record of where a result came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip
from . import metrics as M
from .sequences import bio_spans, running_totals

# ---- top rows and thinning


def top_rows(df: DataFrame, group: list[str], by: Column, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows of each group in which ``by`` is largest in size, with their ``place`` from 1; ties
    go by further columns. Spark keeps no more than ``k`` rows of a group and task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(F.abs(by)), *ties)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def first_items(items: Column, k: int) -> Column:
    """The first ``k`` of an array."""
    return F.slice(items, 1, k)


def _numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds each row's place in its group, ``__k`` from 0, and the group's rows, ``__n``."""
    t = running_totals(df, group, order, {"__place": F.lit(1)})
    return t.select(*df.columns, (F.col("__place") - 1).alias("__k"), F.col("__place_all").alias("__n"))


def thinned(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """Every n-th row of each group from its first on, where n is how often ``most`` goes into its rows."""
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / most))
    return _numbered(df, group, order).where(F.col("__k") % step == 0).drop("__k", "__n")


def evenly(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """``most`` rows of each group, evenly from the first to the last, places cut to whole numbers;
    a group of no more rows stays whole."""
    # the least j whose place j * (n - 1) / (most - 1) is not before k is the only one that can be cut to k
    numbered = _numbered(df, group, order).withColumn("__j", F.expr(f"(__k * {most - 1} + __n - 2) div greatest(__n - 1, 1)"))
    near = F.expr(f"(__j * (__n - 1)) div {most - 1}")
    return numbered.where((F.col("__n") <= most) | (near == F.col("__k"))).drop("__k", "__n", "__j")


# ---- grids of conditions


def detection_grid(scores: DataFrame, axes: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(axes, n, eer, min_tdcf) of every combination of the axes' values, be it without rows; null where
    a class is absent."""
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    curve = M.det_curve(usable, axes, score, label)
    counts = scores.groupBy(*axes).agg(F.count("*").alias("n"))
    both = M.equal_error(curve, axes).drop("threshold")
    cost = M.min_tdcf(curve, axes)
    values = [counts.select(a).distinct() for a in axes]
    grid = reduce(lambda a, b: a.crossJoin(b), values)  # a row for each condition
    out = grid.join(counts, axes, "left").join(both, axes, "left").join(cost, axes, "left").na.fill(0, ["n"])
    return out.withColumn("min_tdcf", F.when(F.col("eer").isNotNull(), F.col("min_tdcf")))


def by_condition(grid: DataFrame, rows: list[str], condition: str, values: list[str], measure: str) -> DataFrame:
    """(rows, a column for each of the condition's values) of one measure of a grid."""
    return grid.groupBy(*rows).pivot(condition, values).agg(F.first(measure))


def tagging_grid(gold: DataFrame, found: DataFrame, keys: list[str], axes: list[str], by_type: bool = False) -> DataFrame:
    """Exact-span scores of predicted tag arrays (axes, keys, tags) against gold (keys, tags) for each
    combination of axes; a prediction of another length than the gold counts as all outside."""
    both = found.join(gold.withColumnRenamed("tags", "__gold"), keys)
    both = both.withColumn("tags", F.when(F.size("tags") == F.size("__gold"), F.col("tags")).otherwise(F.transform("__gold", lambda _: F.lit("O"))))
    own = [*axes, *keys]

    def spans(column: str) -> DataFrame:
        return bio_spans(both.select(*own, F.posexplode(column).alias("pos", "tag")), own)

    return M.span_scores(spans("__gold"), spans("tags"), own, by_type, axes)


# ---- mixing by class


def mixing_by_class(tokens: DataFrame, mix: DataFrame, labels: DataFrame, key: str, first: str, second: str, lang: str = "lang", entity: str = "entity") -> DataFrame:
    """(label, cmi, switch_rate, second_ratio, ent_lang_align, n_entity_tokens): the mean of the calls'
    mixing, switches for 100 tokens of either language, and the second language's share of all such
    tokens and of those in entities. Without such tokens: 0."""
    spoken = F.col(lang).isin(first, second)
    counts = tokens.join(labels, key).groupBy("label").agg(
        F.count_if(spoken).alias("__n"), F.count_if(F.col(lang) == second).alias("__second"),
        F.count_if(spoken & F.col(entity)).alias("n_entity_tokens"), F.count_if((F.col(lang) == second) & F.col(entity)).alias("__entity"),
    )
    calls = mix.join(labels, key).groupBy("label").agg(F.avg("cmi").alias("cmi"), F.sum("switch_points").alias("__s"))
    out = counts.join(calls, "label")
    return out.select("label", "cmi", (100 * M.ratio(F.col("__s"), F.col("__n"))).alias("switch_rate"), M.ratio(F.col("__second"), F.col("__n")).alias("second_ratio"), M.ratio(F.col("__entity"), F.col("n_entity_tokens")).alias("ent_lang_align"), "n_entity_tokens")


def entity_alignment(tokens: DataFrame, key: str, first: str, second: str, lang: str = "lang", entity: str = "entity") -> DataFrame:
    """(key, ent_tokens, ent_lang_align): entity tokens of either language, and the second one's share."""
    n = F.count_if(F.col(entity) & F.col(lang).isin(first, second))
    return tokens.groupBy(key).agg(n.alias("ent_tokens"), M.ratio(F.count_if(F.col(entity) & (F.col(lang) == second)), n).alias("ent_lang_align"))


# ---- ladders


def ladder(rungs: dict[str, Column], last: Column, floor: str = "lexicon") -> tuple[Column, Column]:
    """(score, backend): the first finite score of the rungs in their order, clipped to [0, 1], else
    ``last`` as it is, named ``floor``."""
    score, backend = F, F
    for name, c in rungs.items():
        c = c.cast("double")
        usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        score, backend = score.when(usable, clip(c, 0.0, 1.0)), backend.when(usable, name)
    return score.otherwise(last), backend.otherwise(floor)


# ---- arousal of segments

# How much each measure of a segment counts.
AROUSAL_WEIGHTS = {"f0_cv": 0.34, "f0_span": 0.24, "emphasis_var": 0.26, "rate_std": 0.16}
#: Below this share of voiced frames a segment is drawn to the middle.
VOICED_LEAST = 0.25


def anchored_arousal(components: DataFrame, anchors: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds the four measures between their anchors (``at_<name>``) and ``arousal``; a segment without
    measures has 0 throughout."""
    at = {f"at_{n}": F.coalesce(clip((F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(low)).otherwise(F.col(n)) - low) / (high - low), 0.0, 1.0), F.lit(0.0)) for n, (low, high) in anchors.items()}
    out = components.withColumns(at)
    raw = sum((w * F.col(f"at_{n}") for n, w in AROUSAL_WEIGHTS.items()), F.lit(0.0))
    sure = clip(F.col("voiced_ratio") / VOICED_LEAST, 0.0, 1.0)
    return out.withColumn("arousal", F.coalesce(clip(F.when(F.col("voiced_ratio") < VOICED_LEAST, sure * raw + (1 - sure) * 0.5).otherwise(raw), 0.0, 1.0), F.lit(0.0)))


# ---- pairs of recordings


def channel_lift(pairs: DataFrame, real: str = "floor_real", made: str = "floor_made", margin: float = 1.0) -> DataFrame:
    """Adds ``target`` (the louder floor and a margin, in dB) and the power in dB that noise must add to
    either side to reach it; null where a side lies there already."""
    out = pairs.withColumn("target", F.greatest(real, made) + margin)
    for side in (real, made):
        gap = F.pow(10.0, F.col("target") / 10) - F.pow(10.0, F.col(side) / 10)
        out = out.withColumn(side.replace("floor", "lift"), F.when(gap > 0, 10 * F.log10(gap)))
    return out


def paired(real: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Recordings and their renderings by a shared key, a row for each side: label 0 and 1. What has no
    partner stays out."""
    both = [k.join(o.select(key).distinct(), key, "left_semi").withColumn("label", F.lit(y)) for k, o, y in ((real, made, 0), (made, real, 1))]
    return both[0].unionByName(both[1])


def with_borrowed_negatives(own: DataFrame, others: DataFrame, label: str = "label") -> DataFrame:
    """A set's positives with another set's negatives, as ``borrowed`` says of each row."""
    return own.where(F.col(label) == 1).withColumn("borrowed", F.lit(False)).unionByName(others.where(F.col(label) == 0).withColumn("borrowed", F.lit(True)))


def audit(df: DataFrame, statistics: dict[str, Column], label: Column, stop: float = 0.75, warn: float = 0.62) -> DataFrame:
    """(stat, auc, mean_1, mean_0, status) of each statistic alone: how well it tells the classes apart,
    whichever way round."""
    long = df.select(label.alias("label"), *[v.cast("double").alias(k) for k, v in statistics.items()]).unpivot(["label"], list(statistics), "stat", "value")
    auc = M.roc_auc(long, ["stat"], "value").withColumn("auc", F.greatest("auc", 1 - F.col("auc")))
    means = long.groupBy("stat").agg(F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("mean_1"), F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("mean_0"))
    return auc.join(means, "stat").withColumn("status", F.when(F.col("auc") > stop, "stop").when(F.col("auc") > warn, "warn").otherwise("ok"))


# ---- checks and provenance


def shared_members(df: DataFrame, split: str, member: str) -> DataFrame:
    """(first, second, n): how many members each pair of splits shares; no row where none are shared."""
    own = df.select(F.col(split).alias("split"), F.col(member).alias("member")).distinct()
    held = own.groupBy("member").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)  # a few splits
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return held.select(F.explode(pairs).alias("x")).groupBy("x.first", "x.second").agg(F.count("*").alias("n"))


def corpus_faults(tags: DataFrame, keys: list[str], tag: str, known: list[str]) -> DataFrame:
    """(fault, n) of tag sequences: tags that are none, inside tags of a type that is not known, and
    inside tags that nothing of their type precedes. Faults that do not occur have 0."""
    before = F.lag(tag).over(Window.partitionBy(*keys).orderBy("pos"))
    kind = F.substring_index(F.col(tag), "-", -1)
    typed = F.col(tag).rlike("^[BI]-.")
    found = tags.withColumn("__before", before).agg(
        F.count_if((F.col(tag) != "O") & ~typed).alias("no_tag"), F.count_if(typed & ~kind.isin(*known)).alias("unknown_type"),
        F.count_if(F.col(tag).startswith("I-") & ~(F.coalesce(F.col("__before"), F.lit("O")).rlike("^[BI]-.") & (F.substring_index("__before", "-", -1) == kind))).alias("stray_inside"),
        F.count("*").alias("tokens"),
    )
    return found.unpivot([], ["no_tag", "unknown_type", "stray_inside", "tokens"], "fault", "n")


def leaks(spans: DataFrame, split: str, value: str) -> DataFrame:
    """(type, value, splits): entity values that occur in more than one split."""
    return spans.groupBy("type", F.lower(value).alias("value")).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest) that neither the rows' order nor their place changes: two sums of the rows' digests."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]).cast("binary"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(row, k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("rows"), F.md5(F.concat_ws(":", F.count("*").cast("string"), part(1), part(9)).cast("binary")).alias("digest"))


def write_results(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """The rows as JSON below ``path``/results, and beside them, below ``path``/provenance, where they
    come from: the given entries, the time and the rows' fingerprint."""
    df.write.mode("overwrite").json(f"{path}/results")
    mark = fingerprint(df.sparkSession.read.schema(df.schema).json(f"{path}/results"), df.columns)
    entries = F.create_map(*[F.lit(x) for kv in provenance.items() for x in kv]) if provenance else F.create_map().cast("map<string,string>")
    mark.select("rows", "digest", F.current_timestamp().alias("written"), entries.alias("entries")).write.mode("overwrite").json(f"{path}/provenance")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write the rows as Parquet with their fingerprint unless the same rows lie there already."""
    from pyspark.errors import AnalysisException

    spark: SparkSession = df.sparkSession
    mark = fingerprint(df, df.columns)
    try:
        held = spark.read.schema(mark.schema).json(f"{path}/fingerprint").first()
    except AnalysisException:  # nothing there yet
        held = None
    if held is not None and held == mark.first():
        return False
    df.write.mode("overwrite").parquet(f"{path}/rows")
    mark.write.mode("overwrite").json(f"{path}/fingerprint")
    return True
