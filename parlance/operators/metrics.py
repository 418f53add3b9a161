"""Evaluation metrics over (group, score, label) tables. Labels are 0 or 1.

Curves are built on distinct scores: rows are first counted by score, which pre-aggregates before
the shuffle. Running sums come in two steps: scores are cut to stretches in order, each of which is a
window of its own, and the stretches' sums are added up in a second, small window. So a group of very
many distinct scores is many tasks' work. Both steps read one exchange of the counts, so the input is
evaluated once.

A score that is null or not a number ranks nowhere: such rows count in no curve, area or percentile.
Infinite scores rank before or behind all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(score: Column) -> Column:
    """Whether a score can be ranked."""
    return score.isNotNull() & ~F.isnan(score.cast("double"))


def _by_score(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Rows of each class by score. What cannot be ranked counts as no row, rather than being filtered:
    a filter would be pushed down to where the score is made, and make it again."""
    named = df.select(*group, F.col(score).alias("score"), F.col(label).alias("__label"))
    can = usable(F.col("score"))
    return named.groupBy(*group, "score").agg(F.count_if(can & (F.col("__label") == 1)).alias("p"), F.count_if(can & (F.col("__label") == 0)).alias("n")).where("p + n > 0")


def _stretch(score: str) -> Column:
    """A whole number that never falls as the score grows: within [0, 1] 256 to each doubling of the odds,
    beyond it 256 to each doubling of the score, and one for each infinity."""
    x = F.col(score).cast("double")
    size = F.abs(x)
    odds = F.floor(F.log2(F.greatest(size / F.greatest(1 - size, F.lit(1e-16)), F.lit(1e-300))) * 256) + 300_000
    place = F.when(size < 1, odds).when(size < float("inf"), 600_000 + F.floor(F.log2(F.least(size, F.lit(1.7e308))) * 256)).otherwise(1_000_000)
    # never null, so that no join infers a filter on it: that would be pushed down to where the score is made
    return F.coalesce(F.when(x > 0, place).when(x < 0, -place), F.lit(0).cast("long"))


def _in_stretches(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """The rows with their stretch ``__cut``, dealt by group and stretch."""
    return df.repartition(*group, _stretch(score)).withColumn("__cut", _stretch(score))


def _stretch_sums(cut: DataFrame, group: list[str], sums: dict[str, str | Column], falling: bool = False) -> DataFrame:
    """A row for each stretch, its columns under other names: ``__<name>``, the sum of what lies before
    it, ``__own_<name>`` and ``<name>_all``, its own and the whole group's."""
    order = F.desc if falling else F.asc
    of = cut.groupBy(*group, "__cut").agg(*[F.sum(c).alias(f"__own_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(order("__cut")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    whole = Window.partitionBy(*group)
    zero = F.lit(0).cast("long")
    added = [x for n in sums for x in (F.coalesce(F.sum(f"__own_{n}").over(before), zero).alias(f"__{n}"), F.col(f"__own_{n}"), F.sum(f"__own_{n}").over(whole).alias(f"{n}_all"))]
    return of.select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__cut").alias("__of"), *added)


def _same(group: list[str]) -> Column:
    same = F.col("__cut") == F.col("__of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return same


def running(df: DataFrame, group: list[str], sums: dict[str, str | Column], score: str = "score", falling: bool = False) -> DataFrame:
    """Adds, under new names, the sums of columns over all rows of the group up to each row's score,
    which is distinct in its group and usable, and ``<name>_all``, those over the whole group."""
    cut = _in_stretches(df, group, score)
    of = _stretch_sums(cut, group, sums, falling)
    order = F.desc if falling else F.asc
    within = Window.partitionBy(*group, "__cut").orderBy(order(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(of, _same(group))
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).select(*df.columns, *sums, *[f"{n}_all" for n in sums])


def percentiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, one column for each of ``at``): exact percentiles, interpolated between neighbours.

    Selection by counting: values are counted, their counts added up by stretch, and only the stretch
    that holds a percentile's two neighbours is put in order. No group's values come together. Groups
    without a usable value have no row; no group at all: one row, of nulls if need be."""
    counted = df.select(*group, F.col(value).cast("double").alias("score")).groupBy(*group, "score").agg(F.count_if(usable(F.col("score"))).alias("m")).where("m > 0")
    cut = _in_stretches(counted, group, "score")
    of = _stretch_sums(cut, group, {"upto": "m"})
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in at.items()]))
    place = F.col("x.q") * (F.col("upto_all") - 1)
    edges = of.withColumn("x", wanted).withColumns({"__lo": F.floor(place), "__hi": F.ceil(place), "__part": place - F.floor(place)})
    edges = edges.where("__upto <= __hi AND __lo < __upto + __own_upto")
    within = Window.partitionBy(*group, "__cut", "x.name").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__upto") + F.sum("m").over(within)
    rows = cut.join(edges, _same(group)).withColumn("__end", upto).withColumn("__begin", F.col("__end") - F.col("m"))
    holds = lambda c: F.max(F.when((F.col(c) >= F.col("__begin")) & (F.col(c) < F.col("__end")), F.col("score")))
    found = rows.groupBy(*group, "x.name").agg(holds("__lo").alias("lo"), holds("__hi").alias("hi"), F.max("__part").alias("part"))
    between = F.when(F.col("part") == 0, F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, between)).alias(n) for n in at])


def with_percentiles(summary: DataFrame, df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """The rows of a summary by group with the percentiles of their groups; null where there is no value."""
    found = percentiles(df, group, value, at)
    if not group:
        return summary.crossJoin(found)  # one row each
    found = found.select(*[F.col(g).alias(f"__of_{g}") for g in group], *at)
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return summary.join(found, same, "left").drop(*[f"__of_{g}" for g in group])


def det_curve(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, threshold, fpr, fnr) by falling threshold, ties collapsed, from (0, 1, infinity) on. A group
    without usable rows has that first point alone."""
    counts = _by_score(df, group, score, label)
    summed = running(counts, group, {"tp": "p", "fp": "n"}, falling=True)
    curve = summed.select(*group, F.col("score").alias("threshold"), F.try_divide("fp", "fp_all").alias("fpr"), (1 - F.try_divide("tp", "tp_all")).alias("fnr"))
    seed = df.select(*group).distinct().select(*group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(1.0).alias("fnr"))
    return curve.unionByName(seed)


def equal_error(curve: DataFrame, group: list[str]) -> DataFrame:
    """(group, eer, threshold): the first point by falling threshold at which the rates are nearest; no
    row for a group without both classes."""
    curve = curve.where("fpr IS NOT NULL AND fnr IS NOT NULL")
    best = F.min_by(F.struct("fpr", "fnr", "threshold"), F.struct(F.abs(F.col("fpr") - F.col("fnr")), -F.col("threshold")))
    return curve.groupBy(*group).agg(best.alias("x"), F.count("*").alias("__n")).where("__n > 1").select(*group, ((F.col("x.fpr") + F.col("x.fnr")) / 2).alias("eer"), F.col("x.threshold").alias("threshold"))


def min_tdcf(curve: DataFrame, group: list[str], prior: float = 0.05, miss: float = 1.0, alarm: float = 10.0) -> DataFrame:
    """(group, min_tdcf): the least detection cost over the better of the two trivial answers."""
    cost = miss * prior * F.col("fnr") + alarm * (1 - prior) * F.col("fpr")
    return curve.groupBy(*group).agg((F.min(cost) / min(miss * prior, alarm * (1 - prior))).alias("min_tdcf"))


def roc_auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, auc): by average ranks of the usable scores; null where a class is absent. A group without
    usable rows has no row."""
    # both steps need p and n, and so read one exchange
    summed = running(_by_score(df, group, score, label), group, {"upto": F.col("p") + F.col("n")})
    rank = F.col("upto") - (F.col("p") + F.col("n") - 1) / 2
    pos, neg = F.sum("p"), F.sum("n")
    return summed.groupBy(*group).agg(F.try_divide(F.sum(rank * F.col("p")) - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auc"))


def confusion(df: DataFrame, group: list[str], threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """(group, tp, fp, fn, tn, accuracy, precision, recall, f1); no denominator: 0."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*group).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    return with_rates(c).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_rates(c: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts tp, fp, fn."""
    return c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def calibration(df: DataFrame, group: list[str], bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """(group, bin, n, predicted, observed): equal bins by comparison with their edges, the last closed;
    empty bins do not appear."""
    edge = [k / bins for k in range(bins + 1)]
    number = F
    for k in range(bins):
        upper = F.col("score") <= edge[k + 1] if k == bins - 1 else F.col("score") < edge[k + 1]
        number = number.when((F.col("score") >= edge[k]) & upper, k)
    # distinct scores are binned, so what makes the score is evaluated once a row
    counts = df.groupBy(*group, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count(label).alias("m"), F.sum(label).alias("y")).withColumn("bin", number)
    cut = counts.groupBy(*group, "bin").agg(F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("predicted"), F.try_divide(F.sum("y"), F.sum("m")).alias("observed"), F.count("bin").alias("__k"))
    return cut.where("__k > 0").drop("__k")


def calibration_error(bins: DataFrame, group: list[str]) -> DataFrame:
    """(group, ece) of calibration bins."""
    return bins.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(*group).agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def span_scores(gold: DataFrame, found: DataFrame, keys: list[str], by_type: bool = False, axes: list[str] | None = None) -> DataFrame:
    """Exact-span precision, recall and f1 of (keys, type, tok_start, tok_end) sets: overall, or by
    type over the union of both sets' types, and by those keys that are ``axes``."""
    cols = [*keys, "type", "tok_start", "tok_end"]
    g, p = gold.select(*cols).distinct().withColumn("g", F.lit(1)), found.select(*cols).distinct().withColumn("f", F.lit(1))
    both = g.join(p, cols, "full")
    group = [*(axes or []), *(["type"] if by_type else [])]
    c = both.groupBy(*group).agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return with_rates(c)
