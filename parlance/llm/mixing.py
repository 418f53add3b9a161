"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash that its id alone decides. A source's target T of its size S is met with
floor(T / S) whole copies and, for the rest, the documents whose hash lies below a threshold. The
threshold is found without sorting: sizes are summed by source and hash bucket (4096 at a level), the
bucket in which the running sum crosses the budget is refined on the next bits, and the last level
decides between whole documents, taking the sum nearest to the budget. A larger budget has a larger
threshold, so budgets nest. What a level reads is one table of histograms; documents are filtered by
an equi-join with one row a source, whose size Catalyst checks before it broadcasts.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source of size
0 has target 0; rows that share an id share a hash and are taken together; an empty table gives no
rows. Reruns agree, for nothing but ids, sizes and sources enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Bits below the bucket at each level; a hash has 60 bits.
SHIFTS = (48, 36, 0)


def id_hash(column: str) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h), staged: the texts are read once."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), id_hash(doc_id).alias("h")), "sized")


def targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in order; a target stops at
    ``cap`` times its source and the excess goes to the others by weight.

    That comes to min(cap * size, weight * level) with one level for all, found among the sources in
    the order in which they reach their caps. The windows here see one row for each source.
    """
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    held = sums.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    all_ = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    found = held.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.row_number().over(order).alias("k"), F.col("level")))).over(all_)["level"])
    return found.select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("most").cast("double"))).alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds (copies, below) to (source, source_size, target): the mix takes every document ``copies``
    times and those with h < below once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    now = stage(goals.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("below", F.lit(0).cast("long")), "goals")
    for level, shift in enumerate(SHIFTS):
        open_ = now.where("left > 0").select(F.col("source").alias("s"), "left", "below")
        rows = slim.join(open_, F.col("source").eqNullSafe(F.col("s")))
        if level:
            rows = rows.where(F.shiftright("h", SHIFTS[level - 1]) == F.shiftright("below", SHIFTS[level - 1]))
        hist = rows.groupBy("s", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        crossed = hist.withColumn("upto", upto).where(F.col("upto") >= F.col("left"))
        hit = crossed.groupBy("s").agg(F.min(F.struct("bucket", "upto", "n")).alias("x")).select("s", F.col("x.bucket").alias("bucket"), (F.col("x.upto") - F.col("x.n")).alias("before"), F.col("x.upto").alias("upto"))
        joined = now.join(hit, F.col("source").eqNullSafe(F.col("s")), "left")
        if shift:
            edge = F.shiftleft("bucket", shift)
        else:
            edge = F.col("bucket") + F.when(F.col("upto") - F.col("left") <= F.col("left") - F.col("before"), 1).otherwise(0)
        # no bucket crosses a budget that rounding puts above the whole: then all is taken
        below = F.when(F.col("left") <= 0, F.col("below")).when(F.col("bucket").isNull(), F.lit(1 << 60)).otherwise(edge)
        left = F.when(F.col("left") <= 0, F.col("left")).when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.col("left") - F.col("before"))
        now = stage(joined.select("source", "source_size", "target", "copies", left.alias("left"), below.alias("below")), "goals", instead_of=now)
    return now.select("source", "source_size", "target", "copies", "below")


def mixed_rows(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, each as often as the mix holds it, with all their columns.

    Whether a row is taken follows from its id and its source's rule, so texts meet a table of one row
    a source and are not shuffled.
    """
    slim = sized(docs, doc_id, text, source)
    rules = thresholds(slim, targets(slim, weights, budget, cap)).select(F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("below").alias("__below"))
    copies = F.col("__copies") + F.when(id_hash(doc_id) < F.col("__below"), 1).otherwise(0)
    out = docs.join(rules, docs[source].cast("string").eqNullSafe(rules["__source"])).withColumn("__n", copies.cast("int")).where("__n > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document; copies is how often the
    mix holds it and taken its words, repeats counted."""
    slim = sized(docs, doc_id, text, source)
    rules = thresholds(slim, targets(slim, weights, budget, cap)).withColumnRenamed("source", "s")
    copies = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    out = slim.join(rules, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER o AS k,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(3 * source_size::DOUBLE, coalesce(w * (SELECT arg_min(level, k) FROM r WHERE level <= 3 * source_size / w), 3 * source_size::DOUBLE)) AS target
  FROM s),
g AS (
  SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (
  SELECT d.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rest > 0 AND upto - own < rest AND (upto < rest OR upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
