"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions
alone.

Every shard owns ``vnodes`` points of a ring of 2**32 places; a key belongs to the first point
clockwise. A shard takes no more rows than its bound; keys that find it full continue clockwise,
behind the keys that already wait, to the next point whose shard has room. Walking the ring needs
the number of keys on each arc only (shards * vnodes numbers, whatever the data's size); the walk
gives for each arc which ranks of its keys go to which shard, from which slot on. Ranks come in two
steps: slices of the ring that hold a few thousand keys each are numbered on their own, and
slices' counts are summed along their arc. A slice that one key has filled far beyond that is cut
further, by place, key and the task that read the row, so a key shared by a third of all rows is many
tasks' work. So no task holds a shard, and the rows move once.

With ``load`` 1 the bounds are the equal shares, at most one apart, and add up to all rows, so the
counts of shards are at most one apart whatever the keys. Adding a shard moves the rows it takes and
the overflow that its room sets free.

Defined cases: a null text has size 1; a null id is placed by its text's checksum; rows that share an
id lie next to each other, in the order of checksum and size (of a hot key, by task first); an empty
table gives no rows; a ``load`` below 1 leaves no room for all rows and is refused.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage

SHARDS = 8
VNODES = 128
_BUCKET = 20
_SLICE_ROWS = 4096
#: A slice of more rows than this is cut further.
_HOT_ROWS = 1 << 15


def place(text: Column) -> Column:
    """32 bits of the md5: a place on the ring."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def points(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(arc, shard, lo, hi): the stretches of the ring, each ending at its owner's point; the one
    behind the last point belongs to the first arc."""
    made = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.col("id"))
    made = made.withColumn("at", place(F.concat_ws(":", F.lit("vnode"), "shard", F.floor(F.col("id") / shards))))
    around = Window.orderBy("at", "id")  # shards * vnodes rows
    arcs = made.select((F.row_number().over(around) - 1).alias("arc"), "shard", (F.coalesce(F.lag("at").over(around), F.lit(-1)) + 1).alias("lo"), F.col("at").alias("hi"))
    first = arcs.where("arc = 0").select("arc", "shard")
    last = arcs.agg((F.max("hi") + 1).alias("lo"))
    return arcs.unionByName(first.crossJoin(last).select("arc", "shard", "lo", F.lit((1 << 32) - 1).alias("hi"))).where("lo <= hi")


def walk(owner: list[int], count: list[int], bounds: list[int]) -> list[dict]:
    """The stretches of ranks (arc, first, last, shard, slot) that each shard takes, arc after arc."""
    room, slot = list(bounds), [0] * len(bounds)
    waiting: list[list[int]] = []
    out = []
    arc, arcs = 0, len(owner)
    while arc < arcs or waiting:
        k = arc % arcs
        s = owner[k]
        come = [[k, 0, count[k] - 1]] if arc < arcs and count[k] else []
        queue = come + waiting  # the arc's own keys are first
        rest = []
        for a, first, last in queue:
            n = min(room[s], last - first + 1)
            if n:
                out.append({"arc": a, "first": first, "last": first + n - 1, "shard": s, "slot": slot[s]})
                room[s] -= n
                slot[s] += n
            if first + n <= last:
                rest.append([a, first + n, last])
        if come and rest and rest[0][0] == k and len(rest) > 1:
            rest = rest[1:] + rest[:1]  # but wait behind those that have waited longer
        waiting = rest
        arc += 1
    return out


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from one literal."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def shard(rows: DataFrame, *, key: str, tie: list[str], shards: int = SHARDS, vnodes: int = VNODES, load: float = 1.0, hot_rows: int = _HOT_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 within the shard) to slim rows with a text ``key``;
    rows of one key are ordered by the ``tie`` columns."""
    if load < 1:
        raise ValueError("a load below 1 leaves no room for all rows")
    spark = rows.sparkSession
    arcs = points(spark, shards, vnodes)
    cut = arcs.select("arc", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", _BUCKET), F.shiftright("hi", _BUCKET))).alias("bucket"))
    at = rows.withColumn("at", place(F.col(key))).withColumn("bucket", F.shiftright("at", _BUCKET))
    found = stage(at.join(cut, (at["bucket"] == cut["bucket"]) & F.col("at").between(F.col("lo"), F.col("hi"))).drop("bucket", "lo", "hi").withColumn("task", F.spark_partition_id()), "ring")
    n = found.count()
    shift = 32 - max(0, min(28, math.ceil(math.log2(max(1, n / _SLICE_ROWS)))))
    found = found.withColumn("slice", F.shiftright("at", shift))
    hot = stage(found.groupBy("arc", "slice").count().where(F.col("count") > hot_rows).select("arc", "slice", F.lit(True).alias("hot")), "hot")
    found = found.join(hot, ["arc", "slice"], "left")
    finer = {"cut_at": ("at", -1), "cut_key": (key, ""), "cut_task": ("task", -1)}
    found = found.withColumns({c: F.when(F.col("hot"), F.col(x)).otherwise(F.lit(y)) for c, (x, y) in finer.items()})
    cuts = ["arc", "slice", *finer]
    slices = stage(found.groupBy(*cuts).count(), "slices")
    per_arc = {r["arc"]: r["n"] for r in slices.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    owner = [r["shard"] for r in arcs.select("arc", "shard").distinct().orderBy("arc").collect()]
    if load == 1.0:
        bounds = [n // shards + (s < n % shards) for s in range(shards)]
    else:
        bounds = [math.ceil(load * n / shards)] * shards
    taken = _inline(spark, walk(owner, [per_arc.get(a, 0) for a in range(len(owner))], bounds), "arc: int, first: bigint, last: bigint, shard: int, slot: bigint")
    along = Window.partitionBy("arc").orderBy(*cuts[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*cuts, F.coalesce(F.sum("count").over(along), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*cuts).orderBy("at", key, *tie)
    ranked = found.withColumn("rank", F.row_number().over(within) - 1).join(offsets, cuts).withColumn("rank", F.col("rank") + F.col("offset"))
    t = taken.withColumnRenamed("arc", "of").withColumnRenamed("slot", "slot0")
    placed = ranked.join(t, (F.col("arc") == F.col("of")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.withColumn("slot", F.col("slot0") + F.col("rank") - F.col("first")).select(*rows.columns, "shard", "slot")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string"))))
    out = shard(rows, key="key", tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
