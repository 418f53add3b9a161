import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import ring


def md5(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)


def brute(keys, shards, vnodes, bounds):
    """Insert all keys arc by arc, as a walk around the ring, one key at a time."""
    points = sorted((md5(f"vnode:{i % shards}:{i // shards}"), i, i % shards) for i in range(shards * vnodes))
    home = defaultdict(list)
    for k in sorted(keys, key=lambda k: (md5(k), k)):
        home[next((a for a, p in enumerate(points) if p[0] >= md5(k)), 0)].append(k)
    for a in home:  # the stretch behind the last point comes after, as its places are larger
        home[a].sort(key=lambda k: (md5(k), k))
    room, out, wait, a = list(bounds), {}, [], 0
    filled = [0] * shards
    while a < len(points) or wait:
        s = points[a % len(points)][2]
        own = home.get(a, []) if a < len(points) else []
        rest_own, rest = [], []
        for k in own:
            (out.__setitem__(k, (s, filled[s])) or filled.__setitem__(s, filled[s] + 1)) if filled[s] < room[s] else rest_own.append(k)
        for k in wait:
            (out.__setitem__(k, (s, filled[s])) or filled.__setitem__(s, filled[s] + 1)) if filled[s] < room[s] else rest.append(k)
        wait, a = rest + rest_own, a + 1
    return out


def test_against_one_by_one_insertion(spark):
    df = spark.range(1, 1502).select(F.col("id").cast("string").alias("key")).repartition(5)
    for shards, vnodes in ((8, 16), (3, 4)):
        n = 1501
        got = {r.key: (r.shard, r.slot) for r in ring.shard(df, key="key", tie=[], shards=shards, vnodes=vnodes).collect()}
        assert got == brute([str(i) for i in range(1, 1502)], shards, vnodes, [n // shards + (s < n % shards) for s in range(shards)])


def test_query_laws(spark, docs, no_docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = ring.op8(spark, str(tmp_path)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() and set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert ring.shard(no_docs.select(F.col("source").alias("key")), key="key", tie=[]).count() == 0


def test_hot_key_and_slack(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    for load, most in ((1.0, 225), (1.25, 282)):
        for hot_rows in (1 << 15, 60):
            got = ring.shard(df.repartition(4), key="key", tie=["id"], shards=4, vnodes=8, load=load, hot_rows=hot_rows).collect()
            slots = defaultdict(list)
            for r in got:
                slots[r.shard].append(r.slot)
            assert len({r.id for r in got}) == len(got) == 900 and max(map(len, slots.values())) <= most
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    with pytest.raises(ValueError):
        ring.shard(df, key="key", tie=["id"], load=0.9)


def test_cut_slices_keep_the_order_of_places(spark):
    df = spark.range(1, 1502).select(F.col("id").cast("string").alias("key")).repartition(5)
    got = {r.key: (r.shard, r.slot) for r in ring.shard(df, key="key", tie=[], shards=3, vnodes=4, hot_rows=10).collect()}
    assert got == brute([str(i) for i in range(1, 1502)], 3, 4, [501, 500, 500])
