import pytest
from pyspark.sql import functions as F

from parlance.operators import risk
from parlance.plans import sequence_queries as Q
from parlance.streaming import live

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_live_timeline_equals_the_batch(spark, tmp_path):
    columns = ["call_id", "turn_index", "speaker", "act", "rank", "score", "n_tokens", "n_pressed", "t_end"]
    turns = Q.timeline_input(spark, SF).select(*columns).withColumn("turn_index", F.col("turn_index").cast("long")).cache()
    for k in range(3):  # three files, turns of a call in order over them
        turns.where((F.col("turn_index") >= 3 * k) & (F.col("turn_index") < (3 * k + 3 if k < 2 else 10**9))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.call_id, r.turn_index): r for r in drained(live.live_timeline(source, 0.38), "live").collect()}
    want = risk.prefix_timeline(turns, 0.38).collect()
    assert len(got) == len(want) > 20
    for r in want:
        g = got[r.call_id, r.turn_index]
        assert (g.band, g.alert) == (r.band, r.alert)
        for name in ("risk", "intent", "slope", "peak", "resist", "dt"):
            assert g[name] == pytest.approx(r[name], abs=1e-9)
    assert any(r.alert for r in want)


def test_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/e")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = drained(live.windowed_counts(source), "w", "complete").agg(F.sum("n")).first()[0]
    assert got == events.count()
    assert live.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_turns_that_come_early_wait(spark, tmp_path):
    columns = ["call_id", "turn_index", "speaker", "act", "rank", "score", "n_tokens", "n_pressed", "t_end"]
    turns = Q.timeline_input(spark, SF).select(*columns).withColumn("turn_index", F.col("turn_index").cast("long")).cache()
    first = turns.agg(F.min("turn_index")).first()[0]
    parts = [F.col("turn_index") % 3 == k for k in (2, 0, 1)]  # most turns come before an earlier one
    for part in parts:
        turns.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = {(r.call_id, r.turn_index): r for r in drained(live.live_timeline(source, 0.38, wait=True, first=first), "patient").collect()}
    want = risk.prefix_timeline(turns, 0.38).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.call_id, r.turn_index].risk == pytest.approx(r.risk, abs=1e-9) and got[r.call_id, r.turn_index].alert == r.alert
