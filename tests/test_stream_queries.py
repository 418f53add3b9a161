import datetime
import math

import pytest
from pyspark.sql import functions as F

from parlance import storage
from parlance.operators import risk
from parlance.operators import sequences as S
from parlance.plans import sequence_queries as Q
from parlance.plans import stream_queries as N
from parlance.streaming import live, runs

SF = "/root/testdata/sf0.001"


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    """Half of each call comes, both streams end, then the rest comes: no turn and no alert twice or not at all."""
    t = spark.read.parquet(f"{SF}/conversations.parquet").cache()
    folder = f"file://{tmp_path}"
    for part in (F.col("turn") < 3, F.col("turn") >= 3):
        t.where(part).write.mode("append").parquet(f"{folder}/in/conversations.parquet")
        N.scored_turns(runs.table_stream(spark, f"{folder}/in", "conversations"), f"{folder}/turns", f"{folder}/turns-at")
        N.risk_of(spark, folder)
        N.risk_of(spark, folder)  # nothing new
    got = {(r.call_id, r.turn_index): r for r in runs.read_rows(spark, f"{folder}/risk", live.OUTPUT).collect()}
    want = risk.prefix_timeline(Q.timeline_input(spark, SF), N.THRESHOLD).collect()
    assert runs.read_rows(spark, f"{folder}/risk", live.OUTPUT).count() == len(got) == len(want) > 20
    for r in want:
        g = got[r.call_id, r.turn_index]
        assert g.risk == pytest.approx(r.risk, abs=1e-9)
        assert g.dt == pytest.approx(r.dt, abs=1e-9)
        assert (g.band, g.alert) == (r.band, r.alert)
    assert any(r.alert and r.turn_index < 3 for r in want)
    alerts = [r.call_id for r in got.values() if r.alert]
    assert len(alerts) == len(set(alerts))


def throttled(turns):
    """The voice score by its definition."""
    out, now, at, voice, heard = [], 0, None, 0.0, []
    for k, (n, v) in enumerate(turns):
        now += (250 if k else 0) + max(700, round(n * 1000 / 2.6))
        heard.append((now, v))
        fresh = at is None or now - at >= 4000
        if fresh:
            window = [x for e, x in heard if e > now - 20000]
            at, voice = now, sum(window) / len(window)
        out.append((k, now, fresh, at, voice))
    return out


def test_voice_cache_by_definition_and_from_state(spark, tmp_path):
    calls = {c: [((7 * c + 5 * k * k) % 40, ((c * 31 + k * 17) % 101) / 100) for k in range(1 + 3 * c)] for c in range(9)}
    rows = [(c, k, n, v) for c, turns in calls.items() for k, (n, v) in enumerate(turns)]
    df = spark.createDataFrame(rows, "call_id long, turn_index long, n_tokens int, value double")
    want = {(c, k): x for c, turns in calls.items() for k, *x in throttled(turns)}
    for part in (F.col("turn_index") < 7, F.col("turn_index") >= 7):
        df.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        runs.append_rows(live.live_voice(source), f"file://{tmp_path}/out", f"file://{tmp_path}/at")
    for found in (S.voice_rescoring(df, "value"), spark.read.parquet(f"{tmp_path}/out")):
        got = {(r.call_id, r.turn_index): (r.t_ms, r.rescored, r.scored_at, r.voice) for r in found.collect()}
        assert got.keys() == want.keys()
        for key, (t, fresh, at, voice) in want.items():
            assert got[key][:3] == (t, fresh, at)
            assert math.isclose(got[key][3], voice, abs_tol=1e-9)
    assert sum(x[1] for x in want.values()) < len(want)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    line = risk.prefix_timeline(Q.timeline_input(spark, SF), N.THRESHOLD).cache()
    asked = spark.createDataFrame([(0,), (3,), (10**9,)], "call_id long")
    folder = f"file://{tmp_path}"
    asked.write.parquet(f"{folder}/asked")
    source = spark.readStream.schema(asked.schema).parquet(f"{folder}/asked")
    N.replayed(spark, source, line, f"{folder}/events", f"{folder}/at")
    rows = lambda: sorted(map(tuple, runs.read_rows(spark, f"{folder}/events", N.EVENT).drop("batch").collect()), key=str)
    first = rows()
    assert [r[2] for r in first if r[0] == 10**9] == ["failed"]
    one = [r for r in sorted(first) if r[0] == 0]
    assert one[0][2] == "meta"
    assert one[-1][2] == "done"
    assert [r[1] for r in one] == list(range(len(one)))
    assert sum(r[2] == "turn" for r in one) == one[0][5]
    storage.delete(spark, f"{folder}/at/commits")  # the last commit is lost: the batch runs again
    N.replayed(spark, source, line, f"{folder}/events", f"{folder}/at")
    assert rows() == first


def test_late_and_repeated_events(spark, tmp_path):
    day = datetime.datetime(2024, 3, 1)
    hour = lambda h: day + datetime.timedelta(hours=h)
    deliveries = [
        [(1, hour(1), 1.0), (2, hour(2), 2.0), (2, hour(2), 2.0), (3, hour(9), 4.0)],
        [(4, hour(1), 8.0), (5, hour(8), 16.0), (6, hour(20), 32.0)],  # 4 is behind the watermark of 7:00, 5 is not
        [(7, hour(40), 64.0)],
    ]
    schema = "event_id long, ts timestamp, value double, event_type string, user_id long"
    for rows in deliveries:
        spark.createDataFrame([(*r, "a", 1) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        runs.append_rows(live.windowed_counts(source, "2 hours", "6 hours", key="event_id"), f"file://{tmp_path}/out", f"file://{tmp_path}/at")
    got = {(r.start, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(hour(0), 2, 3.0), (hour(6), 2, 20.0), (hour(18), 1, 32.0)}


def test_tables_of_one_file_or_many(spark, tmp_path):
    df = spark.range(100)
    df.repartition(3).write.parquet(f"{tmp_path}/many/t.parquet")
    one = df.coalesce(1).write.parquet(f"{tmp_path}/x")
    assert one is None
    part = next((tmp_path / "x").glob("part-*.parquet"))
    (tmp_path / "one").mkdir()
    part.rename(tmp_path / "one" / "t.parquet")
    for name in ("many", "one"):
        runs.append_rows(runs.table_stream(spark, str(tmp_path / name), "t"), f"file://{tmp_path}/out-{name}", f"file://{tmp_path}/at-{name}")
        assert spark.read.parquet(f"{tmp_path}/out-{name}").count() == 100
