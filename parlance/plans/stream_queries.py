"""Queries that run as streams over the given tables, each to the end of its input."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import storage
from ..operators import risk as R
from ..operators import sequences as S
from ..streaming import live, runs
from . import base as B
from .sequence_queries import THRESHOLD, TIMELINE_SQL, timeline_input, turn_features

TURN = "call_id long, turn_index long, speaker string, act string, rank double, score double, n_tokens int, n_pressed long"


def scored_turns(conversations, out: str, checkpoint: str) -> None:
    """The stream's turns with what their own text tells, in a folder for each batch: a turn needs no other
    row, so the batch is scored by the same functions as a whole table."""
    spark = conversations.sparkSession
    names = [c.split()[0] for c in TURN.split(", ")]
    made = lambda batch, _: turn_features(spark, {"conversations": batch}).selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in TURN.split(", "))]).select(*names)
    runs.write_batches(conversations, out, checkpoint, made)


def risk_of(spark, folder: str) -> None:
    """One run of both streams over what the feed of scored turns holds; state and place in ``folder``."""
    turns = spark.readStream.schema(TURN).option("recursiveFileLookup", True).parquet(f"{folder}/turns")
    runs.append_rows(live.live_timeline(turns, THRESHOLD), f"{folder}/risk", f"{folder}/risk-at")


def live_risk(spark, sf):
    """Incremental scoring and alert once: conversations stream in, turns are scored batch by batch, and a
    stateful stream keeps each call's running sums and whether it has alerted."""
    folder = storage.fresh_path(spark, "live")
    scored_turns(runs.table_stream(spark, sf, "conversations"), f"{folder}/turns", f"{folder}/turns-at")
    risk_of(spark, folder)
    t = runs.read_rows(spark, f"{folder}/risk", live.OUTPUT)
    return B.rounded(t.select("call_id", "turn_index", "risk", "band", "intent", "slope", "peak", "resist", "dt", "alert"), "risk", "intent", "slope", "peak", "resist", "dt", to=5)


LINE_SQL = f"WITH {TIMELINE_SQL} SELECT call_id, turn_index, round(risk, 5) AS risk, CASE WHEN risk < 0.35 THEN 'low' WHEN risk < 0.65 THEN 'elevated' WHEN risk < 0.85 THEN 'high' ELSE 'critical' END AS band, round(intent, 5) AS intent, round(slope, 5) AS slope, round(peak, 5) AS peak, round(resist, 5) AS resist, round(dt, 5) AS dt, alert FROM line"


def voiced(turns):
    return turns.select("call_id", "turn_index", "n_tokens", (F.pmod(F.length("text"), F.lit(101)) / 100.0).alias("value"))


def voice_cache(spark, sf):
    """The throttled voice score over whole calls."""
    return B.rounded(S.voice_rescoring(voiced(B.turns(spark, sf)), "value"), "voice")


def live_voice(spark, sf):
    """The same scores from a stream's state."""
    folder = storage.fresh_path(spark, "voice")
    turns = voiced(B.turns(spark, {"conversations": runs.table_stream(spark, sf, "conversations")}))
    runs.append_rows(live.live_voice(turns), f"{folder}/voice", f"{folder}/at")
    return B.rounded(runs.read_rows(spark, f"{folder}/voice", live.VOICE), "voice")


VOICE_SQL = f"""WITH RECURSIVE {B.TURNS_SQL}, lengths AS (SELECT call_id, turn_index, greatest(700, round(n_tokens * 1000 / 2.6))::BIGINT AS ms, (length(text) % 101) / 100.0 AS v FROM turns),
  timed AS (SELECT *, (sum(ms) OVER w + 250 * (row_number() OVER w - 1))::BIGINT AS t_ms, row_number() OVER w AS k FROM lengths WINDOW w AS (PARTITION BY call_id ORDER BY turn_index)),
  means AS (SELECT *, avg(v) OVER (PARTITION BY call_id ORDER BY t_ms RANGE BETWEEN 19999 PRECEDING AND CURRENT ROW) AS m FROM timed),
  fold AS (SELECT call_id, turn_index, k, t_ms, true AS rescored, t_ms AS scored_at, m AS voice FROM means WHERE k = 1
    UNION ALL SELECT n.call_id, n.turn_index, n.k, n.t_ms, n.t_ms - f.scored_at >= 4000, CASE WHEN n.t_ms - f.scored_at >= 4000 THEN n.t_ms ELSE f.scored_at END, CASE WHEN n.t_ms - f.scored_at >= 4000 THEN n.m ELSE f.voice END
    FROM fold f JOIN means n ON n.call_id = f.call_id AND n.k = f.k + 1)
  SELECT call_id, turn_index, t_ms, rescored, scored_at, round(voice, 6) AS voice FROM fold"""

EVENT = "call_id long, seq long, event string, turn_index long, risk double, n_turns long"


def call_events(requested, line):
    """(call_id, seq, event, ...) of each requested call: meta, its turns, an alert behind the turn that
    gives it, done; or failed, where there is no such call."""
    known = requested.join(line.groupBy("call_id").agg(F.count("*").alias("n_turns")), "call_id", "left")
    none = F.lit(None)
    row = lambda event, step, turn=none, risk=none, n=none: [F.col("call_id"), F.lit(step).alias("step"), F.lit(event).alias("event"), turn.cast("long").alias("turn_index"), risk.cast("double").alias("risk"), n.cast("long").alias("n_turns")]
    there = known.where("n_turns IS NOT NULL")
    turns = line.join(requested, "call_id", "left_semi")
    out = known.where("n_turns IS NULL").select(*row("failed", 0)).unionByName(there.select(*row("meta", 0, n=F.col("n_turns")))).unionByName(there.select(*row("done", 2)))
    out = out.unionByName(turns.select(*row("turn", 1, F.col("turn_index"), F.col("risk")))).unionByName(turns.where("alert").select(*row("alert", 1, F.col("turn_index"), F.col("risk"))))
    order = Window.partitionBy("call_id").orderBy("step", "turn_index", F.desc("event"))
    return out.select("call_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "event", "turn_index", F.round("risk", 5).alias("risk"), "n_turns")


def replayed(spark, requests, line, out: str, checkpoint: str) -> None:
    """The events of the calls that a stream of requests (call_id) names, each call once."""
    runs.write_batches(requests.dropDuplicates(["call_id"]), out, checkpoint, lambda batch, _: call_events(batch, line))


def replay_events(spark, sf):
    """Requests are the users of the event stream; most have no call, which is an event too."""
    folder = storage.fresh_path(spark, "replay")
    line = R.prefix_timeline(timeline_input(spark, sf), THRESHOLD)
    requests = runs.table_stream(spark, sf, "events").select(F.col("user_id").alias("call_id")).where("call_id IS NOT NULL")
    replayed(spark, requests, line, f"{folder}/events", f"{folder}/at")
    return runs.read_rows(spark, f"{folder}/events", EVENT).select(*[c.split()[0] for c in EVENT.split(", ")])


REPLAY_SQL = f"""WITH {TIMELINE_SQL}, asked AS (SELECT DISTINCT user_id AS call_id FROM events WHERE user_id IS NOT NULL), known AS (SELECT call_id, count(line.call_id) AS n FROM asked LEFT JOIN line USING (call_id) GROUP BY 1),
  u AS (SELECT call_id, 0 AS step, 'failed' AS event, NULL::BIGINT AS turn_index, NULL::DOUBLE AS risk, NULL::BIGINT AS n_turns FROM known WHERE n = 0
    UNION ALL SELECT call_id, 0, 'meta', NULL, NULL, n FROM known WHERE n > 0 UNION ALL SELECT call_id, 2, 'done', NULL, NULL, NULL FROM known WHERE n > 0
    UNION ALL SELECT call_id, 1, 'turn', turn_index, risk, NULL FROM line SEMI JOIN asked USING (call_id) UNION ALL SELECT call_id, 1, 'alert', turn_index, risk, NULL FROM line SEMI JOIN asked USING (call_id) WHERE alert)
  SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY step, turn_index, event DESC) - 1 AS seq, event, turn_index, round(risk, 5) AS risk, n_turns FROM u"""

# ---- event time: extensions

#: Days to a delivery of events, the watermark's delay and how much later one event in 37 is delivered.
DAYS, DELAY, LATER = 12, "2 hours", "8 hours"


def arrivals(spark, sf):
    """Events by delivery: most come with those of their days, some hours late, some twice."""
    e = B.load(spark, sf, "events").where("ts IS NOT NULL AND event_id IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 41 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    came = F.when(F.col("event_id") % 37 == 0, F.col("ts") + F.expr(f"INTERVAL {LATER}")).otherwise(F.col("ts"))
    first = e.agg(F.date_trunc("day", F.min("ts")).alias("first"))
    return e.crossJoin(first).withColumn("delivery", F.floor(F.datediff(came, "first") / DAYS).cast("int")).drop("first")  # one row


def delivered(spark, sf, name: str, run) -> str:
    """Runs a stream after each delivery, always from its checkpoint; returns the folder of its rows."""
    folder, e = storage.fresh_path(spark, name), arrivals(spark, sf)
    n = (e.agg(F.max("delivery")).first()[0] or 0) + 1  # the table's months, not its rows
    schema = e.drop("delivery").schema
    for k in range(n):
        e.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/at")
    return f"{folder}/out"


def event_tumbling(spark, sf):
    out = delivered(spark, sf, "tumbling", lambda s, out, at: runs.append_rows(live.windowed_counts(s, DELAY, "6 hours", key="event_id"), out, at))
    return B.rounded(runs.read_rows(spark, out, "start timestamp, event_type string, n long, total double"), "total", to=4)


def event_sliding(spark, sf):
    out = delivered(spark, sf, "sliding", lambda s, out, at: runs.append_rows(live.windowed_counts(s, DELAY, "12 hours", "6 hours", key="event_id"), out, at))
    return B.rounded(runs.read_rows(spark, out, "start timestamp, event_type string, n long, total double"), "total", to=4)


def event_sessions(spark, sf):
    out = delivered(spark, sf, "sessions", lambda s, out, at: runs.append_rows(live.sessions(s, "3 hours", DELAY, key="event_id"), out, at))
    return runs.read_rows(spark, out, "user_id long, start timestamp, n long")


def late_events(spark, sf):
    """What the windows do not count: deliveries' rows behind the watermark that those before them made. A
    batch knows that from the greatest times of the batches before it, which it finds in their folders."""

    def run(stream, out, at):
        def make(batch, number):
            seen = runs.read_rows(spark, out, "event_type string, n long, late long, top timestamp, batch int").where(F.col("batch") < number) if number else None
            top = seen.agg(F.max("top")).first()[0] if seen is not None else None
            late = F.col("ts") <= F.date_trunc("millisecond", F.lit(top)) - F.expr(f"INTERVAL {DELAY}") if top else F.lit(False)
            return batch.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(late).alias("late"), F.max("ts").alias("top"))

        runs.write_batches(stream, out, at, make)

    out = delivered(spark, sf, "late", run)
    return runs.read_rows(spark, out, "event_type string, n long, late long, top timestamp, batch int").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


ARRIVALS_SQL = f"""arrivals AS (SELECT *, datediff('day', (SELECT min(ts) FROM events)::DATE, (CASE WHEN event_id % 37 = 0 THEN ts + INTERVAL {LATER} ELSE ts END)::DATE) // {DAYS} AS delivery
    FROM (SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL)),
  marks AS (SELECT d.delivery, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY} FROM arrivals b WHERE b.delivery < d.delivery) AS mark FROM (SELECT DISTINCT delivery FROM arrivals) d),
  final AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY} AS final FROM arrivals),
  judged AS (SELECT arrivals.*, coalesce(ts <= mark, false) AS late FROM arrivals JOIN marks USING (delivery)), kept AS (SELECT * FROM judged WHERE NOT late)"""
_START = "to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP"

QUERIES = {f.__name__: f for f in (live_risk, voice_cache, live_voice, replay_events, event_tumbling, event_sliding, event_sessions, late_events)}
ORACLES = {
    "live_risk": LINE_SQL,
    "voice_cache": VOICE_SQL,
    "live_voice": VOICE_SQL,
    "replay_events": REPLAY_SQL,
    "event_tumbling": f"WITH {ARRIVALS_SQL} SELECT {_START} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM kept CROSS JOIN final WHERE {_START} + INTERVAL 6 HOUR <= final GROUP BY 1, 2",
    "event_sliding": f"WITH {ARRIVALS_SQL}, w AS (SELECT *, {_START} - back * INTERVAL 6 HOUR AS start FROM kept CROSS JOIN (SELECT unnest([0, 1]) AS back)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w CROSS JOIN final WHERE start + INTERVAL 12 HOUR <= final GROUP BY 1, 2",
    "event_sessions": f"""WITH {ARRIVALS_SQL}, s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM kept))
      SELECT user_id, min(ts) AS start, count(*) AS n FROM s CROSS JOIN final GROUP BY user_id, k, final HAVING max(ts) + INTERVAL 3 HOUR <= final""",
    "late_events": f"WITH {ARRIVALS_SQL} SELECT event_type, CAST(sum(CASE WHEN event_id % 41 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(sum(CASE WHEN late THEN CASE WHEN event_id % 41 = 0 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS late FROM judged GROUP BY 1",
}
