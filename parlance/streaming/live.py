"""Live scoring: the prefix timeline as a stateful stream, a row for each turn as it comes.

State is a handful of running sums for each call, so a turn costs the same however long its call is.
Turns of a call are put in order within a micro-batch. Across batches they are expected in order, as
the batch timeline reads them, unless they are to ``wait``: then a turn that comes before an earlier
one is kept in the state until all turns from the first on are there. Calls that stay silent for
``silence_ms`` are dropped from the state; what still waits then comes in the order it has.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "call_id long, turn_index long, intent double, slope double, peak double, resist double, risk double, band string, dt double, alert boolean"
_STATE = "n double, sx double, sy double, sxy double, sxx double, peak double, top double, total double, scored double, pressed double, tokens double, resist double, others double, end double, alerted double, waiting string"
_NAMES = [part.split()[0] for part in _STATE.split(",")][:-1]


def _advance(s: dict[str, float], t, threshold: float) -> tuple:
    if t.speaker == "caller":
        x, y = float(t.turn_index), float(t.rank)
        s["n"] += 1
        s["sx"] += x
        s["sy"] += y
        s["sxy"] += x * y
        s["sxx"] += x * x
        s["peak"] = max(s["peak"], y)
        s["top"] = max(s["top"], float(t.score)) if s["scored"] else float(t.score)
        s["total"] += float(t.score)
        s["scored"] += 1
    else:
        s["others"] += 1
        s["resist"] += t.act in ("VICTIM_RESIST", "VICTIM_QUESTION")
    s["pressed"] += float(t.n_pressed)
    s["tokens"] += float(t.n_tokens)
    spread = s["n"] * s["sxx"] - s["sx"] ** 2
    slope = float(np.clip((s["n"] * s["sxy"] - s["sx"] * s["sy"]) / spread, -1, 1)) if s["n"] >= 2 and spread > 1e-9 else 0.0
    intent = float(np.clip(0.6 * s["top"] + 0.4 * s["total"] / s["scored"], 0, 1)) if s["scored"] else 0.0
    pressed = float(np.clip(100 * s["pressed"] / max(1.0, s["tokens"]) / 6, 0, 1))
    risk = float(np.clip(0.30 * intent + 0.14 * pressed + 0.14 * np.clip(2 * slope, 0, 1), 0, 1))
    band = "low" if risk < 0.35 else "elevated" if risk < 0.65 else "high" if risk < 0.85 else "critical"
    end = float(t.t_end) if hasattr(t, "t_end") else s["end"] + max(0.7, float(t.n_tokens) / 2.6) + (0.25 if s["n"] + s["others"] > 1 else 0.0)
    dt, s["end"] = max(0.0, end - s["end"]), end
    alert = risk >= threshold and not s["alerted"]
    s["alerted"] = float(bool(s["alerted"]) or alert)
    return t.call_id, t.turn_index, intent, slope, s["peak"], s["resist"] / s["others"] if s["others"] else 0.0, risk, band, dt, bool(alert)


def live_timeline(turns: DataFrame, threshold: float = 0.65, silence_ms: int | None = None, wait: bool = False, first: int = 0) -> DataFrame:
    """The rows of ``risk.prefix_timeline`` for a stream of turns with the same columns. Where turns carry no
    ``t_end``, their times follow from their tokens, as ``sequences.timings`` estimates them."""
    columns = OUTPUT.replace(",", "").split()[::2]

    def step(key, frames, state: GroupState):
        *held, waiting = state.get if state.exists else (*[0.0] * len(_NAMES), "[]")
        s = dict(zip(_NAMES, held, strict=True))
        late = [] if state.hasTimedOut else list(frames)
        kept = pd.DataFrame(json.loads(waiting))
        turns_ = pd.concat([x for x in (kept, *late) if len(x)] or [kept])
        turns_ = turns_.sort_values("turn_index", kind="stable") if len(turns_) else turns_
        if wait and not state.hasTimedOut and len(turns_):
            due = first + s["n"] + s["others"]  # a turn counts as one of either
            ready = turns_.turn_index.to_numpy() == due + np.arange(len(turns_))
            upto = len(ready) if ready.all() else int(np.argmin(ready))
            turns_, kept = turns_[:upto], turns_[upto:]
        else:
            kept = turns_[:0]
        rows = [_advance(s, t, threshold) for t in turns_.itertuples()]
        if state.hasTimedOut:
            state.remove()
            if rows:
                yield pd.DataFrame(rows, columns=columns)
            return
        state.update((*(float(s[n]) for n in _NAMES), kept.to_json(orient="records")))
        if silence_ms:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(rows, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy("call_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", timeout)


VOICE = "call_id long, turn_index long, t_ms long, rescored boolean, scored_at long, voice double"


def live_voice(turns: DataFrame, gap_ms: int = 4000, window_ms: int = 20000) -> DataFrame:
    """The rows of ``sequences.voice_rescoring`` for a stream of turns (call_id, turn_index, n_tokens, value)
    that come in order. State: the time so far, the last score and when it was taken, and the turns
    of the trailing window."""
    columns = VOICE.replace(",", "").split()[::2]

    def step(key, frames, state: GroupState):
        now, at, voice, kept = state.get if state.exists else (-1, -1, 0.0, "[]")
        trail = [tuple(x) for x in json.loads(kept)]
        rows = []
        for t in pd.concat(list(frames)).sort_values("turn_index", kind="stable").itertuples():
            now = max(0, now + 250 if now >= 0 else 0) + max(700, round(t.n_tokens * 1000 / 2.6))
            trail = [x for x in trail if x[0] > now - window_ms] + [(now, float(t.value))]
            fresh = at < 0 or now - at >= gap_ms
            if fresh:
                at, voice = now, sum(x[1] for x in trail) / len(trail)
            rows.append((key[0], t.turn_index, now, fresh, at, voice))
        state.update((now, at, voice, json.dumps(trail)))
        yield pd.DataFrame(rows, columns=columns)

    return turns.groupBy("call_id").applyInPandasWithState(step, VOICE, "now long, at long, voice double, trail string", "append", GroupStateTimeout.NoTimeout)


def _within(events: DataFrame, late: str, key: str | None) -> DataFrame:
    """Events that are not later than the watermark, each key once within it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark([key]) if key else timed


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, key: str | None = None) -> DataFrame:
    """(start, event_type, n, total): event counts and sums by tumbling or, with ``slide``, sliding window.
    Events behind the watermark are dropped, and with a ``key`` repeated ones too. An extension."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _within(events, late, key).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """(user_id, start, n) of runs of events with no longer gap. An extension."""
    return _within(events, late, key).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
