"""Audio operators over tables of signals (signal_id, sr, samples array<float>).

Signals are processed where they lie, some rows of an Arrow batch at a time; only features leave the
worker, and no waveform is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp

_PROSODY = ("f0_mean", "f0_std", "f0_range", "f0_slope", "voiced_ratio", "jitter", "shimmer", "hnr", "energy_std", "energy_range", "rate", "rate_std", "pause_ratio")
_SHAPE = ("centroid", "bandwidth", "rolloff", "flatness", "flux")


def _each(signals: DataFrame, schema: str, make) -> DataFrame:
    """``make`` gives the rows (dicts) of one signal. Where the schema has an ``error``, a signal that
    fails is one row with its message; elsewhere it ends the job."""
    names = [part.split()[0] for part in schema.split(", ")]

    def guarded(x, sr):
        try:
            return [{"error": None, **r} for r in make(x, sr)]
        except Exception as problem:  # whatever one recording may hold
            return [{**dict.fromkeys(names), "error": f"{type(problem).__name__}: {problem}"[:200]}]

    each = guarded if "error" in names else make

    def run(batches):
        for pdf in batches:
            rows = [{"signal_id": i, **r} for i, sr, x in zip(pdf.signal_id, pdf.sr, pdf.samples, strict=True) for r in each(np.asarray(x if x is not None else [], float), int(sr) or dsp.RATE)]
            if rows:
                yield pd.DataFrame(rows)

    return signals.select("signal_id", "sr", "samples").mapInPandas(run, f"signal_id {signals.schema['signal_id'].dataType.simpleString()}, {schema}")


def frame_levels(signals: DataFrame) -> DataFrame:
    """(signal_id, frame, energy, rms_db, zcr)."""

    def make(x, sr):
        f = dsp.frames(x, sr)
        return [{"frame": k, "energy": e, "rms_db": d, "zcr": z} for k, (e, d, z) in enumerate(zip(dsp.energy(f), dsp.rms_db(f), dsp.zero_crossings(f), strict=True))]

    return _each(signals, "frame int, energy double, rms_db double, zcr double", make)


def spectral_features(signals: DataFrame) -> DataFrame:
    """(signal_id, frame, centroid, bandwidth, rolloff, flatness, flux)."""

    def make(x, sr):
        s = dsp.spectral_shape(dsp.power(dsp.frames(x, sr)), sr)
        return [{"frame": k, **{n: float(s[n][k]) for n in _SHAPE}} for k in range(len(s["flux"]))]

    return _each(signals, "frame int, " + ", ".join(f"{n} double" for n in _SHAPE), make)


def cepstral_features(signals: DataFrame, kind: str = "mfcc", with_deltas: bool = False, normalised: bool = False) -> DataFrame:
    """(signal_id, frame, coef)."""

    def make(x, sr):
        c = dsp.cepstra(x, kind, sr)
        c = np.hstack([c, d := dsp.deltas(c), dsp.deltas(d)]) if with_deltas else c
        c = dsp.cmvn(c) if normalised and len(c) else c
        return [{"frame": k, "coef": row.tolist()} for k, row in enumerate(c)]

    return _each(signals, "frame int, coef array<double>", make)


def utterance_vectors(signals: DataFrame, kind: str = "lfcc") -> DataFrame:
    """(signal_id, vector): 480 pooled numbers."""
    return _each(signals, "vector array<double>", lambda x, sr: [{"vector": dsp.utterance_vector(dsp.condition(x, sr), kind, sr).tolist()}])


def prosody_features(signals: DataFrame, errors: bool = False) -> DataFrame:
    """(signal_id, thirteen numbers), and with ``errors`` what kept a signal from having them."""
    return _each(signals, ", ".join(f"{n} double" for n in _PROSODY) + (", error string" if errors else ""), lambda x, sr: [dsp.prosody(x, sr)])


def interpretable_features(signals: DataFrame, kind: str = "lfcc") -> DataFrame:
    """(signal_id, eleven numbers) on what the spectrum does."""
    names = tuple(dsp.interpretable(np.zeros(0)))
    return _each(signals, ", ".join(f"{n} double" for n in names), lambda x, sr: [dsp.interpretable(x, sr, kind)])


def arousal_components(signals: DataFrame) -> DataFrame:
    """(signal_id, f0_cv, f0_span, emphasis_var, rate_std, voiced_ratio); null for segments too short."""
    names = ("f0_cv", "f0_span", "emphasis_var", "rate_std", "voiced_ratio")
    return _each(signals, ", ".join(f"{n} double" for n in names), lambda x, sr: [dsp.arousal_components(x, sr) or dict.fromkeys(names)])


def channel_statistics(signals: DataFrame) -> DataFrame:
    """(signal_id, ten statistics of the channel) of signals as a detector gets them, conditioned."""
    names = tuple(dsp.channel_statistics(np.zeros(0)))
    return _each(signals, ", ".join(f"{n} double" for n in names), lambda x, sr: [dsp.channel_statistics(dsp.condition(x, sr), sr)])


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (signal_id, sr, real, made) with both sides down one channel; a pair stays in its row."""

    def run(batches):
        for pdf in batches:
            both = [dsp.match_channel(np.asarray(a, float), np.asarray(b, float), int(sr) or dsp.RATE) for a, b, sr in zip(pdf.real, pdf.made, pdf.sr, strict=True)]
            yield pdf.assign(real=[a.astype(np.float32) for a, _ in both], made=[b.astype(np.float32) for _, b in both])

    kind = pairs.schema["signal_id"].dataType.simpleString()
    return pairs.select("signal_id", "sr", "real", "made").mapInPandas(run, f"signal_id {kind}, sr int, real array<float>, made array<float>")


def speech_segments(signals: DataFrame) -> DataFrame:
    """(signal_id, t_start, t_end) of speech."""
    return _each(signals, "t_start double, t_end double", lambda x, sr: [{"t_start": a * dsp.HOP_S, "t_end": z * dsp.HOP_S + dsp.FRAME_S - dsp.HOP_S} for a, z in dsp.runs(dsp.speech_mask(x, sr))])


def degraded(signals: DataFrame, codec: str, snr_db: float | None = None, noise: str = "white") -> DataFrame:
    """(signal_id, sr, samples, real_codec): noise first, then the codec; a stand-in says that it is one."""
    from . import audio_codecs

    def make(x, sr):
        x = dsp.mix_at(x, dsp.noise(noise, len(x), sr, seed=len(x)), snr_db) if snr_db is not None else x
        y, real = audio_codecs.apply(x, codec, sr)
        return [{"sr": sr, "samples": y.astype(np.float32).tolist(), "real_codec": real}]

    return _each(signals, "sr int, samples array<float>, real_codec boolean", make)


def signal_to_noise(pairs: DataFrame, clean: str = "clean", noisy: str = "noisy") -> DataFrame:
    """Adds ``snr_db`` of two sample arrays, without leaving the JVM."""
    power = F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x)
    gap = F.aggregate(F.zip_with(clean, noisy, lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda a, x: a + x)
    return pairs.withColumn("snr_db", 10 * F.log10(F.greatest(power, F.lit(1e-12)) / F.greatest(gap, F.lit(1e-12))))
