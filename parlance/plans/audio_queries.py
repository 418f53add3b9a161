"""Queries of the audio operators over tones that both engines can make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as A
from . import base as B

_N = 1200


def tones(spark, sf):
    """A tone for each page: its frequency and loudness by its id."""
    p = B.load(spark, sf, "pages").select(F.col("page_id").alias("signal_id"), F.lit(8000).alias("sr"))
    hz, loud = 200 + 20 * F.pmod("signal_id", F.lit(40)), 0.1 + 0.02 * F.pmod("signal_id", F.lit(30))
    x = F.transform(F.sequence(F.lit(0), F.lit(_N - 1)), lambda t: loud * F.sin(2 * F.pi() * hz * t / 8000.0) + F.when((t % 400) < 100, 0.0).otherwise(0.01))
    return p.withColumn("samples", x)


TONES_SQL = f"tones AS (SELECT page_id AS signal_id, t, (0.1 + 0.02 * (page_id % 30)) * sin(2 * pi() * (200 + 20 * (page_id % 40)) * t / 8000.0) + CASE WHEN t % 400 < 100 THEN 0.0 ELSE 0.01 END AS x FROM pages, range({_N}) r(t))"


def frame_levels(spark, sf):
    return B.rounded(A.frame_levels(tones(spark, sf)), "energy", "rms_db", "zcr", to=5)


def snr(spark, sf):
    t = tones(spark, sf).select("signal_id", F.col("samples").alias("clean"), F.transform("samples", lambda x, i: x + F.when(i % 2 == 0, 0.01).otherwise(-0.01)).alias("noisy"))
    return B.rounded(A.signal_to_noise(t).select("signal_id", "snr_db"), "snr_db", to=5)


def spectral_features(spark, sf):
    s = A.spectral_features(tones(spark, sf))
    return s.groupBy("signal_id").agg(F.count("*").alias("frames"), F.avg("centroid").alias("centroid"), F.avg("flatness").alias("flatness"))


def cepstra(spark, sf):
    return A.cepstral_features(tones(spark, sf), "mfcc", with_deltas=True)


def utterance_vectors(spark, sf):
    return A.utterance_vectors(tones(spark, sf))


def prosody(spark, sf):
    return A.prosody_features(tones(spark, sf))


def speech_segments(spark, sf):
    return A.speech_segments(tones(spark, sf))


def degraded(spark, sf):
    d = A.degraded(tones(spark, sf), "ulaw", 20.0)
    return d.select("signal_id", "real_codec", F.size("samples").alias("n"))


QUERIES = {"frame_levels": frame_levels, "snr": snr, "spectral_features": spectral_features, "cepstra": cepstra, "utterance_vectors": utterance_vectors, "prosody": prosody, "speech_segments": speech_segments, "degraded": degraded}
ORACLES = {
    "degraded": f"SELECT page_id AS signal_id, true AS real_codec, {_N} AS n FROM pages",
    "frame_levels": f"WITH {TONES_SQL}, f AS (SELECT signal_id, k AS frame, x, t, lag(x) OVER (PARTITION BY signal_id, k ORDER BY t) AS y FROM tones, range(13) r(k) WHERE t >= 80 * k AND t < 80 * k + 200) SELECT signal_id, frame::INT AS frame, round(sum(x * x), 5) AS energy, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-5)), 5) AS rms_db, round(avg(((x >= 0) <> (y >= 0))::INT), 5) AS zcr FROM f GROUP BY ALL",
    "snr": f"WITH {TONES_SQL} SELECT signal_id, round(10 * log10(greatest(sum(x * x), 1e-12) / greatest(sum(0.01 * 0.01), 1e-12)), 5) AS snr_db FROM tones GROUP BY 1",
}
