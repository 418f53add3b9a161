"""WAV files as tables of signals and back. Files are read by Spark's binary source."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp


def decode(data: bytes, rate: int | None = None) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of PCM of 8, 16, 24 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        n, width, channels, sr = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(n), np.uint8)
    if width == 1:
        x = (raw.astype(float) - 128) / 128
    else:
        parts = raw.reshape(-1, width).astype(np.int64)
        value = sum(parts[:, k] << (8 * k) for k in range(width))
        value -= (value >> (8 * width - 1)) << (8 * width)
        x = value / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    return (sr, x) if rate is None or rate == sr else (rate, dsp.resample(x, sr, rate))


def encode(x: np.ndarray, sr: int, peak: float | None = 0.95) -> bytes:
    """16-bit mono; ``peak`` None keeps the gain."""
    x = x if peak is None else dsp.normalise(np.asarray(x, float), peak)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.clip(np.round(np.asarray(x) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """(signal_id, sr, samples) of WAV files; the id is the path. A file that is none has null samples."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    sr, x = decode(data, rate)
                    rows.append((name, sr, x.astype(np.float32)))
                except (wave.Error, EOFError, ValueError):
                    rows.append((name, 0, None))
            yield pd.DataFrame(rows, columns=["signal_id", "sr", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "signal_id string, sr int, samples array<float>")


def encoded(signals: DataFrame, peak: float | None = 0.95) -> DataFrame:
    """Adds ``wav``, the file's bytes."""

    @F.pandas_udf("binary")
    def make(sr: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([encode(x, int(r), peak) for r, x in zip(sr, samples, strict=True)])

    return signals.withColumn("wav", make("sr", "samples"))
