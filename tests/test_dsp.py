import math

import numpy as np
import pytest

from parlance.functions import dsp
from parlance.operators import audio, audio_codecs
from parlance.sources import wav

SR = 8000


def tone(hz, seconds=1.0, amp=0.5):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(SR * seconds)) / SR)


def test_frames_and_levels():
    f = dsp.frames(tone(100))
    assert f.shape == (98, 200) and dsp.frame_count(199, 200, 80) == 0
    assert dsp.rms_db(dsp.frames(tone(200, amp=1.0)))[3] == pytest.approx(-3.0103, abs=1e-3)
    assert dsp.zero_crossings(dsp.frames(tone(1000))).mean() == pytest.approx(0.25, abs=0.01)


def test_spectrum_of_a_tone():
    s = dsp.spectral_shape(dsp.power(dsp.frames(tone(1000)), "hann"))
    assert s["centroid"].mean() == pytest.approx(1000, abs=20) and s["flatness"].max() < 0.01 and s["flux"][0] == 0
    white = dsp.spectral_shape(dsp.power(dsp.frames(dsp.noise("white", SR))))
    assert white["flatness"].mean() > 0.3 and white["centroid"].mean() == pytest.approx(2000, abs=150)


def test_dct_is_orthonormal_and_scales_invert():
    m = dsp.dct(40, 40)
    assert np.allclose(m @ m.T, np.eye(40))
    hz = np.array([100.0, 1000, 3000])
    assert np.allclose(dsp.from_mel(dsp.to_mel(hz)), hz) and np.allclose(dsp.from_erb(dsp.to_erb(hz)), hz)
    for scale in ("mel", "erb", "linear", "cq"):
        assert (dsp.filterbank(scale).sum(axis=1) > 0).all()


def test_levinson_finds_an_autoregression():
    rng = np.random.default_rng(0)
    x = np.zeros(20000)
    for t in range(2, len(x)):
        x[t] = 1.3 * x[t - 1] - 0.6 * x[t - 2] + rng.standard_normal()
    a, _ = dsp.levinson(dsp.autocorrelation(x[None], 4), 4)
    assert np.allclose(a[0], [1.3, -0.6, 0, 0], atol=0.03)
    c = dsp.lpc_cepstra(a[:, :2], np.ones(1), 4)
    assert c[0, 1] == pytest.approx(a[0, 0]) and c[0, 2] == pytest.approx(a[0, 1] + a[0, 0] ** 2 / 2)


@pytest.mark.parametrize("kind", ["mfcc", "lfcc", "gfcc", "cqcc", "lpcc"])
def test_cepstra_shapes(kind):
    c = dsp.cepstra(tone(440) + 0.1 * dsp.noise("white", SR), kind)
    assert c.shape == (98, 20) and np.isfinite(c).all()
    assert np.allclose(dsp.cmvn(c).mean(axis=0), 0, atol=1e-9) and (dsp.deltas(c[:1]) == 0).all()
    assert dsp.utterance_vector(tone(440), kind).shape == (480,)


@pytest.mark.parametrize("hz", [90, 150, 220, 330])
def test_pitch(hz):
    x = sum(tone(hz * k, amp=0.3 / k) for k in (1, 2, 3))
    f0 = dsp.yin(x)
    assert np.median(f0[f0 > 0]) == pytest.approx(hz, rel=0.02)
    p = dsp.prosody(x)
    assert p["jitter"] < 0.02 and p["hnr"] > 10 and len(p) == 13


def test_silence_and_speech():
    p = dsp.prosody(np.zeros(SR))
    assert p["pause_ratio"] == 1 and all(math.isfinite(v) for v in p.values())
    x = np.concatenate([0.001 * dsp.noise("white", SR), tone(200), 0.001 * dsp.noise("white", SR)])
    [(a, z)] = dsp.runs(dsp.speech_mask(x))
    assert a * 0.01 == pytest.approx(1.0, abs=0.08) and z * 0.01 == pytest.approx(2.0, abs=0.08)
    m = np.array([1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0], bool)
    assert dsp.runs(dsp.smoothed(m, 2, 2, 1)) == [(0, 8)]


def test_channels():
    x, n = tone(500), dsp.noise("white", SR)
    for snr in (0, 10, 25):
        assert dsp.measured_snr(x, dsp.mix_at(x, n, snr)) == pytest.approx(snr, abs=1e-6)
    band = dsp.telephone_band(tone(100) + tone(1000))
    assert np.abs(np.fft.rfft(band))[100] < 0.05 * np.abs(np.fft.rfft(band))[1000]
    y = dsp.resample(dsp.resample(x, SR, 16000), 16000, SR)
    assert np.abs(y[200:-200] - x[200:-200]).max() < 2e-3
    assert (dsp.packet_loss(x, 0.5) == 0).mean() == pytest.approx(0.5, abs=0.2)
    for codec, limit in (("ulaw", 30), ("alaw", 30), ("gsm", 5)):
        y, real = audio_codecs.apply(x, codec, SR)
        assert dsp.measured_snr(x, y) > limit and real == (codec != "gsm")


def test_wav_round_trip_and_tables(spark, tmp_path):
    x = tone(300, 0.3)
    for k, width in enumerate((1, 2, 3, 4)):
        import wave

        with wave.open(str(tmp_path / f"{k}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(width), w.setframerate(SR)
            scale = (1 << (8 * width - 1)) - 1
            v = np.round(x * scale).astype(np.int64) + (128 if width == 1 else 0)
            w.writeframes(b"".join(int(s).to_bytes(width, "little", signed=width > 1) * 2 for s in v))
    (tmp_path / "9.wav").write_bytes(b"no audio")
    df = wav.read_wav(spark, f"file://{tmp_path}")
    got = {r.signal_id[-5]: r.samples for r in df.collect()}
    assert got.pop("9") is None and len(got) == 4
    for k, s in got.items():
        assert np.abs(np.array(s) - x).max() < (0.01 if k == "0" else 1e-4)
    [r] = wav.encoded(df.where("signal_id LIKE '%1.wav'"), peak=None).collect()
    assert np.abs(wav.decode(bytes(r.wav))[1] - x).max() < 1e-3
    good = df.where("samples IS NOT NULL")
    assert audio.cepstral_features(good).count() == 4 * 28 and audio.prosody_features(good).count() == 4
    assert {len(r.vector) for r in audio.utterance_vectors(good).collect()} == {480}
    assert audio.frame_levels(df.where("samples IS NULL")).count() == 0
