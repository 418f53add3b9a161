"""Codec round trips on numpy signals."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions import dsp
from ..functions.g711 import ALAW_ENDS, ULAW_BIAS, ULAW_CLIP, ULAW_ENDS


def pcm16(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x * 32767), -32768, 32767).astype(np.int32)


@lru_cache(2)
def _levels(law: str) -> np.ndarray:
    """What each 16-bit sample comes back as."""
    pcm = np.arange(-32768, 32768)
    if law == "ulaw":
        p = pcm >> 2
        v = np.minimum(np.abs(p), ULAW_CLIP) + (ULAW_BIAS >> 2)
        seg = np.minimum(np.searchsorted(ULAW_ENDS, v), 7)
        step = (v >> (seg + 1)) & 15
        level = (((step << 3) + ULAW_BIAS) << seg) - ULAW_BIAS
        return np.where(p < 0, -level, level)
    q = pcm >> 3
    v = np.where(q >= 0, q, -q - 1)
    seg = np.searchsorted(ALAW_ENDS, v)
    step = (v >> np.maximum(seg, 1)) & 15
    level = np.where(seg == 0, (step << 4) + 8, ((step << 4) + 0x108) << np.maximum(seg - 1, 0))
    return np.where(q >= 0, level, -level)


def apply(x: np.ndarray, codec: str, sr: int) -> tuple[np.ndarray, bool]:
    """(signal, whether the codec is the real one)."""
    if codec in ("ulaw", "alaw"):
        return _levels(codec)[pcm16(x) + 32768] / 32767.0, True
    if codec == "gsm":
        return dsp.gsm_stand_in(x, sr), False
    if codec == "clean":
        return x, True
    raise ValueError(f"unknown codec {codec}")
