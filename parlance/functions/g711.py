"""G.711 companding as integer expressions: whole-stage code, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard: the segments' ends, the mu-law bias and clip.
ULAW_ENDS = (0x3F, 0x7F, 0xFF, 0x1FF, 0x3FF, 0x7FF, 0xFFF, 0x1FFF)
ALAW_ENDS = (0x1F, 0x3F, 0x7F, 0xFF, 0x1FF, 0x3FF, 0x7FF, 0xFFF)
ULAW_BIAS, ULAW_CLIP = 0x84, 8159


def _segment(v: Column, ends: tuple[int, ...]) -> Column:
    out = F
    for k, end in enumerate(ends):
        out = out.when(v <= end, k)
    return out.otherwise(len(ends))


def _shift_right(v: Column, by: Column, most: int) -> Column:
    """v >> by for a small computed shift."""
    return F.floor(v / F.element_at(F.array(*[F.lit(1 << k) for k in range(most + 1)]), (by + 1).cast("int"))).cast("int")


def ulaw_encode(pcm: Column) -> Column:
    """A 16-bit sample to its mu-law code, 0 to 255."""
    p = F.shiftright(pcm.cast("int"), 2)
    mask = F.when(p < 0, 0x7F).otherwise(0xFF)
    v = F.least(F.abs(p), F.lit(ULAW_CLIP)) + (ULAW_BIAS >> 2)
    seg = _segment(v, ULAW_ENDS)
    low = F.least(seg, F.lit(7))
    code = F.shiftleft(low, 4).bitwiseOR(_shift_right(v, low + 1, 8).bitwiseAND(F.lit(0xF))).bitwiseXOR(mask)
    return F.when(seg >= 8, F.lit(0x7F).bitwiseXOR(mask)).otherwise(code).cast("int")


def ulaw_decode(code: Column) -> Column:
    u = F.lit(255) - code.cast("int")
    t = F.shiftleft(u.bitwiseAND(F.lit(0x0F)), 3) + ULAW_BIAS
    t = (t * F.pow(F.lit(2), F.shiftright(u.bitwiseAND(F.lit(0x70)), 4))).cast("int")
    return F.when(u.bitwiseAND(F.lit(0x80)) != 0, F.lit(ULAW_BIAS) - t).otherwise(t - ULAW_BIAS)


def alaw_encode(pcm: Column) -> Column:
    """A 16-bit sample to its A-law code, 0 to 255."""
    p = F.shiftright(pcm.cast("int"), 3)
    mask = F.when(p >= 0, 0xD5).otherwise(0x55)
    v = F.when(p >= 0, p).otherwise(-p - 1)
    seg = _segment(v, ALAW_ENDS)
    shift = F.when(seg < 2, 1).otherwise(seg)
    return F.shiftleft(seg, 4).bitwiseOR(_shift_right(v, shift, 8).bitwiseAND(F.lit(0xF))).bitwiseXOR(mask).cast("int")


def alaw_decode(code: Column) -> Column:
    a = code.cast("int").bitwiseXOR(F.lit(0x55))
    t = F.shiftleft(a.bitwiseAND(F.lit(0x0F)), 4)
    seg = F.shiftright(a.bitwiseAND(F.lit(0x70)), 4)
    up = ((t + 0x108) * F.pow(F.lit(2), F.greatest(seg - 1, F.lit(0)))).cast("int")
    t = F.when(seg == 0, t + 8).when(seg == 1, t + 0x108).otherwise(up)
    return F.when(a.bitwiseAND(F.lit(0x80)) != 0, t).otherwise(-t)
