"""Document fingerprints by consistent weighted sampling.

A text is its words weighted by how often they occur (a word of more than 32 bytes counts as its
pieces of 16). For each of ``samples`` draws every term has gamma variates r and c and a uniform b
that only the term and the draw decide; with t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r
the term of least a is drawn, as the pair (term, t). Two texts draw the same pair with a probability
equal to the generalised Jaccard similarity of their weights, sum(min) / sum(max), so the share of
equal draws estimates it, with a standard error of at most 0.5 / sqrt(samples).

The variates come from tables of quantiles, so they do not depend on a processor's logarithm. A draw
is kept as 16 bits; unequal draws agree by chance once in 65,536.

Defined cases: null, empty and blank texts have no terms and share one fingerprint, which is unlike
all others; rows of equal ids follow each other by a hash of their text; the document after the last is the first,
so a single document is followed by itself.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import dealt_by_id, stage

U = np.uint64
SAMPLES = 64
_LONG, _PIECE = 32, 16
_BLOCK = 1 << 20
RANGE_BYTES = 24 << 20


@lru_cache(1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of a Gamma(2, 1) variate, and their logarithms: roots of
    1 - (1 + x) exp(-x) = p by bisection, rounded to single precision."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


@lru_cache(1)
def _logs() -> np.ndarray:
    return np.array([0.0] + [math.log(k) for k in range(1, 1 << 12)], np.float32)


def weighted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term of 48 bits, count) of a block of up to 65,536 documents, as ``tb.blocks`` cuts them."""
    starts, ends, doc = tb.words(data, offsets, tb.SPACED)
    n = np.where(ends - starts > _LONG, -(-(ends - starts) // _PIECE), 1)
    if (n > 1).any():
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        cut = n[of] > 1
        a = np.where(cut, starts[of] + within * _PIECE, starts[of])
        ends = np.where(cut, np.minimum(a + _PIECE, ends[of]), ends[of])
        starts, doc = a, doc[of]
    term = tb.xxh64(data, starts, ends) >> U(16)
    key, count = tb.counted(doc.astype(U) << U(48) | term)
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), count


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """uint16 [documents, samples] of a block; a document without terms has zeros only."""
    doc, term, count = weighted_terms(data, offsets)
    out = np.zeros((len(offsets) - 1, samples), np.uint16)
    if not len(doc):
        return out
    # draws depend on (term, count) alone, so each such pair, named by its term's rank, is drawn once in a block
    _, rank = np.unique(term, return_inverse=True)
    pair, where = np.unique(rank * (int(count.max()) + 1) + count, return_inverse=True)
    first = np.zeros(len(pair), np.int64)
    first[where] = np.arange(len(where))
    own, weight = term[first], count[first]
    logs = _logs()
    log_w = np.where(weight < len(logs), logs[np.minimum(weight, len(logs) - 1)], np.log(np.maximum(weight, 1))).astype(np.float32)
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    seg = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(doc))))
    gamma, log_gamma = _quantiles()
    low = U(0xFFFF)
    for k in range(samples):
        h = tb.mix(own + U((k * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (1 << 64) - 1))
        r = gamma[h & low]
        b = ((h >> U(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + b)
        a = log_gamma[(h >> U(16)) & low] - r * (t - b) - r
        drawn = (tb.mix(h ^ (t.astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))) >> U(48)).astype(np.uint16)
        all_a = a[where]
        least = np.minimum.reduceat(all_a, begin)
        at = np.flatnonzero(all_a == least[seg])
        owner = seg[at]
        at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]  # of equals the first
        out[doc[begin], k] = np.maximum(drawn[where[at]], 1)  # zero marks no terms
    return out


def _texts(texts: list[str], samples: int) -> np.ndarray:
    return signatures(*tb.utf8(pa.array(texts, pa.large_string())), samples)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _described(ids: list, texts: list[str], following: list[str], samples: int) -> list[pa.Array]:
    """The result columns of documents whose following texts are known."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, other = _texts(texts, samples), _texts(new, samples)
    same = len(following) > 1 and all(a is b for a, b in zip(texts[1:], following, strict=False))
    after = np.concatenate([own[1:], _texts(following[-1:], samples)]) if same else _texts(following, samples)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in other], pa.binary()),
        pa.array((own == other).mean(axis=1)), pa.array((own == after).mean(axis=1)),
    ]


_SHOWN = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SHOWN_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def likeness_by_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likeness.

    One shuffle deals the documents to ranges of ids. Within a range each document's successor is
    the next row; only a range's last document looks beyond, and those few wait for the first
    documents of the next ranges in a second, small step.
    """

    def within(batches):
        number, waiting, begun = None, None, False  # waiting: the last row, whose successor is to come
        ends = []
        for block in tb.blocks(batches, "text", _BLOCK):
            number = block.column(2)[0].as_py()
            ids, texts = block.column(0).to_pylist(), [t or "" for t in block.column(1).to_pylist()]
            if not begun:
                ends.append((1, ids[0], texts[0]))
                begun = True
            if waiting:
                ids, texts = [waiting[0], *ids], [waiting[1], *texts]
            if len(ids) > 1:
                columns = _described(ids[:-1], texts[:-1], texts[1:], samples)
                rows = len(ids) - 1
                yield pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), pa.array([number] * rows, pa.int32()), pa.array([None] * rows, pa.string()), *columns], names=["kind", "part", "text", *_SHOWN])
            waiting = ids[-1], texts[-1]
        if waiting:
            ends.append((2, *waiting))
            none = [pa.array([None] * 2, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int32()), pa.array([number] * 2, pa.int32()), pa.array([e[2] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.int64()), *none], names=["kind", "part", "text", *_SHOWN])

    dealt = dealt_by_id(docs, doc_id, text, RANGE_BYTES, ranges).withColumn("part", F.spark_partition_id())
    found = stage(dealt.mapInArrow(within, f"kind int, part int, text string, {_SHOWN_TYPES}"), "prints")

    heads, tails = found.where("kind = 1"), found.where("kind = 2")
    following = Window.orderBy("part")  # a row for each range
    pairs = heads.select("part").select("part", F.lead("part").over(following).alias("then"), F.min("part").over(following).alias("first"))
    pairs = pairs.select("part", F.coalesce("then", "first").alias("then"))
    first = heads.select(F.col("part").alias("then"), F.col("text").alias("following"))
    last = tails.select("part", "doc_id", "text").join(pairs, "part").join(first, "then").select("doc_id", "text", "following")

    def across(batches):
        for block in tb.blocks(batches, "text", _BLOCK):
            ids, texts, after = (c.to_pylist() for c in block.columns)
            yield pa.RecordBatch.from_arrays(_described(ids, texts, after, samples), names=_SHOWN)

    out = found.where("kind = 0").select(*_SHOWN).unionByName(last.mapInArrow(across, _SHOWN_TYPES))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op5(spark, sf_dir: str) -> DataFrame:
    return likeness_by_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
