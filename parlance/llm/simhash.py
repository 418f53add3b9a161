"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: lower-case A-Z, words, three-word shingles with repeats, XXH64 (seed 42); a bit is set
if it is set in over half of the hashes. Distinct fingerprints alone are compared, so a group of
exact copies of any size is one of them.

Two fingerprints that differ in ``radius`` bits or fewer agree on at least one of ``radius + 1``
parts of their bits, so buckets of equal parts lose no link. A bucket above ``bucket_rows`` is dealt
anew by the parts of its remaining bits, level by level, which is exact too. Inside a bucket bit
planes stand vertically, 64 fingerprints to a machine word; carry-save counters of two bits and an
overflow flag take up plane after plane for many fingerprints at once, and a block is given up as
soon as every counter is beyond the radius. A bucket returns a spanning forest of its links, never
all its pairs; the components of all forests are those of all links.

Defined cases: a null, empty or wordless text has fingerprint zero, linked like any other; one or
two words are one shingle; rows without doc_id keep their row, and a group's component_id is its
least non-null doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .shared import stage

U = np.uint64
RADIUS = 2
BUCKET_ROWS = 4096
_SEED = 42
#: Eight bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).copy().view("<u8").ravel()


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """The fingerprint of each document of a block."""
    n = len(offsets) - 1
    starts, ends, doc = tb.words(data, offsets, tb.SPACED)
    out = np.zeros(n, U)
    if not len(starts):
        return out
    held, start, end = tb.joined(tb.LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    doc = np.repeat(np.arange(n), shingles)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    a = first[doc] + within
    b = a + np.minimum(size, count[doc]) - 1
    h = tb.xxh64(held, start[a], end[b], _SEED)
    # sums of set bits: lanes of one byte over 255 shingles at most, then whole numbers by document
    cut = np.flatnonzero(within % 255 == 0)
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.empty((len(cut), 64), np.int32)
    for j in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, 7 - j]], cut)
        votes[:, 8 * j : 8 * j + 8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    some = np.flatnonzero(shingles)
    votes = np.add.reduceat(votes, np.searchsorted(doc[cut], some), axis=0)
    bits = votes * 2 > shingles[some, None]
    out[some] = np.packbits(bits, axis=1).copy().view(">u8").ravel().astype(U)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every document; the long holds the 64 bits as they are."""

    def run(batches):
        for block in tb.blocks(batches, "text"):
            fp = fingerprints_of(*tb.utf8(block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, radius: int = RADIUS):
    """Pairs (i, j), i < j, within the radius (3 at most), some queries at a time, by bit-sliced comparison."""
    n = len(fp)
    wide = -(-n // 64)
    bits = np.unpackbits(np.concatenate([fp, np.zeros(wide * 64 - n, U)]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(U)  # 64 planes of so many words
    for q in range(0, n, 64):
        mine = np.arange(q, min(q + 64, n))
        w0 = q // 64
        flip = np.where(bits[mine].T.astype(bool), U(0xFFFFFFFFFFFFFFFF), U(0))
        # lanes at or before the query itself, or behind the end, count as beyond the radius at once
        over = np.zeros((len(mine), wide - w0), U)
        over[:, 0] = ~((U(0xFFFFFFFFFFFFFFFE)) << (mine - q).astype(U))
        if n % 64:
            over[:, -1] |= U(0xFFFFFFFFFFFFFFFF) << U(n % 64)
        one, two = np.zeros_like(over), np.zeros_like(over)
        for b in range(64):
            d = planes[b, w0:] ^ flip[b][:, None]
            carry = one & d
            one ^= d
            over |= two & carry
            two ^= carry
            if b % 8 == 7 and b >= 15:
                beyond = over if radius == 3 else over | (two & one) if radius == 2 else over | two if radius == 1 else over | two | one
                if (beyond == U(0xFFFFFFFFFFFFFFFF)).all():
                    break
        else:
            beyond = over if radius == 3 else over | (two & one) if radius == 2 else over | two if radius == 1 else over | two | one
            near = ~beyond
            i, w = np.nonzero(near)
            if len(i):
                lane = np.unpackbits(np.ascontiguousarray(near[i, w]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, b = np.nonzero(lane)
                yield mine[i[k]], (w[k] + w0) * 64 + b


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its component) within one set of distinct fingerprints."""
    root = np.arange(len(fp))
    for i, j in close_pairs(fp, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def _parts(mask: int, pieces: int) -> list[int]:
    """Masks of the remaining bits, dealt to so many pieces of consecutive bits."""
    left = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(left) / pieces) for k in range(pieces + 1)]
    return [mask | sum(1 << b for b in left[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(df: DataFrame, masks: list[int], pieces: int) -> tuple[DataFrame, list[int]]:
    """Each (fp, mask) by every finer mask of its own, with the bucket's key."""
    finer = {m: _parts(m, pieces) for m in masks}
    table = F.create_map(*[x for m, parts in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))])
    out = df.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
    return out.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))), [p for parts in finer.values() for p in parts]


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links (u, v) of a table (fp) of distinct fingerprints; the closure of all links within
    the radius."""
    ready, masks = [], [0]
    df = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for _ in range(3):
        df, masks = _keyed(df, masks, radius + 1)
        large = stage(df.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"), "large")
        if large.isEmpty():
            ready.append(df)
            break
        ready.append(df.join(large, "key", "left_anti"))
        df = df.join(large, "key", "left_semi").select("fp", "mask")
    else:
        ready.append(_keyed(df, masks, radius + 1)[0])  # buckets that agree on nearly all bits
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)

    def run(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, U)

        def blocks_of(key, fp):
            """Runs of whole buckets of two or more, 256 rows or one bucket at a time."""
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            many = np.repeat(size > 1, size)
            key, fp = key[many], fp[many]
            if not len(key):
                return
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            at = 0
            while at < len(key):
                k = np.searchsorted(ends, at + 256, "right") - 1
                upto = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[np.searchsorted(ends, at, "right")])
                yield np.unique(fp[at:upto])
                at = upto

        def linked(key, fp):
            got = [forest(block, radius) for block in blocks_of(key, fp)]
            got = [x for x in got if len(x[0])]
            if got:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(U)])
            tail = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            yield from linked(key[:tail], fp[:tail]) if tail else ()
            held_key, held_fp = key[tail:], fp[tail:]
        if len(held_key):
            yield from linked(held_key, held_fp)

    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = stage(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius, bucket_rows))
    known = stage(distinct.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(known.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
