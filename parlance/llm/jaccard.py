"""Exact Jaccard join of documents on word shingles, as a join in the metric space of sets.

A document's set holds its distinct four-word shingles. 1 - Jaccard similarity is a metric, so sets can
be dealt by their distances to pivots; two sets link when that distance is ``EPS`` = 1 - percent / 100
or less. Exact copies (equal sets) are one point of the space from the start.

Pivots, outermost first:

1. One-shingle sets. A set is at distance 1 - 1/n from the pivots that it holds and at 1 from all
   others, so it lies in the cells of the shingles it holds. Of n shingles in one fixed order a set
   needs the cells of its first n - ceil(percent * n / 100) + 1: two sets that link share one of
   those. Rare shingles come first in the order, so that cells are small; frequencies decide the order
   alone, never the result. Sets of a cell stay together when their sketches allow a link (counts of
   shingles by hash, whose L1 distance never exceeds the number of shingles that two sets do not share).
   What stays together, over all cells, is a region; no link leaves its region.
2. Member sets. A region is joined by its own pivots: sets within EPS of a pivot link with it and are
   one component. By the triangle inequality a set can link with another component only where some
   member of one lies within EPS of its distance to every pivot; sets without such a partner are done.
   The others form Voronoi regions around the pivots: a set whose distance to a pivot exceeds that to
   its nearest one by 2 * EPS or less, and that is no further than the region's radius + EPS, is
   replicated into that region. Regions are joined recursively; where pivots cannot tell sets apart, the
   region is compared in blocks of exact intersection counts.

Regions above ``region_values`` shingles are dealt by the same rules as Spark joins (distances from shingles
shared with pivots, radii and nearest others from grouped extremes), round by round; where a round
does not shrink a region, it is dealt into pairs of blocks. No task and not the driver holds more than one
region, and the driver sees counts and the ``COMMON`` most frequent shingles alone.

Defined cases: a null or wordless text has no shingles and links with nothing, not even another such
row; fewer words than a shingle has are one shingle; rows without doc_id keep their row, and a component's
id is its least non-null doc_id.
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
PERCENT = 85
SIZE = 4
#: Shingles of a region that one task joins; and the sets of a cell above which it is one region at once.
REGION_VALUES = 1 << 22
CELL_ROWS = 4096
#: Pivots to a region, and sets that are compared directly.
PIVOTS = 8
LEAF = 48
#: Shingles whose frequency moves them back in the order; and bits of the filter of candidate sets.
COMMON = 1 << 17
FILTER_BITS = 1 << 26
BLOCK = 1 << 20
#: A sketch has a power of two of counts, one for each so many shingles and at least this many, a byte each
#: (255 stands for all greater ones, which only lowers a distance). Half as many are the sums of neighbours.
_PER_LANE = 8
_LANES = 64
_FEW = 16


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles of each document, ascending by document, then hash."""
    starts, ends, doc = tb.words(data, offsets, tb.SPACED)
    word = tb.xxh64(tb.LOWER[data], starts, ends)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    of = np.repeat(np.arange(n), shingles)
    at = (np.cumsum(count) - count)[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    end = np.cumsum(count)[of]
    padded = np.concatenate([word, np.zeros(size, U)])
    h = np.zeros(len(of), U)
    for d in range(size):
        h = h * U(0x9E3779B97F4A7C15) + np.where(at + d < end, padded[at + d], U(1))
    h = tb.mix(h)
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.int16), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _common(docs: DataFrame, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (of those that recur within some task), ascending, and the number of
    binary digits of their counts. They only set the order of shingles."""

    def count(batches):
        def flushed(held):
            h, n = tb.counted(np.concatenate(held))
            often = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

        held, size_ = [], 0
        for block in tb.blocks(batches, "text", BLOCK, 1 << 15):
            held.append(shingles_of(*tb.utf8(block.column(0)), size)[0])
            size_ += len(held[-1])
            if size_ > 1 << 22:
                yield flushed(held)
                held, size_ = [], 0
        if held:
            yield flushed(held)

    top = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], np.array([int(x).bit_length() for x in n[order].tolist()], np.int64)


def _keys(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and 16 bytes that equal sets alone share."""
    size = np.bincount(doc, minlength=n)
    key, some = np.zeros((n, 2), U), np.flatnonzero(size)
    if len(some):
        first = (np.cumsum(size) - size)[some]
        key[some, 0] = np.add.reduceat(tb.mix(h), first)
        key[some, 1] = np.add.reduceat(tb.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), first)
    return size, key


def _binary(key: np.ndarray) -> pa.Array:
    n = len(key)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * key.itemsize * key.shape[1]), pa.py_buffer(np.ascontiguousarray(key))])


def sketches_of(h: np.ndarray, doc: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the sketches of sets of ``held`` shingles: counts by their hashes' leading bits."""
    bits = np.ceil(np.log2(np.maximum(held / _PER_LANE, _LANES))).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(1 << bits)))
    lane = (h >> (64 - bits[doc]).astype(U)).astype(np.int64)
    return first.astype(np.int32), np.minimum(np.bincount(first[doc] + lane, minlength=first[-1]), 255).astype(np.uint8)


def _prints(docs: DataFrame, size: int, percent: int, common) -> DataFrame:
    """(doc_id, n, key, cells, sketch) of every document."""

    def run(batches):
        often, rank = common.value
        seen = np.zeros(1 << 20, bool)
        seen[(often >> U(44)).astype(np.int64)] = True
        for block in tb.blocks(batches, "text", BLOCK, 1 << 15):
            n = block.num_rows
            h, doc = shingles_of(*tb.utf8(block.column(1)), size)
            held, key = _keys(h, doc, n)
            # the order of shingles: seldom ones first, then by hash
            place = np.zeros(len(h), np.int64)
            maybe = np.flatnonzero(seen[(h >> U(44)).astype(np.int64)])
            if len(maybe):
                k = np.minimum(np.searchsorted(often, h[maybe]), len(often) - 1)
                hit = often[k] == h[maybe]
                place[maybe[hit]] = rank[k[hit]]
            order = np.argsort(doc * 64 + place, kind="stable")
            cells = np.where(held > 0, held - (percent * held + 99) // 100 + 1, 0)
            within = np.arange(len(h)) - np.repeat(np.cumsum(held) - held, held)
            chosen = h[order][within < cells[doc]]
            cell = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cells))).astype(np.int32)), pa.array(chosen.view(np.int64)))
            sketch = pa.Array.from_buffers(pa.binary(), n, [None, *map(pa.py_buffer, sketches_of(h, doc, held))])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(held, pa.int64()), _binary(key), cell, sketch], names=["doc_id", "n", "key", "cells", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, cells array<long>, sketch binary")


def _groups(batches):
    """The rows, sorted by their first column, as tables in which no group of it is cut."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = batch.column(0).to_numpy()
        if key[0] == key[-1] and held.column(0)[0].as_py() == key[0]:
            continue  # one group so far
        tail = batch.num_rows - int(np.searchsorted(key, key[-1]))
        yield held.slice(0, held.num_rows - tail).combine_chunks()
        held = held.slice(held.num_rows - tail)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return first, np.diff(np.append(first, len(key)))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Root (least member) of each component, with links i - j added."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


class Sketches:
    """The sketches of a column, and the sizes of their sets."""

    def __init__(self, column, n: np.ndarray):
        raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        self.n, self.first, self.lanes, self.data = n, offsets[:-1], np.diff(offsets), np.frombuffer(raw.buffers()[2] or b"", np.uint8)

    def of(self, which: np.ndarray, lanes: int) -> np.ndarray:
        """Counts of these sets in so many lanes each, which is no more than any of them has."""
        out = np.zeros((len(which), lanes), np.int32)
        for own in np.unique(self.lanes[which]).tolist():
            mine = np.flatnonzero(self.lanes[which] == own)
            counts = self.data[self.first[which[mine]][:, None] + np.arange(own)].astype(np.int32)
            out[mine] = counts.reshape(len(mine), lanes, own // lanes).sum(axis=2)
        return out

    def may_link(self, apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether so many shingles apart, or more, allow a link of sets of a and b shingles."""
        return ((100 + percent) * apart <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def pairs_that_may_link(u: Sketches, v: Sketches, percent: int) -> np.ndarray:
    """Whether the sketches and sizes of u and v, row by row, allow a link."""
    good = np.zeros(len(u.n), bool)
    lanes = np.minimum(u.lanes, v.lanes)
    near = 100 * np.minimum(u.n, v.n) >= percent * np.maximum(u.n, v.n)
    for m in np.unique(lanes[near]).tolist():
        all_ = np.flatnonzero((lanes == m) & near)
        for k in range(0, len(all_), max(1, (1 << 22) // m)):
            some = all_[k : k + max(1, (1 << 22) // m)]
            good[some] = u.may_link(np.abs(u.of(some, m) - v.of(some, m)).sum(axis=1), u.n[some], v.n[some], percent)
    return good


def _shared(table: pa.Table) -> pa.RecordBatch:
    """(cell, u, v): of cells of a few sets all pairs, distinct, without their cell; of larger cells their sets u."""
    cell, ids = table.column("cell").to_numpy(), table.column("set").to_numpy()
    first, size = _edges(cell)
    u, v = [], []
    for c in range(2, _FEW + 1):
        at = first[size == c]
        for a in range(c):
            for b in range(a + 1, c):
                u.append(np.minimum(ids[at + a], ids[at + b]))
                v.append(np.maximum(ids[at + a], ids[at + b]))
    order = np.lexsort([v := np.concatenate(v), u := np.concatenate(u)])
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v = u[new], v[new]
    many = np.repeat(size > _FEW, size)
    mask = np.concatenate([np.ones(len(u), bool), np.zeros(int(many.sum()), bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([u, cell[many]]), pa.int64(), mask=mask), pa.array(np.concatenate([u, ids[many]])), pa.array(np.concatenate([v, ids[many]]), pa.int64(), mask=~mask)], names=["cell", "u", "v"]
    )


def _cell_links(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of the same cell that keep all those together that may link there."""
    cell, ids, n = (table.column(c).to_numpy() for c in ("cell", "set", "n"))
    sketch = Sketches(table.column("sketch"), n)
    out = [(np.zeros(0, np.int64),) * 2]
    for f, c in zip(*(x.tolist() for x in _edges(cell)), strict=True):
        order = f + np.argsort(n[f : f + c], kind="stable")
        size, root, k = n[order], np.arange(c), 0
        while k < c:
            # sets of about one size, and all larger ones that may still link with one of them
            z = max(k + 1, min(k + 64, int(np.searchsorted(size, size[k] * 100 // percent, "right"))))
            upto = int(np.searchsorted(size, size[z - 1] * 100 // percent, "right"))
            if upto > k + 1 and (root[k:upto] != root[k]).any():
                counts = sketch.of(order[k:upto], int(sketch.lanes[order[k:upto]].min()))
                apart = np.stack([np.abs(counts - one).sum(axis=1) for one in counts[: z - k]])
                i, j = np.nonzero(sketch.may_link(apart, size[k:z, None], size[None, k:upto], percent))
                _unite(root, i + k, j + k)
            k = z
        child = np.flatnonzero(root != np.arange(c))
        out.append((ids[order[child]], ids[order[root[child]]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Region:
    """Some sets (sorted hashes one after the other), and the components that their links make."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, percent: int = PERCENT):
        self.percent, self.eps = percent, 1 - percent / 100 + 1e-9
        self.n = np.diff(offsets)
        _, token, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[token] > 1  # what one set alone holds is in no intersection
        self.token = (np.cumsum(count > 1) - 1)[token[shared]]
        self.tokens = int((count > 1).sum())
        of = np.repeat(np.arange(len(self.n)), self.n)[shared]
        self.first = np.searchsorted(of, np.arange(len(self.n) + 1))
        self.root = np.arange(len(self.n))

    def _of(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(self.first)[members]
        of = np.repeat(np.arange(len(members)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[members][of]
        return of, self.token[at]

    def distances(self, members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distance of each member to each pivot; links are noted."""
        of, token = self._of(members)
        out = np.empty((len(members), len(pivots)))
        for k, p in enumerate(pivots.tolist()):
            mark = np.zeros(self.tokens + 1, bool)
            mark[self.token[self.first[p] : self.first[p + 1]]] = True
            both = np.bincount(of[mark[token]], minlength=len(members))
            both[members == p] = self.n[p]
            union = self.n[members] + self.n[p] - both
            near = np.flatnonzero(100 * both >= self.percent * union)
            _unite(self.root, members[near], np.full(len(near), p))
            out[:, k] = 1 - both / union
        return out

    def compare(self, members: np.ndarray) -> None:
        """All members with each other, in blocks of exact counts."""
        of, token = self._of(members)
        used, token = np.unique(token, return_inverse=True)
        for k in range(0, len(members), 256):
            rest = np.arange(k, len(members))
            if (self.root[members[rest]] == self.root[members[k]]).all():
                return
            both = np.zeros((min(256, len(rest)), len(rest)), np.float32)
            for t in range(0, len(used), 2048):
                some = (token >= t) & (token < t + 2048) & (of >= k)
                held = np.zeros((len(rest), 2048), np.float32)
                held[of[some] - k, token[some] - t] = 1
                both += held[: len(both)] @ held.T
            both = both.astype(np.int64)
            n = self.n[members[rest]]
            i, j = np.nonzero(100 * both >= self.percent * (n[: len(both), None] + n[None, :] - both))
            keep = i < j
            _unite(self.root, members[rest[i[keep]]], members[rest[j[keep]]])

    def join(self) -> None:
        """Finds the components of all links."""
        left = [np.arange(len(self.n))]
        while left:
            members = left.pop()
            if (self.root[members] == self.root[members[0]]).all():
                continue
            if len(members) <= LEAF:
                self.compare(members)
                continue
            spread = members[np.linspace(0, len(members) - 1, PIVOTS).astype(np.int64)]
            d = self.distances(members, np.unique(spread))
            # triangle inequality: who has a member of another component within EPS, seen from every pivot?
            component = self.root[members]
            open_ = np.ones(len(members), bool)
            for k in range(d.shape[1]):
                order = np.argsort(d[:, k], kind="stable")
                sorted_, changes = d[order, k], np.concatenate(([0], np.cumsum(component[order[1:]] != component[order[:-1]])))
                lo, hi = np.searchsorted(sorted_, sorted_ - self.eps, "left"), np.searchsorted(sorted_, sorted_ + self.eps, "right")
                open_[order[changes[hi - 1] == changes[lo]]] = False
            d, members = d[open_], members[open_]
            if len(members) < 2:
                continue
            own = d.argmin(axis=1)
            nearest = d[np.arange(len(d)), own]
            parts = []
            for k in np.unique(own).tolist():
                radius = nearest[own == k].max()
                parts.append(members[(d[:, k] <= nearest + 2 * self.eps) & (d[:, k] <= radius + self.eps)])
            if max(map(len, parts)) * 10 <= len(open_) * 9:
                left += parts
            else:
                self.compare(members)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of each member that is not its component's root."""
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


def _region_links(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): links within each region of ``rows`` (region, set, hashes)."""

    def run(batches):
        for table in _groups(batches):
            key, ids = table.column("region").to_numpy(), table.column("set").to_numpy()
            hashes = table.column("hashes").combine_chunks()
            hashes = hashes.chunk(0) if isinstance(hashes, pa.ChunkedArray) else hashes
            offsets = hashes.offsets.to_numpy().astype(np.int64)
            values = hashes.values.to_numpy().view(U)
            out = []
            for f, c in zip(*(x.tolist() for x in _edges(key)), strict=True):
                if c < 2:
                    continue
                region = Region(values[offsets[f] : offsets[f + c]], offsets[f : f + c + 1] - offsets[f], percent)
                region.join()
                u, v = region.links()
                out.append((ids[f + u], ids[f + v]))
            if out:
                u, v = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "u long, v long")


def _hash_arrays(docs: DataFrame, wanted: DataFrame, size: int, bits: int) -> DataFrame:
    """(region, set, hashes) of the wanted sets (region, set, key): the texts are read once more, and a
    filter of fixed size leaves most other sets out before anything is shuffled."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    words = wanted.select(place.alias("place")).selectExpr("shiftright(place, 6) AS w", "shiftleft(1L, CAST(place % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def run(batches):
        given: set[bytes] = set()  # equal sets are sent once by a task, as long as few were sent
        for block in tb.blocks(batches, "text", BLOCK, 1 << 15):
            n = block.num_rows
            h, doc = shingles_of(*tb.utf8(block.column(0)), size)
            held, key = _keys(h, doc, n)
            at = _spark_xxh64(key) % bits
            keep = ((sent.value[at >> 6] >> (at & 63)) & 1 == 1) & (held > 0)
            for k in np.flatnonzero(keep).tolist():
                mine = key[k].tobytes()
                if mine in given:
                    keep[k] = False
                elif len(given) < 1 << 16:
                    given.add(mine)
            some = np.flatnonzero(keep)
            chosen = h[keep[doc]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held[some]))).astype(np.int32)), pa.array(chosen.view(np.int64)))
            yield pa.RecordBatch.from_arrays([_binary(key[some]), lists], names=["key", "hashes"])

    found = docs.select("text").mapInArrow(run, "key binary, hashes array<long>")
    # grouped by the key of the join as well: its partitions are those of the join
    return wanted.join(found, "key").groupBy("key", "region", "set").agg(F.first("hashes").alias("hashes")).select("region", "set", "hashes")


def _spark_xxh64(key: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 16-byte keys, as numbers of 0 or more modulo any power of two up to 2^62."""
    start = np.arange(len(key)) * 16
    data = np.ascontiguousarray(key).view(np.uint8).ravel()
    return (tb.xxh64(data, start, start + 16, 42) & U((1 << 62) - 1)).astype(np.int64)


def _dealt(held: DataFrame, region_values: int, percent: int, pivots: int) -> tuple[DataFrame, list[DataFrame]]:
    """Regions (region, set, hashes) of ``region_values`` shingles or fewer, and links found on the way: one
    round after the other deals the larger regions by pivots. Regions of a few sets stay, however long."""
    eps = 1 - percent / 100 + 1e-9
    sized = F.count("*").alias("c"), F.sum(F.size("hashes").cast("long")).alias("v")
    is_large = (F.col("v") > region_values) & (F.col("c") > LEAF)
    large = stage(held.groupBy("region").agg(*sized).where(is_large), "large")
    if large.isEmpty():
        return held, []
    sets = held.drop("region")
    ready, links, parents = [held.join(large, "region", "left_anti")], [], None
    members = stage(held.join(large, "region").select("region", "set"), "members")
    while True:
        if parents is not None:  # what a round of pivots did not shrink goes to pairs of blocks
            blocks = F.least(F.ceil(2 * F.col("v") / region_values), F.col("c")).cast("int")
            same = large.join(parents, "region").where("v * 10 > parent * 9").select("region", blocks.alias("blocks"))
            stuck = members.join(same, "region").withColumn("mine", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
            pairs = stuck.select("set", "region", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            pairs = pairs.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "set")
            ready.append(pairs.join(sets, "set").select("region", "set", "hashes"))
            members = stage(members.join(large, "region").select("region", "set").join(same, "region", "left_anti"), "members")
        if members.isEmpty():
            break
        found, fresh, parents = _round(members, sets, percent, eps, pivots)
        links.append(found)
        dealt = fresh.join(sets, "set")
        large = stage(dealt.groupBy("region").agg(*sized).where(is_large), "large")
        ready.append(dealt.join(large, "region", "left_anti").select("region", "set", "hashes"))
        members = stage(fresh.join(large, "region").select("region", "set"), "members")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out, links


def _round(now: DataFrame, held: DataFrame, percent: int, eps: float, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One Voronoi round over large regions: (links with pivots, new regions, parents' sizes by region)."""
    from pyspark.sql import Window

    sized = held.select("set", F.size("hashes").cast("long").alias("n"))
    order = Window.partitionBy("region").orderBy(F.xxhash64("set"), "set")
    chosen = stage(now.withColumn("pivot", F.row_number().over(order)).where(F.col("pivot") <= pivots).join(sized, "set").select("region", "pivot", F.col("set").alias("at"), F.col("n").alias("m")), "pivots")
    theirs = chosen.join(held, F.col("at") == F.col("set")).select("region", "pivot", F.explode("hashes").alias("h"))
    mine = now.join(held, "set").select("region", "set", F.explode("hashes").alias("h"))
    both = mine.join(theirs, ["region", "h"]).groupBy("region", "set", "pivot").agg(F.count("*").alias("both"))
    all_ = now.join(sized, "set").join(chosen, "region").join(both, ["region", "set", "pivot"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("n") + F.col("m") - F.col("both")
    far = stage(all_.select("region", "set", "pivot", "at", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= percent * union).alias("near")), "distances")
    links = far.where("near AND set <> at").select(F.col("set").alias("u"), F.col("at").alias("v"))
    # the nearest pivot of each set, and each pivot's radius
    nearest = far.groupBy("region", "set").agg(F.min(F.struct("d", "pivot")).alias("own")).select("region", "set", F.col("own.d").alias("least"), F.col("own.pivot").alias("own"))
    placed = far.join(nearest, ["region", "set"])
    radius = placed.where("pivot = own").groupBy("region", "pivot").agg(F.max("d").alias("radius"))
    cells = placed.join(radius, ["region", "pivot"]).where((F.col("d") <= F.col("least") + 2 * eps) & (F.col("d") <= F.col("radius") + eps))
    # sets linked with the pivot are one component: only those within EPS of the next other one's distance stay
    others = cells.where("NOT near").groupBy("region", "pivot").agg(F.min("d").alias("next"))
    kept = cells.join(others, ["region", "pivot"]).where((~F.col("near")) | (F.col("d") >= F.col("next") - eps))
    fresh = stage(kept.select(F.xxhash64("region", "pivot").alias("new"), "region", "set"), "cells")
    size = now.join(sized, "set").groupBy("region").agg(F.sum("n").alias("parent"))
    parents = fresh.select("new", "region").distinct().join(size, "region").select(F.col("new").alias("region"), "parent")
    return links, fresh.select(F.col("new").alias("region"), "set"), stage(parents, "parents")


def components_by_jaccard(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SIZE, region_values: int = REGION_VALUES, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, common: int = COMMON, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(_common(slim, size, common))
    prints = stage(_prints(slim, size, percent, sent), "prints")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  (equal sets have equal cells and sketches)
    distinct = prints.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), first("n"), first("cells"), first("sketch"))
    sets = stage(distinct.withColumn("set", F.monotonically_increasing_id()), "sets")
    prints = stage(prints.select("doc_id", "n", "key"), "prints", instead_of=prints)

    def several(batches):
        for table in _groups(batches):
            yield _shared(table)

    entries = sets.select(F.explode("cells").alias("cell"), "set").repartition("cell").sortWithinPartitions("cell")
    shared = stage(entries.mapInArrow(several, "cell long, u long, v long"), "shared")
    sets = stage(sets.drop("cells"), "sets", instead_of=sets)
    sketch = lambda c: sets.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def checked(batches):
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.names.index(c))
            u, v, n_u, n_v = (column(c).to_numpy() for c in ("u", "v", "n_u", "n_v"))
            good = pairs_that_may_link(Sketches(column("s_u"), n_u), Sketches(column("s_v"), n_v), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])

    def together(batches):
        for table in _groups(batches):
            u, v = _cell_links(table, percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    pairs = shared.where("cell IS NULL").select("u", "v").distinct().join(sketch("u"), "u").join(sketch("v"), "v").mapInArrow(checked, "u long, v long")
    cells = shared.where("cell IS NOT NULL").select("cell", F.col("u").alias("set"))
    hot = stage(cells.groupBy("cell").agg(F.count("*").alias("c"), F.min("set").alias("v")).where(F.col("c") > cell_rows).select("cell", "v"), "hot")
    whole = cells.join(hot, "cell").select(F.col("set").alias("u"), "v")
    cold = cells.join(hot, "cell", "left_anti").join(sets.select("set", "n", "sketch"), "set").select("cell", "set", "n", "sketch")
    coarse = components(pairs.unionByName(cold.repartition("cell").sortWithinPartitions("cell").mapInArrow(together, "u long, v long")).unionByName(whole).distinct())
    members = coarse.select(F.col("root").alias("region"), F.col("vertex").alias("set"))
    members = stage(members.unionByName(members.select("region", F.col("region").alias("set")).distinct()), "members")
    wanted = stage(members.join(sets.select("set", "key"), "set").select("region", "set", "key"), "wanted", instead_of=members)
    held = stage(_hash_arrays(slim, wanted, size, filter_bits), "held")
    regions, links = _dealt(held, region_values, percent, pivots)
    found = _region_links(regions, percent)
    for more in links:
        found = found.unionByName(more)
    roots = components(found)
    known = stage(sets.select("set", "key", "least").join(roots.withColumnRenamed("vertex", "set"), "set", "left").select("key", "least", F.coalesce("root", "set").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(known.join(least, "root").select("key", "component_id"), "named")
    with_words = prints.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13(spark, sf_dir: str) -> DataFrame:
    return components_by_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), held AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) END AS s FROM worded
), kinds AS (
  SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS k, min(doc_id) OVER (PARTITION BY list_sort(s)) AS least, r, doc_id, s FROM held
), sets AS (
  SELECT k, min(least) AS least, first(s) AS s, len(first(s)) AS n FROM kinds GROUP BY k
), members AS (
  SELECT k, n, unnest(s) AS h FROM sets
), links AS (
  SELECT a.k AS x, b.k AS y FROM members a JOIN members b ON a.h = b.h AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT k AS x, k AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), named AS (
  SELECT reach.x AS k, min(least) AS component_id FROM reach JOIN sets ON reach.y = sets.k GROUP BY reach.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id FROM kinds JOIN named USING (k)
"""
