"""Benchmark decontamination with suffix arrays of the training documents.

Each block of whole documents is a shard. Its suffix array holds, sorted word by word, the suffixes
that begin with a word pair of the benchmark (others cannot share two words with a test suffix; where
an item has one word only, those that begin with a word of the benchmark). Every test suffix is
binary-searched in every shard, equal ones once; the range found gives all places where its window
occurs verbatim. Windows of one length have disjoint ranges, so a shard yields no more places than it
has suffixes for each length of window (one length, but for items shorter than a window). Words are
compared by their XXH64.

The benchmark is the stated query set. It reaches the executors in parts of ``part_bytes`` of text,
``at_once`` parts to a pass; a larger benchmark takes further passes, each over the staged rows, and
what its parts find of a document is put together by the row. Documents are never joined with each
other; with one pass nothing is shuffled, for a result row needs its own document alone.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item occurs
nowhere; an item of fewer words than the window is one window; equal items all count; a null item_id
reads as the string "null"; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import stage

WINDOW = 10
#: Benchmark text in a part (some ten times as much memory), and parts that are held at once.
PART_BYTES = 4 << 20
AT_ONCE = 8
_FEW = 1 << 15
BLOCK = 1 << 20


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_)))


def _spread(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, begin + 0..n - 1) of all members of some ranges."""
    of = np.repeat(np.arange(len(n)), n)
    return of, begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


class TestPart:
    """The test suffixes of some benchmark items: word hashes, and the distinct windows to search for.

    ``owner`` (items by window, from ``owned`` on) has the items that hold a window, ``origin`` where
    each holds it first, and ``group`` a number that windows of the same items share."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
        starts, ends, item = tb.words(data, offsets, tb.ALNUM)
        self.ids, self.window = ids, window
        self.words = np.concatenate([tb.xxh64(tb.LOWER[data], starts, ends), np.zeros(window, np.uint64)])
        self.first = np.searchsorted(item, np.arange(len(ids) + 1))
        n = np.diff(self.first)
        span = np.minimum(n, window)
        of, at = _spread(self.first[:-1], np.where(n > 0, n - span + 1, 0))
        length = span[of]
        # equal windows side by side
        keys = [np.where(d < length, self.words[at + d], np.uint64(0)) for d in range(window)]
        order = np.lexsort([at, *keys[::-1], length])
        same = np.ones(max(0, len(order) - 1), bool)
        for k in (length, *keys):
            same &= k[order[1:]] == k[order[:-1]]
        begin = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        self.at, self.length = at[order[begin]], length[order[begin]]
        pair, first = np.unique(number * (len(ids) + 1) + of[order], return_index=True)
        self.owner, self.origin = pair % (len(ids) + 1), at[order[first]]
        self.owned = np.searchsorted(pair // (len(ids) + 1), np.arange(len(begin) + 1))
        groups: dict[bytes, int] = {}
        self.group = np.array([groups.setdefault(self.owner[a:z].tobytes(), len(groups)) for a, z in zip(self.owned, self.owned[1:], strict=False)], np.int64)
        self.members = [np.frombuffer(g, self.owner.dtype) for g in groups]
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.lead = _lead(self.words, self.at, min(2, self.shortest))
        self.leads = np.unique(self.lead)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.leads >> np.uint64(44)).astype(np.int64)] = True


def _lead(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first word, or the first two, of the suffixes at these places."""
    return words[at] if n < 2 else tb.mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + 1])


class Shard:
    """The word hashes of some whole documents, each followed by ``pad`` words that match nothing."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pad: int):
        n = len(offsets) - 1
        starts, ends, doc = tb.words(data, offsets, tb.ALNUM)
        self.n_words = np.bincount(doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.n_words + pad)))
        self.words = np.zeros(self.first[-1], np.uint64)
        place = np.arange(len(starts)) + doc * pad
        self.words[place] = tb.xxh64(tb.LOWER[data], starts, ends)
        self.place, self.doc, self.pad = place, doc, pad

    def suffixes(self, part: TestPart) -> np.ndarray:
        """Places of the suffixes that some test suffix may share its first words with, sorted."""
        lead = _lead(self.words, self.place, min(2, part.shortest))
        maybe = np.flatnonzero(part.seen[(lead >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(part.leads, lead[maybe])
        k[k == len(part.leads)] = 0
        places = self.place[maybe[part.leads[k] == lead[maybe]]]
        return places[np.lexsort([self.words[places + d] for d in range(part.window - 1, -1, -1)])]


def _bounds(shard: Shard, suffixes: np.ndarray, part: TestPart, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last suffix that begins with each window, by binary search."""
    at, length = part.at[pick], part.length[pick]
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            right = np.zeros(len(open_), bool)  # the suffix at mid lies before the bound
            left = np.arange(len(open_))
            for d in range(part.window):
                over = d >= length[open_[left]]
                right[left[over]] = upper  # equal on the whole window
                left = left[~over]
                if not len(left):
                    break
                mine, theirs = part.words[at[open_[left]] + d], shard.words[suffixes[mid[left]] + d]
                right[left] = theirs < mine
                left = left[theirs == mine]
            right[left] = upper  # equal on the whole window
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def occurrences(shard: Shard, part: TestPart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in the shard, number of the distinct window) of all occurrences, some windows at a time."""
    if not part.shortest or not len(shard.place):
        return
    suffixes = shard.suffixes(part)
    if not len(suffixes):
        return
    here = np.unique(_lead(shard.words, suffixes, min(2, part.shortest)))
    windows = np.flatnonzero(np.isin(part.lead, here))
    for k in range(0, len(windows), _FEW):
        few = windows[k : k + _FEW]
        lo, hi = _bounds(shard, suffixes, part, few)
        window, at = _spread(lo, hi - lo)
        yield suffixes[at], few[window]


def _passes(benchmark: DataFrame, item: str, text: str, window: int, part_bytes: int, at_once: int) -> Iterator[list]:
    """The benchmark's parts, broadcast, in passes of ``at_once``; no part holds much more than
    ``part_bytes``, and at least one pass comes, be it of no parts."""
    spark = benchmark.sparkSession
    slim = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = slim.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    n = math.ceil(total / part_bytes)
    for first in range(0, max(1, n), at_once):
        parts = []
        for k in range(first, min(n, first + at_once)):
            rows = (slim if n == 1 else slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()
            if rows:
                parts.append(spark.sparkContext.broadcast(TestPart([r.i for r in rows], [r.t for r in rows], window)))
        yield parts, first + at_once >= n


def _let_go(parts: list) -> None:
    for part in parts:
        part.unpersist()


MATCHES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
    T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()),
])


def _measured(texts: pa.Array, parts: list, window: int) -> tuple[Shard, np.ndarray, list[list[str]]]:
    """A block's shard, which of its words are hit, and the items of each text, sorted."""
    shard = Shard(*tb.utf8(texts), pad=window)
    reach = np.zeros(len(shard.words) + 1, np.int64)  # by place, the longest window that occurs there
    found: list[list[str]] = [[] for _ in range(len(texts))]
    for part in parts:
        p = part.value
        groups = [np.zeros(0, np.int64)]
        for place, k in occurrences(shard, p):
            for length in np.unique(p.length[k]).tolist():
                at = place[p.length[k] == length]
                reach[at] = np.maximum(reach[at], length)
            groups.append(np.unique((np.searchsorted(shard.first, place, "right") - 1) * len(p.members) + p.group[k]))
        pairs = np.unique(np.concatenate(groups))
        doc, group = pairs // max(1, len(p.members)), pairs % max(1, len(p.members))
        for first, n in zip(*_runs(doc), strict=True):
            items = np.unique(np.concatenate([p.members[g] for g in group[first : first + n]]))
            found[doc[first]] += [p.ids[i] for i in items]
    at = np.flatnonzero(reach)
    marks = np.bincount(at, minlength=len(reach)) - np.bincount(at + reach[at], minlength=len(reach))
    return shard, np.cumsum(marks)[shard.place] > 0, [sorted(x) for x in found]


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """The documents without any occurring window, with all their columns. A row is judged where it
    lies; nothing is joined or shuffled. A further pass over the benchmark reads what is left, staged."""

    def judged(left: DataFrame, parts: list) -> DataFrame:
        def keep(batches):
            for block in tb.blocks(batches, -1, BLOCK):
                shard, hit, _ = _measured(block.columns[-1], parts, window)
                clean = np.bincount(shard.doc[hit], minlength=block.num_rows) == 0
                yield pa.RecordBatch.from_arrays(block.columns[:-1], names=block.schema.names[:-1]).filter(pa.array(clean))

        return left.select("*", F.col(text).alias("__text")).mapInArrow(keep, docs.schema)

    left = docs
    for parts, last in _passes(benchmark, item_id, item_text, window, part_bytes, at_once):
        left = judged(left, parts)
        if not last:
            left = stage(left, "clean")
            _let_go(parts)
    return left


_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(rows: DataFrame, parts: list, window: int) -> DataFrame:
    """Of rows (row, doc_id, text): n_words, the spans of hit words, and the items."""

    def run(batches):
        for block in tb.blocks(batches, "text", BLOCK):
            shard, hit, items = _measured(block.column(2), parts, window)
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))) if len(hit) else np.zeros(0, np.int8)
            word = np.concatenate([shard.place - shard.first[shard.doc], [0]])  # within its document
            new = np.concatenate(([False], hit[1:] & (shard.doc[1:] != shard.doc[:-1]) & hit[:-1])) if len(hit) else hit  # a run ends with its document
            start = np.sort(np.concatenate([np.flatnonzero(edge > 0), np.flatnonzero(new)]))
            end = np.sort(np.concatenate([np.flatnonzero(edge < 0), np.flatnonzero(new)]))
            held = pa.StructArray.from_arrays([pa.array(word[start]), pa.array(word[end - 1] + 1)], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(shard.doc[start], np.arange(block.num_rows + 1)).astype(np.int32)), held)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(shard.n_words, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "spans", "items"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id long, {_FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """One row per document: words, words inside an occurring window, items, the items' digest, and
    the ``spans`` of hit words (first, past the last)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for parts, last in _passes(benchmark, item_id, item_text, window, part_bytes, at_once):
        if found is None and last:  # one pass
            found = _found(rows, parts, window)
            break
        if found is None:
            rows = stage(rows, "rows")
        more = stage(_found(rows, parts, window), "found")
        found = more if found is None else found.unionByName(more.where(F.size("spans") > 0))
        _let_go(parts)
    else:
        both = [F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items")]
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *both)
    # spans of several passes may overlap: each adds what lies behind those before it
    merged = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(
        F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n")))
    n_hit = merged["n"]
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def _widened(shard: Shard, part: TestPart, place: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place in the item, words) of the longest match around each occurrence of a window."""
    n = np.minimum(part.window, part.first[item + 1] - at)  # a short item is one window
    begin = shard.first[np.searchsorted(shard.first, place, "right") - 1]
    room = np.minimum(place - begin, at - part.first[item]), part.first[item + 1] - at - n
    ways = np.zeros((2, len(place)), np.int64)  # words more before and behind
    for way, (step, edge) in enumerate(((-1, np.zeros_like(n)), (1, n - 1))):
        left = np.flatnonzero(room[way] > 0)
        while len(left):
            off = edge[left] + step * (ways[way, left] + 1)
            left = left[shard.words[place[left] + off] == part.words[at[left] + off]]
            ways[way, left] += 1
            left = left[ways[way, left] < room[way][left]]
    return place - ways[0], at - ways[0], n + ways.sum(axis=0)


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """The longest verbatim matches of a window or more: where each begins and how many words it has.

    Every place of a document where a window of an item occurs is matched with the window's first
    place in that item, and the match widened as far as both agree. Items of fewer words than the
    window match whole.
    """

    def searched(parts: list) -> DataFrame:
        def matches(batches):
            for block in tb.blocks(batches, "text", BLOCK):
                shard = Shard(*tb.utf8(block.column(1)), pad=window)
                ids = block.column(0).to_pylist()
                for part in parts:
                    p = part.value
                    for place, k in _diagonals(shard, p):
                        item = p.owner[k]
                        match = np.unique(np.stack([item, *_widened(shard, p, place, p.origin[k], item)]), axis=1)
                        item, place, at, length = match
                        doc = np.searchsorted(shard.first, place, "right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[d] for d in doc], pa.int64()), pa.array([p.ids[i] for i in item], pa.string()), pa.array(place - shard.first[doc], pa.int64()), pa.array(at - p.first[item], pa.int64()), pa.array(length, pa.int64())],
                            names=MATCHES.names,
                        )

        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(matches, MATCHES)

    out = None
    for parts, last in _passes(benchmark, item_id, item_text, window, part_bytes, at_once):
        more = searched(parts)
        if not last:
            more = stage(more, "matches")
            _let_go(parts)
        out = more if out is None else out.unionByName(more)
    return out


def _diagonals(shard: Shard, part: TestPart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, number of (window, item)) where a match begins: pairs without one a word before both."""
    for place, k in _by_document(shard, occurrences(shard, part)):
        of, pair = _spread(part.owned[k], part.owned[k + 1] - part.owned[k])
        place = place[of]
        key = np.stack([place - part.origin[pair], part.owner[pair], place])
        order = np.lexsort(key[::-1])
        diagonal, owner, at = key[:, order]
        goes_on = np.concatenate(([False], (diagonal[1:] == diagonal[:-1]) & (owner[1:] == owner[:-1]) & (at[1:] == at[:-1] + 1)))
        yield place[order[~goes_on]], pair[order[~goes_on]]


def _by_document(shard: Shard, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All occurrences of one document at a time."""
    got = list(found)
    if got:
        place, k = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(place, kind="stable")
        place, k = place[order], k[order]
        for first, n in zip(*_runs(np.searchsorted(shard.first, place, "right")), strict=True):
            yield place[first : first + n], k[first : first + n]


def op7(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")
