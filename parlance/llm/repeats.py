"""Periodic runs of words in each document, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q and length >= max(``least``, ``times`` *
q) that no neighbouring word extends. Runs are found a block of whole documents at a time:

1. Suffix array by prefix doubling, with the document as the first key, so suffixes of two documents
   never tie. The ranks of all lengths 2^k are kept: they answer how far two places agree, forwards
   and backwards, in as many steps as there are lengths.
2. LZ blocks from the longest earlier factor of each place (the nearest earlier suffixes on either
   side in the suffix array).
3. Each block and its successor give the leftmost-covering squares: for every kind of square (a word
   sequence twice in a row) a pair from which its leftmost occurrence is reached by rotation.
4. From each pair the suffix links are walked, place j to j + 1, as long as the square rotates: the
   complete vocabulary, each kind being a node depth in the suffix tree (an interval of the suffix
   array whose neighbours agree on 2q words or more).
5. The leaves below a kind are its occurrences; occurrences of one period in consecutive places merge
   into maximal stretches, of which those of the given length and smallest period are the runs.

Documents in which no ``least - 1`` words recur have no run and get no tree: a run of period q repeats
its first max(least, times * q) - q words q words on. Words are compared by their XXH64, as they are
(upper and lower case differ).

A document needs its own words alone: nothing is shuffled or joined, a lost task is run again. Memory
is bounded by a block, or by one document's words where that is longer.

Defined cases: a null, empty or wordless text has no runs and collapses to the empty text; repeated rows
each have their result; a null id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: A run has ``LEAST`` words or more and holds its period ``TIMES`` times or more.
LEAST = 6
TIMES = 4
#: Text to a block, and words of documents with repeats to a suffix array.
BLOCK = 4 << 20
WORDS = r"[^\x20\x09-\x0D]+"
_ROWS = 1 << 15


def _spread(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, begin + 0..n - 1) of all members of some ranges."""
    of = np.repeat(np.arange(len(n)), n)
    return of, begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _steps(values: np.ndarray) -> list[np.ndarray]:
    """For each place r and k, the least of the 2^k values before r (places before the first count as -1)."""
    now = np.concatenate(([-1], values)).astype(np.int32)  # now[r]: the value before place r
    out = [now]
    while (1 << len(out)) < len(now):
        back = 1 << (len(out) - 1)
        wider = now.copy()
        wider[back:] = np.minimum(now[back:], now[:-back])
        wider[:back] = -1
        out.append(wider)
        now = wider
    return out


def _back(steps: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How far one can go back from each place over values that are ``least`` or more: the first such place."""
    at = at.copy()
    for k in range(len(steps) - 1, -1, -1):
        at -= (steps[k][at] >= least).astype(np.int64) << k
    return at


class Suffixes:
    """Suffix array and ranks of all lengths 2^k of some documents' words (``doc`` ascending)."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        self.n = n = len(word)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        length = np.diff(np.append(first, n))
        self.end = np.repeat(first + length, length)
        _, word = np.unique(word, return_inverse=True)
        _, rank = np.unique(doc.astype(np.int64) * (n + 1) + word, return_inverse=True)
        self.ranks, width, count = [], 1, 0
        while True:
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            count = int(rank.max()) + 1
            if count == n:
                break
            behind = np.arange(n) + width
            key = rank.astype(np.int64) * (n + 1) + np.where(behind < self.end, self.ranks[-1][np.minimum(behind, n)] + 1, 0)
            _, rank = np.unique(key, return_inverse=True)
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words on which the suffixes at places i and j (i differs from j) agree; n is the empty suffix."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][at] == self.ranks[k][to]).astype(np.int64) << k
            at += step
            to += step
        return at - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words on which the prefixes that end before places i < j agree."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = at - (1 << k), to - (1 << k)
            step = ((a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
            at -= step
            to -= step
        return i - at

    def lz_blocks(self) -> np.ndarray:
        """The first place of each LZ block, and the end: a block is the longest factor that occurs
        earlier in its document, or one new word."""
        steps = _steps(self.order)
        back = _back(steps, np.arange(self.n), self.order)  # places before this one, back to a smaller suffix
        turned = _steps(self.order[::-1])
        ahead = _back(turned, np.arange(self.n), self.order[::-1])
        before = np.where(back > 0, self.order[np.maximum(back - 1, 0)], self.n)
        behind = np.where(ahead > 0, self.order[::-1][np.maximum(ahead - 1, 0)], self.n)[::-1]
        longest = np.maximum(self.forward(self.order, before), self.forward(self.order, behind))
        jump = np.empty(self.n, np.int64)
        jump[self.order] = self.order + np.maximum(longest, 1)
        jump, at, out = jump.tolist(), 0, []
        while at < self.n:
            out.append(at)
            at = jump[at]
        return np.array([*out, self.n], np.int64)


def covering_squares(s: Suffixes, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of leftmost-covering squares."""
    h, h1 = blocks[:-1], blocks[1:]
    inside = h1 < s.end[h]
    nextlen = np.where(inside, np.append(h1[1:], s.n) - h1, 0)
    starts, periods = [], []
    # squares whose second half holds the block's end
    b = np.where(inside, h1 - h, 0)
    of, k = _spread(np.ones(len(b), np.int64), b)
    at, q = h1[of], h1[of] - k
    k1 = s.forward(at, q)
    some = np.flatnonzero(k1 > 0)
    at, q, k, k1 = at[some], q[some], k[some], k1[some]
    k2 = s.backward(q, at)
    good = k1 + k2 >= k
    starts.append(np.maximum(q - k2, q - k + 1)[good])
    periods.append(k[good])
    # squares whose first half holds the block's begin
    of, k = _spread(np.ones(len(h), np.int64), h1 - h + nextlen)
    at, q = h[of], h[of] + k
    live = q < s.end[at]
    of, k, at, q = of[live], k[live], at[live], q[live]
    k1 = s.forward(at, q)
    some = np.flatnonzero(k1 > 0)
    of, at, q, k, k1 = of[some], at[some], q[some], k[some], k1[some]
    k2 = s.backward(at, q)
    start = np.maximum(at - k2, at - k + 1)
    good = (k1 + k2 >= k) & (start + k <= h1[of])
    starts.append(start[good])
    periods.append(k[good])
    return np.concatenate(starts), np.concatenate(periods)


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows, ascending by the first column, then the next."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        new |= c[order[1:]] != c[order[:-1]]
    order = order[np.concatenate(([True], new))] if len(order) else order
    return [c[order] for c in columns]


def _smallest(begin: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal stretches only that of the smallest period."""
    begin, length, period = _distinct(begin, length, period)
    keep = np.concatenate(([True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1]))) if len(begin) else np.zeros(0, bool)
    return begin[keep], length[keep], period[keep]


def runs_of(word: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, period) of all runs, ascending by place, then period."""
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none
    s = Suffixes(word, doc)
    start, k = covering_squares(s, s.lz_blocks())
    if not len(start):
        return none, none, none
    # the stretch around each square; squares of one stretch and period are walked once
    begin = start - s.backward(start, start + k)
    length = k + start - begin + s.forward(start, start + k)
    begin, length, k = _smallest(begin, length, k)
    # suffix-link walk: the square's rotations, place after place, until they repeat
    of, place = _spread(begin, np.minimum(length - 2 * k + 1, k))
    depth = 2 * k[of]
    shared = s.forward(s.order[:-1], s.order[1:])  # of neighbours in the suffix array
    leaf = s.rank[place]
    low = _back(_steps(shared), leaf, depth)
    high = s.n - _back(_steps(shared[::-1]), s.n - 1 - leaf, depth)
    low, high, depth = _distinct(low, high, depth)
    # occurrences of every kind of square, and the stretches they make
    of, at = _spread(low, high - low)
    k, at = _distinct(depth[of] // 2, s.order[at])
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.append(new[1:], len(k)) - 1
    begin, k = at[new], k[new]
    length = at[last] - begin + 2 * k
    enough = length >= np.maximum(least, times * k)
    begin, length, k = _smallest(begin[enough], length[enough], k[enough])
    order = np.lexsort([k, begin])
    return begin[order], length[order], k[order]


def _repetitive(word: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Documents (numbers below 2^15) in which some ``size`` words recur."""
    if len(word) < size:
        return np.zeros(0, np.int64)
    h = word[: len(word) - size + 1].copy()
    for d in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[d : len(word) - size + 1 + d]
    low = np.uint64(_ROWS - 1)
    whole = doc[: len(h)] == doc[size - 1 :]
    key = np.sort(((tb.mix(h) & ~low) | doc[: len(h)].astype(np.uint64))[whole])
    return np.unique(key[1:][key[1:] == key[:-1]] & low).astype(np.int64)


def found_in(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Of a block of documents: words (start, end, document), first word of each document, and the
    runs (place among all words, length, period) of all documents."""
    starts, ends, doc = tb.words(data, offsets, tb.SPACED)
    word = tb.xxh64(data, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    some = _repetitive(word, doc, least - 1)
    held, out = np.diff(first)[some], []
    k = 0
    while k < len(some):  # some documents at a time, by their words
        upto = k + max(1, int(np.searchsorted(np.cumsum(held[k:]), BLOCK // 16, "right")))
        of, at = _spread(first[:-1][some[k:upto]], held[k:upto])
        place, length, period = runs_of(word[at], of, least, times)
        out.append((at[place], length, period))
        k = upto
    place, length, period = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return starts, ends, doc, first, place, length, period


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The words of each of n documents joined by one blank."""
    out, _, end = tb.joined(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    tail = np.cumsum(count) - 1
    edge = end[tail[count > 0]]  # the blank behind a document's last word
    keep = np.ones(len(out), bool)
    keep[edge] = False
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:][count > 0] = edge + 1 - np.arange(1, len(edge) + 1)
    offsets = np.maximum.accumulate(offsets)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])])


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each document by start, then period, counted in
    words from 0, and the text that is left, its words joined by one blank, once every word goes that
    a run holds behind its first period."""

    def run(batches):
        for block in tb.blocks(batches, "text", BLOCK, _ROWS):
            n = block.num_rows
            data, offsets = tb.utf8(block.column(1))
            starts, ends, doc, first, place, length, period = found_in(data, offsets, least, times)
            marks = np.zeros(len(starts) + 1, np.int64)
            np.add.at(marks, place + period, 1)
            np.add.at(marks, place + length, -1)
            kept = np.cumsum(marks)[:-1] == 0
            order = np.lexsort([period, place])
            place, length, period = place[order], length[order], period[order]
            of = doc[place]
            held = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (place - first[of], length, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), held)
            left = _texts(data, starts[kept], ends[kept], doc[kept], n).cast(pa.string())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(first), pa.int64()), runs, left], names=["doc_id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_period(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): the texts that the query measures. One id in ten, by its crc32, repeats the words
    from some place on with a period that divides the rest into three to ten parts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chosen = chosen.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))))
    n = F.size("words").cast("long")
    g = F.floor(h / 10).cast("long")
    a = F.when(n > 0, g % F.nullif(n, F.lit(0)))
    numbered = chosen.withColumns({"n": n, "a": a.cast("int"), "p": (1 + F.floor((n - a) / (3 + g % 8))).cast("int")})
    rest = F.col("n").cast("int") - F.col("a")
    part = F.slice("words", F.col("a") + 1, F.least("p", rest))
    again = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    edited: Column = F.concat_ws(" ", F.concat(F.slice("words", F.lit(1), F.col("a")), again))
    return numbered.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row of figures for each document of ``periodic_runs``."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.short")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.short) div best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_period(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


#: crc32 by its definition, over the digits of the id; stretches from recurring five-word sequences.
OP12_SQL = r"""
WITH coded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN NULL ELSE xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) END AS h
  FROM documents
), placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM coded
), words AS (
  SELECT r, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), grams AS (
  SELECT r, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n WHERE y.i + 5 <= y.n
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM again) GROUP BY r, q, island
), runs AS (
  SELECT r, s, l, min(q) AS p FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS runs, first(struct_pack(s := s, l := l, p := p) ORDER BY l DESC, s, p) AS best FROM runs GROUP BY r
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = words.r AND i >= s + p AND i < s + l) GROUP BY words.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM placed LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
