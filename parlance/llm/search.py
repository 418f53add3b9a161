"""Ranked lexical search with dual-sorted wavelet trees, a shard at a time.

A shard holds some whole documents, numbered by ascending doc_id. The postings of each queried term
stand one after the other by falling impact, and the sequence of their document numbers is kept as a
wavelet tree over those numbers: each level splits every postings list by one more bit of the number
and keeps the order inside the halves. So the lists are sorted both ways at once: the first posting of
a list inside a node (a range of doc_ids) has the greatest impact there, and a leaf is one document.

A search keeps for each open node the range of every query term's list. The sum of the terms' first
impacts bounds all scores below the node; the nodes of greatest bound are opened first, some at a
time, terms without postings in a node drop out of it, and a node goes as soon as its bound cannot
reach the k-th best score found (or can only tie with it at a greater doc_id). At a leaf the bound is
the score, so what is returned is the exact top k.

Two passes over the documents: one sums document and term counts (a row for each term and task), one
builds shards and searches them where the documents lie. The best of a task's shards so far are the
bar for its next one. A task sends k rows an item at most; they are ranked in two steps, so no task
ranks all of an item's candidates. Nothing else is shuffled.

The items are the stated query set. They are dealt by row into parts of ``part_bytes`` of text, which
reach the executors one part after the other, each in passes of its own; the terms of a part are the
vocabulary that its shards index.

Defined cases: null texts have no terms, and such documents count nowhere; an item without terms, or
none that occurs, has no rows; each item row is ranked on its own, also where ids repeat; documents
that share an id are ranked apart; a null doc_id comes after all others of its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import stage

K = 20
PART_BYTES = 4 << 20
BLOCK = 1 << 20
#: Postings to a shard (a larger document is a shard of its own), and nodes opened at once.
POSTINGS = 1 << 20
WIDTH = 128
_SALTS = 64
_LAST = np.iinfo(np.int64).max


class Shard:
    """Dual-sorted postings: ``term``, ``doc`` (a number below len(ids)) and ``impact`` of each."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, ids: np.ndarray):
        order = np.lexsort([doc, -impact, term])
        self.ids, self.size = ids, len(order)
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.depth = max(1, int(len(ids) - 1).bit_length())
        doc, impact = doc[order], impact[order]
        before = np.zeros((self.depth, self.size + 1), np.int32)  # postings before each place that go left
        held = np.zeros((self.depth + 1, self.size + 1), np.int32)
        for level in range(self.depth):
            held[level, :-1] = impact
            left = (doc >> (self.depth - 1 - level)) & 1 == 0
            np.cumsum(left, out=before[level, 1:])
            order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            doc, impact = doc[order], impact[order]
        held[self.depth, :-1] = impact
        self.lefts = before[:, -1].astype(np.int64)
        self.before, self.impact = before.ravel(), held.ravel()

    def bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
        first = self.impact[(level * (self.size + 1))[:, None] + lo].astype(np.int64)
        return np.where(lo < hi, first, 0) @ weight

    def children(self, level: np.ndarray, number: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(level, number, lo, hi) of both children of each node."""
        at = (level * (self.size + 1))[:, None]
        lo0, hi0 = self.before[at + lo].astype(np.int64), self.before[at + hi].astype(np.int64)
        right = self.lefts[level][:, None]
        two = np.concatenate
        return two([level, level]) + 1, two([2 * number, 2 * number + 1]), two([lo0, right + lo - lo0]), two([hi0, right + hi - hi0])

    def first_id(self, level: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The least doc_id below each node."""
        return self.ids[np.minimum(number << (self.depth - level), len(self.ids) - 1)]

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of this shard's documents and ``best`` together, best first."""
        held = self.begin[terms] < self.begin[terms + 1]
        terms, weight = terms[held], weight[held]
        if not len(terms):
            return best
        level, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.begin[terms][None, :], self.begin[terms + 1][None, :]
        bound = self.bounds(level, lo, hi, weight)
        score, ids = best

        def open_(level, number, bound):
            if len(score) < k:
                return bound > 0
            return (bound > score[-1]) | ((bound == score[-1]) & (bound > 0) & (self.first_id(level, number) < ids[-1]))

        while len(bound):
            if len(bound) > width:
                cut = np.argpartition(-bound, width - 1)
                now, rest = cut[:width], cut[width:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            leaf = now[level[now] == self.depth]
            if len(leaf):
                score, ids = np.concatenate([score, bound[leaf]]), np.concatenate([ids, self.ids[number[leaf]]])
                order = np.lexsort([ids, -score])[:k]
                score, ids = score[order], ids[order]
            inner = now[level[now] < self.depth]
            c_level, c_number, c_lo, c_hi = self.children(level[inner], number[inner], lo[inner], hi[inner])
            c_bound = self.bounds(c_level, c_lo, c_hi, weight)
            fresh = open_(c_level, c_number, c_bound)
            rest = rest[open_(level[rest], number[rest], bound[rest])]
            level, number, bound, lo, hi = (
                np.concatenate([old[rest], new[fresh]]) for old, new in ((level, c_level), (number, c_number), (bound, c_bound), (lo, c_lo), (hi, c_hi))
            )
        return score, ids


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of some texts."""
    data, offsets = tb.utf8(texts)
    starts, ends, row = tb.words(data, offsets, tb.ALNUM)
    return tb.xxh64(tb.LOWER[data], starts, ends), row


class Items:
    """Query items: their vocabulary (distinct hashes), and for each item its terms and how often it has them."""

    def __init__(self, texts: list[str | None]):
        h, item = _terms(pa.array(texts, pa.large_string()))
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.n, v = len(texts), max(1, len(self.vocabulary))
        pair, self.count = tb.counted(item * v + number)
        self.term, self.first = pair % v, np.searchsorted(pair // v, np.arange(len(texts) + 1))
        self.weight = np.zeros(len(pair), np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.weight = w[self.term] * self.count


_LENGTHS, _DOCS = -1, -2


def _statistics(docs: DataFrame, items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and the documents holding each queried term.
    A row for each of these and task is summed by Spark; the sums are as many as the query set's terms."""

    def count(batches):
        vocabulary = items.value.vocabulary
        table, df, n, length = tb.HashTable(vocabulary), np.zeros(len(vocabulary), np.int64), 0, 0
        for block in tb.blocks(batches, "text", BLOCK):
            h, doc = _terms(block.column(1))
            n, length = n + len(np.unique(doc)), length + len(h)
            term = table.find(h)
            known = term >= 0
            df += np.bincount(np.unique(doc[known] * len(vocabulary) + term[known]) % len(vocabulary), minlength=len(df)) if known.any() else 0
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([term, [_LENGTHS, _DOCS]])), pa.array(np.concatenate([df[term], [length, n]]))], names=["term", "n"])

    sums = {r.term: r.n for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(items.value.vocabulary), np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(_DOCS, 0), sums.get(_LENGTHS, 0), df


def _shards(batches, vocabulary: np.ndarray, n_docs: int, total: int, postings: int) -> Iterator[Shard]:
    """Shards of the task's documents that hold a queried term, of about so many postings each."""
    table, size, held, place = tb.HashTable(vocabulary), 0, [], 0
    doc_ids: list[np.ndarray] = []

    def built() -> Shard:
        term, doc, impact = (np.concatenate(x) for x in zip(*held, strict=True))
        ids = np.concatenate(doc_ids)
        used = np.unique(doc)
        used = used[np.argsort(ids[used], kind="stable")]
        number = np.empty(len(ids), np.int64)
        number[used] = np.arange(len(used))
        return Shard(term, number[doc], impact, len(vocabulary), ids[used])

    for block in tb.blocks(batches, "text", BLOCK):
        h, doc = _terms(block.column(1))
        n = np.bincount(doc, minlength=block.num_rows)
        term = table.find(h)
        known = np.flatnonzero(term >= 0)
        if len(known):
            pair, tf = tb.counted(doc[known] * len(vocabulary) + term[known])
            row, term = pair // len(vocabulary), pair % len(vocabulary)
            m = 75 + 25 * n[row] * n_docs // total
            held.append((term, place + row, 1_000_000_000 * tf // (1000 * tf + 12 * m)))
            size += len(pair)
        doc_ids.append(block.column(0).fill_null(_LAST).to_numpy())
        place += block.num_rows
        if size >= postings:
            yield built()
            size, held, doc_ids, place = 0, [], [], 0
    if size:
        yield built()


def _best(docs: DataFrame, items, n_docs: int, total: int, k: int, postings: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item."""

    def run(batches):
        q = items.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * q.n
        for shard in _shards(batches, q.vocabulary, n_docs, total, postings):
            for item in range(q.n):
                a, z = q.first[item], q.first[item + 1]
                best[item] = shard.search(q.term[a:z], q.weight[a:z], k, best[item])
        of = np.repeat(np.arange(q.n), [len(x[0]) for x in best])
        score, ids = (np.concatenate([x[j] for x in best]) if best else np.zeros(0, np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, part_bytes: int = PART_BYTES, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of score above 0, best first, equal
    scores by ascending doc_id."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = stage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    n = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) / part_bytes))
    found = None
    for part in range(n):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(n)) == part).orderBy("row").collect()
        query = Items([r.text for r in rows])
        sent = spark.sparkContext.broadcast(query)
        n_docs, total, df = _statistics(slim, sent)
        sent.unpersist()
        query.weigh(n_docs, df)
        sent = spark.sparkContext.broadcast(query)
        numbers = spark.createDataFrame([(k_, r.row) for k_, r in enumerate(rows)], "item long, row long")
        more = _best(slim, sent, n_docs, max(1, total), k, postings).join(numbers, "item").select("row", "doc_id", "score")
        if n > 1:
            more = stage(more, "best")
            sent.unpersist()
        found = more if found is None else found.unionByName(more)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    for keys in (["row", "salt"], ["row"]):
        if "salt" in keys:
            found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT r, doc_id, w, len(w) AS n FROM lowered WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), weighed AS (
  SELECT item, item_id, term, times * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM asked JOIN df USING (term) CROSS JOIN whole
), scored AS (
  SELECT item, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN docs USING (r) CROSS JOIN whole GROUP BY item, item_id, doc_id, r
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
