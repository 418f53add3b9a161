"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

The scored string is the lower-cased (A-Z) words with one space between and 0x0A at the end, after
which each document begins anew. A byte is eight binary decisions; every decision has its own tree
of the last 0 to ``DEPTH`` bytes. Each node's Krichevsky-Trofimov block estimate and the product over
its children are weighed one half each, from the leaves up, which yields the posterior weight of
stopping at each node; a decision's probability mixes the estimates along its path with those.

What the corpus gives are exact counts of all (DEPTH + 1)-grams of the training documents, summed by
task before they are shuffled. Every context seen ``LEAST`` times or more is a node of its own, at
every size of the corpus; the rest of its parent's occurrences form one further leaf. So the tree
grows with the corpus and lies nowhere whole: its first ``TOP`` depths, which the bytes' alphabet
bounds, are weighed on the driver, and the subtrees below them where their grams are dealt, by their
context of TOP + 1 bytes. A context with more than ``HOT_GRAMS`` distinct grams is dealt by one byte more,
and so on, its own nodes (256 at most) being weighed on the driver; so no task holds more, and there are
at most as many such contexts as there are grams over ``HOT_GRAMS``. Each distinct gram of the documents is scored there once. The most frequent grams and words, up to
``HELD_GRAMS`` and ``HELD_WORDS``, are broadcast with their scores or counts, all other (row, word)
and (row, gram) pairs meet theirs in a shuffled join.

With ``own`` a document's probability is the mean of two: that of the tree alone, and one where what the
document itself has had so far counts as well. There, after ``own`` bytes that the document has had c times
before, x times with this byte next, a byte has probability (x + OWN_SHARE * tree's) / (c + OWN_SHARE). Both
are probabilities of the whole text, byte after byte, so no text falls more than log10(2) below the tree's.

Defined cases: a null text is empty, one end token; a null id belongs to the training side; without
training rows counts are 0, the tree is empty and every bit has probability 1/2.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import fold_is, stage

U = np.uint64
DEPTH = 6
#: Depths from 0 to TOP are weighed on the driver.
TOP = 2
LEAST = 2
#: Bytes of text that a task counts at least, where there are more tasks than cores.
TASK_BYTES = 64 << 20
#: Grams and words, the most frequent ones, whose scores and counts are broadcast: so many at most.
HELD_GRAMS, HELD_WORDS = 3 << 20, 1 << 20
#: Bytes of a document's own context, and the weight that the tree's probability has there, in occurrences.
OWN, OWN_SHARE = 12, 0.2
#: The end token's key among the words' hashes, which have 63 bits.
END_KEY = (1 << 63) - 1
_END = 0x0A
#: Distinct keys that a task holds, and entries that wait to be merged with them.
_FLUSH = 3 << 20
#: Bytes that a task counts before it sends on what it holds.
_FLUSH_BYTES = 1 << 29
_WAITING = 1 << 20
#: Grams whose subtrees are weighed at once.
_RUN = 1 << 17
#: Contexts with more distinct grams are dealt by a byte more; five bytes have 65,536 grams at most.
HOT_GRAMS = 1 << 18


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, document of each byte, whether it is scored, words' hashes, words' documents).

    In the buffer each document has DEPTH end bytes before it, so no context reaches another text.
    """
    n = len(offsets) - 1
    low = tb.LOWER[data]
    starts, ends, doc = tb.words(data, offsets, tb.SPACED)
    hashes = tb.xxh64(low, starts, ends) >> U(1)
    count = np.bincount(doc, minlength=n)
    length = ends - starts
    size = np.bincount(doc, weights=length + 1, minlength=n).astype(np.int64)
    size[count == 0] = 1  # the end alone
    total = size + DEPTH
    base = np.cumsum(total) - total
    before = np.cumsum(length + 1) - (length + 1)
    first = np.searchsorted(doc, np.arange(n))
    inner = before - np.append(before, 0)[first][doc] if len(doc) else before
    at = base[doc] + DEPTH + inner
    out = np.full(int(total.sum()), 0x20, np.uint8)
    run = np.cumsum(length) - length
    within = np.arange(int(length.sum()))
    out[within + np.repeat(at - run, length)] = low[within + np.repeat(starts - run, length)]
    pads = (base[:, None] + np.arange(DEPTH)).ravel()
    out[pads] = _END
    out[base + total - 1] = _END
    scored = np.ones(len(out), bool)
    scored[pads] = False
    return out, np.repeat(np.arange(n), total), scored, hashes, doc


def grams(buffer: np.ndarray) -> np.ndarray:
    """The last DEPTH + 1 bytes at each place as one number, the latest byte lowest."""
    out = buffer.astype(U)
    for k in range(1, DEPTH + 1):
        out[k:] |= buffer[:-k].astype(U) << U(8 * k)
    return out


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each distinct key, how many places before have the key) of each place."""
    n, bits = len(keys), max(len(keys), 1).bit_length()
    if n and int(keys.max()) >> (64 - bits):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    else:  # key and place fit into one number, which sorts faster
        both = np.sort(keys << U(bits) | np.arange(n, dtype=U))
        order, keys = (both & U((1 << bits) - 1)).astype(np.int64), both >> U(bits)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    number, before = np.empty(n, U), np.empty(n, np.int64)
    number[order], before[order] = group, np.arange(n) - first[group]
    return number, before


def had_before(buffer: np.ndarray, at: np.ndarray, length: int, seven: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, contexts, both) of a ``canonical`` buffer, whose ``grams`` are ``seven``: the places before which
    their document has the same ``length`` bytes as somewhere earlier in it, how often it had those, and how
    often with the place's byte next."""
    size = np.bincount(at)
    start = np.repeat(np.cumsum(size) - size, size)
    place = np.flatnonzero(np.arange(len(buffer)) - start >= DEPTH + length)
    step = DEPTH + 1
    context = [seven[place - 1 - k] & U((1 << 8 * min(step, length - k)) - 1) for k in range(0, length, step)]
    # most contexts occur once: only those that share the high bits of their hash with others are numbered
    mixed = at[place].astype(U)
    for part in context:
        mixed = (mixed ^ part) * U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> U(32)
    low = U((1 << len(place).bit_length()) - 1)
    mixed = np.sort(mixed * U(0xC2B2AE3D27D4EB4F) & ~low | np.arange(len(place), dtype=U))
    same = np.zeros(len(place) + 1, bool)
    same[1:-1] = (mixed[1:] ^ mixed[:-1]) <= low
    many = np.sort((mixed[same[1:] | same[:-1]] & low).astype(np.int64))
    place = place[many]
    number, bits = at[place].astype(U), U(len(place).bit_length())
    for part in context:
        number, before = _dense(number << bits | _dense(part[many])[0])
    both = _dense(number << U(8) | buffer[place])[1]
    again = before > 0
    return place[again], before[again], both[again]


class _Counts:
    """Distinct keys, ascending, and their counts; what is added is merged into them some of it at a time."""

    def __init__(self):
        self.keys, self.n, self.waiting = np.zeros(0, U), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        if sum(len(k) for k, _ in self.waiting) > _WAITING:
            self._merge()

    def _merge(self) -> None:
        keys, n = tb.counted(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
        self.waiting = []
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.n[at[known]] += n[known]
        self.keys, self.n = np.insert(self.keys, at[~known], keys[~known]), np.insert(self.n, at[~known], n[~known])

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self._merge()
        out = self.keys, self.n
        self.keys, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        return out


def corpus_counts(docs: DataFrame, text: str, learnt: Column | None = None) -> DataFrame:
    """(kind, key, n, m), staged: exact counts of words (kind 0) and grams (kind 1) of the rows for which
    ``learnt`` holds (n; all rows by default), and of the other rows' grams (m)."""

    def count(batches):
        held, size = [_Counts(), _Counts()], 0  # by kind

        def flush(kind):
            keys, weights = held[kind].taken()
            for a in range(0, len(keys), 1 << 16):
                k, w = keys[a : a + (1 << 16)], weights[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(w >> 32), pa.array(w & 0xFFFFFFFF)], names=["kind", "key", "n", "m"])

        for block in tb.blocks(batches, "text", 1 << 19):
            buffer, at, scored, hashes, doc = canonical(*tb.utf8(block.column(0)))
            mine = block.column(1).to_numpy(zero_copy_only=False)
            keys, n = tb.counted(hashes[mine[doc]])
            held[0].add(keys, n << 32)
            if mine.any():
                held[0].add(np.array([END_KEY], U), np.array([int(mine.sum()) << 32]))
            # both counts of a gram in one number: a task flushes before it has seen 2**31 bytes
            size += len(buffer)
            held[1].add(*tb.counted(grams(buffer)[scored], np.where(mine[at[scored]], 1 << 32, 1)))
            for kind in (0, 1):
                if len(held[kind].keys) > _FLUSH or size > _FLUSH_BYTES:
                    yield from flush(kind)
            size = 0 if size > _FLUSH_BYTES else size
        for kind in (0, 1):
            yield from flush(kind)

    learnt = F.lit(True) if learnt is None else F.coalesce(learnt, F.lit(False))
    slim = docs.select(F.col(text).alias("text"), learnt.alias("learnt"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(math.ceil(size / TASK_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    raw = slim.coalesce(tasks).mapInArrow(count, "kind byte, key long, n long, m long")
    # a task's rows are distinct already, so they are dealt before Spark sums them
    return stage(raw.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers of 0.5 or more: Stirling's series eight steps up, then back down."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of any string with so many of each."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def kt_next(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _narrow(p: np.ndarray) -> np.ndarray:
    """Probabilities in 32 bits, those above one half as p - 1, so that neither p nor 1 - p becomes 0."""
    return np.where(p > 0.5, p - 1, p).astype(np.float32)


class Tree:
    """The weighted tree: for each depth its contexts, seen grams with their log10 probability, and
    the decisions' mixtures, from which bytes that a context has not seen are scored. With ``above``
    it is some subtrees of a larger tree, whose first depths ``above`` has."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], above: Tree | None = None):
        """levels: by depth, behind those of ``above``, sorted keys (context, then the byte) and counts."""
        self.above, self.first = above, len(above.keys) if above else 0
        shared = lambda name: list(getattr(above, name)) if above else []
        self.keys = shared("keys") + [keys for keys, _ in levels]
        self.logs = shared("logs") + [np.zeros(len(keys)) for keys, _ in levels]
        self.contexts, of, parent = shared("contexts"), [], []
        for d in range(self.first, len(self.keys)):
            context, first = np.unique(self.keys[d] >> U(8), return_index=True)
            self.contexts.append(context)
            of.append(np.repeat(np.arange(len(context), dtype=np.int32), np.diff(np.append(first, len(self.keys[d])))))
            parent.append(np.searchsorted(self.contexts[d - 1], context & U((1 << 8 * (d - 1)) - 1)).astype(np.int32) if d else None)
        #: nodes[d][k]: context * 256 + the k decided bits behind a leading one, ascending
        self.nodes, self.tip, self.sub = (shared(name) + [[None] * 8 for _ in levels] for name in ("nodes", "tip", "sub"))
        #: by decision: the deepest nodes' mixtures so far, and the weight that is still open there
        self.open = [None] * 8
        # decisions of different bits share no node
        self.parts = [self._count(k, [n for _, n in levels], of, parent) for k in range(8)]

    def _count(self, k: int, counts: list[np.ndarray], of: list[np.ndarray], parent: list) -> list[dict]:
        parts = []
        for d, n, own, up in zip(range(self.first, len(self.keys)), counts, of, parent, strict=True):
            byte = (self.keys[d] & U(255)).astype(np.int64)
            node, bit = own.astype(np.int64) * 256 + (1 << k | byte >> (8 - k)), byte >> (7 - k) & 1
            new = np.concatenate(([True], node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            mine = self.nodes[d][k] = node[first]
            both = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            one = np.add.reduceat(n * bit, first) if len(first) else np.zeros(0)
            owner = np.searchsorted(self.nodes[d - 1][k], up[mine >> 8].astype(np.int64) * 256 + (mine & 255)) if d else None
            parts.append({"zeros": (both - one).astype(float), "ones": one.astype(float), "owner": owner, "place": (np.cumsum(new) - 1).astype(np.int32), "bits": bit == 1})
        return parts

    def lift(self, k: int, child: tuple | None = None) -> tuple | None:
        """Weighs the nodes of decision k from the deepest up. ``child``: the sums over the children of
        the deepest nodes, where those lie elsewhere. Returns the sums (logarithms, zeros, ones) over
        the children of the nodes above."""
        for d in range(len(self.keys) - 1, self.first - 1, -1):
            x = self.parts[k][d - self.first]
            zeros, ones = x["zeros"], x["ones"]
            own = kt_block(zeros, ones)
            if d == DEPTH:
                weighted, x["stop"], x["other"] = own, np.ones(len(own)), np.full(len(own), 0.5)
            else:
                below, c0, c1 = child
                rest0, rest1 = np.maximum(zeros - c0, 0), np.maximum(ones - c1, 0)
                split = below + np.where(rest0 + rest1 > 0, kt_block(rest0, rest1), 0)
                weighted = np.logaddexp(own, split) - np.log(2)
                x["stop"], x["other"] = np.exp(own - np.log(2) - weighted), kt_next(rest0, rest1)
            if d:
                child = tuple(np.bincount(x["owner"], weights=y, minlength=len(self.nodes[d - 1][k])) for y in (weighted, zeros, ones))
        return child

    def weigh(self, children: list[tuple] | None = None) -> Tree:
        """Weights from the leaves up, then mixtures from the root, or the tree above, down."""
        for k in range(8):
            self.lift(k, children[k] if children else None)
            mixed, rest = self.above.open[k] if self.above else (None, None)
            for d in range(self.first, len(self.keys)):
                x = self.parts[k][d - self.first]
                w, kt, owner = x["stop"], kt_next(x["zeros"], x["ones"]), x["owner"]
                if d == 0:
                    mixed, rest = w * kt, 1 - w
                else:
                    mixed, rest = mixed[owner] + rest[owner] * w * kt, rest[owner] * (1 - w)
                tip = mixed + rest * x["other"]
                self.tip[d][k], self.sub[d][k] = _narrow(tip), _narrow(mixed + rest * 0.5)
                p = tip[x["place"]]
                self.logs[d] += np.log10(np.where(x["bits"], p, 1 - p))
            self.open[k] = mixed, rest
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "parts")}

    def _tables(self):
        if "tables" not in self.__dict__:
            own = zip(self.keys[self.first :], self.contexts[self.first :], strict=True)
            self.tables = (self.above._tables() if self.above else []) + [(tb.HashTable(k), tb.HashTable(c)) for k, c in own]
        return self.tables

    def unseen(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """log10 probability of bytes that the context of this depth, a node, has never had next."""
        out = np.zeros(len(keys))
        byte = (keys & U(255)).astype(np.int64)
        context = [np.searchsorted(self.contexts[d], (keys >> U(8)) & U((1 << 8 * d) - 1)) for d in range(depth + 1)]
        for k in range(8):
            q, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            p, open_ = np.full(len(keys), 0.5), np.ones(len(keys), bool)
            for d in range(depth, -1, -1):
                want, nodes = context[d] * 256 + q, self.nodes[d][k]
                at = np.searchsorted(nodes, want)
                at[at == len(nodes)] = 0
                hit = open_ & (nodes[at] == want)
                p[hit] = (self.tip if d == depth else self.sub)[d][k][at[hit]]
                open_ &= ~hit
            # p may stand for 1 + p
            out += np.log10(np.where((bit == 1) == (p > 0), np.abs(p), 1 - np.abs(p)))
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the lowest byte of each gram after the others."""
        out = np.empty(len(keys))
        if not len(self.keys[0]):
            out[:] = 8 * np.log10(0.5)
            return out
        left = np.arange(len(keys))
        for d in range(len(self.keys) - 1, -1, -1):
            seen, nodes = self._tables()[d]
            k = keys[left] & U((1 << 8 * (d + 1)) - 1)
            at = seen.find(k)
            hit = at >= 0
            out[left[hit]] = self.logs[d][at[hit]]
            left, k = left[~hit], k[~hit]
            known = nodes.find(k >> U(8)) >= 0 if d else np.ones(len(k), bool)
            if known.any():
                some, inverse = np.unique(k[known], return_inverse=True)
                out[left[known]] = self.unseen(d, some)[inverse]
            left = left[~known]
        return out


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    keys, n = t["key"].to_numpy().astype(np.int64).view(U), t["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def levels_of(keys: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of depths ``first`` to ``last`` of grams and their counts."""
    levels = []
    for d in range(first, last + 1):
        some, m = tb.counted(keys & U((1 << 8 * (d + 1)) - 1), n)
        if d and len(some):
            _, inverse = np.unique(some >> U(8), return_inverse=True)
            node = np.bincount(inverse, weights=m)[inverse] >= LEAST
            some, m = some[node], m[node]
        levels.append((some, m))
    return levels


def learn(counts: DataFrame) -> Tree:
    """The whole tree in one place, for corpora whose grams fit there; ``score`` never gathers it."""
    return Tree(levels_of(*_arrays(counts.where("kind = 1 AND n > 0").select("key", "n")), 0, DEPTH)).weigh()


def _subtrees(batches, above: Tree, width: int):
    """(grams, occurrences, their subtrees) by runs of whole contexts of ``width`` bytes, as the rows
    (key, learnt, n) come sorted; ``above`` has the depths below ``width``."""
    held, rows, limit = [], 0, _RUN

    def made(keys, learnt, n):
        some = learnt > 0
        return keys, n, Tree(levels_of(keys[some], learnt[some], width, DEPTH), above)

    for batch in batches:
        held.append((batch.column(0).to_numpy().view(U), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        rows += batch.num_rows
        if rows >= limit:
            keys, learnt, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = keys >> U(8) & U((1 << 8 * width) - 1)
            cut = int(np.argmax(context == context[-1]))  # the last context may go on
            if cut:
                yield made(keys[:cut], learnt[:cut], n[:cut])
            held, rows = [(keys[cut:], learnt[cut:], n[cut:])], len(keys) - cut
            limit = max(_RUN, 2 * rows)
    if rows:
        yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _low_bytes(some: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << 8 * some) - 1))


def _level(grams: DataFrame, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The level of this depth of some rows (key, learnt): few contexts, 256 keys each at most."""
    return levels_of(*_arrays(grams.where("learnt > 0").groupBy(_low_bytes(depth + 1).alias("key")).agg(F.sum("learnt").alias("n"))), depth, depth)


def dealt_grams(grams: DataFrame) -> list[tuple[int, DataFrame, DataFrame]]:
    """(width, rows, rest) for each width of context, from TOP + 1 bytes on, that rows (key, learnt, n) are
    dealt by: ``rows`` are those whose context has at most ``HOT_GRAMS`` grams (with DEPTH bytes: all),
    ``rest`` those and all that are dealt by more bytes."""
    spark, out, rest = grams.sparkSession, [], grams
    for width in range(TOP + 1, DEPTH + 1):
        rows = rest.withColumn("context", F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * width) - 1)))
        hot = rows.groupBy("context").count().where(F.col("count") > HOT_GRAMS).select("context").toArrow() if width < DEPTH else []
        if not len(hot):
            return [*out, (width, rows, rest)]
        hot = F.broadcast(spark.createDataFrame(hot))  # one row for HOT_GRAMS grams or more
        out.append((width, rows.join(hot, "context", "left_anti"), rest))
        rest = rows.join(hot, "context", "left_semi").drop("context")
    raise AssertionError("contexts of DEPTH bytes are never dealt by more")


def gram_scores(counts: DataFrame) -> DataFrame:
    """(key, n, log): of every gram of all rows how often it occurs and its log10 probability."""
    sc = counts.sparkSession.sparkContext
    grams = counts.where("kind = 1").select("key", F.col("n").alias("learnt"), (F.col("n") + F.col("m")).alias("n"))
    deals = dealt_grams(grams)
    first = grams.where("learnt > 0").groupBy(_low_bytes(TOP + 1).alias("key")).agg(F.sum("learnt").alias("n"))
    # trees[i] ends where what deals[i] deals begins
    trees = [Tree(levels_of(*_arrays(first), 0, TOP))]
    for width, _, rest in deals[1:]:
        trees.append(Tree(_level(rest, width - 1), trees[-1]))
    dealt = [rows.repartition("context").sortWithinPartitions("context").select("key", "learnt", "n") for _, rows, _ in deals]
    names = ["below", "zeros", "ones"]

    def sums_of(i: int) -> list[list[np.ndarray]]:
        """By decision: the sums over the children that deals[i] holds of the deepest nodes of trees[i]."""
        width, size, shape = deals[i][0], [len(x) for x in trees[i].nodes[deals[i][0] - 1]], sc.broadcast(trees[i])

        def lifted(batches):
            sums = [[np.zeros(m) for _ in range(3)] for m in size]
            for _, _, tree in _subtrees(batches, shape.value, width):
                for k in range(8):
                    for mine, more in zip(sums[k], tree.lift(k), strict=True):
                        mine += more
            for k, (below, zeros, ones) in enumerate(sums):
                at = np.flatnonzero(zeros + ones)
                for a in range(0, len(at), 1 << 16):
                    some = at[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some << 3 | k), *(pa.array(x[some]) for x in (below, zeros, ones))], names=["node", *names])

        t = dealt[i].mapInArrow(lifted, "node long, below double, zeros double, ones double").groupBy("node").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        node, children = t["node"].to_numpy(), [[np.zeros(m) for _ in range(3)] for m in size]
        for k in range(8):
            mine = node & 7 == k
            for x, name in zip(children[k], names, strict=True):
                x[node[mine] >> 3] = t[name].to_numpy()[mine]
        return children

    children: list = [None] * len(deals)
    for i in reversed(range(len(deals))):
        children[i] = sums_of(i)
        if i + 1 < len(deals):  # and the hot contexts' own nodes
            for k in range(8):
                for mine, more in zip(children[i][k], trees[i + 1].lift(k, children[i + 1][k]), strict=True):
                    mine += more
    for tree, below in zip(trees, children, strict=True):
        tree.weigh(below)

    def scored(i: int) -> DataFrame:
        width, above = deals[i][0], sc.broadcast(trees[i])

        def run(batches):
            for keys, n, tree in _subtrees(batches, above.value, width):
                logs = tree.weigh().log10(keys)
                for a in range(0, len(keys), 1 << 16):
                    z = a + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:z].view(np.int64)), pa.array(n[a:z]), pa.array(logs[a:z])], names=["key", "n", "log"])

        return dealt[i].mapInArrow(run, "key long, n long, log double")

    out = scored(0)
    for i in range(1, len(deals)):
        out = out.unionAll(scored(i))
    return stage(out, "scores")


def most_frequent(counted: DataFrame, most: int) -> Column:
    """The condition on ``n`` that as many rows as possible, but no more than ``most``, meet: from some
    eighth of a doubling on."""
    eighth = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8)
    held, least = 0, None
    for r in sorted(counted.groupBy(eighth.alias("b")).count().collect(), reverse=True):  # a row for each eighth
        held += r["count"]
        if held > most:
            break
        least = r["b"]
    return F.lit(False) if least is None else eighth >= least


def score(docs: DataFrame, learnt: Column, *, doc_id: str = "doc_id", text: str = "text", own: int = 0) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every
    row; the model learns from the rows for which ``learnt`` holds. ``own``: bytes of context after which
    what the document itself has had earlier counts as well (0: the tree alone)."""
    spark = docs.sparkSession
    counts = corpus_counts(docs, text, learnt)
    words = counts.where("kind = 0").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = F.coalesce(most_frequent(words, HELD_WORDS) | (F.col("key") == END_KEY), F.lit(False))
    scores = gram_scores(counts)
    common = F.coalesce(most_frequent(scores, HELD_GRAMS), F.lit(False))
    t = scores.where(common).select("key", "log").toArrow()
    heavy = t["key"].to_numpy().view(U), t["log"].to_numpy()
    model = spark.sparkContext.broadcast((heavy, _arrays(words.where(frequent).select("key", "n"))))
    divisor = float(np.log10(total + kinds + 1))

    def run(batches):
        (known_grams, gram_logs), (keys, n) = model.value
        seen = tb.HashTable(known_grams)
        table, logs = tb.HashTable(keys), np.log10(n + 1.0)
        end = float(logs[np.searchsorted(keys, U(END_KEY))]) if len(keys) and keys[-1] == U(END_KEY) else 0.0
        number = TaskContext.get().partitionId() << 40

        def lists(values, owner, rows):
            edge = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(edge), pa.array(values.view(np.int64)))

        for block in tb.blocks(batches, "text", 1 << 19):
            rows = block.num_rows
            buffer, at, scored, hashes, doc = canonical(*tb.utf8(block.column(2)))
            found = grams(buffer)
            contexts = both = np.zeros(0, np.int64)
            if own:
                again, contexts, both = had_before(buffer, at, own, found)
                again = (np.cumsum(scored) - 1)[again]
            found, at = found[scored], at[scored]
            place = seen.find(found)
            hit = place >= 0
            bits = np.bincount(at[hit], weights=gram_logs[place[hit]], minlength=rows).astype(float)
            rare_grams, had = lists(found[~hit], at[~hit], rows), np.zeros(len(found), np.int64)
            gain = np.zeros(rows)
            if len(contexts):
                had[again] = contexts << 32 | both
                mine = hit[again]
                tree = gram_logs[place[again[mine]]]
                gain += np.bincount(at[again[mine]], weights=np.log10((both[mine] + OWN_SHARE * 10**tree) / (contexts[mine] + OWN_SHARE)) - tree, minlength=rows)
            rare_had = lists(had[~hit], at[~hit], rows)
            place = table.find(hashes)
            hit = place >= 0
            known = np.bincount(doc[hit], minlength=rows)
            base = np.bincount(doc[hit], weights=logs[place[hit]], minlength=rows) + end
            tokens = np.bincount(doc, minlength=rows) + 1
            size = np.bincount(at, minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(rows)), block.column(0), block.column(1), pa.array(tokens), pa.array(known + (end > 0)), pa.array(base), pa.array(bits), pa.array(gain), pa.array(size), lists(hashes[~hit], doc[~hit], rows), rare_grams, rare_had],
                names=["row", "doc_id", "learnt", "n_tokens", "known", "base", "score", "gain", "size", "rare", "rare_grams", "rare_had"],
            )
            number += rows

    slim = docs.select(F.col(doc_id).alias("doc_id"), learnt.alias("learnt"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    base = stage(slim.mapInArrow(run, f"row long, doc_id {id_type}, learnt boolean, n_tokens long, known long, base double, score double, gain double, size long, rare array<long>, rare_grams array<long>, rare_had array<long>"), "scored")
    words_of = base.select("row", F.lit(0).alias("kind"), F.explode("rare").alias("key"), F.lit(0).cast("long").alias("had"))
    grams_of = base.select("row", F.lit(1).alias("kind"), F.inline(F.arrays_zip(F.col("rare_grams").alias("key"), F.col("rare_had").alias("had"))))
    pairs = words_of.unionAll(grams_of)
    light = words.where(~frequent).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("log")).unionAll(scores.where(~common).select(F.lit(1).alias("kind"), "key", "log"))
    word = F.col("kind") == 0
    contexts, both = F.shiftright("had", 32), F.col("had").bitwiseAND(F.lit((1 << 32) - 1))
    gain = F.log10((both + OWN_SHARE * F.pow(F.lit(10.0), "log")) / (contexts + OWN_SHARE)) - F.col("log")
    more = pairs.join(light, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(word, F.col("log"))).alias("more"), F.count_if(word).alias("more_known"), F.sum(F.when(~word, F.col("log"))).alias("more_score"), F.sum(F.when(F.col("had") != 0, gain)).alias("more_gain")
    )
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    if own:  # the mean of the two probabilities
        gain = F.col("gain") + F.coalesce("more_gain", F.lit(0.0))
        score += F.greatest(gain, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(gain))) - F.lit(math.log10(2))
    out = base.drop("rare", "rare_grams", "rare_had").join(more, "row", "left")
    return out.select(
        "doc_id", "learnt", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), score.alias("score"),
        (-score / F.lit(float(np.log10(2))) / F.col("size")).alias("bits_per_byte"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    held = fold_is("doc_id", 7, 2)
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held, own=OWN)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
