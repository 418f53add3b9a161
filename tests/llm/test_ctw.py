import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import ctw
from parlance.llm.shared import fold_is


def string_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return b" ".join(bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words) + b"\n"


def seen_bytes(texts):
    """(context of DEPTH bytes, byte) of every scored byte."""
    for t in texts:
        s = b"\n" * ctw.DEPTH + string_of(t)
        for i in range(ctw.DEPTH, len(s)):
            yield s[i - ctw.DEPTH : i], s[i]


class Brute:
    """Context-tree weighting by its definition: predictions are ratios of weighted block probabilities."""

    def __init__(self, texts):
        self.data = list(seen_bytes(texts))
        least = ctw.LEAST
        self.nodes = {b""}
        for d in range(1, ctw.DEPTH + 1):
            self.nodes |= {c for c, n in Counter(x[0][-d:] for x in self.data).items() if n >= least}

    def kt(self, bits):
        a, b = bits.count(0), bits.count(1)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, data):
        own = self.kt([b for _, b in data])
        if len(context) == ctw.DEPTH:
            return own
        parts, rest = {}, []
        for c, b in data:
            longer = c[-len(context) - 1 :]
            (parts.setdefault(longer, []) if longer in self.nodes else rest).append((c, b))
        split = sum(self.weighted(c, x) for c, x in parts.items()) + (self.kt([b for _, b in rest]) if rest else 0)
        return np.logaddexp(own, split) - math.log(2)

    def probability(self, context, byte):
        p = 1.0
        for k in range(8):
            own = [(c, b >> (7 - k) & 1) for c, b in self.data if b >> (8 - k) == byte >> (8 - k)]
            p *= math.exp(self.weighted(b"", [*own, (context, byte >> (7 - k) & 1)]) - self.weighted(b"", own))
        return p


TEXTS = ["the cat sat on the mat", "the dog sat on the cat.", "Über the façade", "a b c a b c a b", "the cat sat", None, ""]


@pytest.fixture(scope="module")
def tree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    return ctw.learn(ctw.corpus_counts(df, "text"))


def key_of(context, byte):
    return int.from_bytes(context + bytes([byte]), "big")


def test_probabilities_against_the_definition(tree):
    brute = Brute(TEXTS)
    for context, byte in [*sorted(set(seen_bytes(TEXTS)))[::7], (b"the ca", 120), (b"zzzzzz", 97), (b"on the", 10), (b"\n\n\n\n\n\n", 200)]:
        got = 10 ** tree.log10(np.array([key_of(context, byte)], np.uint64))[0]
        assert got == pytest.approx(brute.probability(context, byte), rel=2e-5)
    for context in (b" the c", b"zzzzzz"):
        assert (10 ** tree.log10(np.array([key_of(context, b) for b in range(256)], np.uint64))).sum() == pytest.approx(1, rel=1e-4)


def test_scores_and_base_against_brute_force(spark, docs, monkeypatch):
    rows = docs.collect()
    for grams, words in ((3 << 20, 1 << 20), (900, 6), (0, 0)):  # with less held, more take the shuffled join
        monkeypatch.setattr(ctw, "HELD_GRAMS", grams)
        monkeypatch.setattr(ctw, "HELD_WORDS", words)
        got = {r.doc_id: r for r in ctw.score(docs, ~fold_is("doc_id", 3, 1)).collect()}
        learnt = [r.text for r in rows if got[r.doc_id].learnt]
        assert 0 < len(learnt) < len(rows) == len(got)
        counts = Counter()
        for t in learnt:
            counts.update([*string_of(t)[:-1].split(b" "), b"\n"] if string_of(t) != b"\n" else [b"\n"])
        n, v = sum(counts.values()), len(counts)
        tree = ctw.learn(ctw.corpus_counts(docs.where(~fold_is("doc_id", 3, 1)), "text"))
        for r in rows:
            tokens = [*string_of(r.text)[:-1].split(b" "), b"\n"] if string_of(r.text) != b"\n" else [b"\n"]
            x = got[r.doc_id]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
            assert x.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
            want = tree.log10(np.array([key_of(c, b) for c, b in seen_bytes([r.text])], np.uint64)).sum()
            assert x.score == pytest.approx(want, rel=1e-6)


def test_empty(spark, docs, no_docs):
    assert ctw.score(no_docs, F.lit(True)).count() == 0
    r = {x.doc_id: x for x in ctw.score(docs, F.lit(False)).collect()}
    assert all(x.train_tokens == x.n_known == 0 for x in r.values()) and r[360].score == pytest.approx(8 * math.log10(0.5))


def test_contexts_seen_twice_are_nodes_at_every_size(spark):
    common = [("lorem ipsum dolor " * 40000,) for _ in range(3)]  # two million bytes
    rare = ["qxzjvk", "qxzjvk"]
    df = spark.createDataFrame([*common, *[(t,) for t in rare], ("qxzjvk again",)], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    learnt = ~F.col("text").endswith("again")
    tree = ctw.learn(ctw.corpus_counts(df.where(learnt), "text"))
    assert int.from_bytes(b"qxzjvk"[: ctw.DEPTH], "big") in tree.contexts[ctw.DEPTH].tolist()
    for r in ctw.score(df, learnt).collect():
        text = df.where(F.col("doc_id") == r.doc_id).first().text
        want = tree.log10(np.array([key_of(c, b) for c, b in seen_bytes([text])], np.uint64)).sum()
        assert r.score == pytest.approx(want, rel=1e-6)


def test_subtrees_give_the_whole_tree_s_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(ctw, "_RUN", 50)
    learnt = ~fold_is("doc_id", 3, 1)
    tree = ctw.learn(ctw.corpus_counts(docs.where(learnt), "text"))
    got = ctw.gram_scores(ctw.corpus_counts(docs, "text", learnt)).collect()
    assert len(got) == len({r.key for r in got}) == len({key_of(c, b) for c, b in seen_bytes(r.text for r in docs.collect())})
    assert [r.log for r in got] == pytest.approx(tree.log10(np.array([r.key for r in got], np.uint64)).tolist(), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_hot_contexts_are_dealt_by_more_bytes(spark, docs, monkeypatch, hot):
    """One three-byte context has most grams; its tasks give what the whole tree gives."""
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    monkeypatch.setattr(ctw, "_RUN", 50)
    letters = "abcdefghijklmnopqrstuvwxyz"
    skewed = spark.createDataFrame([(f"{a}{b}the{c}{d} {a}the{b}",) for a in letters for b in letters[::3] for c in letters[::9] for d in "xy"], "text string")
    df = docs.select("text").unionAll(skewed).coalesce(3).withColumn("id", F.monotonically_increasing_id())
    learnt = F.col("id") % 3 != 1
    counts = ctw.corpus_counts(df, "text", learnt)
    grams = counts.where("kind = 1").select("key", F.col("n").alias("learnt"), (F.col("n") + F.col("m")).alias("n"))
    deals = ctw.dealt_grams(grams)
    assert [w for w, _, _ in deals] == list(range(ctw.TOP + 1, ctw.TOP + 1 + len(deals))) and len(deals) > 1
    assert sum(rows.count() for _, rows, _ in deals) == grams.count()
    for width, rows, _ in deals:
        assert width == ctw.DEPTH or all(r["count"] <= hot for r in rows.groupBy("context").count().collect())
    under = [(width, r.context) for width, rows, _ in deals for r in rows.where(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)) == int.from_bytes(b"the", "big")).collect()]
    assert len(under) > 400 and len(set(under)) > 20
    tree = ctw.learn(ctw.corpus_counts(df.where(learnt), "text"))
    got = ctw.gram_scores(counts).collect()
    assert len(got) == len({r.key for r in got}) == grams.count()
    assert [r.log for r in got] == pytest.approx(tree.log10(np.array([r.key for r in got], np.uint64)).tolist(), rel=1e-5, abs=1e-6)


def test_most_frequent_holds_no_more_than_asked(spark):
    df = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 3, 3, 9, 500)], "n long")
    for most in range(10):
        got = [r.n for r in df.where(ctw.most_frequent(df, most)).collect()]
        assert len(got) <= most and (not got or min(got) > max([n for n in (1, 2, 3, 9, 500) if n not in got], default=0))
    assert df.where(ctw.most_frequent(df, 8)).count() == 8


def test_bytes_that_a_very_frequent_context_never_had_have_a_probability():
    text = np.array([key_of(b"the ca", b) for b in b"ty"], np.uint64)
    for n in (1 << 20, 1 << 26, 1 << 40):
        tree = ctw.Tree(ctw.levels_of(text, np.full(2, n), 0, ctw.DEPTH)).weigh()
        for context in (b"the ca", b"zhe ca"):  # a node, and none
            got = tree.log10(np.array([key_of(context, b) for b in range(256)], np.uint64))
            assert np.isfinite(got).all() and (10**got).sum() == pytest.approx(1, rel=1e-4)


def own_score(tree, text, own):
    """Byte by byte: the mean of the tree's probability and of one that counts what the text had so far."""
    s, plain, mine, had = string_of(text), 0.0, 0.0, {}
    for i, (context, byte) in enumerate(seen_bytes([text])):
        log = tree.log10(np.array([key_of(context, byte)], np.uint64))[0]
        here = had.setdefault(s[i - own : i], Counter()) if i >= own else Counter()
        plain += log
        mine += math.log10((here[byte] + ctw.OWN_SHARE * 10**log) / (sum(here.values()) + ctw.OWN_SHARE))
        here[byte] += 1
    high = max(plain, mine)
    return plain, high + math.log10((10 ** (plain - high) + 10 ** (mine - high)) / 2)


LINES = "qvxz wkjq zzyvq fqjxk"


@pytest.mark.parametrize("held", [3 << 20, 40, 0])
def test_what_a_document_had_before_counts(spark, docs, monkeypatch, held):
    """With all, some and no grams held; a text's neighbours in a block change nothing."""
    monkeypatch.setattr(ctw, "HELD_GRAMS", held)
    texts = [f"{LINES}\n" * 6, "a" * 60, "", None, "", LINES, f"{LINES} Über {LINES} ubER {LINES}", "once only, all of it"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionAll(more).coalesce(1)
    learnt = F.col("doc_id") < 1000
    tree = ctw.learn(ctw.corpus_counts(df.where(learnt), "text"))
    for own in (5, ctw.OWN):
        got = {r.doc_id: r.score for r in ctw.score(df, learnt, own=own).collect()}
        for r in df.collect():
            plain, want = own_score(tree, r.text, own)
            assert got[r.doc_id] == pytest.approx(want, rel=1e-6) and got[r.doc_id] > plain - math.log10(2) - 1e-3
    assert got[1000] > 0.4 * own_score(tree, texts[0], ctw.OWN)[0]  # its lines come six times


def test_held_out_texts_that_repeat_unknown_words_keep_up_with_the_base(spark, tmp_path):
    rows = [(i, " ".join(f"{w}{LINES[(i * 7 + k) % 20]}" for k, w in enumerate("the cat sat on a mat".split() * 3))) for i in range(70)]
    held = [r.i for r in spark.range(70).select(F.col("id").alias("i")).where(fold_is("i", 7, 2)).collect()]
    rows = [(i, f"{LINES} {t[:20]}\n" * 12 if i in held[::2] else t) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ctw.op3(spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r.held_out} == set(held) and len(held) > 3
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert all(got[i].n_known < got[i].n_tokens and got[i].score > got[i].base_score for i in held[::2])
