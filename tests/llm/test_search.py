import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from parlance.llm import search

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracles

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERMS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """(item row, rank, doc_id, score) by the definition."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for row, text in enumerate(items):
        asked = Counter(terms(text))
        scored = []
        for d, c, length in counted:
            m = 75 + 25 * length * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(row, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def items_of(rng, docs):
    texts = [" ".join(rng.sample(terms(t), min(12, len(terms(t))))) for _, t in docs if t]
    return [*rng.sample(texts, 8), "the THE the and", "no-such-thing", "", None, "end", "the THE the and"]


@pytest.mark.parametrize(("k", "postings", "part_bytes"), [(20, 1 << 20, 1 << 22), (3, 40, 1 << 22), (5, 300, 60)])
def test_against_brute_force(spark, docs, k, postings, part_bytes):
    rng = random.Random(k)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = items_of(rng, rows)
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in search.ranked(docs, items, k=k, postings=postings, part_bytes=part_bytes).collect())
    assert got == brute(rows, asked, k)


def test_ties_nulls_repeats_and_clashing_names(spark):
    rows = [(d, "alpha beta gamma") for d in (9, 3, 7, 3, None)] + [(1, "alpha delta"), (2, None), (4, ""), (5, "delta " * 30), (6, "-- !")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = ["beta", "delta", "beta"]
    items = spark.createDataFrame([(8, "beta"), (None, "delta"), (8, "beta")], "item_id long, text string").coalesce(1)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(df, items, k=4).collect()), key=str)
    want = [((8, None, 8)[row], r, d, s) for row, r, d, s in brute(rows, asked, 4)]
    assert got == sorted(want, key=str)
    assert [x[2] for x in got if x[0] == 8] == [3, 3, 3, 3, 7, 7, 9, 9]
    clash = df.selectExpr("doc_id AS item", "text AS score", "'x' AS row", "'x' AS rank", "'x' AS salt")
    again = search.ranked(clash, items.selectExpr("item_id AS rank", "text AS row"), doc_id="item", text="score", item_id="rank", item_text="row", k=4)
    assert again.count() == len(got)


def test_no_rows(spark, no_docs):
    items = spark.createDataFrame([(1, "the"), (2, None)], "item_id long, text string")
    assert search.ranked(no_docs, items).count() == 0
    assert search.ranked(no_docs, items.limit(0)).count() == 0


def test_tree_opens_fewer_nodes_than_documents():
    """Best-first search leaves most of a shard unopened where impacts differ, and is still exact."""
    rng = np.random.default_rng(2)
    n = 4096
    held = rng.random((6, n)) < 0.3
    term, doc = np.nonzero(held)
    impact = (1000 * rng.pareto(1.2, len(term)) + 1).astype(np.int64)
    shard = search.Shard(term, doc, impact, 6, np.arange(n) * 2)
    weight = np.array([5, 3, 9, 1, 2, 7])
    opened = []
    real = shard.children
    shard.children = lambda level, *rest: (opened.append(len(level)), real(level, *rest))[1]
    none = np.zeros(0, np.int64)
    score, ids = shard.search(np.arange(6), weight, 10, (none, none), width=16)
    exact = np.zeros(n, np.int64)
    np.add.at(exact, doc, weight[term] * impact)
    order = np.lexsort([np.arange(n), -exact])[:10]
    assert score.tolist() == exact[order].tolist()
    assert ids.tolist() == (order * 2).tolist()
    assert sum(opened) < n / 4


def test_same_as_sql(spark):
    assert oracles.differences(spark, "op11", search.op11, search.OP11_SQL, "/root/testdata/sf0.001") == ""
