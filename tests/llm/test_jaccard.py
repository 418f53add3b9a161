import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import jaccard

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracles


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=85, size=4):
    """(n_shingles, component) by row, by comparing all sets."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links += a != sets[j]
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)], links


def families(seed, n=12, copies=14):
    """Texts whose copies differ by a few words, so that many pairs lie about the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        if k % 3 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: rng.randint(max(1, len(text) * 8 // 10), len(text))]
            texts.append(" ".join(text))
    texts += ["", None, " \t", "One", "one", "one two", "ONE two", "A b  c d", "a B c\td", "a b c d", "x y z x y z x y z x y z"]
    return [(None if k % 17 == 5 else 7 * k % 1000, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (3, {"region_values": 300, "cell_rows": 20, "pivots": 2, "common": 10, "filter_bits": 64}), (4, {"percent": 60, "size": 2, "region_values": 2000})])
def test_against_brute_force(spark, monkeypatch, seed, options):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rows = families(seed)
    want, links = brute(rows, options.get("percent", 85), options.get("size", 4))
    assert links > 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard.components_by_jaccard(df, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("leaf", [2, 8, 48])
def test_region_join_is_exact(monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(25):
        sets, base = [], [rng.getrandbits(62) for _ in range(40)]
        for _ in range(rng.randint(2, 90)):
            if rng.random() < 0.1:
                base = [rng.getrandbits(62) for _ in range(rng.randint(1, 60))]
            sets.append(sorted({x if rng.random() > 0.06 else rng.getrandbits(62) for x in base}))
        region = jaccard.Region(np.array([x for s in sets for x in s], np.uint64), np.cumsum([0, *map(len, sets)]), 85)
        region.join()
        root = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len({*a} & {*sets[j]})
                if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                    x, y = i, j
                    while root[x] != x:
                        x = root[x]
                    while root[y] != y:
                        y = root[y]
                    root[max(x, y)] = min(x, y)
        for i in range(len(sets)):
            while root[root[i]] != root[i]:
                root[i] = root[root[i]]
        assert region.root.tolist() == root


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    linked = 0
    for _ in range(200):
        n = int(rng.integers(5, 40_000 if rng.random() < 0.2 else 400))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        b = a[: int(n * rng.uniform(0.84, 1))].copy()
        swap = rng.random(len(b)) < rng.random() * 0.1
        b[swap] = rng.integers(0, 1 << 63, int(swap.sum())).astype(np.uint64)
        both = len(np.intersect1d(a, b))
        held = np.array([len(a), len(b)])
        offsets, data = jaccard.sketches_of(np.concatenate([a, b]), np.repeat([0, 1], held), held)
        one = pa.Array.from_buffers(pa.binary(), 2, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        u, v = jaccard.Sketches(one.slice(0, 1), held[:1]), jaccard.Sketches(one.slice(1, 1), held[1:])
        if 100 * both >= 85 * (held.sum() - both):
            linked += 1
            assert jaccard.pairs_that_may_link(u, v, 85).all()
        elif both < n / 2:
            assert not jaccard.pairs_that_may_link(u, v, 85).any()
    assert linked > 50


def test_hot_cell_and_copies(spark):
    """A third of the rows are copies of one text, as many differ from it by a word."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(300)] + [(300 + k, " ".join(base[:k] + [f"v{k}"] + base[k + 1 :])) for k in range(60)] * 5 + [(1000 + k, " ".join(f"u{k}.{j}" for j in range(20))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for options in ({}, {"region_values": 900, "cell_rows": 16}):
        got = {(r.doc_id, r.component_id) for r in jaccard.components_by_jaccard(df, **options).collect()}
        assert got == {(d, 0 if d < 1000 else d) for d, _ in rows}


def test_no_rows_and_clashing_names(spark, no_docs):
    assert jaccard.components_by_jaccard(no_docs).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 0, "x"), (2, "a b c d e", 1, "y")], "n long, key string, set int, region string")
    assert [tuple(r) for r in jaccard.components_by_jaccard(df, doc_id="n", text="key").orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]


def test_same_as_sql(spark):
    assert oracles.differences(spark, "op13", jaccard.op13, jaccard.OP13_SQL, "/root/testdata/sf0.001") == ""
