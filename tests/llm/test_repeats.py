import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from parlance.llm import repeats

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracles


def brute(words, least=6, times=4):
    """All runs by their definition, (start, length, period)."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def made_up(rng):
    size = rng.choice([1, 2, 2, 3, 4, 9])
    words = [rng.randrange(size) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        period = rng.randint(1, 8)
        at = rng.randint(0, len(words))
        words[at:at] = ([rng.randrange(size) for _ in range(period)] * 9)[: rng.randint(period, 9 * period)]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3)])
def test_runs_by_definition(least, times):
    rng = random.Random(least)
    for _ in range(250):
        docs = [made_up(rng) for _ in range(rng.randint(1, 6))]
        lengths = [len(d) for d in docs]
        first = np.cumsum([0, *lengths])
        place, length, period = repeats.runs_of(np.array([w for d in docs for w in d], np.uint64), np.repeat(np.arange(len(docs)), lengths), least, times)
        of = np.searchsorted(first, place, "right") - 1
        for k, words in enumerate(docs):
            mine = of == k
            assert list(zip((place[mine] - first[k]).tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)) == brute(words, least, times)


def test_lz_blocks_are_the_longest_earlier_factors():
    rng = random.Random(5)
    for _ in range(60):
        words = made_up(rng) or [0]
        s = repeats.Suffixes(np.array(words, np.uint64), np.zeros(len(words), np.int64))
        want, at = [], 0
        while at < len(words):
            want.append(at)
            longest = max((n for j in range(at) for n in range(len(words) - at + 1) if words[j : j + n] == words[at : at + n]), default=0)
            at += max(1, longest)
        assert s.lz_blocks().tolist() == [*want, len(words)]


@pytest.mark.parametrize("period", [1, 2, 7, 1000])
def test_one_long_run(period):
    """Very long periodic texts take no more than a few steps for each word."""
    words = np.arange(60_000, dtype=np.uint64) % np.uint64(period)
    got = repeats.runs_of(words, np.zeros(len(words), np.int64))
    assert [x.tolist() for x in got] == [[0], [60_000], [period]]


def test_collapse_and_defined_cases(spark):
    rows = [(1, "a b " * 4 + "c"), (2, None), (3, " \t\n"), (None, "x " * 9), (5, "A a A a A a A a"), (5, "A a A a A a A a"), (7, "a a a a a"), (8, "ß  ß\tß\nß ß ß é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in repeats.periodic_runs(df).collect()]
    twice = (5, 8, [(0, 8, 2)], "A a")
    want = [(1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (None, 9, [(0, 9, 1)], "x"), twice, twice, (7, 5, [], "a a a a a"), (8, 7, [(0, 6, 1)], "ß é")]
    assert sorted(got, key=str) == sorted(want, key=str)
    clash = df.selectExpr("doc_id AS runs", "text AS start", "1 AS n_words", "'x' AS words")
    assert repeats.periodic_runs(clash, doc_id="runs", text="start").count() == len(rows)
    assert repeats.periodic_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in repeats.op12(spark, str(tmp_path)).collect()}
    changed = 0
    for r in docs.collect():
        words = re.findall(repeats.WORDS, r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        if n > 2000:  # one long text; the definition would take too long
            continue
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        row = got[r.doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        assert (row.start, row.length, row.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert row.exponent_milli == (1000 * -best[0] // best[2] if best else None)
    assert changed > 3


def test_same_as_sql(spark):
    assert oracles.differences(spark, "op12", repeats.op12, repeats.OP12_SQL, "/root/testdata/sf0.001") == ""
