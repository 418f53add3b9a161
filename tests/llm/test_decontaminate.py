import hashlib
import random
import re

import pyarrow as pa

from parlance.llm import textbytes as tb
from parlance.llm.decontaminate import Shard, TestPart, clean_documents, contamination, occurrences, verbatim_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = {}
    for doc_id, text in docs:
        w = lowered(text)
        hit, ids = [False] * len(w), []
        for item_id, item in items:
            q = lowered(item)
            span = min(window, len(q))
            found = False
            for j in range(len(q) - span + 1 if span else 0):
                for i in range(len(w) - span + 1):
                    if w[i : i + span] == q[j : j + span]:
                        hit[i : i + span] = [True] * span
                        found = True
            if found:
                ids.append(str(item_id))
        out[doc_id] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit))
    return out


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [lowered(t) for _, t in rows if t]
    items = [(10, " ".join(words[4][2:30])), (2, " ".join(words[9][:4])), (30, "unseen thing " * 9), (4, None), (5, "!!"), (6, "über"), (7, " ".join(words[20][-12:]).upper()), (7, " ".join(words[20][-12:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, part_bytes, at_once in ((10, 1 << 20, 8), (3, 60, 8), (20, 1 << 20, 8), (24, 1 << 20, 8), (10, 60, 2)):
        found = contamination(docs, bench, window=window, part_bytes=part_bytes, at_once=at_once)
        got = {r.doc_id: tuple(r)[1:6] for r in found.collect()}
        assert got == brute(rows, items, window)
        assert all(r.n_hit == sum(x.end - x.start for x in r.spans) for r in found.collect()) or at_once < 8
        clean = clean_documents(docs, bench, window=window, part_bytes=part_bytes, at_once=at_once)
        assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, x in got.items() if not x[4])
        assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "zero A b c d e f zero b c d e"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "x a B c d e f y")], "item_id long, text string")
    got = sorted(tuple(r) for r in verbatim_matches(docs, bench, window=3).collect())
    assert got == [(1, "9", 1, 1, 6), (1, "9", 8, 2, 4)]


def test_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, bench).count() == 0
    assert contamination(docs, bench).where("contaminated").count() == 0


def test_maximal_matches_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(30)]
    items = [" ".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for at_once, part_bytes in ((8, 1 << 20), (1, 40)):
        got = [tuple(r) for r in verbatim_matches(docs, bench, window=5, part_bytes=part_bytes, at_once=at_once).collect()]
        assert len(got) == len(set(got)) > 50
        covered = {}
        for d, item, i, j, n in got:
            w, q = texts[d].split(), items[int(item)].split()
            assert w[i : i + n] == q[j : j + n] and n >= min(5, len(q))
            assert not (i and j and w[i - 1] == q[j - 1]) and not (i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n])
            covered.setdefault((d, int(item)), set()).update(range(i, i + n))
        for d, text in enumerate(texts):
            for k, item in enumerate(items):
                assert len(covered.get((d, k), ())) == brute([(d, text)], [(k, item)], 5)[d][1]


def test_words_that_a_polynomial_hash_would_confuse(spark):
    """A Thue-Morse word and its complement have equal polynomial sums modulo 2**64."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in contamination(docs, spark.createDataFrame([(7, word)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_equal_words_stay_linear(spark):
    data, offsets = tb.utf8(pa.array(["w " * 2000]))
    shard, part = Shard(data, offsets, pad=10), TestPart(["1", "2"], ["w " * 2000] * 2)
    assert sum(len(place) for place, _ in occurrences(shard, part)) == 1991
    docs = spark.createDataFrame([(1, "w " * 2000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w " * 2000), (2, "w " * 2000)], "item_id long, text string")
    [r] = contamination(docs, bench).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (2000, 2000, 2)
    assert max(r.n_words for r in verbatim_matches(docs, bench).collect()) == 2000
