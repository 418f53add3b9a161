import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import fingerprint as fp
from parlance.llm import textbytes as tb
from parlance.llm.shared import dealt_by_id


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_follow_generalised_jaccard():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    pairs = []
    for k in range(60):
        a = rng.choices(words[: 10 + k // 2], k=80)
        b = a[: k + 1] + rng.choices(words, k=79 - k)
        pairs.append((" ".join(a), " ".join(b)))
    own, other = (fp.signatures(*tb.utf8(pa.array(x, pa.large_string())), 512) for x in zip(*pairs, strict=True))
    error = (own == other).mean(axis=1) - np.array([jaccard(a, b) for a, b in pairs])
    assert np.abs(error).max() < 0.09 and abs(error.mean()) < 0.01


def test_weights_matter_not_only_presence():
    a, b = "x " * 90 + "y " * 10, "x " * 10 + "y " * 90
    s = fp.signatures(*tb.utf8(pa.array([a, b], pa.large_string())), 1024)
    assert (s[0] == s[1]).mean() == pytest.approx(20 / 180, abs=0.05)


def test_query_against_direct_computation(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for ranges in (1, 6):
        got = {r.doc_id: r for r in fp.likeness_by_next(docs, ranges=ranges).collect()}
        assert len(got) == len(rows)
        by_text = {}
        for k, (doc_id, text) in enumerate(rows):
            after_id, after = rows[(k + 1) % len(rows)]
            half = len(text) // 2
            new = text[: len(text) - half] + after[:half]
            r = got[doc_id]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
            both = fp.signatures(*tb.utf8(pa.array([text, new, after], pa.large_string())))
            assert r.near_edited == (both[0] == both[1]).mean() and r.near_next == (both[0] == both[2]).mean()
            assert r.fingerprint == both[0].tobytes().hex() and r.edited_fingerprint == both[1].tobytes().hex()


def test_a_word_repeated_more_than_65536_times(spark):
    """Equal texts have equal fingerprints whatever lies beside them in a block."""
    long, short = "a " * 65537 + "b", "a b"
    rows = [(1, long), (2, short), (5, long), (6, "c d"), (7, "a " * 70000), (8, "a"), (9, None)]
    got = {r.doc_id: r for r in fp.likeness_by_next(spark.createDataFrame(rows, "doc_id long, text string"), ranges=1).collect()}
    assert got[1].fingerprint == got[5].fingerprint != got[2].fingerprint
    assert got[1].near_next < 0.1 and got[7].near_next < 0.1
    alone, beside = (fp.signatures(*tb.utf8(pa.array(x, pa.large_string()))) for x in ([long], [short, long, short, "a"]))
    assert (alone[0] == beside[1]).all()


def test_ids_shared_by_many_rows_are_dealt_to_several_ranges(spark):
    rows = [(None, f"text {k}") for k in range(600)] + [(4, "same")] * 600 + [(k, f"x {k}") for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fp.likeness_by_next(docs, ranges=8)
    assert got.count() == len(rows) and {r.near_next for r in got.where("doc_id = 4").collect()} >= {1.0}
    parts = dealt_by_id(docs, "doc_id", "text", 1 << 20, 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 400


def test_single_and_empty(spark, no_docs):
    assert fp.likeness_by_next(no_docs).count() == 0
    [r] = fp.likeness_by_next(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0
