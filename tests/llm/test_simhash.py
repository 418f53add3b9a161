import random
import re

import numpy as np
import xxhash

from parlance.llm import simhash
from parlance.llm import textbytes as tb


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius=2):
    """component of each (id, fp): the smallest id reachable."""
    distinct = sorted(set(prints.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in prints.items()}


def test_xxh64_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 90000).astype(np.uint8)
    length = np.concatenate([np.arange(300), rng.integers(0, 60, 200)])
    starts = rng.integers(0, 80000, len(length))
    for seed in (0, 42):
        got = tb.xxh64(data, starts, starts + length, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(starts, length, strict=True)]


def test_query_against_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: fingerprint(t) for d, t in rows.items()}
    for radius, bucket_rows in ((2, 4096), (2, 3), (3, 4096), (3, 5)):
        want = brute(prints, radius)
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, radius=radius, bucket_rows=bucket_rows).collect()}
        assert {d: x[0] for d, x in got.items()} == prints
        assert {d: x[1] for d, x in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_links_of_crowded_buckets(spark):
    """Chains and clusters of near fingerprints, through refined buckets, keep every component."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            prints.add(f)
            for _ in range(rng.choice([1, 1, 2, 3])):
                f ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    want = brute(dict(zip(prints, prints, strict=True)))
    df = spark.createDataFrame([((f - (1 << 64) if f >> 63 else f),) for f in prints], "fp long")
    for bucket_rows in (4096, 5):
        u = simhash.links(df, bucket_rows=bucket_rows).collect()
        assert all(((a & (1 << 64) - 1) ^ (b & (1 << 64) - 1)).bit_count() > 0 for a, b in u)
        root = {f: f for f in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in u:
            a, b = find(a & (1 << 64) - 1), find(b & (1 << 64) - 1)
            root[max(a, b)] = min(a, b)
        assert {f: find(f) for f in prints} == want


def test_empty(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
