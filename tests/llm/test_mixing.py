import hashlib
import re
from collections import Counter, defaultdict

import pytest

from parlance.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling as told: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_against_brute_force(spark, docs):
    rows = docs.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    goal = brute_targets(total)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    source, taken = {r.doc_id: r.source for r in rows}, defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in total:
        own = sorted((hashlib.md5(str(d).encode()).hexdigest()[:15], d) for d in size if source[d] == s)
        copies = int(goal[s] // total[s]) if total[s] else 0
        sums, at = [copies * total[s]], copies * total[s]
        for _, d in own:
            at += size[d]
            sums.append(at)
        assert abs(taken[s] - goal[s]) == pytest.approx(min(abs(x - goal[s]) for x in sums))


def test_budgets_nest_and_empty(spark, docs, no_docs):
    low, high = ({r.doc_id: r.copies for r in mixing.mix(docs, budget=b).collect()} for b in (0.2, 0.3))
    assert all(low[d] <= high[d] for d in low) and sum(low.values()) < sum(high.values())
    assert mixing.mix(no_docs).count() == 0
