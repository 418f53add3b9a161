import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import brute as contaminated
from test_mixing import brute_targets
from test_simhash import brute as grouped
from test_simhash import fingerprint

import corpus_pipeline
from parlance.llm.tokenize import Encoder, tokenizer_path


def expected(rows, items):
    """The ids that each stage keeps, and the copies of the mix."""
    kept = [r for r in rows if r.text and re.search(r"[^\W\d_]", r.text)]
    yield "language", sorted(r.doc_id for r in kept)
    root = grouped({r.doc_id: fingerprint(r.text) for r in kept}, corpus_pipeline.RADIUS)
    kept = [r for r in kept if root[r.doc_id] == r.doc_id]
    yield "near_duplicates", sorted(r.doc_id for r in kept)
    bad = contaminated([(r.doc_id, r.text) for r in kept], items, 10)
    kept = [r for r in kept if not bad[r.doc_id][4]]
    yield "decontaminate", sorted(r.doc_id for r in kept)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept}
    total = Counter()
    for r in kept:
        total[r.source] += size[r.doc_id]
    goal, copies = brute_targets(total), {}
    for s in total:
        whole = int(goal[s] // total[s])
        rest, at = goal[s] - whole * total[s], 0
        for r in sorted((r for r in kept if r.source == s), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15]):
            n = size[r.doc_id]
            copies[r.doc_id] = whole + int(rest > 0 and at < rest and (at + n <= rest or at + n - rest <= rest - at))
            at += n
    yield "mix", sorted(d for d, n in copies.items() for _ in range(n))


@pytest.mark.parametrize("clash", [False, True])
def test_stages_against_brute_force(spark, docs, tmp_path, clash):
    rows = docs.collect()
    words = [r.text.split() for r in rows if r.text and len(r.text.split()) > 20]
    items = [(1, " ".join(words[3][2:18])), (2, " ".join(words[8][:15]).upper()), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    if clash:  # further columns with the names that operators use
        from pyspark.sql import functions as F

        now = docs.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "fp", "copies", "size", "h", "u", "rank", "__x")})
    columns = now.columns
    (now).write.parquet(f"{tmp_path}/documents.parquet")
    want = dict(expected(rows, items))
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES[:-1]):
        apply(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == want[name], name
    library, texts = Encoder(tokenizer_path()), {r.doc_id: r.text for r in rows}
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect())
    assert [g[1] for g in got] == want["mix"]
    start = 0
    for at, doc_id, n, crc in got:
        ids = np.append(np.frombuffer(library.exact([texts[doc_id]])[0], "<u2"), 2).astype("<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
    if not clash:
        assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == got


def test_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_of_copies(spark, tmp_path):
    one, two, three = ("the first text of many words here", "an entirely other passage about something else", "and finally a third that nobody has seen before")
    rows = [(None, one), (None, one), (5, two), (3, two), (3, two), (None, two), (7, three), (7, one + " " + two), (7, three)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", one), ("3", two), ("7", three), ("7", one + " " + two)])


def test_unlabelled_documents_with_a_letter_stay(spark, tmp_path):
    rows = [(1, "plain words"), (2, "12 !?"), (3, None), (4, "日本"), (5, "")]
    df = spark.createDataFrame([(i, t, None, "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, df, str(tmp_path))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]


def test_a_text_of_another_language_than_its_own_goes(spark):
    import random

    rng = random.Random(6)
    stems = {"aa": "the ing of tion and er".split(), "bb": "der ung keit sch über ein".split()}
    made = lambda lang: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(200))
    rows = [(k, made("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb", "s", 1) for k in range(400)]
    rows += [(500, made("aa"), "bb", "s", 1), (501, made("bb"), None, "s", 1), (502, "12 ?", "zz", "s", 1), (503, "12 !", "aa", "s", 1), (504, "the", "bb", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()}
    assert {r[0] for r in rows} - kept == {500, 502, 503}
