"""All operators and the pipeline over rows with nulls in any column, ties, repeats and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm.queries import QUERIES

ROWS = [
    (None, None, None, None, None), (None, "a text without id", "en", None, 17), (None, "a text without id", "en", None, 17), (1, "repeated row here", "en", "a", 17), (1, "repeated row here", "en", "a", 17),
    (1, "same id other text", None, "b", 18), (2, None, "fr", "a", 0), (3, "", "de", "b", 0), (4, "x" * 70000, "en", "a", 70000), (5, "word " * 9000, "fr", "a", 45000), (6, "12 !? 34", "en", None, 8),
    (7, "\u0000 odd   blanks \x0b and \x1c", "de", "a", 20), (8, "ça va très bien", "fr", "b", 15), (9, "ça va très bien", "fr", "b", 15), (-3, "negative id", "en", "c", 11),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edge")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "size", "h", "fp", "key", "word", "rank", "shard", "slot", "row", "part", "kind", "label", "toxic", "at", "s", "l", "file", "copies", "value")
    docs.withColumns({c: F.lit("clash") for c in clash}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (2, 1, None), (8, 1, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "no such words in here at all"), (None, "odd"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith("op10"):
        assert sum(r.n_docs for r in rows) == len(ROWS)
        return
    if name.startswith("op11"):  # the best documents of each item
        assert sorted((r.item_id is None, r["rank"], r.doc_id) for r in rows) == [(False, 1, 1), (False, 2, 1), (True, 1, 7)]
        return
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, folder, tmp_path, name):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark, folder):
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        now = apply(spark, now, folder)
        assert now.columns == columns
    kept = {r.doc_id for r in now.collect()}
    assert 4 in kept and not kept & {2, 3, 6, 7}
    assert corpus_pipeline.run(spark, folder).count() >= len(kept)
