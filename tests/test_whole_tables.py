"""Queries that have no SQL cover all rows of their tables."""

from pyspark.sql import functions as F

from parlance.plans import base as B
from parlance.plans import catalog


def test_all_turns_are_tagged(spark, tmp_path):
    rows = [(1, 0, "user", "the cat and der Hund"), (1, 1, "assistant", "the long turn " * 30), (1, 2, "user", ""), (1, 3, "user", None), *[(2, k, "user", f"word the {k} le") for k in range(20)]]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    turns = {(r.call_id, r.turn_index): r.n for r in B.turns(spark, str(tmp_path)).select("call_id", "turn_index", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")).collect()}
    got = catalog.QUERIES["crf_tags"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {(r.call_id, r.turn_index): r.n for r in got} == turns
    assert max(turns.values()) == 90 and all(0 <= r.right <= r.n for r in got)


def test_cepstra_of_all_pages(spark, tmp_path):
    spark.range(60).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["cepstra"](spark, str(tmp_path)).select("signal_id").distinct().collect()
    assert sorted(r.signal_id for r in got) == list(range(60))
