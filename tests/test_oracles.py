"""Every query that SQL can express, against DuckDB on the smallest tables; the others run at least."""

import random
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracles

from parlance.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracles.database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    assert oracles.differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF, con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["top_contributions", "reasons"])
def test_exact_ties_as_in_sql(spark, tmp_path, name):
    """Slopes that lie on a bound, or that are zero but for rounding, fall on the same side as in SQL."""
    rng = random.Random(11)
    rows = [(k, t, ("user", "assistant")[t % 2], "x" * rng.randint(1, 40)) for k in range(4000) for t in range(rng.randint(2, 8))]
    columns = dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))
    pq.write_table(pa.table(columns), tmp_path / "conversations.parquet")
    assert oracles.differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path)) == ""
