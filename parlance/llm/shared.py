"""What the operators of this package share on the driver's side: staged tables and ranges of ids.

Staged tables lie in the shared folder, below one folder of the application's own, which goes at the
driver's exit (``remove_staged`` removes it sooner).
"""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset and
    everything runs in one process (tests), a temporary folder of our own, removed at exit; on a
    cluster a ValueError, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parlance-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_staged(spark: SparkSession) -> None:
    """Removes all tables staged by this application; results that still read them can't be read then."""
    for folder in list(_own.values()):
        with contextlib.suppress(Exception):  # at exit the session may be gone already
            _delete(spark, folder)
    _own.clear()


def fresh_path(spark: SparkSession, name: str) -> str:
    top = shared_dir(spark)
    if top not in _own:
        if not _own:
            atexit.register(remove_staged, spark)
        _own[top] = f"{top}/parlance-{uuid.uuid4().hex}"
    return f"{_own[top]}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; a staged table ``instead_of``,
    which nothing reads any more, goes then.

    This cuts the lineage, gives Catalyst true sizes for its choice of joins, and survives lost
    executors, since the files live in the shared store.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    old = getattr(instead_of, "staged_at", None)
    if old:
        _delete(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dealt_by_id(docs: DataFrame, doc_id: str, text: str, range_bytes: int, ranges: int | None = None) -> DataFrame:
    """(doc_id, text) in ranges of ascending ids that hold about ``range_bytes`` of text each.

    Rows of one id, null ids too, follow each other by a hash of their text, and equal rows are
    interchangeable, so ranges are cut inside an id as well, however many rows share it.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if ranges is None:
        ranges = math.ceil((slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / range_bytes)
    keyed = slim.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = "doc_id", "tie", "row"
    return keyed.repartitionByRange(max(1, min(1 << 20, ranges)), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fold_is(column: str, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the named fold; a null id belongs to none."""
    return F.coalesce(crc_of_id(column) % modulus == remainder, F.lit(False))


def unit_hash(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that only these columns and the seed decide (nulls count for nothing)."""
    h = F.xxhash64(*columns, F.lit(seed))
    return F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))
