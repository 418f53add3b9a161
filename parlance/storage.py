"""Where streams keep their checkpoints and results, and staged tables lie: the folder that all executors
share, below one folder of the application's own, which goes at the driver's exit."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset and everything runs in one process
    (tests), a temporary folder of our own, removed at exit; on a cluster a ValueError, since executors
    do not see each other's disks."""
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


_own: dict[str, str] = {}


def remove_own(spark: SparkSession) -> None:
    """Removes all that this application has put below its folder; results that still read it can't be read then."""
    for folder in list(_own.values()):
        with contextlib.suppress(Exception):  # at exit the session may be gone already
            delete(spark, folder)
    _own.clear()


def fresh_path(spark: SparkSession, name: str) -> str:
    top = shared_dir(spark)
    if top not in _own:
        if not _own:
            atexit.register(remove_own, spark)
        _own[top] = f"{top}/parlance-{uuid.uuid4().hex}"
    return f"{_own[top]}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in place by a rename, so that readers see the old text or the new."""
    jvm = spark.sparkContext._jvm
    at, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, at):  # some stores do not rename onto a file
        fs.delete(at, False)
        fs.rename(beside, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def staged(df, name: str):
    """The rows, written below the shared folder and read back: the lineage ends here, the table's size is
    known, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
