"""A store of calls in versions: data by version and split, a manifest for each version, one pointer.

A new version writes the splits whose rows have changed and nothing else; its manifest names, for every split,
the version whose files hold it. The pointer is replaced by a rename once all is written, so readers see
the old version or the new one, whole. Old versions stay readable, and a restore moves the pointer back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage


def _current(spark: SparkSession, path: str) -> int:
    return int(storage.read_text(spark, f"{path}/CURRENT") or 0)


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    if not version:
        return {"schema": None, "types": None, "splits": {}}
    text = storage.read_text(spark, f"{path}/manifests/{version}.json")
    if text is None:
        raise ValueError(f"no version {version} at {path}")
    return json.loads(text)


def digests(calls: DataFrame, split: str = "split") -> dict[str, tuple[int, str]]:
    """Rows and a digest of each split, whatever the rows' order; a row for each split reaches the driver."""
    rest = [c for c in sorted(calls.columns) if c != split]
    h = F.xxhash64(*[F.to_json(F.struct(*rest))])
    found = calls.groupBy(split).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("d"))
    return {r[split]: (r["n"], r["d"]) for r in found.collect()}


def write_version(calls: DataFrame, path: str, split: str = "split") -> int:
    """Writes what differs from the current version as a new one; returns its number, or that of the current
    version if nothing differs. A null split is refused: a partition could not tell it from a name."""
    spark = calls.sparkSession
    now = _current(spark, path)
    old = _manifest(spark, path, now)
    found = digests(calls, split)
    if None in found:
        raise ValueError("every row needs a split")
    same = {s for s, (n, d) in found.items() if s in old["splits"] and old["splits"][s]["digest"] == d and old["splits"][s]["rows"] == n and old["types"] == calls.schema.simpleString()}
    if same == set(found) == set(old["splits"]) and now:
        return now
    version = now + 1
    while storage.exists(spark, f"{path}/manifests/{version}.json"):  # after a restore later versions stay
        version += 1
    changed = sorted(set(found) - same)
    if changed:
        calls.where(F.col(split).isin(changed)).repartition(split, F.xxhash64(*[c for c in calls.columns if c != split]) % 64).write.mode("overwrite").partitionBy(split).parquet(f"{path}/data/version={version}")
    splits = {s: {"rows": n, "digest": d, "version": old["splits"][s]["version"] if s in same else version} for s, (n, d) in sorted(found.items())}
    storage.write_text(spark, f"{path}/manifests/{version}.json", json.dumps({"schema": calls.schema.json(), "types": calls.schema.simpleString(), "split": split, "splits": splits}))
    storage.write_text(spark, f"{path}/CURRENT", str(version))
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the current one by default), with the ``version`` that wrote each split. Filters
    on the split leave other splits' files unread."""
    version = _current(spark, path) if version is None else version
    m = _manifest(spark, path, version)
    if not m["splits"]:
        raise ValueError(f"no version {version} at {path}")
    from pyspark.sql.types import IntegerType, StructType

    schema = StructType.fromJson(json.loads(m["schema"]))
    named = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path}/data/version={x['version']}/{m['split']}={named(s)}" for s, x in m["splits"].items()]
    return spark.read.schema(StructType([*schema.fields]).add("version", IntegerType())).option("basePath", f"{path}/data").parquet(*folders)


def restore(spark: SparkSession, path: str, version: int) -> None:
    """Makes an old version the current one."""
    if not storage.exists(spark, f"{path}/manifests/{version}.json"):
        raise ValueError(f"no version {version} at {path}")
    storage.write_text(spark, f"{path}/CURRENT", str(version))
