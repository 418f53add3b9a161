"""Readers of transcripts, manifests and calls. All are Spark sources, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import CALL


def read_calls(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Call JSON, one document a file or a line; unknown fields are dropped. With files laid out by
    ``split=`` folders the filter prunes folders."""
    df = spark.read.schema(CALL).option("multiLine", True).json(path)
    return df if split is None else df.where(F.col("split") == split)


def write_calls(calls: DataFrame, path: str) -> None:
    """Calls as JSON by split, in place of what was there."""
    calls.write.mode("overwrite").partitionBy("split").json(path)


def kaldi_lines(lines: DataFrame, line: str = "value", place: str = "place") -> DataFrame:
    """(uid, text) of lines ``uid<blank>text``; lines without both are dropped, the last uid counts."""
    parsed = lines.select(F.regexp_extract(line, r"^(\S+)[\t ]+(.*\S)\s*$", 1).alias("uid"), F.regexp_extract(line, r"^(\S+)[\t ]+(.*\S)\s*$", 2).alias("text"), place).where("uid <> ''")
    return parsed.groupBy("uid").agg(F.max_by("text", place).alias("text"))


def read_kaldi(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"))
    return kaldi_lines(lines)


def metadata_rows(table: DataFrame, key: str) -> DataFrame:
    """(key, meta): a row's other columns as a map, without empty and "NA" values."""
    cells = [x for c in table.columns if c != key for x in (F.lit(c), F.col(c).cast("string"))]
    return table.select(key, F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull() & (v != "") & (v != "NA")).alias("meta"))


def read_metadata(spark: SparkSession, path: str, key: str) -> DataFrame:
    return metadata_rows(spark.read.option("header", True).option("sep", "\t").csv(path), key)


def spoken_rows(rows: DataFrame, text: str = "text", language: str = "language", least: int = 4) -> DataFrame:
    """Rows of ``least`` words or more; a missing language is ``en``."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return rows.where(words >= least).withColumn(language, F.coalesce(F.when(F.col(language) != "", F.col(language)), F.lit("en")))


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def sidecar_stem(path: Column) -> Column:
    """A recording's stem without the suffixes of its channel versions."""
    return F.regexp_replace(stem(path), r"(_(clean|ulaw|alaw|gsm|amr|noisy))+$", "")


def by_stem(rows: DataFrame, files: DataFrame, path: str = "path", file: str = "path") -> DataFrame:
    """Rows joined with files of the same stem; without any rows, the files alone."""
    r = rows.withColumn("stem", stem(F.col(path)))
    f = files.select(stem(F.col(file)).alias("stem"), F.col(file).alias("audio_path"))
    none = r.select(F.lit(1).alias("__some")).limit(1)  # one row if there is any
    alone = f.join(none, F.lit(True), "left_anti")
    return r.join(f, "stem").unionByName(alone, allowMissingColumns=True)


def sidecar_candidates(path: Column, calls: str) -> list[Column]:
    """Where a recording's call file may lie, in order: beside it, in ``calls`` below its folder or the
    folder above, and in the given folder, each by its own stem, then by that without channel suffixes."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    places = (folder, F.concat(folder, F.lit("/calls")), F.concat(F.regexp_replace(folder, "/[^/]*$", ""), F.lit("/calls")), F.lit(calls))
    return [F.concat(place, F.lit("/"), s, F.lit(".json")) for s in (stem(path), sidecar_stem(path)) for place in places]


def utterances(files: DataFrame, texts: DataFrame, meta: DataFrame, shortest: float = 1.5, longest: float = 20.0) -> DataFrame:
    """(uid, seconds, text, meta, speaker) of files with their transcripts and metadata where there are
    any; the speaker is the uid's first two dash-parts."""
    held = files.where(F.col("seconds").between(shortest, longest))
    return held.join(texts, "uid", "left").join(meta, "uid", "left").withColumn("speaker", F.substring_index("uid", "-", 2))


def first_existing(wanted: DataFrame, listing: DataFrame, candidates: list[Column], key: str) -> DataFrame:
    """(key, path): of a row's candidate paths the first that the listing holds, else null."""
    asked = wanted.select(key, F.posexplode(F.array(*candidates)).alias("__k", "path"))
    found = asked.join(listing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "__k").alias("path"))
    return wanted.select(key).join(found, key, "left")


NO_TRANSCRIPT = "(no transcript supplied)"
_ROLE = r"^([^:]{1,11}):(.*)$"


def manual_turns(texts: DataFrame, key: str, text: str, callees: tuple[str, ...] = ("callee", "victim", "user"), callers: tuple[str, ...] = ("caller", "agent"), seconds: str | None = None) -> DataFrame:
    """(key, turn_index, speaker, text, t_start, t_end) of pasted transcripts: a turn for each line that
    is not blank, with an optional ``role:`` in its first twelve characters.

    Without ``seconds`` a turn lasts 1 + 0.3 for each token, with gaps of 0.3; with it turns share the
    time equally, and a text without a line is one turn that says so.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    if seconds:
        lines = F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, lines).otherwise(F.array(F.lit(NO_TRANSCRIPT)))
    t = texts.select(key, *([seconds] if seconds else []), F.posexplode(lines).alias("turn_index", "line"), F.size(lines).alias("__n"))
    role = F.lower(F.trim(F.regexp_extract("line", _ROLE, 1)))
    known = role.isin(*callees, *callers)
    t = t.withColumn("speaker", F.when(role.isin(*callees), "callee").otherwise("caller")).withColumn("text", F.when(known, F.trim(F.regexp_extract("line", _ROLE, 2))).otherwise(F.col("line")))
    if seconds:
        step = F.col(seconds) / F.col("__n")
        return t.select(key, "turn_index", "speaker", "text", (F.col("turn_index") * step).alias("t_start"), ((F.col("turn_index") + 1) * step).alias("t_end"))
    w = Window.partitionBy(key).orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    length = 1.0 + 0.3 * F.size(tokens("text"))
    t = t.withColumn("__len", length).withColumn("t_end", F.sum("__len").over(w) + 0.3 * F.col("turn_index"))
    return t.select(key, "turn_index", "speaker", "text", (F.col("t_end") - F.col("__len")).alias("t_start"), "t_end")
