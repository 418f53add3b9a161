"""Token ids as length-delimited binary records, with an offset index beside them.

A file is a run of records, in ascending doc_id order within a file and from file to file::

    uint64  n           bytes of the payload
    uint32  masked crc32 of those eight bytes
    payload int64 doc_id, uint8 id_is_null, then the ids as uint16 (vocabularies to 65,536) or uint32
    uint32  masked crc32 of the payload
    byte    0x0A

all little-endian; a masked checksum is ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32. The offset
index is a Parquet table (file, offset, n_bytes, doc_id, start, n_tokens, ids_crc32): with it a
reader takes records in any order. Files are written and read by Spark's own writers and readers
(each record is one "line" of the text writer, whose separator ends it), so any store that Spark
reaches will do and a lost executor's files are written anew by the committer.

One shuffle deals the texts to ranges of ids; the number of ranges follows the texts' bytes, which
are counted first. Defined cases: a null text is empty; every document ends with ``end_id``; null ids
sort first; rows that share an id follow each other by a hash of their text.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import dealt_by_id, fresh_path, stage
from .tokenize import HELD, encoder, tokenizer_path

END = 2
#: Text bytes in a file.
FILE_BYTES = 24 << 20
_READ = 1 << 20
_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_OWN = struct.Struct("<qB")
_CRC = struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its final 0x0A."""
    payload = _OWN.pack(doc_id or 0, doc_id is None) + ids
    n = struct.pack("<Q", len(payload))
    return b"".join((n, _CRC.pack(masked(n)), payload, _CRC.pack(masked(payload))))


def parse(data) -> list[tuple[int, int, int | None, memoryview]]:
    """(offset, bytes, doc_id, ids) of each record of a file; ValueError where a checksum fails."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        n, crc = _HEAD.unpack_from(view, at)
        if masked(view[at : at + 8]) != crc:
            raise ValueError(f"the length at byte {at} is damaged")
        payload = view[at + 12 : at + 12 + n]
        if len(payload) != n or masked(payload) != _CRC.unpack_from(view, at + 12 + n)[0]:
            raise ValueError(f"the record at byte {at} is damaged")
        doc_id, absent = _OWN.unpack_from(payload)
        out.append((at, n + 17, None if absent else doc_id, payload[_OWN.size :]))
        at += n + 17
    return out


def write_records(docs: DataFrame, path: str, *, tokenizer: str | None = None, kind: str = "H", end_id: int = END, doc_id: str = "doc_id", text: str = "text", files: int | None = None, held: int = HELD) -> None:
    """Encode whole texts and write the record files to ``path``/records and the index to
    ``path``/index."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u2" if kind == "H" else "<u4").tobytes()

    def encode(batches):
        e = encoder(tokenizer, kind, held)
        for block in tb.blocks(batches, "text", 1 << 20):
            rows = zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([frame(i, e.encode(t) + end) for i, t in rows], pa.binary())], names=["record"])

    dealt_by_id(docs, doc_id, text, FILE_BYTES, files).mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    _index(spark, f"{path}/records", kind).write.parquet(f"{path}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")


def _index(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The index as read from the files: ``start`` still counts from the file's own beginning."""
    width = 2 if kind == "H" else 4

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py()
                found = parse(batch.column(1)[k].as_buffer())
                n = np.array([len(x[3]) // width for x in found], np.int64)
                crc = [zlib.crc32(np.frombuffer(x[3], f"<u{width}").astype("<u4")) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["file", "offset", "n_bytes", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return _files(spark, folder).mapInArrow(read, "file string, offset long, n_bytes long, doc_id long, start long, n_tokens long, ids_crc32 long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, with ``start`` counted over all files, which are numbered as their ids run."""
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_shuffled(spark: SparkSession, path: str, seed: int, kind: str = "H") -> DataFrame:
    """(place, doc_id, ids) of all records, taken by the index's offsets; ``place`` orders them anew
    for each seed. Payloads move once, as they lie in the files, and become arrays where they end."""
    where = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "n_bytes"))).alias("at"))
    kind = "<u2" if kind == "H" else "<u4"

    def take(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file, view = batch.column(0)[k].as_py(), memoryview(batch.column(1)[k].as_buffer())
                places = batch.column(2)[k].values
                offsets, sizes = places.field("offset").to_numpy(), places.field("n_bytes").to_numpy()
                ends = np.cumsum(sizes)
                at = 0
                while at < len(offsets):
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _READ, "left")))
                    found = [parse(view[o : o + n])[0] for o, n in zip(offsets[at:upto].tolist(), sizes[at:upto].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * (upto - at), pa.string()), pa.array(offsets[at:upto]), pa.array([x[2] for x in found], pa.int64()), pa.array([bytes(x[3]) for x in found], pa.binary())], names=["file", "offset", "doc_id", "ids"]
                    )
                    at = upto

    def unpack(batches):
        for block in tb.blocks(batches, "ids", _READ):
            data, offsets = tb.utf8(block.column(2))
            ids = pa.array(data.view(kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.ListArray.from_arrays(pa.array((offsets // np.dtype(kind).itemsize).astype(np.int32)), ids)], names=["place", "doc_id", "ids"])

    rows = _files(spark, f"{path}/records").join(where, "file").mapInArrow(take, "file string, offset long, doc_id long, ids binary")
    placed = rows.select(F.xxhash64("file", "offset", F.lit(seed)).alias("place"), "doc_id", "ids").orderBy("place")
    return placed.mapInArrow(unpack, "place long, doc_id long, ids array<int>")


def encoded(docs: DataFrame, **how) -> DataFrame:
    """Write the files into the shared folder and return (doc_id, start, n_tokens, ids_crc32) of each
    document as read back from them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_records(docs, path, **how)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def lengths(docs: DataFrame, *, tokenizer: str | None = None, kind: str = "H", end_tokens: int = 0, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Counted by task first."""
    tokenizer, width = tokenizer or tokenizer_path(), 2 if kind == "H" else 4

    def count(batches):
        e, seen = encoder(tokenizer, kind), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for block in tb.blocks(batches, "text", 1 << 20):
            n = np.array([len(e.encode(t)) // width + end_tokens for t in block.column(0).to_pylist()], np.int64)
            more = tb.counted(n)
            seen = tb.counted(*(np.concatenate(x) for x in zip(seen, more, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen], names=["n_tokens", "n_docs"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_histogram(docs: DataFrame, *, block: int = 128, **how) -> DataFrame:
    """The exact length histogram with its suffix sums, from which any context limit is answered.

    Columns: n_tokens, n_docs, tokens (of these documents), docs_at_least and tokens_at_least (of
    documents this long or longer), docs_below, truncated_tokens (what all documents keep when each
    is cut to n_tokens), and quantile (share of documents of this length or less). Sums run in two
    steps, over blocks of ``block`` lengths and within each, so no task holds all lengths. A null or
    empty text has the length of its end tokens, ``end_tokens`` (one in the query op10, none by default);
    an empty table gives no rows.
    """
    h = stage(lengths(docs, **how), "lengths").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("all_t"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(after, "block").withColumn("docs_at_least", F.col("d") + F.sum("n_docs").over(within)).withColumn("tokens_at_least", F.col("t") + F.sum("tokens").over(within))
    below = F.col("all_d") - F.col("docs_at_least")
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", below.alias("docs_below"),
        (F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((below + F.col("n_docs")) / F.col("all_d")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, truncated_docs, truncated_tokens, lost_tokens) of each context limit, in one pass
    over the histogram."""
    over = [F.greatest(F.col("n_tokens") - int(x), F.lit(0)) for x in limits]
    sums = [f for x in over for f in (F.sum(F.when(x > 0, F.col("n_docs")).otherwise(0)), F.sum(x * F.col("n_docs")))]
    row = histogram.agg(F.sum("tokens"), *sums).first()
    total = row[0] or 0
    rows = [(int(x), row[2 * k + 1] or 0, total - (row[2 * k + 2] or 0), row[2 * k + 2] or 0) for k, x in enumerate(limits)]
    return histogram.sparkSession.createDataFrame(rows, "context long, truncated_docs long, truncated_tokens long, lost_tokens long")


def op4(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10(spark, sf_dir: str) -> DataFrame:
    return length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), end_tokens=1)
