"""The corpus pipeline: five stages, each one operator of ``parlance.llm`` on all that its
predecessor kept.

1. language: documents without a letter of any script (and null texts) go, and those whose text is surely
   (``SURE``) in another language than their own lang says; all others stay.
2. near_duplicates: of each group of SimHash near copies (fingerprints that differ in ``RADIUS`` bits or
   fewer) one row stays, that of the least doc_id (a null id only where no row of the group has one; of
   rows that share the least id, one).
3. decontaminate: documents with an occurring benchmark window go.
4. mix: sources are mixed to their target weights; a document that the mix holds twice is two rows.
5. records: what is left is encoded, written as binary records in ascending doc_id order and read
   back; the result has a row for each record.

Rows that share a doc_id share its fate in stages 3 and 4. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, langid, mixing, records, simhash
from parlance.llm.shared import stage

#: One bit more than op9's contract: three bits in 64 still tell unlike texts apart, and catch more near copies.
RADIUS = 3
#: The score from which on a language that contradicts a document's own lang counts. Short texts of any
#: language score lower, so an unclear text never goes for its language.
SURE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and does not contradict their lang. A lang that is null or was not
    learned contradicts nothing. Rows stay with their verdict in one pass: no join."""
    model = langid.train(docs, F.lit(True))
    if model is None:  # nothing to learn from: the letters alone decide
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, names=("__lang", "__sure"))
    learned = F.coalesce(F.col("lang").isin(model.languages), F.lit(False))
    contradicted = learned & (F.col("__lang") != F.col("lang")) & (F.col("__sure") >= SURE)
    return found.where((F.col("__lang") != langid.UND) & ~contradicted).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one stage whose verdict needs other rows than the document's own. Verdicts grow with the
    documents, so they are never broadcast: both sides are dealt by a staged row key, alike at every size."""
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_duplicates(rows, doc_id="__row", radius=RADIUS).withColumnRenamed("doc_id", "__row")
    named = rows.select("__row", F.col("doc_id").alias("id")).join(found, "__row")
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "fp", "__row"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them."""
    return mixing.mixed_rows(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that also ran the other stages keep fewer pieces
    return records.encoded(docs, held=1 << 17)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("records", token_records),
]

#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name, instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
