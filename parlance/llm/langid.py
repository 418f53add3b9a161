"""Language identification with string kernels.

A text is the set of its byte n-grams of lengths 2 to 4 (lower-case A-Z; what is no letter is a
space) together with its single bytes, each length hashed to a space of its own. The blended-spectrum
presence kernel counts the n-grams that two texts share, over the geometric mean of their numbers.
Nyström: the kernel against ``landmarks`` texts, times the inverse root of the landmarks' own kernel
matrix, stands for the text; one-versus-rest kernel ridge regression is ridge regression there. A
block of texts is scored by two matrix products, bits by landmarks and kernels by weights.

Fitted on a bounded sample: about ``fit_per_language`` labelled rows of each language, and of many
languages ``fit_rows`` in all, chosen by a hash of id and text against the language's row count, so nothing
is sorted, no language can crowd out another and an id that many rows share can't either; rows of equal
n-grams teach once. Of more than ``fit_languages`` values of lang the most frequent ones are learned. Only
packed bits (about 3 kB a row) reach the driver, and every language has a landmark of its own.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no
row was labelled; a null lang teaches nothing; of equal scores the first language by code point wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import fold_is, stage, unit_hash

UND = "und"
LANDMARKS = 96
FIT_PER_LANGUAGE = 600
#: Rows in all, and languages, that one model learns.
FIT_ROWS = 4800
FIT_LANGUAGES = 512
RIDGE = 1e-2
_BITS = 13
_ORDERS = (2, 3, 4)
WIDTH = 256 + len(_ORDERS) * (1 << _BITS)
_SHARP = 2.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case letters and bytes of other characters stay; everything else is a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for base in (0x41, 0x61):
        table[base : base + 26] = np.arange(0x61, 0x7B)
    return table


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint8 [documents, WIDTH]: which hashed n-grams each text has."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.uint8)
    if not len(data):
        return out
    held = _letters()[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    flat, row = out.ravel(), doc * WIDTH
    flat[row + held] = 1
    code = held.copy()
    for k, order in enumerate(_ORDERS):
        m = len(held) - order + 1
        if m < 1:
            break
        code = code[:m] << np.uint32(8) | held[order - 1 :]
        within = np.flatnonzero(doc[:m] == doc[order - 1 :])
        bucket = (code[within] * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        flat[row[within] + 256 + (k << _BITS) + bucket] = 1
    out[:, 0x20] = 0
    return out


def _roots(bits: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)


class Model:
    """Landmark bits (float32, transposed, over the root of their number) and weights by language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def scores(self, bits: np.ndarray) -> np.ndarray:
        kernel = (bits.astype(np.float32) @ self.landmarks) / _roots(bits)[:, None]
        return kernel @ self.weights


def _kernel(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The kernel of texts with landmarks, some texts at a time."""
    return np.concatenate([(bits[k : k + 256].astype(np.float32) @ marks) / _roots(bits[k : k + 256])[:, None] for k in range(0, len(bits), 256)])


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on a Nyström map; rows come in an order that only hashes decide. Each
    language has a landmark at least, so of more languages than ``landmarks`` there are as many."""
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    landmarks = max(landmarks, len(languages))
    turn = np.zeros(len(y), np.int64)  # the languages' rows take turns as landmarks
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort([y, turn])[:landmarks]
    marks = (bits[chosen].astype(np.float32) / _roots(bits[chosen])[:, None]).T.copy()
    kernel = _kernel(bits, marks)
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel @ root])
    balance = np.array([len(y) / (len(languages) * (y == k).sum()) for k in range(len(languages))])[y]
    goal = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = (phi * balance[:, None]).T @ phi
    w = np.linalg.solve(gram + ridge * len(y) / len(languages) * np.eye(phi.shape[1]), (phi * balance[:, None]).T @ goal)
    return Model(languages, marks, (root @ w).astype(np.float32))


def _packed(batches):
    for block in tb.blocks(batches, "text"):
        for k in range(0, block.num_rows, 128):
            some = block.slice(k, 128)
            bits = np.packbits(presence(*tb.utf8(some.column(1))), axis=1)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), some.column(2)], names=["label", "bits", "at"])


def train(docs: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_per_language: int = FIT_PER_LANGUAGE, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS, fit_languages: int = FIT_LANGUAGES) -> Model | None:
    """A model of the labelled rows that ``usable`` admits; None if there are none."""
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("label"), F.col(text).alias("text"), unit_hash(11, doc_id, text).alias("at"))
    counts = known.groupBy("label").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    counts = stage(counts.orderBy(F.desc("n"), "label").limit(fit_languages), "languages")  # a row for each language
    languages = counts.count()
    if not languages:
        return None
    fit_per_language = min(fit_per_language, fit_rows / languages)
    # of a language of few rows at least the one of the least hash teaches
    sample = known.join(counts, "label").where((F.col("at") < F.lit(float(fit_per_language)) / F.col("n")) | (F.col("at") == F.col("least")))
    found = sample.select("label", "text", "at").mapInArrow(_packed, "label string, bits binary, at double")
    rows = found.groupBy("label", "bits").agg(F.min("at").alias("at")).select("label", "bits", "at").toArrow()
    rows = rows.take(pc.sort_indices(rows, [("at", "ascending"), ("bits", "ascending")]))
    bits = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)
    return fit(bits[:, :WIDTH], rows["label"].to_pylist(), landmarks)


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score, called ``names``, to the ``keep`` columns (all by default)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    cast = spark.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        for block in tb.blocks(batches, -1):
            column = block.column(block.num_columns - 1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            found = np.full(block.num_rows, UND, object)
            score = np.zeros(block.num_rows)
            rows = np.flatnonzero(lettered)
            for k in range(0, len(rows) if m else 0, 64):
                some = rows[k : k + 64]
                f = m.scores(presence(*tb.utf8(column.take(pa.array(some)))))
                best = f.argmax(axis=1)
                found[some] = np.array(m.languages, object)[best]
                score[some] = 1 / np.exp(_SHARP * (f - f.max(axis=1, keepdims=True)).astype(np.float64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(found, pa.string()), pa.array(score)], names=[*block.schema.names[:-1], *names])

    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return slim.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold_is("doc_id", 4, 2)
    model = train(docs, F.col("doc_id").isNotNull() & ~held)
    return predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
