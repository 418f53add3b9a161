import random

import pytest

WORDS = "the of and idiot über façade naïve one two three four five six seven eight nine ten Alpha BETA x1 end. a-b 日本 ß".split()


def make_docs(n: int, seed: int = 0) -> list[tuple]:
    """Rows of documents with nulls, empty and long texts, copies, near copies, and a hot source."""
    rng = random.Random(seed)
    rows, texts = [], []
    for k in range(n):
        text = "\n ".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        if k % 11 == 3 and texts:
            text = rng.choice(texts)
        if k % 13 == 5 and texts:
            text = rng.choice(texts) + " end."
        texts.append(text)
        rows.append((k * 3, text, rng.choice(["en", "fr", None]), "hot" if k % 3 == 0 else rng.choice(["b", "c", "Z", None]), len(text)))
    rows += [(n * 3, None, "en", "b", None), (n * 3 + 1, "", None, "hot", 0), (n * 3 + 2, " \t\n ", "en", "c", 4), (n * 3 + 3, "9 7 !", "en", "c", 5), (n * 3 + 4, "long word " * 5000, "en", "c", 50000)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(120), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
