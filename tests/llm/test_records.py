import random
import zlib

import numpy as np
import pytest

from parlance.llm import records
from parlance.llm.tokenize import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Encoder(tokenizer_path())


def test_pieces_give_the_library_s_ids(library):
    rng = random.Random(1)
    texts = ["a  b", "a   b ", " a b", "\n b", "a \n b", " ", "it's  '' 's", "\0x \0", "x\xa0 b \xa0 c", "<|endoftext|> a", "1 2  3\t 4", "日本 語 x", "\x1c a \x85b"]
    texts += ["".join(rng.choice(" \n\t'a'sBzé9½.,!ñÑ\x85\xa0\x1c\x1fß日́ªº ") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert [library.encode(t) for t in texts] == library.exact(texts)


def test_added_tokens_as_the_plain_library_has_them(spark, library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z ", "日本<|endoftext|><|endoftext|> a", "<|endoftext| >", "no such token"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(library.encode(t), "<u2").tolist() for t in texts] == want
    got = records.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), files=2).collect()
    assert [(r.n_tokens, r.ids_crc32) for r in sorted(got)] == [(len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x in want]
    lengths = records.lengths(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(n for r in lengths.collect() for n in [r.n_tokens] * r.n_docs) == sorted(map(len, want))


def test_another_vocabulary(spark):
    """A file that asks for another cutting is left to the library."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello  World, it's 42", "a<|endoftext|>b", "Ünïcode 日本", "", "x" * 50]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kind in "HI":
        got = sorted(records.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path, kind=kind, files=2).collect())
        assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x in want]
        found = records.lengths(spark.createDataFrame([(t,) for t in texts], "text string"), tokenizer=path, kind=kind)
        assert sorted(n for r in found.collect() for n in [r.n_tokens] * r.n_docs) == sorted(map(len, want))


def test_round_trip_and_order(spark, docs, library):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = [], 0
    for (doc_id, text), ids in zip(rows, library.exact([t for _, t in rows]), strict=True):
        ids = np.append(np.frombuffer(ids, "<u2"), 2).astype("<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in records.encoded(docs, files=4).collect())
    assert got == want


def test_shuffled_read_by_index(spark, docs, tmp_path, library):
    path = f"file://{tmp_path}/t"
    records.write_records(docs, path, files=3)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    a, b = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, path, seed).collect()] for seed in (1, 2))
    assert a != b and sorted(a) == sorted(b)
    for doc_id, ids in a[:40]:
        assert np.array(ids[:-1], "<u2").tobytes() == library.exact([texts[doc_id]])[0] and ids[-1] == 2


def test_damage_is_found():
    data = bytearray(records.frame(7, b"\x01\x00\x02\x00") + b"\n" + records.frame(None, b"") + b"\n")
    assert [(x[2], bytes(x[3])) for x in records.parse(data)] == [(7, b"\x01\x00\x02\x00"), (None, b"")]
    data[22] ^= 1
    with pytest.raises(ValueError):
        records.parse(data)


def test_histogram_against_brute_force(spark, docs, no_docs, library):
    n = [len(x) // 2 + 1 for x in library.exact([r.text or "" for r in docs.collect()])]
    got = {r.n_tokens: r for r in records.length_histogram(docs, end_tokens=1, block=16).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert r.n_docs == n.count(k) and r.docs_at_least == sum(x >= k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in n) and r.docs_below == sum(x < k for x in n)
    limits = [1, 7, 50, 10**6]
    for r in records.at_limits(records.length_histogram(docs, end_tokens=1), limits).collect():
        assert (r.truncated_docs, r.truncated_tokens) == (sum(x > r.context for x in n), sum(min(x, r.context) for x in n))
    assert records.length_histogram(no_docs).count() == 0 and records.encoded(no_docs).count() == 0
