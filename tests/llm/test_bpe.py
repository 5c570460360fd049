import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


TEXTS = [
    None, "", " ", "  ", "\n\n a", "Hello world's  it'll 12345 !!!", "aaaaaaaaaaaaaaaaaaaaaaa", "ab" * 5000, "x" * 20_001, "日本語テキスト ñandú straße",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "\x1c\x1d a\x85b\xa0c\u2003d\u200be", "I'M can'T don't", "٣٤ ½ ²³ Ⅷ 一二", "e\u0301 👩‍👩‍👧 \U0001f600" * 3, "\t\tif x:\r\n\t\treturn", "\x00\x01\x7f",
]


def same(library, vocabulary, texts):
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = vocabulary.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert vocabulary.decode(got) == [library.decode(x, skip_special_tokens=False) for x in want] == [t or "" for t in texts]


def test_texts(library, vocabulary):
    same(library, vocabulary, TEXTS)


def test_random(library, vocabulary):
    rng = np.random.default_rng(8)
    letters = list("abcdefghij ABC \n'123é日!.  ")
    same(library, vocabulary, ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(300)])
    same(library, vocabulary, ["".join(rng.choice(list("abcxyz0123456789"), 6000))])


def test_every_character(library, vocabulary):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    bad = [t for t, x in zip(texts, vocabulary.encode(texts)) if np.frombuffer(x, "<u4").tolist() != library.encode(t, add_special_tokens=False).ids]
    assert not bad


def test_partial_characters_decode_alike(library, vocabulary):
    ids = np.random.default_rng(9).integers(0, 50257, (200, 12)).astype("<u4")
    assert vocabulary.decode([x.tobytes() for x in ids]) == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids]


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, vocabulary):
    df = spark.createDataFrame([(None, None, "n"), (1, "", "n"), (1, "a b", "n"), (1, "a b", None)], "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert sorted(r.decoded for r in got) == ["", "", "a b", "a b"] and len(got[0]) == 5
    assert bpe.encode(df.limit(0), vocabulary).collect() == []
