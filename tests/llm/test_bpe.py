import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from pixelwarrant.llm import bpe
from pixelwarrant.llm.queries import op1_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def twin(codec):
    ranks = {t: i for i, t in enumerate(codec[0])}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect(codec):
    tokens, steer, slots, _ = codec
    find = bpe.finder(tokens, steer, slots)
    assert sorted(slots) == list(range(len(tokens)))
    assert [find(t) for t in tokens] == list(range(len(tokens)))
    assert find(b"no such token, surely") == -1


def test_ids_equal_the_public_encoder(codec, twin):
    one, rng = bpe.encoder(*codec), random.Random(5)
    letters = "abz  \n\t'sé1,.!　漢字\r ZZ\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["<|endoftext|>", "don't we'll", "x" * 5000, "ab" * 20000 + "q", " " * 999, "a\n\nb \n c", "\n", " ", "a ", "\na"]
    assert [one(t) for t in texts] == [twin.encode_ordinary(t) for t in texts]


def test_edge_rows(spark):
    rows = [Row(doc_id=1, text=None, n_tokens="x"), Row(doc_id=None, text="", n_tokens="y"), Row(doc_id=2, text="a b", n_tokens=None), Row(doc_id=2, text="a b", n_tokens=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, PATH, PATTERN).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got] == [0, 0, 2, 2]
    assert got[0].ids_sha256 == got[1].decoded_sha256 == empty
    both = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded) for r in both) == [b"", b"", b"a b", b"a b"]
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_query_against_the_public_encoder(spark, sf, twin):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_byte_bpe(spark, sf).collect():
        ids = twin.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
