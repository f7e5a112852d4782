import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelwarrant.llm import token_store
from pixelwarrant.llm.queries import op4_token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(PATH)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def test_ranges_cover_all_ids():
    assert len(token_store.SIZES) == 64 and token_store.RANGES[-1] == 65536 and (token_store.SIZES > 0).all() and len(token_store.OF) == 65536


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=300), st.integers(1, 40))
def test_round_trip_of_any_ids(ids, times):
    ids = np.array(ids * times, np.int64)
    assert (token_store.decompress(*token_store.compress(ids), len(ids)) == ids).all()


def test_round_trip_of_many_blocks_and_damage():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50257, 300)
    ids = np.concatenate([words[np.minimum(rng.zipf(1.3, 20_000), 300) - 1], np.full(9_000, 7), rng.integers(0, 65536, 5_001)])
    payload, sizes, checks = token_store.compress(ids)
    assert (token_store.decompress(payload, sizes, checks, len(ids)) == ids).all()
    assert len(token_store.compress(np.full(4096 * 3, 7))[0]) < 600  # what repeats costs next to nothing
    # Blocks stand alone: the second one is read without the others.
    one = token_store.decompress(payload[sizes[0] : sizes[0] + sizes[1]], sizes[1:2], checks[1:2], token_store.BLOCK)
    assert (one == ids[token_store.BLOCK : 2 * token_store.BLOCK]).all()
    broken = bytearray(payload)
    broken[100] ^= 1
    with pytest.raises(ValueError):
        token_store.decompress(bytes(broken), sizes, checks, len(ids))
    with pytest.raises(ValueError):
        token_store.decompress(payload[:-2], sizes, checks, len(ids))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,'\n\t\r  é漢1", max_size=40))
def test_cutting_changes_no_ids(plain, text):
    own = token_store.tokenizer(PATH)
    assert np.frombuffer(own([text])[0], "<u2").tolist() == plain(text)


def test_tasks_of_a_process_share_a_tokenizer(plain, monkeypatch):
    own = token_store.tokenizer(PATH)
    assert token_store.tokenizer(PATH) is own
    monkeypatch.setattr(token_store, "MEMO", 5)  # what is remembered is given up, ids stay the same
    texts = ["one two three four five six seven", "eight nine ten", "one nine"] * 2
    assert [np.frombuffer(b, "<u2").tolist() for b in own(texts)] == [plain(t) for t in texts]


def expected(rows, plain):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*plain(text or ""), 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf, plain):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op4_token_store(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(rows, plain)


def test_edges_and_segments(spark, plain, monkeypatch):
    rows = [(None, "first"), (1, None), (2, ""), (3, "a b\nc"), (5, "x y " * 3000), (7, "<|endoftext|>"), (9, " \t ")]
    df = spark.createDataFrame([(i, t, 5) for i, t in reversed(rows)], "doc_id long, text string, start int").repartition(3)
    folder = token_store.new_folder(spark)
    token_store.write(df, folder, PATH)
    got = sorted((tuple(r) for r in token_store.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(rows, plain)
    twice = token_store.new_folder(spark)
    token_store.write(df.union(df), twice, PATH)
    assert token_store.read(spark, twice).count() == 2 * len(rows)
    none = token_store.new_folder(spark)
    token_store.write(df.limit(0), none, PATH)
    assert token_store.read(spark, none).count() == 0
