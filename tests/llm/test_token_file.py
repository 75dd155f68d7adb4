import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries, token_file

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 49_407), st.integers(0, 2**32 - 1)), max_size=1200))
def test_ids_come_back(ids):
    assert token_file.decode_ids(token_file.encode_ids(np.array(ids, np.int64))).tolist() == ids


def test_repetition_is_coded_shortly_and_damage_is_seen():
    ids = np.tile(np.arange(40), 2000)
    data = token_file.encode_ids(ids)
    assert len(data) < len(ids) and (token_file.decode_ids(data) == ids).all()
    assert len(token_file.encode_ids(ids)) < len(ids) / 8  # followers of one and of two ids hold
    bad = bytearray(data)
    bad[-400] ^= 64
    with pytest.raises(ValueError):
        token_file.decode_ids(bytes(bad))


def order_0_bytes(ids):
    """Length of the block-wise adaptive code of single ids, with an escape and 16 bits for a new id, by plain counting."""
    bits = 0.0
    for begin in range(0, len(ids), token_file.BLOCK):
        counts = {}
        for t, x in enumerate(ids[begin : begin + token_file.BLOCK].tolist()):
            if x in counts:
                bits -= math.log2((2 * counts[x] - 1) / (2 * t))
            else:
                bits += 16 - (math.log2(len(counts) / (2 * t)) if t else 0)
            counts[x] = counts.get(x, 0) + 1
    return bits / 8


def test_real_ids_take_little_more_than_a_byte():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks().fill_null("")
    found, sizes = token_file.tokens(PATH).encode(texts)
    ids = np.insert(found, np.cumsum(sizes), 1)
    data = token_file.encode_ids(ids)
    assert len(data) < 1.10 * len(ids) and len(data) < order_0_bytes(ids)
    assert (token_file.decode_ids(data) == ids).all()


@pytest.mark.parametrize("ids", [[7] * 9000, [1, 2] * 4096, [*range(4096)] * 2, [5] * 4095 + [6], [3, *[4] * 4095]])
def test_shares_at_their_limits(ids):
    assert token_file.decode_ids(token_file.encode_ids(np.array(ids))).tolist() == ids


def test_parts_have_a_least_size(spark, tmp_path):
    """With many shuffle partitions, texts are not dealt over more of them than hold a quarter of a part."""
    docs = spark.range(0, 3000, 1, 4).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 200) AS text")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions may be joined
    try:
        token_file.write(docs, PATH, str(tmp_path / "ids"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert spark.read.parquet(str(tmp_path / "ids")).count() <= 1 + 200 * 3000 * 9 // (token_file.PART >> 2)


PIECES = st.text(alphabet="abcdeinrstthéàüß0123'.,!-", min_size=1, max_size=24)


@settings(max_examples=40, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=80))
def test_words_side_by_side_have_the_library_s_ids(words):
    tokens = token_file.tokens(PATH)
    found, sizes = tokens.encode(pa.array([" ".join(words), *words]))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in (" ".join(words), *words)]
    assert found.tolist() == sum(want, []) and sizes.tolist() == [*map(len, want)]


def test_a_context_predicts_only_its_own_followers():
    rng = np.random.default_rng(7)
    follows = rng.permutation(3000)
    ids = [0]
    for _ in range(3 * token_file.BLOCK):  # mostly one follower of each id, new contexts all the time
        ids.append(int(follows[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(3000)))
    data = token_file.encode_ids(np.array(ids))
    assert token_file.decode_ids(data).tolist() == ids and len(data) < order_0_bytes(np.array(ids))


@pytest.mark.parametrize("n", [1, 2, token_file.BLOCK - 1, token_file.BLOCK, token_file.BLOCK + 1])
@pytest.mark.parametrize("top", [1, 1 << 16, 1 << 17, 1 << 32])
def test_blocks_of_new_ids(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    assert (token_file.decode_ids(token_file.encode_ids(ids)) == ids).all()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAbH.,'s \n1é<|endoftx>̱İ", max_size=60)))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    found, sizes = token_file.tokens(PATH).encode(pa.array([text]))
    assert found.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(found)]


def test_query(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_token_file(spark, str(tmp_path)).collect()
    want = sorted((str(r[0]), len(ids := [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)


def test_no_documents(spark, no_docs):
    assert token_file.round_trip(no_docs, PATH).count() == 0
