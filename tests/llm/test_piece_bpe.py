import hashlib

import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="  \n\tabdeinost▁日ﬁ𓀀é.,1<>0xA'-", max_size=80)))
def test_same_ids_and_text_as_the_library(text):
    bpe = piece_bpe.model(PATH)
    ids = LIBRARY.encode(text)
    assert bpe.encode(text) == ids and bpe.decode(ids) == LIBRARY.decode(ids)


def test_runs_of_spaces():
    bpe = piece_bpe.model(PATH)
    for n in [*range(1, 200), 1000, 4001, 200_000]:
        for text in (" " * n, "a" + " " * n + "the", " " * n + "日") if n < 5000 else (" " * n,):
            assert bpe.encode(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="  \nab▁é.", max_size=30)), max_size=8))
def test_columns_of_texts(texts):
    bpe = piece_bpe.model(PATH)
    column = pa.array(texts, pa.string())
    ids = [LIBRARY.encode(t or "") for t in texts]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = [tuple(zip(n.tolist(), i, d)) for n, i, d in map(bpe.digests, common.slices(column, 40))]
    assert sum(got, ()) == tuple((len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for x in ids)


def test_query(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op4_piece_bpe(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for row in odd_rows:
        ids = LIBRARY.encode(row[1] or "")
        want.append((str(row[0]), len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert got == sorted(want)


def test_round_trip_of_tables(spark, odd_docs, no_docs):
    back = piece_bpe.decode(piece_bpe.encode(odd_docs, PATH), PATH)
    want = sorted((str(r["doc_id"]), LIBRARY.decode(LIBRARY.encode(r["text"] or ""))) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == want
    assert piece_bpe.encode(no_docs, PATH).count() == 0


def test_small_cache_changes_nothing():
    bpe = piece_bpe.PieceBpe(PATH)
    bpe.cache.size = bpe.parts.size = 3
    text = "some words, some other words; some words again and again"
    assert [bpe.encode(text) for _ in range(3)] == [LIBRARY.encode(text)] * 3
