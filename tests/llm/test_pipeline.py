import re

import pyarrow as pa
import sentencepiece

import corpus_pipeline
import public_tokenizers
from tessera.llm import pii
from tessera.llm.common import pieces, read_table


def test_stages_hold_their_words(spark, medium):
    docs = read_table(spark, medium, "documents")
    columns, counts = docs.columns, [docs.count()]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, medium, "labels").collect()}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, medium).cache()
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in seen[0] for d in good) >= 0.98 * len(good)
    assert sum(d in seen[0] for d, q in labels.items() if q == 0) <= 0.15 * sum(q == 0 for q in labels.values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = {tuple(w[i : i + 10]) for r in read_table(spark, medium, "benchmark").collect() for w in [words(r["text"])] for i in range(len(w) - 9)}
    leaks = {d for d, t in seen[1].items() if any(tuple(w[i : i + 10]) in grams for w in [words(t)] for i in range(len(w) - 9))}
    assert leaks and set(seen[2]) == set(seen[1]) - leaks
    for text in seen[3].values():
        assert not any(pii.base_spans(text).values())
    clean = [d for d, t in seen[2].items() if not any(pii.base_spans(t).values())]
    assert clean and all(seen[3][d] == seen[2][d] for d in clean)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {d: library.encode(t) for d, t in seen[3].items()}
    assert counts == sorted(counts, reverse=True)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "no such passage of words")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        ids = [r["doc_id"] for r in out.collect()]
        assert ({0, 1, 2} <= set(ids) and ids.count(7) <= 1) if name == "odd" else ids == []


def test_rows_reach_python_in_small_batches(spark, medium):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(substr(sha2(cast(id AS string), 256), 1, 50), 200) AS text")
    corpus_pipeline.near_duplicate_stage(spark, docs, medium)  # 30 MB in one partition

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 6 << 20


def test_pieces_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 40, None, "", "b" * 90, "c" * 30, None, "d" * 70])], ["doc_id", "text"])
    got = list(pieces([batch, batch.slice(0, 0)], 1, 75))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and [b.num_rows for b in got] == [3, 1, 2, 1]
