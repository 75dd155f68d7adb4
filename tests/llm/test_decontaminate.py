import hashlib
import random
import re
import time

from tessera.llm import decontaminate as D
from tessera.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(text, items, window=10):
    w = WORD.findall(low(text))
    hit, ids = set(), set()
    for item_id, item in items:
        v = WORD.findall(low(item))
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.update([] if item_id is None else [str(item_id)])
    return len(w), len(hit), sorted(ids)


def fixture(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (None, "w1"), (3, "w0 w1 w2 w3")]
    docs = []
    for i in range(120):
        text = [r.choice(vocabulary + ["Z", "é"]) for _ in range(r.randrange(40))]
        if i % 3 == 0:
            text[5:5] = (items[i % 12][1] or "").upper().split()
        docs.append((i, ", ".join(text)))
    return docs, items


def test_against_all_windows(spark):
    docs, items = fixture()
    docs += [docs[3], docs[6], (None, docs[9][1]), (None, docs[0][1])]
    for block in (10_000, 200):
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in D.report(d, b, block_bytes=block).collect())
        assert got == sorted((str(i), *plain(t, items)) for i, t in docs)


def test_long_items_are_cut_into_pieces_without_loss(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    r = random.Random(3)
    item = [f"v{r.randrange(9)}" for _ in range(300)]
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:9])), (None, "only here")], "item_id long, text string")
    docs = [(i, " ".join(item[i : i + 10 + i % 3])) for i in range(0, 288)] + [(900, "stands only here alone")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, " ".join(item)), (2, " ".join(item[:9])), (None, "only here")]
    for block in (1 << 20, 400):
        assert sum(1 for _ in D.benchmark_blocks(b, 10, block)) > (block == 400)
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], sorted(x["items"])) for x in D.report(d, b, block_bytes=block).collect()}
        assert got == {i: plain(t, items) for i, t in docs}


def test_a_window_of_many_items():
    many = [(f"i{i}", "a b c d e f g h i j k") for i in range(20_000)]
    start = time.process_time()
    index = D.build_index(many)
    spans, ids = D.hits(D.words(b"a b c d e f g h i j k " * 200), index)
    assert len(ids) == 20_000 and spans == [(0, 2200)] and time.process_time() - start < 10


def test_query(spark, odd_docs, odd_rows, tmp_path):
    items = [(7, "same text here for all of us"), (12, "fox jumps over the lazy dog the quick brown fox jumps over"), (100, "dog")]
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op2_decontaminate(spark, str(tmp_path)).collect())
    want = []
    for row in odd_rows:
        n, hit, ids = plain(row[1], items)
        want.append((str(row[0]), n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)


def test_removal(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "text here for all")], "item_id long, text string")
    kept = D.remove_contaminated(odd_docs, b)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    cut = {r["text"] for r in D.remove_contaminated(odd_docs, b, action="span").collect()}
    assert "same  of us" in cut and "same text here for all of us" not in cut
    assert D.remove_contaminated(no_docs, b).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.remove_contaminated(odd_docs, none).count() == odd_docs.count() and D.report(odd_docs, none).count() == odd_docs.count()
