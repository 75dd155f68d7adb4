import random

import numpy as np
from oracle import assert_same, connect

from tessera.llm import minhash, queries


def test_against_sql(spark, medium):
    assert_same(queries.op10_minhash(spark, medium), connect(medium), minhash.ORACLE_SQL)


def plain(rows, size, percent=80):
    sets = []
    for _, text in rows:
        w = [x.lower() if x.isascii() else x for x in (text or "").split()]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def clusters(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(5):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([3, 10, 40, 90]))]
        for _ in range(90):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 4))):
                w[r.randrange(len(w))] = f"x{r.randrange(2000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_variants_of_one_text_against_all_pairs(spark):
    rows = clusters(4) + [(1000, ""), (1001, None), (1002, "one"), (1003, "ONE"), (None, "one"), (1002, "one")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == plain(rows, 2)


def test_many_repeated_rows(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    rows = [(7, " ".join(base))] * 500
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(2000)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(7, " ".join(base[:30] + ["other"] * 30))] * 20 + [(8, " ".join(base) + " end"), (9, "plain"), (9, "plain"), (9, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, shingle=2).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == plain(rows, 2)
    kept = sorted((x["doc_id"], x["text"]) for x in minhash.deduplicate(docs, shingle=2).collect() if x["doc_id"] < 100)
    assert kept == sorted(set(rows[:1]) | set(rows[540:541]) | {(9, "plain"), (9, "other")})


def test_small_blocks_lose_nothing():
    r = random.Random(7)
    pivot = np.unique(np.array([r.getrandbits(63) for _ in range(80)], np.uint64))
    rows = []
    for i in range(60):
        own = [x for x in pivot.tolist() if r.random() > 0.15] + [r.getrandbits(63) for _ in range(r.randrange(12))]
        rows.append((i, np.unique(np.array(own, np.uint64))))
    masks = [np.packbits(np.isin(pivot, s)).tobytes() for _, s in rows]
    beyond = [s[~np.isin(s, pivot)].tobytes() for _, s in rows]
    ids = [i for i, _ in rows]
    links = minhash.joining_links(ids, ids, [len(s) for _, s in rows], masks, beyond, 80)
    near = {(i, j) for i, a in rows for j, b in rows if i < j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert set(links) <= near

    def parts(edges):
        root = {i: i for i in ids}
        for a, b in edges:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return [sorted(k for k in ids if root[k] == root[i]) for i in ids]

    assert parts(links) == parts(near)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(400 * j), dtype=np.int64).astype(np.uint64)
        rest = [rng.integers(0, 2**63, (400 - len(both)) // 2, dtype=np.int64).astype(np.uint64) for _ in range(2)]
        a, b = (minhash.signature(np.unique(np.concatenate([both, x])), 240) for x in rest)
        errors.append(abs((a == b).mean() - j))
    assert max(errors) < 0.09


def test_deduplicate(spark, odd_docs, no_docs):
    kept = minhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and {0, 1, 2, 3} <= set(ids) and ids.count(None) == 2
    assert minhash.deduplicate(no_docs).count() == 0 and minhash.near_duplicates(no_docs).count() == 0


def components_in_rounds(spark, monkeypatch, edges):
    """Each node's component as the least node in it, and how many rounds were taken."""
    made = []
    monkeypatch.setattr(minhash, "cut", lambda df, tag, real=minhash.cut: (made.append(tag), real(df, tag))[1])
    found = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    least = {}
    for r in found:
        least[r["component"]] = min(r["node"], least.get(r["component"], r["node"]))
    return {r["node"]: least[r["component"]] for r in found}, made.count("near-least")


def test_a_path_in_the_order_of_its_nodes_takes_logarithmic_rounds(spark, monkeypatch):
    got, rounds = components_in_rounds(spark, monkeypatch, [(i, i + 1) for i in range(2000)])
    assert got == dict.fromkeys(range(2001), 0) and rounds <= 30


def test_components_of_mixed_shapes(spark, monkeypatch):
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1000 + j) for i in range(30) for j in range(i)] + [(3000 - i, 2999 - i) for i in range(500)]
    edges += [(5000 + r.randrange(600), 5000 + r.randrange(600)) for _ in range(400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got, rounds = components_in_rounds(spark, monkeypatch, edges)
    met = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in met} and rounds <= 25


def test_versions_of_one_text(spark, monkeypatch):
    """Each of 24 versions changes one word of the one before: near in a row, far from end to end."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(24):
        words[2 * i] = f"new{i}"
        rows.append((i, " ".join(words)))
    made = []
    monkeypatch.setattr(minhash, "cut", lambda df, tag, real=minhash.cut: (made.append(tag), real(df, tag))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == plain(rows, 2)
    assert made.count("near-least") <= 14
