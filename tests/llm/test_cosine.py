"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from oracle import assert_same, connect

from tessera.llm import cosine, queries

SCHEMA = "vec_id long, embedding array<double>, label int, part int, n long, key string"


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by comparing every two rows."""
    dim = max((len(v) for _, v, _ in rows if v), default=1)

    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    x = np.array([[*v, *[0.0] * (dim - len(v))] if usable(v, label) else [0.0] * dim for _, v, label in rows])
    x = x / np.maximum(np.abs(x).max(axis=1), 5e-324)[:, None]
    size = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        cosines = (x @ x.T) / (size[:, None] * size[None, :])
    near = np.nan_to_num(cosines, nan=-2) >= threshold
    labels = np.array([-1 if label is None else label for *_, label in rows])
    near &= (labels[:, None] == labels[None, :]) & ~np.eye(len(rows), dtype=bool)
    root = list(range(len(rows)))
    for start in range(len(rows)):
        if root[start] == start:
            todo = [start]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if root[j] != start:
                        root[j] = start
                        todo.append(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = None if vec_id is None else min(ids)
        out.append((vec_id, int(near[i].sum()), least, least is None or vec_id == least))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def groups(seed, dim, sizes, noise, labels=3):
    """Groups around random centres; in chains each member is near the one before only."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        v = rng.normal(size=dim)
        label = int(rng.integers(labels))
        for _ in range(size):
            v = v if rng.random() < 0.7 else v + noise * 0.5 * rng.normal(size=dim)
            rows.append((len(rows), (v + noise * rng.normal(size=dim) * rng.random()).tolist(), label))
    return rows


@pytest.mark.parametrize(("dim", "noise", "block"), [(64, 0.14, 1024), (64, 0.14, 16), (10, 0.15, 8), (3, 0.1, 32), (1, 0.5, 8)])
def test_groups_against_all_pairs(spark, dim, noise, block):
    rows = groups(dim + block, dim, [1] * 40 + [2, 3, 5, 30, 90, 60], noise)
    rows += [(1000 + i, [2 * x for x in rows[k][1]] if i % 2 else list(rows[k][1]), rows[k][2]) for i, k in enumerate([5, 5, 5, 60, 60, 100, 101])]  # copies, and of twice the length
    docs = spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)
    assert got(cosine.near_vectors(docs, block=block, load=4)) == plain(rows)


ODD = [
    (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, 2.0], None), (7, [], 1),
    (8, [1.0, 2.0], 1), (9, [1e308, 2e308 / 1.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [1.0, 2.0], 2), (10, [1e-310, 2e-310], 1), (11, [1.0, 2.0], 3),
    (12, [1.0], 4), (13, [1.0, 0.0, 0.0], 4), (14, [-1.0, 0.0, 0.0], 4), (15, [1.0, 0.0, 0.01], -4), (None, None, None),
]


def test_odd_vectors_and_no_vectors(spark):
    docs = spark.createDataFrame([(*r, 7, 7, "clash") for r in ODD], SCHEMA)
    assert got(cosine.near_vectors(docs)) == plain(ODD)
    assert cosine.near_vectors(docs.limit(0)).isEmpty()


def test_query_against_sql(spark, medium):
    assert_same(queries.op11_cosine(spark, medium), connect(medium), cosine.ORACLE_SQL)


def test_a_group_of_many_copies_is_one_node(spark):
    rows = [(i, [0.6, 0.8, 0.1], 1) for i in range(3000)] + [(5000, [0.6, 0.8, 0.11], 1), (5001, [0.6, -0.8, 0.1], 1)]
    out = {r[0]: tuple(r)[1:] for r in cosine.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out[0] == (3000, 0, True) and out[2999] == (3000, 0, False) and out[5000] == (3000, 0, False) and out[5001] == (0, 5001, True)


@pytest.mark.parametrize("bits", [1, 4, 9, 14, 20])
def test_no_pair_at_the_threshold_is_missed(bits):
    rng = np.random.default_rng(bits)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
    lsh = cosine.CrossPolytope(64, bits, 4 + max(0, -((14 - bits) // 7)))
    x, y = lsh.codes(a), lsh.codes(b)
    met = (x[:, :, 0] == y[:, :, 0]) | (x[:, :, :1] == y[:, :, 1:]).any(axis=2) | (x[:, :, 1:] == y[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.9998
    assert int(x.max()) < 1 << bits and all(len(set(c)) == len(c) for c in x[:50].reshape(-1, x.shape[2]).tolist())


def test_each_pair_is_counted_in_one_bucket():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 16)) + 0.1 * rng.normal(size=(60, 16))
    lsh = cosine.CrossPolytope(16, 7)
    names = cosine.buckets(lsh.codes(x), np.zeros(60, int))
    count = np.zeros((60, 60), int)
    for t in range(names.shape[1]):
        for bucket in np.unique(names[:, t, 0]):
            inside = np.flatnonzero((names[:, t] == bucket).any(axis=1))
            for a in inside:
                for b in inside[inside > a]:
                    if bucket in (names[a, t, 0], names[b, t, 0]):
                        count[a, b] += cosine.first_met(names[[a]], names[[b]], t, bucket)[0]
    share = np.array([[any(set(names[a, t, :1]) & set(names[b, t]) or set(names[b, t, :1]) & set(names[a, t]) for t in range(names.shape[1])) for b in range(60)] for a in range(60)])
    assert (count == np.triu(share, 1)).all()
