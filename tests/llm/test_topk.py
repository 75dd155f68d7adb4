import math
import random
from fractions import Fraction

import pytest
from oracle import assert_same, connect

from tessera.llm import queries, topk


def test_against_sql(spark, medium):
    assert_same(queries.op5_topk(spark, medium), connect(medium), topk.ORACLE_SQL)


def test_buckets_of_lengths_at_every_size(spark, medium):
    for path in (medium, medium.replace("0.01", "0.001")):
        data = topk.scaled(spark.read.parquet(f"{path}/embeddings.parquet"), 256)
        marks = topk.bucket_marks(data, data.count(), topk.CELL)
        assert len(marks) > 4
        held = [data.filter(f"length >= {m}").count() for m in marks]
        assert held == sorted(held) and len(set(held)) == len(held)


def plain(rows, k=5, every=50):
    data = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, v in data:
        if q % every == 0:
            best = sorted(((-dot(v, w), i) for i, w in data if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cell, block, spread", [(8192, 2048, 0), (16, 3, 0), (8, 2, 3.0)])
def test_cells_blocks_and_lengths(spark, cell, block, spread):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * math.exp(spread * r.random()) / 8 for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [math.nan] * 6), (2150, [math.inf] * 6), (None, [1.0] * 6), (2200, [0.0] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=cell, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, score long"
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0], 1), (1, [2.0, 5.0], 1)], kind)).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0


def test_many_lengths_use_many_buckets(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 40) for _ in range(4)]) for i in range(700)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=4, block=7)
    assert sorted(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("cell, block", [(8192, 2048), (8, 5)])
@pytest.mark.parametrize("size", [1e6, 1e12, 1e30, 1e160, 1e307])
def test_long_vectors_take_part(spark, size, cell, block):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) * (size if i % 7 == 0 else 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(8)] + [(2000, [size, 0.0, 0.0, 0.0, 0.0, 1.0]), (2001, [size, 0.0, 0.0, 0.0, 0.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=cell, block=block)
    want = exact_plain(rows)
    assert sorted(map(tuple, got.collect())) == [(q, n, i, s if -(2**63) <= s < 2**63 else None) for q, n, i, s in want]
    assert any(i % 7 == 0 and i for _, _, i, _ in want)


def exact_plain(rows, k=5, every=50):
    """As plain(), in whole numbers: 256 * x may be beyond the doubles."""
    data = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    out = []
    for q, v in data:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in data if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)
