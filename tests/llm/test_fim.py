"""Fill-in-middle: every row against plain string slicing, its SQL, and other units."""

import hashlib
import re

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from tessera.llm import fim, queries


def plain_fim(doc_id, text, units=None):
    text = text or ""
    units = list(text) if units is None else units(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)


def words(text):
    return re.findall(fim.WORD, text, re.ASCII)


MARKED = ["<", "<P", "<P>", "x<S>y", "<M><M>", "P><S", "<<<", "a<", "<S<S", "𓀀<𓀀>é", "\n\n", "a b\tc  d ", "ab" * 33, "word " * 65]


@pytest.fixture(scope="module")
def rows(odd_rows):
    return [(r[0], r[1]) for r in odd_rows] + [(1000 + 20 * k + i, t) for k in range(12) for i, t in enumerate(MARKED)]


@pytest.mark.parametrize("run", [1, 2, 7, 32])
@pytest.mark.parametrize(("unit", "units"), [(fim.POINT, None), (fim.WORD, words)])
def test_as_by_slices(spark, rows, run, unit, units):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.transform(docs, unit=unit, run=run)
    assert rows_of(got) == sorted((plain_fim(i, t, units) for i, t in rows), key=str)
    back = got.select("text", fim.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.filter("text <> back or back is null").isEmpty()


def test_odd_rows_extra_columns_and_no_rows(spark, odd_docs, odd_rows, no_docs):
    assert rows_of(fim.transform(odd_docs)) == sorted((plain_fim(r[0], r[1]) for r in odd_rows), key=str)
    assert fim.transform(no_docs).isEmpty()


def test_query_against_sql_and_slices(spark, medium):
    df = queries.op13_fim(spark, medium)
    assert_same(df, connect(medium), fim.ORACLE_SQL)
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    want = {(i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest()) for i, n, form, p, m, out in (plain_fim(*r) for r in docs)}
    assert {tuple(r)[:6] for r in df.collect()} == want


def test_no_python_and_single_units_only_in_runs_asked_for(spark, medium):
    plan = queries.op13_fim(spark, medium)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
