"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted into buckets by their length, longest first. A query has a lower bound of its k-th
score from a small head of the longest vectors; a bucket whose longest member cannot reach that bound is
skipped. Inside a bucket the bound becomes a local cosine threshold: where it is high, coordinate pruning
drops candidates whose value at the query's largest coordinate lies outside the feasible range, and else
length pruning keeps the candidates that are long enough; what is left is verified by exact products.

Plan. Candidates are dealt into cells (bucket, part) of bounded size, queries into blocks of bounded size;
a cell meets a query block only where a query of the block needs the cell. Both sides of a meeting are
bounded, so a length that a third of all vectors share only makes more parts. The best k of each meeting
are ranked once more by query.

Products are exact at any size: in doubles up to 2^53, in longs up to 2^62, and beyond that doubles with
an error bound choose the candidates whose products are taken in whole numbers of any length.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; a score that no
long holds is ranked by its exact value and given as null; shorter vectors are filled up with zeros; ties go to the smaller vec_id; a vec_id that repeats counts as that many
candidates, and as one query with its least vector; a null vec_id takes no part; with fewer candidates
than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Vectors of a cell, queries of a block, and vectors of the head that gives the first bounds.
CELL, BLOCK, HEAD = 8192, 2048, 1024
#: Buckets of lengths: at least and at most, whatever the table's size.
BUCKETS_LEAST, BUCKETS_MOST = 16, 1024
#: Local cosine thresholds from which coordinates prune better than lengths.
COORDINATE_FROM = 0.75


def unit_of(scale: int) -> float:
    """The least power of two that is not below ``scale``: vectors are kept in parts of it, so no finite component overflows."""
    return float(1 << max(0, scale - 1).bit_length())


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) / unit of each component, exact in doubles) and length (of unit * v)."""
    unit = unit_of(scale)
    # From 2^52 on a double is whole: only what is smaller needs floor, whose result would not fit a long there.
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double") / F.lit(unit))
    v = F.transform("embedding", lambda x: F.coalesce(whole(x.cast("double") * F.lit(float(scale))), x.cast("double") * F.lit(scale / unit)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .withColumn("length", F.lit(unit) * F.sqrt(F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x)))
    )


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray, q_most: float, c_most: float) -> np.ndarray | None:
    """Exact inner products of whole numbers as longs: by doubles where no sum can leave 2^53. ``q_most`` and ``c_most``
    are their greatest sizes. None: a sum could leave the longs."""
    peak = q_most * c_most * q.shape[1]
    if not max(peak, q_most, c_most) < 2.0**62:
        return None
    if peak >= 2.0**53:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q @ c.T).astype(np.int64)


def raised(v: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """unit * v, and the greatest size in each row; infinite where a double does not hold it."""
    with np.errstate(all="ignore"):
        out = v * unit
    return out, np.abs(out).max(axis=1, initial=0.0)


def enclosed(q: np.ndarray, q_len: np.ndarray, c: np.ndarray, c_len: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers not above and not below the products, by doubles and their rounding error; infinite where those overflow."""
    with np.errstate(all="ignore"):
        s = (q @ c.T) * (unit * unit)
        error = q_len[:, None] * c_len[None, :] * (4 * (q.shape[1] + 4) * 2.0**-52) + 2.0**-500
        low, high = s - error, s + error
    fine = np.isfinite(low) & np.isfinite(high)
    return np.where(fine, low, -np.inf), np.where(fine, high, np.inf)


def whole_numbers(v: np.ndarray, unit: float) -> list[int]:
    return [int(x) * int(unit) if abs(x) >= 2.0**53 else int(x * unit) for x in v.tolist()]


def exact(q: np.ndarray, c: np.ndarray, unit: float) -> np.ndarray:
    """Inner products of one vector with others in whole numbers of any length."""
    own = whole_numbers(q, unit)
    out = np.empty(len(c), object)
    out[:] = [sum(map(int.__mul__, own, whole_numbers(v, unit))) for v in c]
    return out


def sortable(score: int) -> tuple[int, int, bytes]:
    """(over, score, key), in the order of the scores: over is 1 above the longs and -1 below, where the key takes the score's place."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, int(score), b""
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, 0, key) if score > 0 else (-1, 0, bytes(255 - x for x in key))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], int)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def feasible(q_unit: float, threshold: float) -> tuple[float, float]:
    """The range that a unit vector's coordinate can have if its cosine with a query is ``threshold`` or more
    and the query's own coordinate is ``q_unit``."""
    rest = math.sqrt(max(0.0, 1 - q_unit * q_unit)) * math.sqrt(max(0.0, 1 - threshold * threshold))
    low = q_unit * threshold - rest if q_unit > -threshold else -1.0
    high = q_unit * threshold + rest if q_unit < threshold else 1.0
    return low - 1e-9, high + 1e-9


def search_cell(q_ids, q, q_len, bound, ids, c, c_len, k: int, unit: float = 1.0) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in one cell; candidates longest first."""
    (q_whole, q_most), (c_whole, c_most) = raised(q, unit), raised(c, unit)
    with np.errstate(all="ignore"):  # where a length is infinite nothing is pruned
        direction = c_whole / np.where(c_len > 0, c_len, 1)[:, None]
    longest = c_len[0] if len(c_len) else 0.0
    for i in range(len(q_ids)):
        with np.errstate(all="ignore"):
            top = q_len[i] * longest
        if math.isinf(bound[i]) or not math.isfinite(top):
            keep = np.arange(len(ids))
        elif top <= 0:
            keep = np.arange(len(ids)) if bound[i] <= 0 else ids[:0].astype(int)
        elif bound[i] > top * (1 + 1e-12):
            continue
        else:
            threshold = bound[i] / top
            if threshold >= COORDINATE_FROM:
                f = int(np.argmax(np.abs(q[i])))
                low, high = feasible(q_whole[i, f] / q_len[i], min(1.0, threshold) * (1 - 1e-12))
                keep = np.flatnonzero((direction[:, f] >= low) & (direction[:, f] <= high))
            elif threshold > 0:
                keep = np.arange(np.searchsorted(-c_len, -(bound[i] / q_len[i]) * (1 - 1e-12), side="right"))
            else:
                keep = np.arange(len(ids))
        whole = len(keep) and len(keep) == keep[-1] + 1  # a prefix needs no copy
        s = products(q_whole[i : i + 1], c_whole[: len(keep)] if whole else c_whole[keep], q_most[i], c_most[: len(keep)].max() if whole else c_most[keep].max(initial=0.0))
        other = ids[keep] != q_ids[i]
        if s is None:  # doubles choose who can be among the k best, whole numbers decide
            keep = keep[other]
            near = c[keep]
            low, high = (x[0] for x in enclosed(q[i : i + 1], q_len[i : i + 1], near, c_len[keep], unit))
            if len(keep) > k:
                can = high >= np.partition(low, len(low) - k)[len(low) - k]
                keep, near = keep[can], near[can]
            s = exact(q[i], near, unit)
        else:
            s, keep = s[0][other], keep[other]
        for j in best(s, ids[keep], k) if len(keep) else ():
            if s[j] >= float(bound[i]):  # a Python float: exact beside whole numbers of any length
                yield int(q_ids[i]), int(ids[keep][j]), int(s[j])


def bucket_marks(data: DataFrame, n: int, cell: int) -> list[float]:
    """The lengths at which buckets begin, longest first: about equally many of the ``n`` vectors in each."""
    wanted = min(BUCKETS_MOST, max(BUCKETS_LEAST, n // (8 * cell)))
    return sorted(set(data.approxQuantile("length", [i / wanted for i in range(1, wanted)], 0.5 / wanted)), reverse=True)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of each vector whose id is divisible by ``every``."""
    spark, unit = vectors.sparkSession, unit_of(scale)
    data = cut(scaled(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    about = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    n, dim = about["n"], max(1, about["dim"])
    asks = data.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    asks = asks.withColumn("n", F.row_number().over(_by_query())).filter("n = 1").drop("n")
    if not n:
        return asks.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)

    # Buckets by length, longest first; their bounds are a few numbers, found approximately: any bounds are right.
    marks = bucket_marks(data, n, cell)
    bucket = F.lit(len(marks))
    for i in reversed(range(len(marks))):
        bucket = F.when(F.col("length") >= marks[i], i).otherwise(bucket)
    if len(marks) > 16:  # a chain of whens grows with the buckets: find the place by search
        bucket = F.lit(len(marks)) - F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: F.col("length") >= m))
    sized = data.withColumn("bucket", bucket.cast("int"))
    cells = {r["bucket"]: (max(1, -(-r["n"] // cell)), r["top"]) for r in sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for b, (p, _) in cells.items() for x in (b, p)]), F.col("bucket"))

    head = data.orderBy(F.desc("length"), "vec_id").limit(HEAD)
    shared = spark.sparkContext.broadcast(_head(head.collect(), dim))  # HEAD vectors, whatever the table's size

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, c_len = shared.value
        for batch in batches:
            q = _matrix(batch.column(1).to_pandas(), dim)
            (q_whole, q_most), (c_whole, c_most) = raised(q, unit), raised(c, unit)
            s = products(q_whole, c_whole, q_most.max(initial=0.0), c_most.max(initial=0.0))
            if s is None:
                s = enclosed(q, batch.column(2).to_numpy(zero_copy_only=False), c, c_len, unit)[0]
            least = []
            for q_id, row in zip(batch.column(0).to_pylist(), s):
                own = np.sort(row[ids != q_id])
                reached = float(own[-k]) if len(own) >= k else float("-inf")
                least.append(reached if abs(reached) < 2.0**53 else float(np.nextafter(reached, -np.inf)))  # never rounded up
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], ["vec_id", "v", "length", "bound"])

    asked = cut(asks.select("vec_id", "v", "length").mapInArrow(bounds, "vec_id long, v array<double>, length double, bound double"), "topk-queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    # The buckets that a query needs, by arithmetic on at most BUCKETS_MOST lengths.
    known = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).alias("parts"), F.lit(float(top)).alias("top")) for b, (p, top) in sorted(cells.items())])
    reached = F.filter(known, lambda b: F.col("length") * b["top"] * F.lit(1 + 1e-12) >= F.col("bound"))
    ways = (
        asked.withColumn("b", F.explode(reached))
        .select("block", "b.bucket", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("part"), F.col("vec_id").alias("id"), F.col("v").alias("vector"), F.col("length").alias("size"), "bound", F.lit(True).alias("asks"))
    )
    needed = cut(ways.select("bucket", "part", "block").distinct(), "topk-needed")
    there = (
        sized.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
        .join(needed, ["bucket", "part"])
        .select("block", "bucket", "part", F.col("vec_id").alias("id"), F.col("v").alias("vector"), F.col("length").alias("size"), F.lit(float("nan")).alias("bound"), F.lit(False).alias("asks"))
    )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows.asks], rows[~rows.asks].sort_values(["size", "id"], ascending=[False, True])
        found = list(search_cell(
            q.id.to_numpy(), _matrix(q.vector, dim), q["size"].to_numpy(), q.bound.to_numpy(),
            c.id.to_numpy(), _matrix(c.vector, dim), c["size"].to_numpy(), k, unit,
        ))
        return pd.DataFrame([(q_id, vec_id, *sortable(score)) for q_id, vec_id, score in found], columns=["query_id", "vec_id", "over", "score", "key"])

    met = ways.unionByName(there).groupBy("block", "bucket", "part").applyInPandas(meet, "query_id long, vec_id long, over int, score long, key binary")
    rank = F.row_number().over(_best_first())
    score = F.when(F.col("over") == 0, F.col("score")).alias("score")
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def _by_query():
    return Window.partitionBy("vec_id").orderBy("v")


def _best_first():
    return Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("key"), "vec_id")


def _head(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    c = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        c[i, : len(r["v"])] = r["v"]
    return ids, c, np.array([r["length"] for r in rows], float)


#: The same rows by brute force, for vectors of one length and distinct ids.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
