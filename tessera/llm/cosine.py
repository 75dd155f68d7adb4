"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest of the corners
``+-e_i`` is its hash. A table concatenates such hashes of further rotations (the last one over fewer coordinates)
to as many bits as the number of vectors asks for, and has a bucket for each value and label. A vector is at home
in one bucket of each table and *visits* the next nearest ones (multiprobe). Vectors that share a bucket in which
one of them is at home are candidates, and their cosine, in doubles, decides.

Plan. Vectors of equal label and components are one node, so copies are counted, not compared. Buckets in which
nobody could meet are dropped before any vector is shuffled. A bucket's members are dealt into blocks of bounded
size, and each two blocks meet in one task as a matrix product; what leaves the task is, for each node, the number
of its links and one node of its part there, never a pair. A pair that meets more than once is counted in the
first bucket of those that the two have in common, which both know from their hashes. Links of a node add up;
parts become components by contracting an edge table round by round.

A group of m vectors that are all near one another has m * m / 2 links to count: they are counted in blocks, and
each member is sent to m / ``BLOCK`` tasks. That is the size of the question, not of its answer.

Defined cases: a vector that is null, zero or holds null, NaN or infinite components, or whose label is null,
links with nothing and stays; shorter vectors are filled up with zeros; a null vec_id has its own row, links like
others and is never the name of a component; repeated rows are linked with each other and stay; ties at the
threshold are links; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut
from tessera.llm.minhash import components

#: Tables, and buckets that a vector visits in each besides its own.
TABLES, PROBES = 4, 4
#: Members of a block, and vectors of one label that a bucket is made for.
BLOCK, LOAD = 1024, 16
_M = np.uint64(0x9E3779B97F4A7C15)


def padded(dim: int) -> int:
    """The power of two in which vectors of a length are rotated."""
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of the last axis, not scaled."""
    h = 1
    while h < x.shape[-1]:
        y = x.reshape(*x.shape[:-1], -1, 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


class CrossPolytope:
    """``tables`` hashes of ``bits`` bits each, for vectors of length ``dim``."""

    def __init__(self, dim: int, bits: int, tables: int = TABLES, probes: int = PROBES, seed: int = 11):
        self.dim, self.size, self.tables = dim, padded(dim), tables
        own = self.size.bit_length()  # bits of one whole hash
        #: Coordinates of each hash of a table: all, and in the last one those that the bits left over name.
        self.wide = [self.size] * (bits // own) + ([1 << (bits % own - 1)] if bits % own else [])
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (3, tables * len(self.wide), self.size))
        singles, pairs = len(self.wide) * probes, math.comb(len(self.wide), 2)
        self.probes = min(probes, singles + pairs, sum(2 * w - 1 for w in self.wide))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) codes: the home, then what is visited."""
        full = np.zeros((len(x), 1, self.size))
        full[:, 0, : x.shape[1]] = x
        y = full
        for signs in self.signs:
            y = hadamard(y * signs)
        y = y.reshape(len(x), self.tables, len(self.wide), self.size)
        parts, losses = [], []  # of each hash: the best corners, and what the others lose
        for k, w in enumerate(self.wide):
            corner = np.concatenate([y[:, :, k, :w], -y[:, :, k, :w]], axis=2)
            most = min(self.probes + 1, 2 * w)
            best = np.argpartition(-corner, most - 1, axis=2)[:, :, :most] if most < 2 * w else np.broadcast_to(np.arange(2 * w), corner.shape)
            value = np.take_along_axis(corner, best, axis=2)
            order = np.argsort(-value, axis=2, kind="stable")
            best, value = np.take_along_axis(best, order, axis=2), np.take_along_axis(value, order, axis=2)
            parts.append(best.astype(np.uint64))
            losses.append((value[:, :, :1] - value) ** 2)
        ways: list[tuple[tuple[int, int], ...]] = [((k, r),) for k in range(len(parts)) for r in range(1, parts[k].shape[2])]
        ways += [((k, 1), (m, 1)) for k, m in combinations(range(len(parts)), 2)]
        loss = np.stack([sum(losses[k][:, :, r] for k, r in way) for way in ways], axis=2) if ways else np.zeros((len(x), self.tables, 0))
        chosen = np.argsort(loss, axis=2, kind="stable")[:, :, : self.probes]
        out = np.empty((len(x), self.tables, 1 + chosen.shape[2]), np.uint64)

        def joined(pick: list[np.ndarray]) -> np.ndarray:
            code = pick[0]
            for k in range(1, len(pick)):
                code = code * np.uint64(2 * self.wide[k]) + pick[k]
            return code

        homes = [p[:, :, 0] for p in parts]
        out[:, :, 0] = joined(homes)
        if ways:
            every = []
            for way in ways:
                pick = list(homes)
                for k, r in way:
                    pick[k] = parts[k][:, :, r]
                every.append(joined(pick))
            out[:, :, 1:] = np.take_along_axis(np.stack(every, axis=2), chosen, axis=2)
        return out


def buckets(codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """64-bit names of the buckets: of label, table and code."""
    table = np.arange(1, codes.shape[1] + 1, dtype=np.uint64)[None, :, None]
    h = (labels.astype(np.int64).view(np.uint64)[:, None, None] * _M) ^ (table << np.uint64(56))
    for part in (codes, codes >> np.uint64(32)):
        h = (h ^ part) * _M
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def scan(vectors: DataFrame, dim: int) -> DataFrame:
    """row, vec_id, label, key and data (doubles, filled up) of each vector; key and data are null where it cannot be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = [], []
            for label, values in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = np.zeros(dim)
                if label is not None and values is not None and None not in values:
                    x[: len(values)] = values
                if np.isfinite(x).all() and x.any():
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))  # cosines stay as they are, and nothing overflows
                    data.append(x.tobytes())
                    keys.append(hashlib.blake2b(data[-1], digest_size=16, key=str(label).encode()).digest())
                else:
                    data.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["row", "vec_id", "label", "key", "data"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "row long, vec_id long, label long, key binary, data binary")


def hashed(nodes: DataFrame, lsh: CrossPolytope) -> DataFrame:
    """node, n, label, data and the names of its buckets: for each table the home and what it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(part.num_rows, -1)
                names = buckets(lsh.codes(x), part.column(2).to_numpy())
                flat = pa.array(names.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (names.shape[1] * names.shape[2])), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["node", "n", "label", "data", "names"])

    return nodes.select("node", "n", "label", "data").mapInArrow(run, "node long, n long, label long, data binary, names array<long>")


def first_met(names_a: np.ndarray, names_b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Which pairs meet here first: in no earlier table, and in none of this table's buckets that comes before."""
    keep = np.ones(len(names_a), bool)
    for t in range(table + 1):
        a, b = names_a[:, t], names_b[:, t]
        a_home, b_home = a[:, 0], b[:, 0]
        at_a = (a_home[:, None] == b).any(axis=1)  # they meet where a is at home
        at_b = (b_home[:, None] == a).any(axis=1)
        keep &= ~((at_a & (a_home < bucket)) | (at_b & (b_home < bucket))) if t == table else ~(at_a | at_b)
    return keep


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of two matrices whose cosine reaches the threshold."""
    lengths = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
    return np.nonzero((x @ y.T) / lengths >= threshold)


def meet(bucket: int, table: int, rows: dict[str, np.ndarray], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of two blocks, weighted by copies, and the first row of its part; pairs that meet elsewhere first are left out.

    ``rows`` has x, names, n, label, home and side (0 or 1: the block); one block with itself where ``same``.
    """
    n = len(rows["n"])
    links, part = np.zeros(n, np.int64), np.arange(n)
    at = [np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == (0 if same else 1))]
    home = [x[rows["home"][x]] for x in at]
    away = [x[~rows["home"][x]] for x in at]
    ways = [(home[0], at[1])] + ([] if same else [(away[0], home[1])])
    found_a, found_b = [], []
    for left, right in ways:
        if not len(left) or not len(right):
            continue
        for begin in range(0, len(left), 256):
            own = left[begin : begin + 256]
            i, j = near_pairs(rows["x"][own], rows["x"][right], threshold)
            i, j = own[i], right[j]
            alike = rows["label"][i] == rows["label"][j]  # names of buckets are hashes
            i, j = i[alike], j[alike]
            if same:  # two at home meet in both orders, with themselves too
                keep = (i < j) | ~rows["home"][j]
                i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                first = first_met(rows["names"][a], rows["names"][b], table, bucket)
                found_a.append(a[first])
                found_b.append(b[first])
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        np.add.at(links, a, rows["n"][b])
        np.add.at(links, b, rows["n"][a])
        while True:  # the least row of each part, halving what is left of its paths
            least = np.minimum(part[a], part[b])
            before = part.copy()
            np.minimum.at(part, a, least)
            np.minimum.at(part, b, least)
            part = part[part]
            if (part == before).all():
                break
    return links, part


def met(dealt: DataFrame, tables: int, dim: int, threshold: float) -> DataFrame:
    """(node, links, part) of the nodes that have links, for each two blocks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            bucket, i, j = key
            x = np.frombuffer(b"".join(table.column("data").to_pylist()), np.float64).reshape(table.num_rows, dim)
            names = table.column("names").combine_chunks().flatten().to_numpy().reshape(table.num_rows, tables, -1)
            node = table.column("node").to_numpy()
            home = table.column("home").to_numpy()
            at = int(np.flatnonzero(names[np.argmax(home), :, 0] == bucket)[0]) if home.any() else 0
            rows = {"x": x, "names": names, "n": table.column("n").to_numpy(), "label": table.column("label").to_numpy(), "home": home, "side": (table.column("own").to_numpy() == j).astype(int) if i != j else np.zeros(len(node), int)}
            links, part = meet(bucket, at, rows, i == j, threshold) if home.any() else (np.zeros(len(node), np.int64), np.arange(len(node)))
            keep = links > 0
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[part[keep]])], ["node", "links", "part"])

        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            begin = np.concatenate([[0], 1 + np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)), [batch.num_rows]]) if batch.num_rows else [0]
            for x, y in zip(begin, begin[1:]):
                now = tuple(int(k[x]) for k in keys)
                if now != key:
                    if held:
                        yield out()
                    key, held = now, []
                held.append(batch.slice(int(x), int(y - x)).select(["own", "home", "node", "n", "label", "data", "names"]))
        if held:
            yield out()

    return dealt.mapInArrow(run, "node long, links long, part long")


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, tables: int | None = None, probes: int = PROBES, block: int = BLOCK, load: int = LOAD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector: links are pairs of one label with a cosine of ``threshold`` or more.

    With 4 tables and 4 visits a pair of 64 components at cosine 0.98 is missed about once in 10^5; a table is
    added for each 7 bits above 14.
    """
    dim = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("n")).first()["n"]
    dim = max(1, dim)
    scanned = cut(scan(vectors, dim), "cos-scan")
    known = scanned.filter("key is not null")
    nodes = cut(known.groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "cos-nodes")
    most = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    bits = max(1, math.ceil(math.log2(max(1, most / load))))
    lsh = CrossPolytope(dim, bits, tables or 4 + max(0, math.ceil((bits - 14) / 7)), probes)
    own = known.select(F.col("row").alias("node"), "label", "data").join(nodes.select("node", "n"), "node")
    named = cut(hashed(own, lsh), "cos-named")

    # Who is in which bucket, without vectors: buckets with one member, or with visitors only, go.
    visits = 1 + lsh.probes
    entries = named.select("node", F.posexplode("names").alias("at", "bucket")).select("node", "bucket", (F.col("at") % visits == 0).alias("home"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes")).filter("members > 1 and homes > 0")
    blocks = sizes.select("bucket", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    met_in = cut(entries.join(blocks, "bucket"), "cos-entries")
    placed = (
        met_in.withColumn("own", F.expr("cast(pmod(xxhash64(node, bucket), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "node")
    )
    dealt = placed.join(named, "node").select("bucket", "i", "j", "own", "home", "node", "n", "label", "data", "names").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut(met(dealt, lsh.tables, dim, threshold), "cos-met")

    joined = components(found.filter("node <> part").select(F.least("node", "part").alias("a"), F.greatest("node", "part").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed_nodes = nodes.join(linked, "node", "left").join(joined, "node", "left").select("key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    rows = cut(scanned.select("row", "vec_id", "key").join(placed_nodes, "key", "left"), "cos-rows")
    least = cut(rows.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least")), "cos-least")
    drop_cut(met_in)
    out = rows.join(least, "component", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


#: The same rows by comparing all vectors of a label, for vectors of one length and distinct ids.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), k AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings AS e JOIN c ON e.vec_id = c.vec_id LEFT JOIN k ON e.vec_id = k.vec_id
"""
