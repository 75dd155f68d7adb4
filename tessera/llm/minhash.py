"""Near-duplicate groups by circulant MinHash.

Two permutations of a 2^32 universe make all K signature coordinates: the first scatters a document's
shingles, the second, shifted by k, gives coordinate k as the least of its values (C-MinHash). Bands of
``ROWS`` coordinates become bucket keys; documents that share a bucket are compared on their full
shingle sets, and links (Jaccard at least ``similarity``) become components.

Plan. Documents with equal sets are one node. A bucket's nodes are compared with one of them (its pivot)
first. What a comparison finds is kept as the difference from the pivot (a bit for each of its shingles,
and the others), a fraction of a set's size. Where nodes around a pivot still lie in different components
they are compared with each other, in blocks of bounded size, from those differences: intersections of two
blocks are one matrix product, and only links that join two components leave the task. So no pair is a row
of any table, and every pair of nodes that shares a bucket is decided on full sets. Texts are shuffled once,
to meet the pivots that they are compared with. Large pivots are salted. Components are found by contracting the
edge table round by round in the shared folder; nothing is collected.

With 40 bands of 6 rows a pair at similarity 0.8 shares no band with probability 5e-6; a pair at 0.9
with 1e-13.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id stands alone (component null, kept); repeated
rows stay, in one group; rows that share a doc_id but not a text are grouped by their own texts; empty
tables give empty results; a very long text is one set of as many hashes as it has shingles. Texts of one doc_id
are told apart by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, pieces, text_bytes

BANDS, ROWS = 40, 6
#: Members that one copy of a pivot's set is compared with.
SALT = 64
#: Nodes of a block around a pivot.
AROUND = 512
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    h = xxhash.xxh3_64_intdigest
    words = np.array([h(w) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(size, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        mixed = (mixed ^ words[j : len(words) - n + 1 + j]) * _M
        mixed ^= mixed >> np.uint64(29)
    mixed *= _N
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _scatter(hashes: np.ndarray) -> np.ndarray:
    """The first permutation, of the universe that 32 bits of a shingle's hash name."""
    x = hashes.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least value of the second permutation, shifted by 0, 1, 2, ..."""
    x = _scatter(hashes)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for begin in range(0, len(x), 512):  # in pieces that stay in a processor's cache
        part = x[begin : begin + 512]
        for k in range(0, size, 40):
            y = part - shift[k : k + 40]
            y *= np.uint32(0x7FEB352D)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x846CA68B)
            y ^= y >> np.uint32(16)
            np.minimum(out[k : k + 40], y.min(axis=1), out=out[k : k + 40])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _N
    for j in range(rows):
        key = (key ^ parts[:, j]) * _M
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def scan(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key, band keys and text hash of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n, keys, buckets = [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingles(text, shingle)
                n.append(len(s))
                keys.append(set_key(s))
                buckets.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)],
                ["doc_id", "n_shingles", "set_key", "bands", "text_hash"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, text_hash long")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Each (a, b) of ``pairs``, and each a with itself: whether their full sets are near, and b's difference from a.

    Each set goes through one shuffle to the pivots ``a`` that it is compared with; a pivot with many
    members is sent to one task for each ``SALT`` of them. Of repeated rows one text is read: copies
    are dropped in their tasks, before the shuffle that joins texts with roles.
    """
    pairs = cut(pairs, "near-pairs")
    salts = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")), "near-salts")
    member = pairs.join(salts, "a").select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt"), F.lit(1).alias("member"))
    pivot = salts.select(F.col("a").alias("node"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    roles = cut(member.unionByName(pivot), "near-roles").join(nodes.select("node", F.col("doc_id").alias("id"), "text_hash", "set_key"), "node")
    once = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text").filter("id is not null").dropDuplicates(["id", "text_hash"])
    texts = once.join(roles, ["id", "text_hash"]).select("text", "node", "pivot", "salt", "member", "set_key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes, key = None, None, None
        for batch in pieces(batches, 0):
            keep, out = [], []
            for text, want in zip(text_bytes(batch.column(0)), batch.column(5).to_pylist()):
                if text != last:  # the roles of a document follow one another
                    last, hashes = text, shingles(text, shingle)
                    key = set_key(hashes)
                keep.append(key == want)
                if key == want:
                    out.append(hashes.tobytes())
            rest = batch.select([1, 2, 3, 4]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], ["node", "pivot", "salt", "member", "hashes"])

    dealt = (
        texts.mapInArrow(sets, "node long, pivot long, salt int, member int, hashes binary")
        .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for batch in pieces(batches, 4):
            rows: list[tuple] = []
            for node, pivot, salt, is_member, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                other = np.frombuffer(data, np.uint64)
                if not is_member:
                    current, own = pivot, other
                    if salt:
                        continue
                elif pivot != current:
                    continue
                shared = np.isin(own, other, assume_unique=True)
                both = int(shared.sum())
                near = 100 * both >= percent * (len(own) + len(other) - both)
                beyond = other[~np.isin(other, own, assume_unique=True)] if both < len(other) else other[:0]
                rows.append((pivot, node, near, len(other), np.packbits(shared).tobytes(), beyond.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))],
                ["pivot", "node", "near", "n", "mask", "beyond"],
            )

    return dealt.mapInArrow(compare, "pivot long, node long, near boolean, n long, mask binary, beyond binary")


def _shared_beyond(beyond: list[np.ndarray], out: np.ndarray, few: int = 6) -> None:
    """Adds to ``out`` how many shingles beyond the pivot's each two rows share."""
    size = [len(x) for x in beyond]
    if not sum(size):
        return
    owner = np.repeat(np.arange(len(beyond)), size)
    _, column, count = np.unique(np.concatenate(beyond), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, begin = owner[order], np.concatenate([[0], np.cumsum(count)[:-1]])
    for f in range(2, few + 1):
        rows = owner[begin[count == f][:, None] + np.arange(f)]
        for i in range(f):
            for j in range(f):
                if i != j:
                    np.add.at(out, (rows[:, i], rows[:, j]), 1)
    many = np.flatnonzero(count > few)
    for at in range(0, len(many), 1024):
        x = np.zeros((len(beyond), min(1024, len(many) - at)), np.float32)
        for c, k in enumerate(many[at : at + 1024]):
            x[owner[begin[k] : begin[k] + count[k]], c] = 1
        out += (x @ x.T).astype(out.dtype)


def joining_links(node: list[int], component: list[int], n: list[int], mask: list[bytes], beyond: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links among the rows of two blocks that join different components, no more than it takes to join them."""
    bits = np.unpackbits(np.frombuffer(b"".join(mask), np.uint8).reshape(len(node), -1), axis=1).astype(np.float32)
    both = (bits @ bits.T).astype(np.int32)
    _shared_beyond([np.frombuffer(x, np.uint64) for x in beyond], both)
    size = np.array(n)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    part = np.array(component)
    near &= part[:, None] != part[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(near))):
        a, b = find(component[i]), find(component[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((min(node[i], node[j]), max(node[i], node[j])))
    return out


def compare_around(pivots: DataFrame, percent: int, block: int = AROUND) -> DataFrame:
    """(a, b) links of nodes around one pivot that lie in different components: (pivot, node, component, n, mask, beyond)."""
    blocks = cut(pivots.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "near-blocks")
    dealt = (
        pivots.join(blocks, "pivot")
        .withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .select("pivot", "i", "j", "node", "component", "n", "mask", "beyond")
        .repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out() -> pa.RecordBatch:
            links = joining_links(*map(list, zip(*rows)), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for pivot, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (pivot, i, j) != key:
                    if rows:
                        yield out()
                    key, rows = (pivot, i, j), []
                rows.append(row)
        if rows:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has an edge; the component is one of its nodes, which stands for all.

    Each round replaces every node by the first of itself and its neighbours, in an order that is drawn anew
    for the round, and drops what became a loop or a repeat. Whatever the nodes' numbers, about half of a path
    goes in a round (a star or a group of mutual neighbours goes whole), so the rounds are about the logarithm
    of the longest path. Tables of earlier rounds are removed.
    """
    edges = cut(edges.filter("a <> b").distinct(), "near-edges")
    found, turn = None, 0
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
        drawn = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        first = ends.groupBy("n").agg(F.min_by("v", drawn("v")).alias("v"))
        least = cut(first.select("n", F.when(drawn("n") <= drawn("v"), F.col("n")).otherwise(F.col("v")).alias("to")), "near-least")
        if found is None:
            found = cut(least.select(F.col("n").alias("node"), F.col("to").alias("component")), "near-found")
        else:
            moved = found.join(least.withColumnRenamed("n", "component"), "component", "left")
            found, earlier = cut(moved.select("node", F.coalesce("to", "component").alias("component")), "near-found"), found
            drop_cut(earlier)
        to_a, to_b = least.select(F.col("n").alias("a"), F.col("to").alias("x")), least.select(F.col("n").alias("b"), F.col("to").alias("y"))
        met = edges.join(to_a, "a").join(to_b, "b").filter("x <> y")
        rest = cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-edges")
        drop_cut(edges)
        drop_cut(least)
        edges, turn = rest, turn + 1
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    return _grouped(docs, shingle, percent, bands, rows).drop("text_hash", "component")


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    scanned = cut(scan(docs, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()), "near-scan")
    least = (
        scanned.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "row", "text_hash")).alias("first")).select("set_key", "first.doc_id", "first.text_hash", F.col("first.row").alias("node"))
    )
    nodes = cut(least, "near-nodes")
    buckets = cut(
        scanned.join(nodes.select(F.col("node").alias("row"), "node"), "row").select("node", "n_shingles", F.explode("bands").alias("band")),
        "near-buckets",
    )
    pivots = cut(buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot <> other").drop("other"), "near-pivots")
    mates = cut(buckets.join(pivots, "band"), "near-mates")
    drop_cut(buckets)
    stars = cut(mates.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")
    drop_cut(mates)
    around = cut(verify(docs, nodes, stars, shingle, percent), "near-around")
    edges = around.filter("near and pivot <> node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    found = components(edges)
    # Nodes around one pivot that are in different components by now are compared with each other.
    placed = around.select("pivot", "node").join(found, "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("component"))
    placed = cut(placed, "near-placed")
    split = placed.groupBy("pivot").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("pivot")
    apart = cut(around.join(cut(split, "near-split"), "pivot", "left_semi").join(placed, ["pivot", "node"]), "near-apart")
    more = cut(compare_around(apart, percent), "near-links")
    if not more.isEmpty():
        found = components(edges.union(more))
    return _labelled(scanned, nodes, found)


def _labelled(scanned: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    placed = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = cut(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-ids")
    of_set = cut(placed.join(ids, "component").select("set_key", "component_id", "component"), "near-sets")
    return (
        scanned.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
        .join(of_set, "set_key", "left")
        .select(
            "doc_id", "text_hash", "n_shingles", "component",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; repeated rows become one.

    Only rows whose doc_id and text repeat are gathered (the one with the least hash of all its columns stays);
    all others are kept or dropped where they are read, by joins with keys of a few bytes.
    """
    groups = cut(_grouped(docs, shingle, percent), "near-groups")
    least = groups.filter("kept and component is not null and doc_id is not null")  # more than one where near texts share a doc_id
    first = least.groupBy("component").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).filter("first <> last")
    later = least.join(first, "component").filter("text_hash <> first")
    dropped = cut(groups.filter("not kept").select("doc_id", "text_hash").union(later.select("doc_id", "text_hash")).distinct(), "near-dropped")
    counted = groups.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_hash")
    repeated = cut(counted, "near-repeated")

    text_hash = F.xxhash64(docs["text"])
    match = lambda keys: docs["doc_id"].eqNullSafe(keys["doc_id"]) & (text_hash == keys["text_hash"])
    alone = docs.join(dropped.union(repeated), match(dropped), "left_anti")
    copies = docs.join(repeated.join(dropped, [repeated["doc_id"].eqNullSafe(dropped["doc_id"]), repeated["text_hash"] == dropped["text_hash"]], "left_anti"), match(repeated), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = copies.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(row, F.xxhash64(row)).alias("kept_row")).select("kept_row.*")
    return alone.unionByName(one).select(*(f"`{c}`" for c in docs.columns))


#: The same rows by comparing all sets, for two-word shingles.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS shingles
  FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""
