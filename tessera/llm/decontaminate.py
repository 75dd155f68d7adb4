"""Benchmark decontamination: broadcast blocks of normalised test n-grams against training token windows.

Items are cut into overlapping pieces of bounded numbers of words, and pieces are dealt to blocks whose sizes are
checked before one is fetched. A block becomes a hash set of its windows, and a smaller set of *probe* grams: each occurrence of a
window of L words contains, whatever its place, a probe of k words at a place divisible by L - k + 1.
So a task looks up one short gram every few words and verifies whole windows only around a hit.
One block needs no shuffle. With several, each scan writes the hits of a block only (no texts), which are then
joined by document.

Defined cases: null texts have no words and are never contaminated; an item without words has no
window; items are told apart by item_id; words hit by an item whose item_id is null count as hit, but no item
is named for them; windows that overlap or touch make one span, and a window that many items share names them all;
repeated documents give repeated rows; a very long text is scanned whole; an empty benchmark leaves every document clean; further columns are kept by
:func:`remove_contaminated` and ignored by :func:`scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_bytes

#: Bytes of benchmark text that one broadcast holds at most, and words of a piece of an item.
BLOCK_BYTES = 4_000_000
PIECE = 4096
WINDOW = 10

_WORD_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(c if c in _WORD_BYTES else 32 for c in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    """Words of lower-cased text: runs of letters, digits and everything beyond ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class Windows:
    """The windows of one length and their probes."""

    length: int
    items: dict[bytes, list[str]] = field(default_factory=lambda: defaultdict(list))
    probes: set[tuple[bytes, ...]] = field(default_factory=set)

    @property
    def probe_length(self) -> int:
        return (self.length + 1) // 2

    @property
    def step(self) -> int:
        return self.length - self.probe_length + 1


def build_index(rows: list[tuple[str | None, str | bytes | None]], window: int = WINDOW) -> list[Windows]:
    by_length: dict[int, Windows] = {}
    for item_id, text in sorted(rows, key=lambda r: r[0] or ""):  # the pieces of an item follow one another
        w = words(text if isinstance(text, bytes) else (text or "").encode())
        length = min(window, len(w))
        if not length:
            continue
        x = by_length.setdefault(length, Windows(length))
        for i in range(len(w) - length + 1):
            gram = w[i : i + length]
            ids = x.items[b" ".join(gram)]
            if item_id is not None and (not ids or ids[-1] != item_id):
                ids.append(item_id)
            x.probes.update(tuple(gram[j : j + x.probe_length]) for j in range(x.step))
    return list(by_length.values())


def hits(w: list[bytes], index: list[Windows]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint word intervals that windows cover, and the items whose windows occur."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for x in index:
        k, step, n = x.probe_length, x.step, len(w)
        named: set[bytes] = set()
        if n < x.length:
            continue
        columns = [w[j::step] for j in range(k)] if step > 1 else [w[j:] for j in range(k)]
        for at, gram in enumerate(zip(*columns)):
            if gram not in x.probes:
                continue
            p = at * step
            for i in range(max(0, p - step + 1), min(p, n - x.length) + 1):
                if (ids := x.items.get(whole := b" ".join(w[i : i + x.length]))) is not None:
                    if whole not in named:  # a window that comes again names the same items
                        named.add(whole)
                        items.update(ids)
                    found.append((i, i + x.length))
    return _union(found), items


def benchmark_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, the words of a piece, its size and a hash; each window of an item is in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                w = words(text)
                for begin in range(0, max(1, len(w) - window + 1), PIECE) if w else ():
                    ids.append(item_id)
                    pieces.append(b" ".join(w[begin : begin + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary())], ["item_id", "piece"])

    cut_up = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, piece binary")
    return cut_up.withColumn("size", F.octet_length("piece").cast("long")).withColumn("h", F.xxhash64("item_id", "piece"))


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[Windows]]:
    """Indexes of blocks that together hold the whole benchmark; a block is larger than ``block_bytes`` only if one piece is."""
    pieces = benchmark_pieces(benchmark, window)
    got = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    n = -(-got["n"] // block_bytes)
    bound = max(block_bytes, got["most"])
    if n > 1:
        pieces = cut(pieces.distinct(), "leak-pieces")
    dealt = F.pmod(F.col("h"), F.lit(n)) if n > 1 else F.lit(0)
    while n > 1:  # deal again, to more blocks, until none is too large; one row a block comes back
        sizes = pieces.groupBy(F.pmod(F.col("h"), F.lit(n)).alias("block")).agg(F.sum("size").alias("n"))
        if sizes.agg(F.max("n").alias("n")).first()["n"] <= bound:
            dealt = F.pmod(F.col("h"), F.lit(n))
            break
        n += -(-n // 4)
    for i in range(n):
        block = pieces.filter(dealt == i) if n > 1 else pieces
        yield build_index([(r["item_id"], bytes(r["piece"])) for r in block.select("item_id", "piece").collect()], window)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HIT = "spans array<struct<start:int,end:int>>, items array<string>"


def _scan_block(df: DataFrame, index: list[Windows], hits_only: bool) -> DataFrame:
    """doc_id, a hash of the text, n_words, spans and items of each document, or of those that the block hits."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in text_bytes(batch.column(2)):
                w = words(text)
                got, ids = hits(w, shared.value)
                n_words.append(len(w))
                spans.append([{"start": s, "end": e} for s, e in got])
                items.append(sorted(ids))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "h", "n_words", "spans", "items"],
            )
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, n_words long, {_HIT}")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id of each of ``docs`` (doc_id, text), with n_words, hit word ``spans`` and ``items``."""
    first, found = None, []
    for index in benchmark_blocks(benchmark, window, block_bytes):
        if first is None:
            first = index
            continue
        if not found:
            found.append(cut(_scan_block(docs, first, True), "leak-hits"))
        found.append(cut(_scan_block(docs, index, True), "leak-hits"))
    if not found:
        return _scan_block(docs, first or [], False).drop("h")
    # Rows of one doc_id and text have the same hits: one of each block is kept, so a list has a block's number of parts at most.
    once = reduce(DataFrame.unionByName, [x.dropDuplicates(["doc_id", "h"]) for x in found])
    parts = once.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("k")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counts = _scan_block(docs, [], False).select("doc_id", "h", "n_words")
    joined = counts.join(parts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")), "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": s, "end": e} for s, e in _union([(x["start"], x["end"]) for x in row])] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN), batch.column(3)], batch.schema.names)

    return joined.mapInArrow(merge, joined.schema)


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The counts of each document, with the hits."""
    return scan(docs, benchmark, window=window, block_bytes=block_bytes).select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long")).alias("n_hit"),
        "spans", "items",
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    out.append(text[done:])
    return "".join(out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, action: str = "document", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``action="span"``) without the contaminated spans."""
    if action not in ("document", "span"):
        raise ValueError(f"action is 'document' or 'span', not {action!r}")
    out = docs
    for index in benchmark_blocks(benchmark, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [hits(words(t), shared.value)[0] for t in text_bytes(batch.column(at))]
                if not any(found):
                    yield batch
                elif action == "document":
                    yield batch.filter(pa.array([not x for x in found]))
                else:
                    texts = [t if not x else remove_spans(t, x) for t, x in zip(batch.column(at).to_pylist(), found)]
                    arrays = list(batch.columns)
                    arrays[at] = pa.array(texts, batch.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

        out = out.mapInArrow(run, docs.schema)
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
