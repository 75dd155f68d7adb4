"""Token-id files: an adaptive context-mixing coder of ranges in independently reset, checksummed blocks.

Ids are cut into blocks of ``BLOCK``; each block starts from the same state, carries its own CRC-32 and can
be decoded alone. Inside a block an id is named by its *place*: how many others came up before it first did.
Three predictions share the range of one coding step:

* order 2: the id that last followed the two ids before, order 1: the id that last followed the one before.
  Their slots hold the context itself; a slot of another context predicts nothing;
* order 0: adaptive frequencies of all ids of the block so far, renewed with every id, and an escape, as
  frequent as new ids have been. The new ids of a block follow its places in a range coder of their own, each
  spelt as its class and the part of its class (both adaptive) and the rest evenly.

Places are coded by the range variant of asymmetric numeral systems, where what an id has need not be one
interval: every id of the block so far adds two slots, both its own, or one of them the escape's if it was new.
A decoder finds an id by looking up a slot's time; no sums of frequencies are kept. The coder of places goes
through a block from its end, with the shares that the model found from its beginning.

The shares of the orders are mixed by weights that learn, with every id and for each record of the two
predictions (how often either has held, and whether both name one id), how often each was right. All arithmetic
is on whole numbers or on doubles that IEEE rounding fixes, so that every machine decodes alike.

All blocks of a segment are coded side by side: states are arrays, and each step is a fixed number of array
operations over the blocks.

Plan: texts are range-partitioned by doc_id, about half a segment to a partition, and sorted, tokenised and coded in the task that writes a
partition's segments (Parquet rows: documents, lengths, coded blocks); offsets of partitions are one number
a partition. Reading decodes segments in parallel and checks each block's sum.

Defined cases: a null text is empty (its end id is still written); a very long text goes through whole and
may cross blocks and segments' sizes; equal doc_ids are ordered by a hash of their texts; null doc_ids come
first; an empty table writes no segment; ids may be any unsigned 32-bit numbers; further columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import distinct_words, shared_dir, slices, small_batches

#: Ids of a block (places have 12 bits) and of a segment.
BLOCK, SEGMENT = 4096, 1 << 23
#: Bytes of texts of a partition, about half a segment: each step of a coder costs much the same however many blocks it has.
PART = 20 << 20
MAGIC = b"TIDS\x04"
#: Slots of followers of two ids.
SLOT_BITS = 11
ONE_BITS = 12
#: The most that orders 2 and 1 get of ``1 << ONE_BITS``; order 0 has the rest.
FOLLOWERS = 3840
#: The least that they get. So no step has a share of more than 31 in 32 (see :func:`_units`).
FEWEST = 128
LEAST_STATE = 1 << 31
#: A range is kept from 2^30 to below 2^62; words have 32 bits.
LEAST, MASK = 1 << 30, (1 << 30) - 1

# New ids: 16 classes by binary length, each with 16 parts; the last class is spelt bit by bit beyond 2^16.
_LENGTHS = np.arange(16)
_CLASS_FIRST = np.append(0, 1 << _LENGTHS[1:])
_PART_SHIFT = np.maximum(_LENGTHS - 4, 0)

# What is known of two followers: their records (0: not seen, 1: seen, 3: has held since) and whether they are one id.
_KIND = np.arange(32)
_RECORD2, _RECORD1, _AGREE = (_KIND >> 2) & 3, _KIND & 3, _KIND >> 4
_USES2 = _RECORD2 > 0
_USES1 = (_RECORD1 > 0) & ~((_AGREE > 0) & _USES2)
# A record's counts in one number: hits of order 2, of order 1, and all. Twice the counts, and a start of one in eight or a half.
_COUNT2, _COUNT1 = 1 << 40, 1 << 20
_START = _COUNT2 * _USES2 * (1 + (_RECORD2 == 3)) + _COUNT1 * _USES1 * (1 + (_RECORD1 == 3)) + np.where((_RECORD2 == 3) | (_RECORD1 == 3), 5, 12)

# What a count of 1 at each of 16 places adds to the sums before the places.
_STEPS = (np.arange(16) > np.arange(16)[:, None]).astype(np.int16)
_ROWS = np.repeat(np.arange(2 * BLOCK, dtype=np.int16), 16).reshape(-1, 16)
# By what a record grows: no order right, order 1, order 2.
_GROWTH = np.array([2, 2 + 2 * _COUNT1, 2 + 2 * _COUNT2])


class _Encoder:
    """Range encoders of all blocks. Words may hold a carry until :meth:`finish`."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, (1 << 62) - 1, np.int64)
        self.words, self.size = np.zeros((n, 512), np.int64), np.zeros(n, np.int64)
        self.begin = np.arange(n)

    def reserve(self, more: int) -> None:
        """Room for ``more`` words of each block."""
        n, width = self.words.shape
        if (need := int(self.size.max(initial=0)) + more) > width:
            self.words = np.concatenate([self.words, np.zeros((n, max(need - width, width // 4)), np.int64)], axis=1)

    def settle(self) -> None:
        due = (self.range < LEAST).nonzero()[0]
        low, size = self.low.take(due), self.size.take(due)
        self.words[due, size] = low >> 30
        self.size[due] = size + 1
        self.low[due] = (low & MASK) << 32
        self.range[due] = self.range.take(due) << 32

    def part(self, rows: np.ndarray, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the ranges of ``rows`` to ``size`` units of ``r`` from ``start``."""
        self.low[rows] += r * start
        self.range[rows] = r * size

    def finish(self) -> list[bytes]:
        self.reserve(2)
        for word in (self.low >> 30, (self.low & MASK) << 2):
            self.words[self.begin, self.size] = word
            self.size += 1
        words = np.ascontiguousarray(self.words[:, : self.size.max(initial=0)].T)
        carry = np.zeros(len(self.size), np.int64)
        for i in range(len(words) - 1, -1, -1):
            words[i] += carry
            carry = words[i] >> 32
        out = np.ascontiguousarray(words.T.astype("<u4"))
        return [w[:k].tobytes() for w, k in zip(out, self.size)]


class _Decoder:
    def __init__(self, data: list[bytes]):
        n = len(data)
        width = max((len(d) // 4 for d in data), default=0) + 3
        words = np.zeros((n, width), np.uint32)
        for i, d in enumerate(data):
            words[i, : len(d) // 4] = np.frombuffer(d, "<u4")
        self.words = words.reshape(-1)
        # 62 bits are 30 of a second word after 32 of the first; what is left of it comes with the third.
        self.code = (words[:, 0].astype(np.int64) << 30) | (words[:, 1] >> 2)
        self.at, self.last = np.arange(n) * width + 1, np.arange(1, n + 1) * width - 2
        self.range = np.full(n, (1 << 62) - 1, np.int64)

    def settle(self) -> None:
        due = (self.range < LEAST).nonzero()[0]
        at = np.minimum(self.at.take(due), self.last.take(due))  # damaged data may ask for more
        low = (self.words.take(at).astype(np.int64) & 3) << 30
        self.code[due] = (self.code.take(due) << 32) | low | (self.words.take(at + 1) >> 2)
        self.at[due] = at + 1
        self.range[due] = self.range.take(due) << 32

    def value(self, rows: np.ndarray, r: np.ndarray, total) -> np.ndarray:
        """The unit of ``r`` that the code of ``rows`` lies in (damaged data may lie beyond)."""
        return np.clip(self.code.take(rows) // r, 0, total - 1)

    def part(self, rows: np.ndarray, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.code[rows] -= r * start
        self.range[rows] = r * size


class _Spelling:
    """New ids: class and part by how often each has been among a block's new ids, the rest evenly."""

    def __init__(self, n: int, bits: int):
        self.bits = bits
        # Sums before the classes (row 0 of a block) and before the parts of each class, and what they add up to.
        self.sums = np.tile(np.arange(16, dtype=np.int16), (n * 17, 1))
        self.total = np.full(n * 17, 16)

    def _digit(self, coder, rows: np.ndarray, at: np.ndarray, digit: np.ndarray | None) -> np.ndarray:
        total = self.total.take(at)
        r = coder.range.take(rows) // total
        if digit is None:
            under = (self.sums.take(at, axis=0) <= _ROWS.take(coder.value(rows, r, total), axis=0)).view(np.uint64)
            digit = np.bitwise_count(under).sum(axis=1, dtype=np.int64) - 1
        flat = self.sums.reshape(-1)
        start = flat.take((at << 4) + digit).astype(np.int64)
        end = np.where(digit == 15, total, flat.take(np.minimum((at << 4) + digit + 1, flat.size - 1)))
        coder.part(rows, r, start, end - start)
        coder.settle()
        self.sums[at] = self.sums.take(at, axis=0) + _STEPS.take(digit, axis=0)
        self.total[at] = total + 1
        return digit

    def _even(self, coder, rows: np.ndarray, bits, value: np.ndarray | None) -> np.ndarray:
        r = coder.range.take(rows) >> bits
        if value is None:
            value = coder.value(rows, r, np.int64(1) << bits)
        coder.part(rows, r, value, np.int64(1))
        coder.settle()
        return value

    def code(self, coder, rows: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        part = rest = kind = None
        if ids is not None:
            kind = np.minimum(np.frexp(np.maximum(ids, 1).astype(np.float64))[1] - 1, 15).astype(np.int64)
            shift = _PART_SHIFT.take(kind)
            part = np.minimum((ids - _CLASS_FIRST.take(kind)) >> shift, 15)
            rest = ids - _CLASS_FIRST.take(kind) - (part << shift)
        kind = self._digit(coder, rows, rows * 17, kind)
        out = np.zeros(len(rows), np.int64)
        wide = (kind == 15) & (self.bits > 16)
        own = np.flatnonzero(~wide)
        if len(own):
            k, at = kind[own], rows[own]
            digit = self._digit(coder, at, at * 17 + 1 + k, None if ids is None else part[own])
            left = self._even(coder, at, _PART_SHIFT.take(k), None if ids is None else rest[own])
            out[own] = _CLASS_FIRST.take(k) + (digit << _PART_SHIFT.take(k)) + left
        own = np.flatnonzero(wide)
        for low, size in ((16, self.bits - 16), (0, 16)) if len(own) else ():
            piece = None if ids is None else (ids[own] >> low) & ((1 << size) - 1)
            out[own] |= self._even(coder, rows[own], np.int64(size), piece) << low
        return out


class _Followers:
    """Orders 2 and 1 of all blocks, and what each order has of ``1 << ONE_BITS`` at the next id."""

    def __init__(self, n: int):
        self.blocks = np.arange(n)
        self.slots, self.slots2, self.of_kind = self.blocks * BLOCK, self.blocks << SLOT_BITS, self.blocks * 32
        # The place that last followed a context, and its record: 4 * place + record. Contexts of order 2 stand beside.
        self.one, self.two, self.context = np.zeros(n * BLOCK, np.int16), np.zeros(n << SLOT_BITS, np.int16), np.full(n << SLOT_BITS, -1, np.int32)
        self.records = np.tile(_START, n)
        self.before = self.earlier = np.zeros(n, np.int64)
        self.bounds = np.zeros((4, n), np.int64)  # where the shares of order 0, 1 and 2 end, and 0
        self.bounds[0] = 1 << ONE_BITS

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of orders 1 and 2, and the ends of their shares."""
        self.slot1 = self.before + self.slots
        self.both = (self.before << 12) + self.earlier
        self.slot2 = (((self.both * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - SLOT_BITS)) + self.slots2
        self.follows1 = self.one.take(self.slot1)
        self.follows2 = self.two.take(self.slot2) * (self.context.take(self.slot2) == self.both)
        self.id1, self.id2 = self.follows1 >> 2, self.follows2 >> 2
        self.kind = (((self.follows2 & 3) << 2) | (self.follows1 & 3) | ((self.id1 == self.id2) << np.int8(4))) + self.of_kind
        self.known = self.records.take(self.kind)
        right2 = self.known >> 40
        share = FOLLOWERS / (self.known & 0xFFFFF)
        np.maximum(((right2 + ((self.known >> 20) & 0xFFFFF)) * share).astype(np.int64), FEWEST, out=self.bounds[1])
        self.bounds[2] = right2 * share
        return self.id1, self.id2, self.bounds[1], self.bounds[2]

    def share(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each block's order begins, and how wide it is."""
        at = order * np.int64(len(order)) + self.blocks
        begin = self.bounds.take(at + len(order))
        return begin, self.bounds.take(at) - begin

    def learn(self, now: np.ndarray, order: np.ndarray) -> None:
        self.records[self.kind] = self.known + _GROWTH.take(order)
        # A follower that held is marked so, another takes its place.
        other = ((now << 2) | 1).astype(np.int16)
        self.two[self.slot2] = np.where((now == self.id2) & (self.follows2 > 0), self.follows2 | np.int16(2), other)
        self.one[self.slot1] = np.where((now == self.id1) & (self.follows1 > 0), self.follows1 | np.int16(2), other)
        self.context[self.slot2] = self.both
        self.earlier, self.before = self.before, now


def _places(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id of each row: place, slots before it and where its id begins in the row's order (12, 14 bits and the rest
    of one number), whether it is new in the row, and the times of the row's ids in order of ids, then of its new ids."""
    n, width = grid.shape
    facts, fresh, times = np.zeros(grid.shape, np.int64), np.zeros(grid.shape, bool), np.zeros((n, 2 * width), np.int16)
    for begin in range(0, n, 64):
        x = grid[begin : begin + 64]
        if int(x.max(initial=0)) < 1 << 16:
            x = x.astype(np.uint16)  # sorted by digits
        order = np.argsort(x, axis=1, kind="stable")
        ordered = np.take_along_axis(x, order, axis=1)
        first = np.ones(x.shape, bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        new = np.zeros(x.shape, bool)
        np.put_along_axis(new, order, first, axis=1)
        names = np.cumsum(new, axis=1, dtype=np.int16) - np.int16(1)
        led = np.take_along_axis(names, order, axis=1).reshape(-1)
        each = np.arange(x.size)
        at = np.maximum.accumulate(np.where(first.reshape(-1), each, 0))
        slots = np.maximum(2 * (each - at) - 1, 0)
        packed = led.take(at) | (slots << 12) | ((at % width) << 26)
        np.put_along_axis(facts[begin : begin + 64], order, packed.reshape(x.shape), axis=1)
        fresh[begin : begin + 64] = new
        times[begin : begin + 64, :width] = order
        rows, when = new.nonzero()
        times[begin + rows, width + names[rows, when]] = when
    return facts, fresh, times


def _units(t: int) -> int:
    """States before id ``t`` are from (units << ONE_BITS) * 2 * t to below 2^32 times that: at most 2^63, less by a 64th at most."""
    return LEAST_STATE // (2 * t << ONE_BITS)


def _least(t: int) -> int:
    return _units(t) * (2 * t << ONE_BITS)


def _encode_places(grid: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each row's places, coded, and the transposed marks of new ids. The orders look forward; the coder goes back."""
    n, longest = grid.shape
    facts, fresh, times = _places(grid)
    facts, news, times = np.ascontiguousarray(facts.T), np.ascontiguousarray(fresh.T), times.reshape(-1)
    del fresh
    follow, shares = _Followers(n), np.zeros((longest, n), np.int32)
    for t in range(1, longest):
        id1, id2, end1, end2 = follow.predict()
        now = facts[t] & 0xFFF
        hit2 = (now == id2) & (end2 > 0)
        order = (hit2 | ((now == id1) & (end1 > end2))).view(np.int8) + hit2.view(np.int8)
        begin, size = follow.share(order)
        shares[t] = begin | (size << 12) | ((order > 0) << 25)
        follow.learn(now, order)
    state, distinct, base = np.full(n, _least(longest)), news.sum(axis=0, dtype=np.int64), np.arange(n) * (2 * longest)
    words, count = np.zeros((n, 2048), np.uint32), np.zeros(n, np.int64)
    for t in range(longest - 1, 0, -1):
        if not t % 64 and (need := int(count.max(initial=0)) + 65) > words.shape[1]:
            words = np.concatenate([words, np.zeros((n, max(need - words.shape[1], words.shape[1] // 4)), np.uint32)], axis=1)
        new, fact, share = news[t], facts[t], shares[t]
        distinct -= new
        begin, width, hit = share & 0xFFF, ((share >> 12) & 0x1FFF).astype(np.int64), share >= 1 << 25
        size = np.where(new, distinct, (fact >> 12) & 0x3FFF)
        np.copyto(size, 2 * t, where=hit)
        due = ((state >> 32) >= size * width * _units(t)).nonzero()[0]
        full, at = state.take(due), count.take(due)
        words[due, at] = full & 0xFFFFFFFF
        count[due] = at + 1
        state[due] = full >> 32
        # One of the slots that the id, or the escape, has among the 2 * t slots of the ids before; a follower needs none.
        part = (state.view(np.uint64) // size.view(np.uint64)).view(np.int64)
        k = state - part * size
        when = times.take(base + np.where(new, k + longest, (fact >> 26) + ((k + 1) >> 1))).astype(np.int64)
        slot = (when << 1) + (new | ((k & 1 == 0) & (k > 0)))
        np.copyto(slot, k, where=hit)
        whole = part * (2 * t) + slot
        part = (whole.view(np.uint64) // width.view(np.uint64)).view(np.int64)
        state = (part << ONE_BITS) + (whole - part * width) + begin
    head = state.astype("<u8")
    return [head[i : i + 1].tobytes() + words[i, :c][::-1].astype("<u4").tobytes() for i, c in enumerate(count.tolist())], news


def _decode_places(data: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that rows have at each time, and how many ids are new in each row."""
    n = len(data)
    width = max(len(d) // 4 for d in data) + 1
    words = np.zeros((n, width), np.int64)
    for i, d in enumerate(data):
        words[i, : len(d) // 4 - 2] = np.frombuffer(d, "<u4", offset=8)
    at, last, words = np.arange(n) * width, np.arange(1, n + 1) * width - 1, words.reshape(-1)
    state = np.array([struct.unpack_from("<q", d)[0] for d in data])
    follow, blocks, slots = _Followers(n), np.arange(n), np.arange(n) * BLOCK
    # Of the two slots that an id added: its place, and how many its id had before; an id that was new gave one to the escape.
    history, counts, distinct = np.zeros((longest, n), np.int32), np.zeros(n * BLOCK, np.int16), np.ones(n, np.int64)
    flat = history.reshape(-1)
    counts[slots] = 1
    for t in range(1, longest):
        id1, id2, end1, end2 = follow.predict()
        code = state & ((1 << ONE_BITS) - 1)
        hit2, hit = code < end2, code < end1
        order = hit.view(np.int8) + hit2.view(np.int8)
        begin, wide = follow.share(order)
        whole = (state >> ONE_BITS) * wide + (code - begin)
        part = whole // (2 * t)
        value = whole - part * (2 * t)
        fact = flat.take((value >> 1) * n + blocks)
        low, place, had = value & 1, fact & 0xFFF, fact >> 12
        escape = had < low
        now = np.where(escape, distinct, place)
        np.copyto(now, np.where(hit2, id2, id1), where=hit)
        mine = now + slots
        size = counts.take(mine)
        state = part * np.where(escape, distinct, size) + np.where(escape, place, had + low)
        np.copyto(state, whole, where=hit)
        due = (state < _least(t + 1)).nonzero()[0]
        from_ = np.minimum(at.take(due), last.take(due))  # damaged data may ask for more
        state[due] = (state.take(due) << 32) | words.take(from_)
        at[due] = from_ + 1
        new = size == 0
        counts[mine] = size + (np.int16(2) - new)
        history[t] = now | (size.astype(np.int32) << 12)
        distinct += new
        follow.learn(now, order)
    return history & 0xFFF, distinct


def _spell(n: int, bits: int, coder, distinct: np.ndarray, ids: np.ndarray | None) -> np.ndarray | None:
    """New ids after the places: ``ids`` of all blocks to an encoder, or a row for each block from a decoder."""
    spelling, names = _Spelling(n, bits), np.zeros((n, BLOCK), np.uint32) if ids is None else None
    at = np.cumsum(distinct) - distinct
    for k in range(int(distinct.max(initial=0))):
        if ids is not None and not k % 64:
            coder.reserve(64 * 5)
        rows = (distinct > k).nonzero()[0]
        found = spelling.code(coder, rows, None if ids is None else ids.take(at.take(rows) + k))
        if ids is None:
            names[rows, k] = found
    return names


def encode_ids(ids: np.ndarray) -> bytes:
    """The coded blocks of a run of ids."""
    ids = np.asarray(ids).astype(np.uint32, copy=False)
    n = -(-len(ids) // BLOCK)
    longest = min(BLOCK, len(ids))
    bits = int(ids.max(initial=0)).bit_length()
    lengths = np.full(n, BLOCK)
    coded = []
    if n:
        lengths[-1] = len(ids) - (n - 1) * BLOCK
        grid = np.zeros(n * longest, np.uint32)  # the last block is filled up
        grid[: len(ids)] = ids
        grid = grid.reshape(n, longest)
        places, news = _encode_places(grid)
        coder = _Encoder(n)
        _spell(n, bits, coder, news.sum(axis=0, dtype=np.int64), grid[news.T].astype(np.int64))
        coded = [struct.pack("<I", len(x)) + x + y for x, y in zip(places, coder.finish())]
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4", copy=False).tobytes()) for i in range(n)]
    head = struct.pack("<5sII", MAGIC, n, bits) + b"".join(struct.pack("<III", k, len(d), s) for k, d, s in zip(lengths.tolist(), coded, sums))
    return head + b"".join(coded)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of :func:`encode_ids`; each block's sum is checked."""
    magic, n, bits = struct.unpack_from("<5sII", data)
    if magic != MAGIC:
        raise ValueError("not a token-id segment")
    heads = [struct.unpack_from("<III", data, 13 + 12 * i) for i in range(n)]
    at, coded = 13 + 12 * n, []
    for _, size, _ in heads:
        coded.append(data[at : at + size])
        at += size
    if not n:
        return np.zeros(0, np.uint32)
    longest = BLOCK if n > 1 else heads[0][0]
    ends = [min(max(int.from_bytes(d[:4], "little"), 8), len(d) - 4) + 4 for d in coded]
    places, distinct = _decode_places([d[4:e] for d, e in zip(coded, ends)], longest)
    names = _spell(n, bits, _Decoder([d[e:] for d, e in zip(coded, ends)]), distinct, None)
    for begin in range(0, n, 64):  # places give way to ids
        own = names[begin : begin + 64]
        own[:, :longest] = np.take_along_axis(own, places[:, begin : begin + 64].T.astype(np.int64), axis=1)
    grid = np.ascontiguousarray(names[:, :longest], "<u4")
    for i, (k, _, total) in enumerate(heads):
        if zlib.crc32(grid[i, :k].tobytes()) != total:
            raise ValueError(f"block {i} is damaged")
    return grid.reshape(-1)[: sum(h[0] for h in heads)]


#: Fixed values of the byte-level format: the sign of each byte, itself where it can be seen, and else the next above 255.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
#: Words whose small letters and normal form are plain: ASCII signs, digits and the letters of Latin-1.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _pattern(file: dict) -> regex.Pattern | None:
    """The pattern that cuts words into pieces, if the tokenizer lower-cases and maps bytes and does nothing more."""
    kinds = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or file.get("post_processor"):
        return None
    if (m := file["model"])["type"] != "BPE" or m.get("dropout") or m.get("continuing_subword_prefix") or m.get("ignore_merges") or not m.get("end_of_word_suffix"):
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"])


class Tokens:
    """Ids of texts by a tokenizer file: each distinct word is encoded once while the bounded table holds it.

    White space separates words in the tokenizer's own rules, so a text's ids are its words' ids in turn. Words of
    Latin letters, digits and ASCII signs are cut by the tokenizer file's own pattern, and the file's merges are made in
    all their pieces side by side; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path) as f:
            file = json.load(f)
        self.pieces = _pattern(file)
        if self.pieces:
            self._merges(file["model"])
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offset, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def _merges(self, model: dict) -> None:
        """The model's tables: ids of single bytes, within a piece and at its end, and by pair of ids the merge's number."""
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = [chr(_BYTE_SIGNS.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[x + tail] for x in signs], np.int32) for tail in ("", end))
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        self.order = np.append(np.argsort(keys), len(pairs)).astype(np.int32)
        self.keys = np.append(np.sort(keys), np.iinfo(np.int64).max)

    def _numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merges of pairs, past the last one where there is none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at) == key, self.order.take(at), np.int32(len(self.made)))

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each piece has): in each round every piece makes its first merge, of the least number."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max(initial=1))
        given = np.frombuffer(b"".join(pieces), np.uint8)
        out = np.full((len(pieces), width), -1, np.int32)
        out[np.arange(width) < size[:, None]] = self.inner.take(given)
        out[np.arange(len(pieces)), size - 1] = self.last.take(given.take(np.cumsum(size) - 1))
        for least, most in ((2, 6), (7, 10), (11, 16), (17, width)):
            rows = ((size >= least) & (size <= most)).nonzero()[0]
            w = min(most, width)
            ids = out[rows, :w]
            numbers = self._numbers(ids[:, :-1], ids[:, 1:])
            while len(rows) and w > 1:
                each, j = np.arange(len(rows)), numbers.argmin(axis=1)
                best = numbers[each, j]
                if not (more := best < len(self.made)).all():
                    out[rows[~more], :w], out[rows[~more], w:] = ids[~more], -1
                    rows, ids, numbers, best, j = rows[more], ids[more], numbers[more], best[more], j[more]
                    each = np.arange(len(rows))
                ids[each, j] = self.made.take(best)
                ids = ids[np.arange(w) != (j + 1)[:, None]].reshape(len(rows), w - 1)
                numbers = numbers[np.arange(w - 1) != j[:, None]].reshape(len(rows), w - 2)
                w -= 1
                for at in (j - 1, j):
                    own = ((at >= 0) & (at < w - 1)).nonzero()[0]
                    numbers[own, at[own]] = self._numbers(ids[own, at[own]], ids[own, at[own] + 1])
            out[rows, :w], out[rows, w:] = ids, -1
        return out[out >= 0].astype(np.uint32), (out >= 0).sum(axis=1)

    def _cut(self, word: str) -> list[str]:
        """The pieces of a plain word in small letters."""
        if word.isalpha():
            return [word]
        if not word[-1].isalnum() and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces.findall(word)

    def _learn(self, fresh: list[str]) -> None:
        """Put words into the table; a piece that words share is merged once."""
        at: dict[str, int] = {}  # places of pieces
        plain, parts, many, other = [], [], [], []
        for w in fresh:
            if not self.pieces or len(w) > 24:
                other.append(w)
            elif w.isascii() and w.isalpha():
                plain.append(w)
                parts.append(at.setdefault(w.lower(), len(at)))
                many.append(1)
            elif _PLAIN.fullmatch(w) and "<|" not in w:
                cut = self._cut(w.lower())
                plain.append(w)
                parts += [at.setdefault(p, len(at)) for p in cut]
                many.append(len(cut))
            else:
                other.append(w)
        if plain:
            ids, size = self._merged([p.encode() for p in at])
            each, parts = np.cumsum(np.append(0, many)), np.array(parts)
            size, begin = size.take(parts), (np.cumsum(size) - size).take(parts)
            ends = np.append(0, np.cumsum(size))
            self._put(plain, ids.take(np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])), np.diff(ends[each]))
        if other:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            self._put(other, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size)

    def _put(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        end = self.n + len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while end > len(self.offset):
            self.offset, self.size = np.concatenate([self.offset, self.offset]), np.concatenate([self.size, self.size])
        self.ids[self.used : self.used + len(ids)] = ids
        self.offset[self.n : end] = self.used + np.cumsum(size) - size
        self.size[self.n : end] = size
        self.at.update(zip(words, range(self.n, end)))
        self.n, self.used = end, self.used + len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        if self.n > self.most:
            self._clear()
        words, places, bounds = distinct_words(pc.ascii_split_whitespace(texts))
        rows = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(rows < 0)
        for begin in range(0, len(fresh), 20_000):
            part = [words[i] for i in fresh[begin : begin + 20_000]]
            self._learn(part)
            rows[fresh[begin : begin + 20_000]] = list(map(self.at.__getitem__, part))
        offset, size = self.offset[rows].take(places), self.size[rows].take(places)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(offset - ends[:-1], size)
        at += np.arange(len(at))
        return self.ids.take(at), np.diff(ends[bounds])


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)  # the table holds no cycles
    return _TOKENS[path]


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write segments to ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (PART >> 2))))
    ordered = (
        docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer)
        part = TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, base, number = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, held, base, number
            row = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([base]), pa.array([doc_ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([encode_ids(np.concatenate(ids))], pa.binary())],
                ["part", "number", "base", "doc_ids", "lengths", "blocks"],
            )
            base, number, held, doc_ids, lengths, ids = base + held, number + 1, 0, [], [], []
            return row

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = iter(batch.column(0).to_pylist())
            for texts in slices(batch.column(1), 12 << 20):
                found, sizes = encoder.encode(texts)
                for x in np.split(found, np.cumsum(sizes)[:-1]):
                    doc_ids.append(next(keys))
                    lengths.append(len(x) + 1)
                    ids += [x, np.array([end_id], np.uint32)]
                    held += len(x) + 1
                    if held >= SEGMENT:
                        yield segment()
        if doc_ids:
            yield segment()

    schema = f"part int, number int, base long, doc_ids array<{kind}>, lengths array<long>, blocks binary"

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in run(batches):
            yield pa.RecordBatch.from_arrays([row.column(0).cast(pa.int32()), row.column(1).cast(pa.int32()), *row.columns[2:]], row.schema.names)

    ordered.mapInArrow(cast, schema).write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files at ``path``."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    offsets, before = [], 0
    for r in sorted(sizes.collect()):  # one row a written partition
        offsets.append((r["part"], before))
        before += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, doc_ids, lengths, blocks in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                ids = decode_ids(blocks)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, batch.schema.field(3).type.value_type), pa.array(np.full(len(doc_ids), part, np.int32)), pa.array(base + ends - np.array(lengths)), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "at", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "number", "base", "doc_ids", "lengths", "blocks").mapInArrow(run, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    starts = spark.createDataFrame(offsets, "part int, start long")
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to the shared folder and describe what the files hold."""
    spark = docs.sparkSession
    small_batches(spark, "12m")
    path = f"{shared_dir(spark)}/tessera/token-ids-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, end_id=end_id)
    return read(spark, path)
