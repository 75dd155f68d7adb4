"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is the merge result of a text exactly if each two neighbours are: merging the two
pieces' text again gives those two pieces. So we search for the one sequence of compatible neighbours:
an Aho-Corasick automaton gives the longest piece at each place, a piece that is not compatible with the
one before it is replaced by its next shorter prefix piece, and a bitfield remembers the places from
which no way leads on. Compatibility is decided by re-merging and remembered.

Words are independent (no piece holds the space mark after another character), so each task encodes each
distinct word once while its bounded cache holds it: column functions split a batch's texts into words and
tell which are different, and join what is known of each. Runs of spaces go on their own: their pieces all
have the same, lowest score, which makes them the last merges.

Defined cases: null text is empty and gives no ids; decoding no ids gives the empty text; unknown
characters become their UTF-8 bytes' ids; further columns are ignored; repeated rows stay repeated; very
long texts and runs of spaces take time in proportion to their length.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import distinct_words, slices

SPACE = "▁"
#: Fixed values of the model file format: field numbers of a piece and its types.
_PIECE, _TEXT, _SCORE, _TYPE = 1, 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE = 140_000
#: Bytes of text that are encoded at a time: what is known of their words is held together.
SLICE = 6 << 20
#: Longer words are not cached.
LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message: varints, 32-bit and 64-bit values and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    pieces = []
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == _PIECE:
            piece = {_TYPE: NORMAL, _SCORE: b"\0\0\0\0"} | dict(_fields(value))
            pieces.append((piece[_TEXT].decode(), struct.unpack("<f", piece[_SCORE])[0], piece[_TYPE]))
    return pieces


class Recent:
    """A bounded memory of two generations: what was used since the last change stays."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PieceBpe:
    """Encoder and decoder of one model of merge type with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL,) else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.is_byte = [kind == BYTE for _, _, kind in pieces]
        # Only pieces that the merges reach can stand in a result.
        reached = [p for p in self.score if set(p) != {SPACE} and self.merge(p) == [p]]
        reached.append(SPACE)
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        alive = set(reached)
        #: Pieces of spaces only, by length: the first of a run of so many spaces.
        self.spaces = [SPACE * max((k for k in range(1, n + 1) if SPACE * k in self.score), default=1) for n in range(1, 1 + max(len(p) for p in self.score if set(p) == {SPACE}))]
        alive |= set(self.spaces)
        #: The next shorter piece that begins a piece.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in alive), None) for p in alive}
        self.fits: dict[tuple[str, str], bool] = {}
        self.joined = {p[i : i + 2] for p in reached for i in range(len(p) - 1)}
        self.parts: Recent = Recent(CACHE // 4)
        self.cache: Recent = Recent(CACHE)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        longest: list[str | None] = [None] * len(text)
        for end, p in self.automaton.iter(text):
            start = end - len(p) + 1
            if longest[start] is None or len(longest[start]) < len(p):
                longest[start] = p
        return self._search(text, longest)

    def run(self, marks: int) -> list[str]:
        """The pieces of a run of spaces."""
        most = len(self.spaces)
        return self._search(SPACE * marks, [self.spaces[min(most, marks - at) - 1] for at in range(marks)])

    def _search(self, text: str, longest: list[str | None]) -> list[str]:
        """The compatible pieces of a text, from the longest that begins at each place."""
        failed = bytearray(len(text) + 1)
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < len(text):
            while piece is not None and (failed[at + len(piece)] or out and not self.compatible(out[-1], piece)):
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < len(text) else None
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
        return out

    def word(self, word: str) -> list[int]:
        """Ids of one word with the space marks before it."""
        bare = word.lstrip(SPACE)
        marks = len(word) - len(bare)
        pieces: list[str] = []
        if bare:
            for part in self._parts(SPACE + bare if marks else bare):
                pieces += self.part(part)
            marks -= bool(marks)
            if marks and pieces[0] == SPACE:
                del pieces[0]
                marks += 1
        ids = [self.id[p] for p in self.run(marks)] if marks else []
        known = self.id
        for p in pieces:
            if p in known:
                ids.append(known[p])
            else:
                ids += [self.byte_id[b] for b in p.encode()]
        return ids

    def part(self, part: str) -> list[str]:
        """Pieces of a part that no piece crosses the ends of; kept, as words differ by their punctuation."""
        got = self.parts.get(part)
        if got is None:
            got = self.backtrack(part) if len(part) > 1 or part in self.id else [part]
            if len(part) <= LONG:
                self.parts.put(part, got)
        return got

    def _parts(self, text: str) -> list[str]:
        """``text`` cut between each two characters that follow one another in no piece (and so at unknown ones)."""
        joined, out, begin = self.joined, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                out.append(text[begin:i])
                begin = i
        out.append(text[begin:])
        return out

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def known(self, chunk: str) -> tuple[int, bytes, bytes, bytes]:
        """(number of ids, ids in decimal, decoded bytes, ids as 32-bit integers) of a chunk."""
        got = self.cache.new.get(chunk) or self.cache.get(chunk)
        if got is None:
            ids = self.word(chunk)
            got = (len(ids), ",".join(map(str, ids)).encode(), b"".join([self.bytes[i] for i in ids]), array("i", ids).tobytes())
            if len(chunk) <= LONG:
                self.cache.put(chunk, got)
        return got

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers."""
        return b"".join([self.known(c)[3] for c in self.chunks(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join([self.bytes[i] for i in ids]))

    @staticmethod
    def _text(data: bytes) -> str:
        """Decoded bytes without the dummy prefix's space."""
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def found(self, texts: pa.Array) -> tuple[list[tuple[int, bytes, bytes, bytes]], np.ndarray, np.ndarray]:
        """What is known of the different chunks of texts, the place among them of each chunk, and the first chunk of each text.

        Words are what spaces divide; only where spaces stand together or at an end, or a text holds the
        space mark itself, chunks are cut by the pattern.
        """
        odd = pc.or_(pc.match_substring_regex(texts, f"^ | $|  |{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if not odd.any():
            words, places, bounds = distinct_words(lists)
            return [self.known(SPACE + w) for w in words], places, bounds
        words, places, bounds = distinct_words(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
        known = [self.known(SPACE + w) for w in words]
        parts, sizes = np.split(places, bounds[1:-1]), np.diff(bounds)
        for i in np.flatnonzero(odd):
            chunks = self.chunks(texts[i].as_py())
            parts[i], sizes[i] = np.arange(len(known), len(known) + len(chunks)), len(chunks)
            known += map(self.known, chunks)
        return known, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Counts and hashes of the ids, and hashes of the texts that they decode to."""
        known, places, bounds = self.found(texts)
        at, offsets = pa.array(places), pa.array(bounds.astype(np.int32))

        def joined(k: int, by: bytes) -> list[bytes]:
            if texts.nbytes > 1 << 27:  # one very long text: its result may outgrow a column of this kind
                return [by.join([known[i][k] for i in places[a:b].tolist()]) for a, b in zip(bounds, bounds[1:])]
            return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in known], pa.binary()).take(at)), by).to_pylist()

        ends = np.concatenate([[0], np.cumsum(np.array([x[0] for x in known], np.int64)[places])])
        ids = [hashlib.sha256(x).hexdigest() for x in joined(1, b",")]
        decoded = [hashlib.sha256(self._text(x).encode()).hexdigest() for x in joined(2, b"")]
        return np.diff(ends[bounds]), ids, decoded


_MODELS: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    """One encoder a worker and model: its cache of words outlives a task."""
    if path not in _MODELS:
        _MODELS[path] = PieceBpe(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)  # the cache holds no cycles
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            begin = 0
            for texts in slices(batch.column(1), SLICE):
                known, places, bounds = bpe.found(texts)
                ends = np.concatenate([[0], np.cumsum(np.array([x[0] for x in known], np.int64)[places])])
                packed = b"".join([known[i][3] for i in places.tolist()])
                ids = pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(np.frombuffer(packed, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), ids], ["doc_id", "ids"])
                begin += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            begin = 0
            for texts in slices(batch.column(1), SLICE):
                n, ids, decoded = bpe.digests(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                begin += len(texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
