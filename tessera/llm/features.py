"""Hashed character n-grams of words, many words at a time."""

from __future__ import annotations

import re
import sys

import numpy as np

#: Runs of letters and numerals; nearly all are letters only.
_RUN = re.compile(r"[^\W\d_]+")
#: Signs such as superscripts and fractions: numbers to the pattern's classes, but not decimal digits, and no letters.
_NUMERALS = dict.fromkeys((i for i in range(sys.maxunicode + 1) if chr(i).isnumeric() and not chr(i).isdecimal() and not chr(i).isalpha()), " ")
#: Letters of a word; a longer run goes on as a further word.
LONGEST = 24


def words(text: str) -> list[str]:
    """The words of a text in small letters: runs of letters, in parts of ``LONGEST``."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)) and max(map(len, found), default=0) <= LONGEST:
        return found
    out = []
    for run in found:
        for w in (run,) if run.isalpha() else run.translate(_NUMERALS).split():
            out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def grams(items: list[str], sizes: tuple[int, ...], bits: int, whole: bool = True) -> np.ndarray:
    """For each word the slots of its n-grams, with marks at both ends, and of the word itself.

    One row a word; places beyond a word's n-grams hold ``2 ** bits``, the slot of nothing.
    """
    none = np.int32(1 << bits)
    if not items:
        return np.full((0, 1), none, np.int32)
    wide = np.array(items, dtype=np.str_)
    length = np.char.str_len(wide)
    most = int(length.max())
    code = np.zeros((len(items), most + 2), np.uint64)
    code[:, 1:-1] = wide.view(np.uint32).reshape(len(items), -1)[:, :most]
    code[:, 0] = 1
    code[np.arange(len(items)), length + 1] = 2
    total = length + 2
    parts = []
    with np.errstate(over="ignore"):
        for n in sizes:
            if most + 2 < n:
                continue
            h = np.full((len(items), most + 3 - n), n, np.uint64)
            for j in range(n):
                h = (h ^ code[:, j : most + 3 - n + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            slot = (h >> np.uint64(64 - bits)).astype(np.int32)
            slot[np.arange(slot.shape[1])[None, :] + n > total[:, None]] = none
            parts.append(slot)
        if whole:
            h = np.full(len(items), 77, np.uint64)
            for j in range(most + 2):
                step = (h ^ code[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
                step ^= step >> np.uint64(31)
                h = np.where(j < total, step, h)
            parts.append((h >> np.uint64(64 - bits)).astype(np.int32)[:, None])
    return np.concatenate(parts, axis=1) if parts else np.full((len(items), 1), none, np.int32)


class Table:
    """Rows of numbers by word, in a growing matrix of bounded size that ``fill`` computes for new words."""

    def __init__(self, fill, width: int, most: int = 200_000):
        self.fill, self.most = fill, most
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, width), np.float32)
        self.n = 0

    def lookup(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The row numbers of each document's words, valid until the next call."""
        if self.n > self.most:
            self.at, self.n = {}, 0
        at = self.at
        fresh = sorted({w for d in docs for w in d if w not in at}, key=len)  # words of like length share few columns
        for begin in range(0, len(fresh), 1024):
            part = fresh[begin : begin + 1024]
            while self.n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(part)] = self.fill(part)
            at.update(zip(part, range(self.n, self.n + len(part))))
            self.n += len(part)
        get = at.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in docs]
