"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation over the
counts of vote patterns (a table bounded by 3 ^ heuristics, whatever the corpus) estimates how often each
heuristic gives each vote in either class. The posterior labels train a hashed linear scorer over token
shapes, which judges each document.

Plan: one scan for votes (counted before the shuffle), one for a bounded sample of documents' features,
one to score; only the sample's texts are shuffled, to take copies once.

Defined cases: a null text is empty; a text without words has no features and gets the prior's score, and
is kept; a very long text counts whole, in shares of its tokens; a score of exactly ``keep_from`` keeps; repeated
rows get equal scores; an empty table gives an empty result; further columns are kept
by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, text_strings

#: Documents that the scorer is fitted on at most (about; chosen by a hash of their text).
SAMPLE = 4000
SLOTS = 1 << 12
#: Frequent words of four languages.
COMMON = frozenset(
    "the of and to in a is that it for on with as was by an be at this are or from "
    "de la le les et des un une est dans que qui par sur au du en "
    "der die und das ist von zu den mit sich auf für ein nicht "
    "el los las por se del con para lo como más su".split()
)
_SYMBOLS = b"#$%&*|<>{}[]~^@=\\"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of ASCII, and all bytes of what is beyond it.
_LETTERS = _CAPITALS + _CAPITALS.lower() + bytes(range(128, 256))

HEURISTICS = ("capitals", "exclaims", "symbols", "separators", "repeats", "word_length", "common_words", "letters", "distinct")


def votes(text: str) -> tuple[int, ...]:
    """1 good, -1 bad, 0 no vote, of each heuristic."""
    w = text.split()
    n = len(w)
    if not n:
        return (0,) * len(HEURISTICS)
    data = text.encode()
    size = len(data)
    rest = len(data.translate(None, _LETTERS))
    letters = size - rest or 1
    capitals = (size - len(data.translate(None, _CAPITALS))) / letters
    exclaims = text.count("!!") / n
    symbols = (size - len(data.translate(None, _SYMBOLS))) / size
    separators = (text.count(" | ") + text.count(" - ") + text.count(" > ")) / n
    repeats = sum(map(str.__eq__, w, w[1:])) / n
    mean = (len(text) - text.count(" ")) / n
    common = sum(map(COMMON.__contains__, w)) / n
    distinct = len(set(w)) / n
    alpha = (letters + n) / size
    some, more = n > 8, n > 20
    return (
        -1 if capitals > 0.22 and some else 1,
        -1 if exclaims > 0.05 and some else 1,
        -1 if symbols > 0.03 and some else 1 if symbols < 0.01 else 0,
        -1 if separators > 0.06 and some else 1,
        (-1 if repeats > 0.12 else 1 if repeats < 0.06 else 0) if some else 0,
        (-1 if not 2.2 < mean < 14 else 1) if more else 0,
        (-1 if common < 0.01 else 1 if common > 0.08 else 0) if more else 0,
        (-1 if alpha < 0.72 else 1) if size > 300 else 0,
        -1 if 60 < n < 3000 and distinct < 0.12 else 1 if more and distinct > 0.2 else 0,
    )


def pattern(text: str) -> int:
    code = 0
    for v in votes(text):
        code = code * 3 + v + 1
    return code


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n): how many documents got each combination of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in pieces(batches, 0):
            for text in text_strings(batch.column(0)):
                p = pattern(text)
                counts[p] = counts.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class LabelModel:
    """P(good) and, by class and heuristic, the probability of a good vote where the heuristic votes."""

    prior: float
    good: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of vote codes; no vote says nothing."""
        votes = _digits(patterns)
        logs = np.stack([np.where(votes == 2, np.log(g), np.where(votes == 0, np.log(1 - g), 0.0)).sum(axis=1) for g in self.good])
        logs += np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def accuracy(self) -> dict[str, float]:
        """How often a vote of each heuristic is right."""
        return dict(zip(HEURISTICS, (1 - self.prior) * (1 - self.good[0]) + self.prior * self.good[1]))


def _digits(patterns: np.ndarray) -> np.ndarray:
    """Votes by code: 0 bad, 1 none, 2 good."""
    m = len(HEURISTICS)
    return (np.asarray(patterns, np.int64).reshape(-1, 1) // 3 ** np.arange(m - 1, -1, -1)[None, :]) % 3


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation. To begin with a bad vote is strong evidence and a good one weak: bad documents
    are bad in one way and look good to the heuristics of all others."""
    m = len(HEURISTICS)
    model = LabelModel(0.8, np.stack([np.full(m, 0.6), np.full(m, 0.98)]))
    votes = _digits(patterns)
    for _ in range(rounds if len(patterns) else 0):
        p = model.posterior(patterns)
        for c, share in enumerate((counts * (1 - p), counts * p)):
            voted = ((votes != 1) * share[:, None]).sum(axis=0)
            model.good[c] = (((votes == 2) * share[:, None]).sum(axis=0) + (1, 2)[c]) / (voted + 2 + c * 0.02)
        model.good = np.clip(model.good, 1e-4, 1 - 1e-4)
        model.prior = float(np.clip((counts * p).sum() / counts.sum(), 0.02, 0.98))
    return model


#: Characters of a piece of a token, and marks of a shape; a longer token has more pieces, more marks make more shapes.
PIECE, MARKS = 48, 12
#: Pieces whose shapes a worker remembers.
REMEMBERED = 100_000
_SHAPES: dict[str, tuple[int, ...]] = {}


def _slot(shape: str) -> int:
    slot = 7
    for ch in shape:
        slot = (slot * 131 + ord(ch)) & 0x7FFFFFFF
    return slot * 2654435761 % (1 << 32) >> 20


def _shapes(piece: str) -> tuple[int, ...]:
    """The slots of a piece's shapes: runs of capitals, small letters and digits as one mark each, signs as they are."""
    out = ""
    for ch in piece:
        mark = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
        if mark != out[-1:]:
            out += mark
    return tuple(_slot(out[i : i + MARKS]) for i in range(0, len(out), MARKS))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of token shapes, of neighbouring shapes and of repeated tokens, in hashed slots.

    Every character counts: a token longer than ``PIECE`` goes in piece by piece.
    """
    w = text.split()
    out = np.zeros(SLOTS, np.float32)
    if not w:
        return out
    shapes: list[int] = []
    for x in w:
        for piece in (x,) if len(x) <= PIECE else (x[i : i + PIECE] for i in range(0, len(x), PIECE)):
            s = _SHAPES.get(piece)
            if s is None:
                if len(_SHAPES) > REMEMBERED:
                    _SHAPES.clear()
                s = _SHAPES[piece] = _shapes(piece)
            shapes += s
    a = np.array(shapes, np.int64)
    out += np.bincount(a, minlength=SLOTS)
    if len(a) > 1:
        out += np.bincount((a[:-1] * 31 + a[1:] * 17 + 5) % SLOTS, minlength=SLOTS)
        out[1] += 3 * sum(map(str.__eq__, w, w[1:]))
    return np.sqrt(out / len(a))


@dataclass
class Scorer:
    """A linear scorer of hashed features; None weights: nothing to learn from."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = float(features(text) @ self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(x: np.ndarray, target: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Scorer:
    """Logistic regression to soft labels by full-batch Adam; both classes weigh the same."""
    if not len(x):
        return Scorer(np.zeros(SLOTS, np.float32), 2.0)
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used].astype(np.float64)
    share = np.clip(target.mean(), 0.02, 0.98)
    weight = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - target) * weight / len(x)
        grad = np.append(x.T @ error + ridge * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w[:-1]
    return Scorer(weights, float(w[-1]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model from all documents, the scorer from about ``sample`` of them."""
    rows = vote_patterns(docs).collect()  # at most 3 ^ heuristics rows
    patterns, counts = np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    labels = fit_labels(patterns, counts)
    rate = min(1.0, sample / max(1.0, counts.sum()))
    # Copies count once, so that the sample neither fills with one text nor depends on the order of tasks.
    chosen = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) or 1)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            codes, at, values = [], [], []
            for text in text_strings(batch.column(0)):
                f = features(text)
                on = np.flatnonzero(f)
                codes.append(pattern(text))
                at.append(on.astype(np.int32))
                values.append(f[on])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["pattern", "at", "values"])

    got = chosen.mapInArrow(run, "pattern long, at array<int>, values array<float>").limit(2 * sample).collect()
    got.sort(key=lambda r: (r["pattern"], r["at"], r["values"]))
    x = np.zeros((len(got), SLOTS), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["values"]
    target = labels.posterior(np.array([r["pattern"] for r in got], np.int64).reshape(-1)) if got else np.zeros(0)
    return labels, fit_scorer(x, target)


def classify(docs: DataFrame, *, sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score (0 to 1) and keep of each document."""
    labels, scorer = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((labels, scorer))  # a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for batch in pieces(batches, 1):
            texts = text_strings(batch.column(1))
            weak = labels.posterior(np.array([pattern(t) for t in texts], np.int64))
            score = np.array([scorer.score(t) for t in texts])
            empty = np.array([not t or t.isspace() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score), pa.array((score >= keep_from) | empty)], ["doc_id", "weak_label", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, weak_label double, score double, keep boolean")


def keep_good(docs: DataFrame, *, sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the scorer rejects."""
    _, scorer = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            good = [not t or t.isspace() or shared.value.score(t) >= keep_from for t in text_strings(batch.column(at))]
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
