"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as the sum of learned rows of its hashed character n-grams (character input)
beside a learned row of the word itself (word input). Windows of ``SPAN`` words that overlap cover the
whole text; in each, two gated recurrent passes (left to right, right to left) are pooled by attention
and give a logit. A document's score is its most toxic window's, calibrated on training documents that the
network was not fitted to.

Labels are of documents, windows are what is trained: a toxic document's window is first the one that holds
the n-grams most over-represented in toxic documents, and then the one that the network itself scores
highest; of clean documents random windows and the highest-scoring ones are taken.

Fitting takes a bounded sample of labelled documents; scoring covers every window of every text in the
tasks that read it, with no shuffle. A word's input products are computed once while a bounded table
holds them.

Defined cases: a null text is empty; an empty text or one without letters is one empty window and gets the
least of scores; without labels of both classes every score is 0; a document labelled more than once
counts with each label; a very long text has as many windows as it needs; repeated rows (and ties) get equal
scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_strings
from tessera.llm.features import Table, grams, words

#: Labelled documents of each class that are learned from at most (about).
TOXIC_SAMPLE, CLEAN_SAMPLE = 900, 1800
SPAN, STRIDE = 24, 16
SIZES, BITS, WORD_BITS = (3, 4, 5), 15, 14
CHAR_DIM, WORD_DIM, HIDDEN, ATTEND = 12, 4, 8, 8
DIM = CHAR_DIM + WORD_DIM


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = False

    @staticmethod
    def fresh(seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        n = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        return Network({
            "chars": np.zeros(((1 << BITS) + 1, CHAR_DIM), np.float32),
            "words": np.zeros(((1 << WORD_BITS) + 1, WORD_DIM), np.float32),
            "input": n(DIM, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "state": n(2, HIDDEN, 3 * HIDDEN), "attend": n(2 * HIDDEN, ATTEND), "query": n(ATTEND),
            "out": n(2 * HIDDEN), "out_bias": np.full(1, -1.0, np.float32),
        })

    def embed(self, slots: np.ndarray) -> np.ndarray:
        """Inputs of words from :func:`word_slots`."""
        return np.concatenate([self.p["chars"][slots[:, :-1]].sum(axis=1), self.p["words"][slots[:, -1]]], axis=1)

    def inputs(self, items: list[str]) -> np.ndarray:
        """Input products of words for both directions."""
        return self.embed(word_slots(items)) @ self.p["input"] + self.p["bias"]

    def logits(self, products: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from (windows, SPAN, 6 * HIDDEN) input products; ``keep`` returns what training needs."""
        n, span, h3 = len(products), products.shape[1], 3 * HIDDEN
        state = self.p["state"]
        a = np.empty((span, 2, n, h3), np.float32)
        a[:, 0] = products[:, :, :h3].transpose(1, 0, 2)
        a[:, 1] = products[:, ::-1, h3:].transpose(1, 0, 2)
        m = np.stack([mask.T, mask.T[::-1]], axis=1).astype(np.float32)[..., None]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((span, 2, n, HIDDEN), np.float32)
        kept = []
        for t in range(span):
            g = np.matmul(h, state)
            rz = _sigmoid(a[t, :, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])
            r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
            new = np.tanh(a[t, :, :, 2 * HIDDEN :] + r * g[:, :, 2 * HIDDEN :])
            if keep:
                kept.append((h, r, z, new, g[:, :, 2 * HIDDEN :]))
            h = h + m[t] * (1 - z) * (new - h)
            states[t] = h
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # span, n, 2 * HIDDEN
        hidden = np.tanh(both @ self.p["attend"])
        score = np.where(mask.T, hidden @ self.p["query"], -30.0)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        z = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (z, (m, kept, both, hidden, weight, pooled)) if keep else z

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean cross-entropy, and of the inputs ``x`` (windows, SPAN, DIM)."""
        p, n, span = self.p, len(x), x.shape[1]
        z, (m, kept, both, hidden, weight, pooled) = self.logits(x @ p["input"] + p["bias"], mask, keep=True)
        dz = ((_sigmoid(z) - target) / n).astype(np.float32)
        g = {"out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dpooled = dz[:, None] * p["out"]
        dboth = weight[..., None] * dpooled
        dscore = (dpooled * both).sum(axis=2)
        dscore = weight * (dscore - (weight * dscore).sum(axis=0)) * mask.T
        g["query"] = (hidden * dscore[..., None]).sum(axis=(0, 1))
        dpre = dscore[..., None] * p["query"] * (1 - hidden**2)
        g["attend"] = both.reshape(-1, 2 * HIDDEN).T @ dpre.reshape(-1, ATTEND)
        dboth = dboth + dpre @ p["attend"].T
        dstates = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        da = np.empty((span, 2, n, 3 * HIDDEN), np.float32)
        dstate = np.zeros_like(p["state"])
        for t in range(span - 1, -1, -1):
            h, r, z_, new, gn = kept[t]
            dh = dh + dstates[t]
            step = m[t] * dh
            dnew = step * (1 - z_) * (1 - new**2)
            dz_ = step * (h - new) * z_ * (1 - z_)
            dr = dnew * gn * r * (1 - r)
            da[t] = np.concatenate([dr, dz_, dnew], axis=2)
            dg = np.concatenate([dr, dz_, dnew * r], axis=2)
            dstate += np.matmul(h.transpose(0, 2, 1), dg)
            dh = dh * (1 - m[t]) + step * z_ + np.matmul(dg, p["state"].transpose(0, 2, 1))
        g["state"] = dstate
        dproducts = np.concatenate([da[:, 0].transpose(1, 0, 2), da[::-1, 1].transpose(1, 0, 2)], axis=2)
        g["bias"] = dproducts.sum(axis=(0, 1))
        g["input"] = x.reshape(-1, DIM).T @ dproducts.reshape(-1, 6 * HIDDEN)
        return g, dproducts @ p["input"].T

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logit + self.shift) if self.trained else np.zeros_like(logit)


def word_slots(items: list[str]) -> np.ndarray:
    slots = grams(items, SIZES, BITS)
    if slots.shape[1] == 1:  # no item
        return np.full((len(items), 2), 1 << BITS, np.int32)
    slots[:, -1] >>= BITS - WORD_BITS
    return slots


def windows(n: int) -> np.ndarray:
    """(windows, SPAN) places of the overlapping windows of ``n`` words; -1 beyond the end."""
    starts = np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)
    at = starts[:, None] + np.arange(SPAN)
    return np.where(at < n, at, -1)


def window_logits(net: Network, rows: list[np.ndarray], table: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of all documents, and each window's document."""
    places, owner, begin = [], [], 0
    for d, r in enumerate(rows):
        w = windows(len(r))
        places.append(np.where(w >= 0, w + begin, -1))
        owner.append(np.full(len(w), d))
        begin += len(r)
    places, owner = np.concatenate(places), np.concatenate(owner)
    flat = np.concatenate([*rows, np.zeros(1, np.int32)])
    out = np.empty(len(places), np.float32)
    for i in range(0, len(places), chunk):
        at = places[i : i + chunk]
        out[i : i + chunk] = net.logits(table[flat[at]], at >= 0)
    return out, owner


def document_logits(net: Network, table: Table, docs: list[list[str]]) -> np.ndarray:
    """The greatest logit of each document's windows."""
    rows = table.lookup(docs)
    out = np.full(len(docs), -np.inf, np.float32)
    at = 0
    while at < len(docs):
        end, size = at + 1, len(docs[at])
        while end < len(docs) and size + len(docs[end]) <= 100_000:
            size += len(docs[end])
            end += 1
        z, owner = window_logits(net, rows[at:end], table.rows)
        np.maximum.at(out, owner + at, z)
        at = end
    return out


def _fit_steps(net: Network, slots: np.ndarray, picked: np.ndarray, target: np.ndarray, steps: int, state: dict, rng, learned: dict[str, np.ndarray], batch: int = 128, rate: float = 0.01) -> None:
    """Adam over windows of word types, as many toxic as clean in each batch."""
    one, zero = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
    for _ in range(steps):
        own = np.concatenate([rng.choice(one, batch // 2), rng.choice(zero, batch // 2)])
        at = picked[own]
        mask = at >= 0
        types, inverse = np.unique(np.where(mask, at, 0), return_inverse=True)
        inverse = inverse.reshape(at.shape)
        x = net.embed(slots[types])
        g, dx = net.gradients(x[inverse], mask, target[own].astype(np.float32))
        dtypes = np.zeros((len(types), DIM), np.float32)
        np.add.at(dtypes, inverse[mask], dx[mask])
        chars = slots[types][:, :-1]
        flat = chars.reshape(-1)
        g["chars"] = np.stack([np.bincount(flat, np.repeat(dtypes[:, c], chars.shape[1]), minlength=(1 << BITS) + 1) for c in range(CHAR_DIM)], axis=1)
        g["words"] = np.zeros_like(net.p["words"])
        np.add.at(g["words"], slots[types][:, -1], dtypes[:, CHAR_DIM:])
        for name, use in learned.items():
            g[name] *= use[:, None]
        state["step"] += 1
        t = state["step"]
        for name, grad in g.items():
            m, v = state.setdefault(name, (np.zeros_like(net.p[name]), np.zeros_like(net.p[name])))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            net.p[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def _evidence(seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each slot speaks for class 1 (log-likelihood ratio), and which slots tell the classes apart."""
    p0, p1, p = seen[0] / n[0], seen[1] / n[1], seen.sum(axis=0) / n.sum()
    ratio = seen[1] * np.log((p1 + 1e-9) / (p + 1e-9)) + (n[1] - seen[1]) * np.log((1 - p1 + 1e-9) / (1 - p + 1e-9))
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    useful = (seen.sum(axis=0) >= 3) & (np.abs(z) >= 4)
    useful[-1] = False
    return np.where(p1 > 3 * p0, ratio, 0.0), useful


def train(texts: list[str], labels: list[int], seed: int = 3, steps: tuple[int, int] = (220, 180)) -> Network:
    """A calibrated network from labelled texts."""
    net = Network.fresh(seed)
    label = np.array(labels, np.int64)
    if not len(label) or label.min() == label.max():
        return net
    rng = np.random.default_rng(seed)
    docs = [words(t) for t in texts]
    types = {w: i for i, w in enumerate({w: 0 for d in docs for w in d} or {"": 0})}
    slots = word_slots(list(types))
    ids = [np.array([types[w] for w in d], np.int32) for d in docs]
    fitted = rng.random(len(docs)) < 0.8
    for c in (0, 1):  # both classes on either side
        own = np.flatnonzero(label == c)
        fitted[own[0]] = True
        if len(own) > 1:
            fitted[own[1]] = False

    # In how many documents of each class each n-gram and each word stands: what is as frequent in both is not
    # learned from (its rows stay zero), which keeps a small sample from being learned by heart.
    gram_seen, word_seen = np.zeros((2, (1 << BITS) + 1)), np.zeros((2, (1 << WORD_BITS) + 1))
    for d, y, use in zip(ids, label, fitted):
        if use and len(d):
            own = slots[np.unique(d)]
            gram_seen[y, np.unique(own[:, :-1])] += 1
            word_seen[y, np.unique(own[:, -1])] += 1
    n = np.array([(fitted & (label == c)).sum() for c in (0, 1)])
    evidence, useful = zip(*(_evidence(seen, n) for seen in (gram_seen, word_seen)))
    evidence[0][-1] = 0
    telling = evidence[0][slots[:, :-1]].max(axis=1)
    learned = {"chars": useful[0], "words": useful[1]}

    def pick(score_of) -> tuple[np.ndarray, np.ndarray]:
        out, target = [], []
        for d, y, use, i in zip(ids, label, fitted, range(len(ids))):
            if not use:
                continue
            w = windows(len(d))
            w = np.where(w >= 0, d[np.maximum(w, 0)] if len(d) else 0, -1)
            score = score_of(i, w)
            if y:
                out.append(w[np.argmax(score)])
                target.append(1)
            else:
                for j in {int(np.argmax(score)), *map(int, rng.integers(0, len(w), 3))}:
                    out.append(w[j])
                    target.append(0)
        return np.array(out), np.array(target)

    state: dict = {"step": 0}
    picked, target = pick(lambda i, w: np.where(w >= 0, telling[np.maximum(w, 0)], -9).max(axis=1))
    _fit_steps(net, slots, picked, target, steps[0], state, rng, learned)

    def all_logits() -> list[np.ndarray]:
        products = np.concatenate([net.embed(slots[i : i + 8192]) for i in range(0, len(slots), 8192)]) @ net.p["input"] + net.p["bias"]
        z, owner = window_logits(net, ids, products)
        return np.split(z, np.flatnonzero(np.diff(owner)) + 1)

    z = all_logits()
    again, target_again = pick(lambda i, w: z[i])
    _fit_steps(net, slots, np.concatenate([picked, again]), np.concatenate([target, target_again]), steps[1], state, rng, learned, rate=0.005)
    top = np.array([x.max() for x in all_logits()])
    _calibrate(net, top[~fitted], label[~fitted])
    return net


def _calibrate(net: Network, z: np.ndarray, y: np.ndarray) -> None:
    """The score 0.7 falls where held-back documents are told apart best, in the gap."""
    order = np.argsort(-z)
    z, y = z[order], y[order]
    right = np.concatenate([[0], np.cumsum(np.where(y == 1, 1, -1))])
    best = np.flatnonzero(right == right.max())
    first, last = int(best[0]), int(best[-1])
    high = z[first - 1] if first else z[0] + 1
    low = z[last] if last < len(z) else z[-1] - 1
    cut = 0.6 * high + 0.4 * low
    net.slope = float(np.clip(6 / max(1e-3, z[y == 1].mean() - z[y == 0].mean()), 0.3, 3)) if (y == 1).any() and (y == 0).any() else 1.0
    net.shift = float(np.log(0.7 / 0.3) - net.slope * cut)
    net.trained = True


_TABLES: dict[float, tuple[Network, Table]] = {}


def _table(key: float, net: Network) -> tuple[Network, Table]:
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = (net, Table(net.inputs, 6 * HIDDEN, most=150_000))
    return _TABLES[key]


def sample_labelled(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> list[tuple[str, int]]:
    """Texts and labels of about so many documents of each class, chosen by a hash of doc_id."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    rate = F.when(F.col("toxic") == 1, int(min(1.0, toxic / max(1, n.get(1, 0))) * (1 << 20))).otherwise(int(min(1.0, clean / max(1, n.get(0, 0))) * (1 << 20)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate).limit(2 * (toxic + clean))
    # At most 2 * (toxic + clean) rows of two numbers: a bounded broadcast.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").limit(4 * (toxic + clean)).collect()
    return [(r["text"] or "", r["toxic"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score (0 to 1) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # the tables' sizes are fixed
    key = float(sum(np.abs(p).sum() for p in net.p.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table = _table(key, shared.value)
        for batch in batches:
            texts, out = text_strings(batch.column(1)), []
            for begin in range(0, len(texts), 256):
                out.append(net.probability(document_logits(net, table, [words(t) for t in texts[begin : begin + 256]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a network fitted on ``learn_from`` joined with ``labels``."""
    got = sample_labelled(learn_from, labels)
    return score(docs, train([t for t, _ in got], [y for _, y in got]))
