"""Language of code-switched text by a linear-chain conditional random field.

Each word of a text is a place of the chain and each learned language a label. A word's score for a label
is the sum of learned weights of its hashed character n-grams with marks at both ends (affixes and
n-grams) and of the word itself (lexicon); learned transitions say how likely a switch is. Forward-backward
gives each word's label probabilities; a document's language is the label with the greatest mean.

Fitting takes a bounded sample of labelled documents and windows of words at places chosen by a hash;
windows of several documents are joined into one chain, so that switches are seen. Prediction covers every
word of every text, in the tasks that read it; nothing is shuffled.

Defined cases: null text, or one without letters, gives ``und`` with score 0; documents with null lang are
not learned from; without any labelled document every text gets ``und``; ties go to the language that
sorts first; a very long text goes through whole, in blocks of the chain; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_strings
from tessera.llm.features import Table, grams, words

#: Labelled documents learned from at most, over all languages (about), windows of a document and words of a window.
SAMPLE, WINDOWS, SPAN = 4000, 2, 32
SIZES, BITS = (1, 2, 3, 4), 16
UNDETERMINED = "und"


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (slots + 1, labels); the last row is nothing
    transitions: np.ndarray  # from, to

    def emissions(self, items: list[str]) -> np.ndarray:
        return self.weights[grams(items, SIZES, BITS)].sum(axis=1)


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of each place of a batch of chains, and the forward and backward messages.

    ``scores`` is (chains, places, labels); ``mask`` marks the places that a chain has, from the first on.
    Messages are scaled to sum to 1 at each place.
    """
    n, places, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    way = np.exp(transitions - transitions.max())
    fore = np.empty((places, n, k), scores.dtype)
    back = np.ones((places, n, k), scores.dtype)
    a = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    fore[0] = a
    for t in range(1, places):
        b = (a @ way) * local[:, t]
        b /= b.sum(axis=1, keepdims=True)
        a = fore[t] = np.where(mask[:, t, None], b, a)
    b = back[places - 1]
    for t in range(places - 2, -1, -1):
        x = (b * local[:, t + 1]) @ way.T
        x /= x.sum(axis=1, keepdims=True)
        b = back[t] = np.where(mask[:, t + 1, None], x, 1.0)
    p = (fore * back).transpose(1, 0, 2)
    p = p / p.sum(axis=2, keepdims=True)
    return p, fore, back


def train(windows: list[tuple[list[str], str]], rounds: int = 4, seed: int = 5) -> Crf:
    """Maximum conditional likelihood by Adam over chains of up to three windows."""
    labels = sorted({lang for _, lang in windows})
    k = len(labels)
    crf = Crf(labels, np.zeros(((1 << BITS) + 1, k), np.float32), np.zeros((k, k), np.float32))
    if not k:
        return crf
    number = {lang: i for i, lang in enumerate(labels)}
    types = {w: i for i, w in enumerate({w: 0 for ws, _ in windows for w in ws})}
    slots = grams(list(types), SIZES, BITS)
    rng = np.random.default_rng(seed)
    w, tr = crf.weights, crf.transitions
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    step, batch = 0, 96
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), batch):
            chains, i = [], begin
            end = min(begin + batch, len(order))
            while i < end:
                take = int(rng.integers(1, 4))
                chains.append([windows[j] for j in order[i : min(i + take, end)]])
                i += take
            longest = max(sum(len(ws) for ws, _ in c) for c in chains)
            at = np.zeros((len(chains), longest), np.int64)
            gold = np.zeros((len(chains), longest), np.int64)
            mask = np.zeros((len(chains), longest), bool)
            for r, c in enumerate(chains):
                p = 0
                for ws, lang in c:
                    at[r, p : p + len(ws)] = [types[x] for x in ws]
                    gold[r, p : p + len(ws)] = number[lang]
                    p += len(ws)
                mask[r, :p] = True
            own, inverse = np.unique(at, return_inverse=True)
            scores = w[slots[own]].sum(axis=1)[inverse.reshape(at.shape)]
            prob, fore, back = forward_backward(scores, mask, tr)
            error = (prob - np.eye(k, dtype=np.float32)[gold]) * mask[:, :, None]
            total = mask.sum()
            of_type = np.zeros((len(own), k), np.float64)
            np.add.at(of_type, inverse.reshape(-1), error.reshape(-1, k))
            flat, count = slots[own].reshape(-1), slots.shape[1]
            g = np.stack([np.bincount(flat, np.repeat(of_type[:, c], count), minlength=len(w)) for c in range(k)], axis=1) / total
            g[-1] = 0
            local = np.exp(scores - scores.max(axis=2, keepdims=True))
            way = np.exp(tr - tr.max())
            pair = fore[:-1][:, :, :, None] * way * (local[:, 1:].transpose(1, 0, 2) * back[1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            both = (mask[:, 1:] & mask[:, :-1]).T[:, :, None, None]
            gt = (pair * both).sum(axis=(0, 1))
            np.subtract.at(gt, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            gt = gt / total + 1e-4 * tr
            step += 1
            for value, grad, m, v, rate in ((w, g, state[0], state[1], 0.05), (tr, gt, state[2], state[3], 0.05)):
                m += 0.1 * (grad - m)
                v += 0.02 * (grad**2 - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return crf


def sample_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[list[str], str]]:
    """Windows of words of about ``sample`` labelled documents, as many of each language as there are."""
    labelled = docs.filter("lang is not null and text is not null").select("text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return []
    quota = max(1, sample // len(counts))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, int(min(1.0, quota / n) * (1 << 20))))]), F.col("lang"))
    # Copies count once, so that the sample neither fills with one text nor depends on the order of tasks.
    chosen = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, langs = [], []
            for text, lang in zip(text_strings(batch.column(0)), batch.column(1).to_pylist()):
                w = words(text)
                if not w:
                    continue
                for i in range(WINDOWS):
                    start = xxhash.xxh32_intdigest(text.encode(), seed=i) % max(1, len(w) - SPAN + 1)
                    out.append(w[start : start + SPAN])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(langs, pa.string())], ["words", "lang"])

    got = chosen.mapInArrow(run, "words array<string>, lang string").limit(2 * sample * WINDOWS).collect()
    return sorted((r["words"], r["lang"]) for r in got)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def chain_probabilities(scores: np.ndarray, lengths: list[int], transitions: np.ndarray, block: int = 64) -> np.ndarray:
    """Label probabilities of chains that follow one another in ``scores`` (words, labels).

    The same as :func:`forward_backward`, for chains of any length at once: chains are cut into blocks, the
    blocks' transfer matrices are multiplied out side by side, messages pass from block to block, and
    each block is then filled in.
    """
    k = scores.shape[1]
    lengths_ = np.array(lengths)
    blocks = -(-lengths_ // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    at = np.arange(len(scores)) + np.repeat(first[:-1] * block - np.concatenate([[0], np.cumsum(lengths_)[:-1]]), lengths_)
    local = np.ones((total * block, k), np.float64)
    local[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros(total * block, bool)
    real[at] = True
    local = np.ascontiguousarray(local.reshape(total, block, k).transpose(1, 0, 2))
    real = np.ascontiguousarray(real.reshape(total, block).T)
    all_real = real.all(axis=1)
    way = np.exp(transitions.astype(np.float64) - transitions.max())
    begins = np.zeros(total, bool)
    begins[first[:-1][lengths_ > 0]] = True

    # What each block does to a message that comes in.
    whole = way[None] * local[0][:, None, :]
    whole[begins] = np.eye(k) * local[0][begins][:, None, :]
    for t in range(1, block):
        x = (whole.reshape(-1, k) @ way).reshape(whole.shape) * local[t][:, None, :]
        x /= x.sum(axis=(1, 2), keepdims=True)
        whole = x if all_real[t] else np.where(real[t][:, None, None], x, whole)

    # Messages into each block, from the left and from the right.
    left = np.ones((total, k))
    right = np.ones((total, k))
    by_size = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max(initial=0))):
        own = by_size[: np.searchsorted(-blocks[by_size], -j, side="left")]
        b = first[own] + j
        left[b] = _scaled(np.matmul(left[b - 1][:, None, :], whole[b - 1])[:, 0])
        c = first[own] + blocks[own] - j
        right[c - 1] = _scaled(np.matmul(whole[c], right[c][:, :, None])[:, :, 0])

    fore = np.empty((block, total, k))
    a = np.where(begins[:, None], local[0], (left @ way) * local[0])
    fore[0] = a = _scaled(a)
    for t in range(1, block):
        x = (a @ way) * local[t]
        x /= x.sum(axis=1, keepdims=True)
        a = fore[t] = x if all_real[t] else np.where(real[t][:, None], x, a)
    out = np.empty((block, total, k))
    b = right
    out[block - 1] = fore[block - 1] * b
    for t in range(block - 2, -1, -1):
        x = (b * local[t + 1]) @ way.T
        x /= x.sum(axis=1, keepdims=True)
        b = x if all_real[t + 1] else np.where(real[t + 1][:, None], x, b)
        np.multiply(fore[t], b, out=out[t])
    out = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(total * block, k)[at]
    return _scaled(out)


def label_words(crf: Crf, table: Table, docs: list[list[str]], chunk: int = 200_000) -> list[np.ndarray]:
    """Label probabilities of each word of each document."""
    rows = table.lookup(docs)
    out: list[np.ndarray] = []
    at = 0
    while at < len(docs):
        end, size = at + 1, len(docs[at])
        while end < len(docs) and size + len(docs[end]) <= chunk:
            size += len(docs[end])
            end += 1
        if size:
            p = chain_probabilities(table.rows[np.concatenate(rows[at:end])], [len(r) for r in rows[at:end]], crf.transitions)
            out += np.split(p, np.cumsum([len(r) for r in rows[at:end]])[:-1])
        else:
            out += [np.zeros((0, len(crf.labels)))] * (end - at)
        at = end
    return out


_TABLES: dict[int, tuple[Crf, Table]] = {}


def _table(number: int, crf: Crf) -> Table:
    """One table of word scores a worker and model: it outlives a task."""
    if number not in _TABLES:
        _TABLES.clear()
        _TABLES[number] = (crf, Table(crf.emissions, len(crf.labels)))
    return _TABLES[number][1]


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred, score and switches (places where the likeliest label changes)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # 2 ^ BITS slots, whatever the corpus
    number = int(np.abs(crf.weights).sum() * 1e4) ^ len(crf.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        table = _table(number, crf)
        for batch in batches:
            langs, scores, switches = [], [], []
            texts = text_strings(batch.column(1))
            for begin in range(0, len(texts), 512):
                docs_words = [words(t) for t in texts[begin : begin + 512]] if crf.labels else [[] for _ in texts[begin : begin + 512]]
                for p in label_words(crf, table, docs_words):
                    if not len(p):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        switches.append(0)
                        continue
                    mean = p.mean(axis=0)
                    best = int(mean.argmax())
                    langs.append(crf.labels[best])
                    scores.append(min(1.0, max(0.0, float(mean[best]))))
                    likeliest = p.argmax(axis=1)
                    switches.append(int((likeliest[1:] != likeliest[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())], ["doc_id", "lang_pred", "score", "switches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, switches long")


def identify(docs: DataFrame, learn_from: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Languages of ``docs`` by a field fitted on ``learn_from`` (text, lang)."""
    return predict(docs, train(sample_windows(learn_from, sample)))
