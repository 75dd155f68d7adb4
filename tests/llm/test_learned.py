"""Learned operators: held-out accuracy, odd rows, empty tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quality, queries, toxicity
from tessera.llm.common import read_table
from tessera.llm.features import grams, words


def test_quality_on_labels(spark, medium):
    got = queries.op6_quality(spark, medium).join(read_table(spark, medium, "labels"), "doc_id").select("keep", "quality").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    got = quality.classify(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and {0, 1, 2} <= {r["doc_id"] for r in kept.collect()}
    assert quality.classify(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_quality_reads_whole_tokens():
    clean = "word" * 12
    junk = "{x}|$9~=" * 40
    assert not np.array_equal(quality.features(clean + clean * 40), quality.features(clean + junk))
    for text in (clean * 20, "a1" * 60):  # long, and many marks
        for at in range(len(text)):
            assert not np.array_equal(quality.features(text[:at] + "$" + text[at + 1 :]), quality.features(text))
    learned = quality.fit_scorer(np.stack([quality.features(f"{clean} {i}" if i % 2 else f"{junk} {i}") for i in range(60)]), np.arange(60) % 2.0)
    assert learned.score(clean * 40) > 0.5 > learned.score(clean + junk * 40)


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.85
    m = len(quality.HEURISTICS)
    votes = np.where(y[:, None], np.where(rng.random((len(y), m)) < 0.99, 2, 0), np.where(rng.random((len(y), m)) < 0.35, 0, 2))
    votes[rng.random(votes.shape) < 0.2] = 1
    codes, counts = np.unique((votes * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1), return_counts=True)
    model = quality.fit_labels(codes, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.03 and np.all(np.abs(model.good[1] - 0.99) < 0.02) and np.all(np.abs(model.good[0] - 0.65) < 0.06)


def _plain_labels(votes, rounds=60):
    """P(good) of each document, one document and one heuristic at a time."""
    m = len(votes[0])
    prior, rates = 0.8, [[0.6] * m, [0.98] * m]
    odds = lambda v: [(1 - prior, prior)[c] * np.prod([rates[c][h] if x > 0 else 1 - rates[c][h] if x < 0 else 1.0 for h, x in enumerate(v)]) for c in (0, 1)]
    for _ in range(rounds):
        p = [b / (a + b) for a, b in map(odds, votes)]
        shares = [[1 - x for x in p], p]
        rates = [
            [
                min(1 - 1e-4, max(1e-4, (sum(s for s, v in zip(shares[c], votes) if v[h] > 0) + (1, 2)[c]) / (sum(s for s, v in zip(shares[c], votes) if v[h]) + (2, 2.02)[c])))
                for h in range(m)
            ]
            for c in (0, 1)
        ]
        prior = min(0.98, max(0.02, sum(p) / len(p)))
    return [b / (a + b) for a, b in map(odds, votes)]


def _plain_features(text):
    """Slot to value, token by token."""
    tokens, shapes, slots = text.split(), [], {}
    for token in tokens:
        for begin in range(0, len(token), quality.PIECE):
            marks = ["X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch for ch in token[begin : begin + quality.PIECE]]
            runs = "".join(k for k, _ in itertools.groupby(marks))
            shapes += [quality._slot(runs[i : i + quality.MARKS]) for i in range(0, len(runs), quality.MARKS)]
    for s in shapes + [(a * 31 + b * 17 + 5) % quality.SLOTS for a, b in zip(shapes, shapes[1:])]:
        slots[s] = slots.get(s, 0) + 1
    if len(shapes) > 1:
        slots[1] = slots.get(1, 0) + 3 * sum(a == b for a, b in zip(tokens, tokens[1:]))
    return {s: math.sqrt(n / len(shapes)) for s, n in slots.items()}


def test_quality_by_brute_force(spark, small):
    docs = read_table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weak = dict(zip(texts, _plain_labels([quality.votes(t) for t in texts.values()])))
    _, scorer = quality.fit(docs)
    got = quality.classify(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        z = sum(v * float(scorer.weights[s]) for s, v in _plain_features(texts[r["doc_id"]]).items()) + scorer.bias
        assert abs(r["weak_label"] - weak[r["doc_id"]]) < 1e-6
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4
        assert r["keep"] == (r["score"] >= 0.5 or not texts[r["doc_id"]].split())


def test_samples_take_copies_once(spark):
    rows = [(i, f"the report of week {i % 9} is on the table and we read it" if i % 3 else "one text of very many copies, all of them equal", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = quality.fit(docs, 400)[1]
    two = quality.fit(docs.repartition(7).orderBy(F.desc("doc_id")), 400)[1]
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    found = language.sample_windows(docs)
    assert found == language.sample_windows(docs.repartition(7)) and len(found) == 7 * language.WINDOWS


def _plain_toxicity(net, text):
    """The network in one word, one window and one direction at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p = {k: x.astype(np.float64) for k, x in net.p.items()}
    w, h3, starts, best = words(text), 3 * toxicity.HIDDEN, [0], -math.inf
    while starts[-1] + toxicity.SPAN < len(w):
        starts.append(starts[-1] + toxicity.STRIDE)
    for start in starts:
        part = w[start : start + toxicity.SPAN]
        states = []
        for way in (0, 1):
            h, out = np.zeros(toxicity.HIDDEN), {}
            for i in range(len(part))[:: 1 - 2 * way]:
                a, g = net.inputs([part[i]])[0][way * h3 : (way + 1) * h3].astype(np.float64), h @ p["state"][way]
                reset, update, new = np.split(a, 3)[0] + np.split(g, 3)[0], np.split(a, 3)[1] + np.split(g, 3)[1], np.split(a, 3)[2]
                h = h + (1 - sigmoid(update)) * (np.tanh(new + sigmoid(reset) * np.split(g, 3)[2]) - h)
                out[i] = h
            states.append(out)
        both = [np.concatenate([states[0][i], states[1][i]]) for i in range(len(part))]
        weights = np.array([math.exp(np.tanh(b @ p["attend"]) @ p["query"]) for b in both])
        pooled = sum((x * b for x, b in zip(weights / weights.sum(), both)), np.zeros(2 * toxicity.HIDDEN)) if both else np.zeros(2 * toxicity.HIDDEN)
        best = max(best, pooled @ p["out"] + p["out_bias"][0])
    return sigmoid(net.slope * best + net.shift)


def test_toxicity_by_brute_force(spark):
    rng = np.random.default_rng(7)
    net = toxicity.Network.fresh(5)
    for name in ("chars", "words"):
        net.p[name][:-1] = rng.standard_normal(net.p[name][:-1].shape) * 0.3
    net.slope, net.shift, net.trained = 1.3, 0.2, True
    lexicon = ["you", "are", "an", "awful", "person", "und", "der", "é日本", "x" * 30, "ok"]
    texts = [" ".join(rng.choice(lexicon, n)) for n in (0, 1, 2, 23, 24, 25, 40, 41, 130)] + [None, "12 !!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert abs(got[i] - _plain_toxicity(net, text or "")) < 1e-4, text


def test_toxicity_held_out(spark, medium):
    got = queries.op7_toxicity(spark, medium).join(read_table(spark, medium, "labels"), "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in got]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert np.mean(right) > 0.9 and np.mean(clean) < 0.03


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (7, 1, 0), (9, 0, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd_docs, odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in toxicity.classify(odd_docs, odd_docs, labels.limit(0)).collect())
    assert toxicity.classify(no_docs, odd_docs, labels).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    x, mask = rng.standard_normal((3, 5, toxicity.DIM)), np.arange(5)[None, :] < np.array([[5], [3], [1]])
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(x @ net.p["input"] + net.p["bias"], mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target)))

    grads, dx = net.gradients(x, mask, target)
    for name in ("input", "bias", "state", "attend", "query", "out", "out_bias"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        keep = net.p[name][at]
        values = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = keep + step
            values.append(loss())
        net.p[name][at] = keep
        assert abs((values[0] - values[1]) / 2e-2 - grads[name][at]) < 2e-3, name
    assert np.all(dx[1, 3:] == 0)


def test_windows_cover_all_words():
    for n in (0, 1, 24, 25, 40, 41, 1000):
        w = toxicity.windows(n)
        assert set(w[w >= 0]) == set(range(n)) and len(w) >= 1


def test_language_held_out(spark, medium):
    got = queries.op8_language(spark, medium).join(read_table(spark, medium, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in language.identify(odd_docs, odd_docs).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0 and got[4]["lang_pred"] == "en"
    assert all(r["lang_pred"] == "und" for r in language.identify(odd_docs, no_docs).collect()) and language.identify(no_docs, odd_docs).count() == 0


@pytest.mark.parametrize("lengths", [[1, 5, 64, 65, 200, 0, 128, 3], [0, 700], [64], [0]])
def test_blocks_give_the_chain_probabilities(lengths):
    rng = np.random.default_rng(2)
    scores, way = rng.standard_normal((sum(lengths), 4)) * 2, rng.standard_normal((4, 4)) * 1.5
    got, at = language.chain_probabilities(scores, lengths, way), 0
    for n in lengths:
        if n:
            want, _, _ = language.forward_backward(scores[None, at : at + n], np.ones((1, n), bool), way)
            assert np.allclose(want[0], got[at : at + n], atol=1e-9)
        at += n


def test_chain_probabilities_are_sums_over_all_paths():
    rng = np.random.default_rng(3)
    s, way = rng.standard_normal((1, 4, 3)), rng.standard_normal((3, 3))
    p, _, _ = language.forward_backward(s, np.ones((1, 4), bool), way)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(s[0, i, y] for i, y in enumerate(path)) + sum(way[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(p[0], want / want.sum(axis=1, keepdims=True))


def test_grams_do_not_depend_on_company():
    alone, together = grams(["ab"], (2, 3), 12), grams(["ab", "abcdefgh"], (2, 3), 12)
    assert set(alone[0]) - {1 << 12} == set(together[0]) - {1 << 12}


def test_switches_are_seen(spark):
    rows = [(i, ("der und die ist nicht " if i % 2 else "the and of this with ") * 12, "de" if i % 2 else "en") for i in range(80)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, "the and of this with the and " * 3 + "der und die ist nicht die der " * 2)], "doc_id long, text string")
    r = language.identify(mixed, learn).first()
    assert r["lang_pred"] == "en" and r["switches"] >= 1 and F is not None
