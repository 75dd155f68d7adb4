"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers encode the same bytes (a space and the text). A two-pointer merge of the cumulative token ends
walks both sequences once: it emits a *group* wherever both have a token end at the same byte, and a *link* for
each two tokens whose byte ranges overlap. Over the corpus, a pair of ids counts once in each document that
holds it linked; a link is *best* where its pair's count is the highest of its id.

Plan. ``mapInPandas`` encodes and merges whole texts and writes, for each document, the number of links of each
pair. A space after anything but white space is an end of a token for both tokenizers, so what lies between two
of them is merged once a worker while its bounded table holds it, and a text is the sum of its parts. Then Spark
counts pairs with ``groupBy``, and joins counts and each side's maxima back. Maxima are at most one row an id of
a vocabulary and are broadcast. Pairs that stand in at least one of ``HOT`` of all rows are at most ``HOT`` pairs:
these are broadcast, so no key of the shuffled join has a larger share than that. Sums of a document are
pre-aggregated before they are shuffled.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from it, has no tokens (zeros and
empty groups) but keeps its row; special tokens' strings are plain text; repeated rows count as that many
documents; equal counts are all best; very long texts go through in one piece; an empty table gives an empty
result; a null doc_id stays null; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, distinct_words
from tessera.llm.piece_bpe import BYTE, CONTROL, SPACE, read_pieces
from tessera.llm.token_file import _BYTE_SIGNS, _SEEN

#: Pairs that are broadcast, at most: each stands in at least one of so many rows.
HOT = 10_000
#: Parts that a worker remembers, and bytes of text that are merged at a time.
MOST, SLICE = 300_000, 4 << 20
#: Ends of parts: a space after no white space, with something behind it.
_ENDS = re.compile(r"(?<=\S) (?=.)", re.S)


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level token; one that holds other signs (an added token) is its own text."""
    try:
        return bytes(_SIGN_BYTES[c] for c in token)
    except KeyError:
        return token.encode()


_SIGN_BYTES = {chr(b): b for b in _SEEN} | {chr(sign): b for b, sign in _BYTE_SIGNS.items()}


def merged(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """Groups and links of two token sequences over the same bytes, by one walk along both."""
    groups, links = [], []
    i = j = 0
    end_a = end_b = 0
    own_a: list[int] = []
    own_b: list[int] = []
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        links.append((x, y))
        reach_a, reach_b = end_a + a_size[x], end_b + b_size[y]
        if reach_a <= reach_b:
            own_a.append(x)
        if reach_b <= reach_a:
            own_b.append(y)
        if reach_a == reach_b:
            groups.append((own_a, own_b))
            own_a, own_b = [], []
        if reach_a <= reach_b:
            i, end_a = i + 1, reach_a
        if reach_b <= reach_a:
            j, end_b = j + 1, reach_b
    return groups, links


class Aligner:
    """Two tokenizers and what is known of parts of texts: a bounded table of counts, groups and links."""

    def __init__(self, path_a: str, path_b: str, most: int = MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = byte_level_bytes(token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(SPACE, " ").encode() for p, _, kind in read_pieces(path_b)]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.counts = np.zeros((1 << 12, 5), np.int64)  # tokens of both, groups, links, and where the bytes differ
        self.first = np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, parts: int, links: int) -> None:
        while len(self.at) + parts > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + links > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])

    def learn(self, parts: list[str]) -> None:
        """Encode and merge new parts; each stands for a space and itself."""
        wide = len(self.b_bytes)
        encoded_a = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        encoded_b = self.b.encode(parts, num_threads=1)
        for part, x, b in zip(parts, encoded_a, encoded_b):
            a, whole = x.ids, (" " + part).encode()
            row = len(self.at)
            if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
                self._room(1, 0)
                self.counts[row], self.first[row] = (0, 0, 0, 0, 1), self.used
                shown = b""
            elif len(a) == 1 or len(b) == 1:
                self._room(1, len(a) * len(b))
                self.counts[row], self.first[row] = (len(a), len(b), 1, len(a) * len(b), 0), self.used
                self.links[self.used : self.used + len(a) * len(b)] = [i * wide + j for i in a for j in b]
                self.used += len(a) * len(b)
                shown = b"%b|%b" % (",".join(map(str, a)).encode(), ",".join(map(str, b)).encode())
            else:
                groups, links = merged(a, b, self.a_size, self.b_size)
                self._room(1, len(links))
                self.counts[row], self.first[row] = (len(a), len(b), len(groups), len(links), 0), self.used
                self.links[self.used : self.used + len(links)] = [i * wide + j for i, j in links]
                self.used += len(links)
                shown = ";".join([",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups]).encode()
            self.shown.append(shown)
            self.at[part] = row

    def parts(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different parts of texts, the place among them of each part, and the first part of each text."""
        words, places, bounds = distinct_words(pc.split_pattern(texts, " "))
        # Where spaces follow white space, they and what is before them go together.
        open_end = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))
        odd = np.flatnonzero(np.add.reduceat(np.append(open_end[places], False), np.minimum(bounds[:-1], len(places))) * (np.diff(bounds) > 0))
        if not len(odd):
            return words, places, bounds
        lists, sizes = np.split(places, bounds[1:-1]), np.diff(bounds)
        known = {w: i for i, w in enumerate(words)}
        for i in odd.tolist():
            found = _ENDS.split(texts[i].as_py())
            for w in found:
                if w not in known:
                    known[w] = len(known)
            lists[i], sizes[i] = np.fromiter(map(known.__getitem__, found), np.int64, len(found)), len(found)
        return list(known), np.concatenate(lists), np.concatenate([[0], np.cumsum(sizes)])

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[np.ndarray], list[np.ndarray]]:
        """For each text: its counts (tokens of both, groups, links), groups, pairs and how often each is linked."""
        if len(self.at) > self.most:
            self._clear()
        words, places, bounds = self.parts(texts)
        fresh = [w for w in words if w not in self.at]
        for begin in range(0, len(fresh), 10_000):
            self.learn(fresh[begin : begin + 10_000])
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        sums = np.zeros((len(places) + 1, 5), np.int64)
        np.cumsum(self.counts[rows].take(places, axis=0), axis=0, out=sums[1:])
        counts = np.diff(sums[bounds], axis=0)
        none = empty | (counts[:, 4] > 0)
        counts[none] = 0
        shown = [self.shown[i] for i in rows.tolist()]
        if texts.nbytes > 1 << 27:
            groups = [b";".join([shown[i] for i in places[x:y].tolist()]) for x, y in zip(bounds, bounds[1:])]
        else:
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shown, pa.binary()).take(pa.array(places)))
            groups = pc.binary_join(lists, b";").to_pylist()
        groups = [b"" if n else g for n, g in zip(none.tolist(), groups)]
        # The links of each text's parts in turn, counted by text and pair.
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        keep = ~none[owner]
        owner, row = owner[keep], rows.take(places[keep])
        size = self.counts[row, 3]
        ends = np.cumsum(size)
        at = np.repeat(self.first[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        wide = len(self.a_bytes) * len(self.b_bytes)
        held, times = np.unique(np.repeat(owner, size) * wide + self.links.take(at), return_counts=True)
        cuts = np.searchsorted(held, np.arange(1, len(texts)) * wide)
        return counts[:, :4], groups, np.split(held % wide, cuts), np.split(times.astype(np.int32), cuts)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker and pair of files: its table outlives a task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)  # the table holds no cycles
    return _ALIGNERS[path_a, path_b]


_LINKED = "row long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def linked(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """Counts, groups and linked pairs of each document; a pair is a * (number of B's ids) + b."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(path_a, path_b)
        for frame in frames:
            texts = frame["text"].tolist()
            ends = np.cumsum([len(t) for t in texts])
            begin = 0
            while begin < len(texts):  # in runs of bounded size, or one text
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, side="right")))
                counts, groups, pairs, times = both.align(pa.array(texts[begin:end], pa.string()))
                out = frame[["row", "id"]].iloc[begin:end].reset_index(drop=True)
                for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                    out[name] = counts[:, k]
                out["groups_sha256"] = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                out["groups"] = [g.decode() for g in groups] if keep_groups else None
                out["pairs"], out["times"] = pd.Series(pairs, dtype=object), pd.Series(times, dtype=object)
                yield out
                begin = end

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType
    found = rows.mapInPandas(run, _LINKED).withColumn("doc_id", F.col("id").cast(kind)).drop("id")
    return found if keep_groups else found.drop("groups")


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """(pair, a, b, docs, best_a, best_b): in how many documents each pair is linked, and whether that is the most of its ids.

    Counting is pre-aggregated in the tasks; a side's maxima are at most one row an id of its vocabulary.
    """
    counted = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = cut(counted.select("pair", F.expr(f"pair div {wide}").alias("a"), (F.col("pair") % wide).alias("b"), "docs"), "align-counts")
    most = {side: F.broadcast(counts.groupBy(side).agg(F.max("docs").alias(f"most_{side}"))) for side in "ab"}
    best = counts.join(most["a"], "a").join(most["b"], "b")
    return best.select("pair", "a", "b", "docs", *((F.col("docs") == F.col(f"most_{s}")).alias(f"best_{s}") for s in "ab"))


def align(docs: DataFrame, path_a: str, path_b: str, *, keep_groups: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum and groups_sha256 of each document.

    ``keep_groups`` adds the groups themselves: ``a1,a2|b1;a3|b2,b3``.
    """
    found = cut(linked(docs, path_a, path_b, keep_groups), "align-linked")
    wide = len(read_pieces(path_b))
    counts = cut(pair_counts(found, wide), "align-pairs")
    total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
    common = F.col("docs") * hot >= F.lit(total)  # at most ``hot`` pairs
    often = F.broadcast(counts.filter(common).select("pair", "docs", "best_a", "best_b"))
    rows = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    rest = rows.join(often.select("pair"), "pair", "left_anti").join(counts.filter(~common).select("pair", "docs", "best_a", "best_b"), "pair")
    summed = [
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"),
        F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
    ]
    columns = ["row", "times", "docs", "best_a", "best_b"]
    of_row = rows.join(often, "pair").select(*columns).unionByName(rest.select(*columns)).groupBy("row").agg(*summed)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if keep_groups else [])]
    joined = found.select(*kept).join(of_row, "row", "left")
    return joined.select(*kept[1:6], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "n_best_b", "count_sum")), *kept[6:])
