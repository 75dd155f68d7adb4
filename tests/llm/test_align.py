"""Alignment of two tokenizers against a plain version that encodes whole texts with the libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}

    def one(text):
        """(tokens of both, groups, links) by byte ranges and a check of every two tokens that could meet."""
        none = ([], [], "", [])
        if not text:
            return none
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [(b.id_to_piece(i), b.is_byte(i)) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return none

        def ranges(parts):
            out, at = [], 0
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        ra, rb = ranges(bytes_a), ranges(bytes_b)
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, begin = [], 0
        for end in both:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, ra) if s >= begin and e <= end) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, rb) if s >= begin and e <= end))
            begin = end
        starts = defaultdict(list)  # tokens of B by byte
        for j, (s, e) in enumerate(rb):
            for k in range(s, e):
                starts[k].append(j)
        links = [(i, ids_b[j]) for i, (s, e) in zip(ids_a, ra) for j in sorted({j for k in range(s, e) for j in starts[k]})]
        return ids_a, ids_b, ";".join(groups), links

    return one


def expected(plain, rows):
    done = [(i, *plain(t)) for i, t in rows]
    docs = Counter(p for *_, links in done for p in set(links))
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (a, b), n in docs.items():
        most_a[a], most_b[b] = max(n, most_a[a]), max(n, most_b[b])
    return sorted((
        (
            i, len(a), len(b), g.count("|"), len(links), sum(docs[p] == most_a[p[0]] for p in links), sum(docs[p] == most_b[p[1]] for p in links),
            sum(docs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "", g,
        )
        for i, a, b, g, links in done
    ), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256", "groups"]
ODD = [
    " two  spaces   three", "ends in space ", "  ", " ", "\n", "a\n b", "a\n  b \n\n  c\t d", "tab\tand\r\nline ends;\r\n x", "▁ mark", "a▁b c", " no break   here",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "naïve café Ünïcödé 日本語のテキスト 𓀀 \U0001f600‍\U0001f600", "\u0000nul", "x" * 3000, "don't 'll I'm 12,345.67 a_b", "é ẛ̣ ﬁ Ω", "word " * 400, "\x1c \x1f \x85 　 x",
]


@pytest.mark.parametrize("hot", [1, 40, align.HOT])
def test_as_by_whole_texts(spark, plain, odd_rows, hot):
    rows = [(r[0], (r[1] or "")[:4000] if r[1] is not None else None) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(ODD)]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, keep_groups=True, hot=hot)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == expected(plain, rows)


def test_odd_columns_very_long_text_and_no_rows(spark, plain, odd_docs, odd_rows, no_docs):
    got = align.align(odd_docs, A, B).select(*COLUMNS[:5]).collect()
    want = [(r[0], len(a), len(b), g.count("|"), len(links)) for r in odd_rows for a, b, g, links in [plain(r[1])]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert align.align(no_docs, A, B).isEmpty()


def test_query_on_its_table(spark, plain, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_align(spark, small).select(*COLUMNS[:9]).collect()
    assert sorted(map(tuple, got), key=str) == [w[:9] for w in expected(plain, docs)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e\n\t\r ;)'.,019▁é日𓀀  "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_parts_are_as_whole_texts(plain, text):
    counts, groups, pairs, times = align.aligner(A, B).align(pa.array([text, "plain words", text + " end"], pa.string()))
    for k, t in enumerate([text, "plain words", text + " end"]):
        a, b, g, links = plain(t)
        assert counts[k].tolist() == [len(a), len(b), g.count("|"), len(links)]
        assert groups[k].decode() == g
        wide = len(align.aligner(A, B).b_bytes)
        assert dict(zip(pairs[k].tolist(), times[k].tolist())) == Counter(x * wide + y for x, y in links)


def test_a_full_table_is_begun_again(plain):
    both = align.Aligner(A, B, most=5)
    for text in ("one two three four five six seven", "eight nine ten", "one two"):
        a, b, g, links = plain(text)
        assert both.align(pa.array([text]))[1][0].decode() == g
