"""Cutting texts into words: what counts as a word, and how fast."""

import re
import sys
from time import perf_counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import features

NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
WORD = re.compile(rf"[^\W\d_{NUMERALS}]{{1,24}}")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab é²½Ⅷ一 _9-𐄇日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_are_runs_of_letters(text):
    assert features.words(text) == WORD.findall(text.lower())


def test_long_runs_and_numerals():
    for text in ("x" * 70, "x" * 30 + "²" + "y" * 25, "² ½", "", "日" * 100 + "½"):
        assert features.words(text) == WORD.findall(text.lower())


def test_ten_megabytes_a_second(spark, medium):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{medium}/documents.parquet").select("text").collect()]
    size = sum(len(t.encode()) for t in texts)
    best = 9e9
    for _ in range(3):
        begin = perf_counter()
        for t in texts:
            features.words(t)
        best = min(best, perf_counter() - begin)
    assert size / best > 10e6
